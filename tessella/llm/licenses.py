"""License scans by canonical digest.

A text is normalised (case, punctuation, white space, list marks, copyright lines, equivalent spellings) and the digest
of the whole of it is hash-joined to the digests of known licences, to which a caller can add a table of texts. Every line that speaks of licences is looked up in the
same way among the known notices, so that a notice inside a larger text is found too.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fresh, utf8

#: Spellings that count as the same, after punctuation is gone.
EQUIVALENT = {
    b"licence": b"license", b"licences": b"licenses", b"licenced": b"licensed", b"sublicence": b"sublicense", b"sublicences": b"sublicenses", b"sublicenced": b"sublicensed", b"licencee": b"licensee", b"licencees": b"licensees", b"licencor": b"licensor", b"relicence": b"relicense", b"acknowledgement": b"acknowledgment",
    b"analogue": b"analog", b"analyse": b"analyze", b"artefact": b"artifact", b"authorisation": b"authorization", b"authorised": b"authorized", b"calibre": b"caliber",
    b"cancelled": b"canceled", b"capitalisations": b"capitalizations", b"catalogue": b"catalog", b"categorise": b"categorize", b"centre": b"center", b"emphasised": b"emphasized",
    b"favour": b"favor", b"favourite": b"favorite", b"fulfil": b"fulfill", b"fulfilment": b"fulfillment", b"initialise": b"initialize", b"judgement": b"judgment",
    b"labelling": b"labeling", b"labour": b"labor", b"maximise": b"maximize", b"modelled": b"modeled", b"modelling": b"modeling", b"offence": b"offense", b"optimise": b"optimize",
    b"organisation": b"organization", b"organise": b"organize", b"practise": b"practice", b"programme": b"program", b"realise": b"realize", b"recognise": b"recognize",
    b"signalling": b"signaling", b"utilisation": b"utilization", b"whilst": b"while", b"wilful": b"willful", b"https": b"http", b"owner": b"holder", b"owners": b"holders",
    b"noninfringement": b"noninfringement", b"cc": b"creativecommons",
}
#: Punctuation within a word is dropped, so that sub-license is sublicense; all other ASCII that isn't a letter or digit separates.
JOINS = b"-'`_"
SEPARATES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
FOREIGN = ((b"\xe2\x80\x9c", b'"'), (b"\xe2\x80\x9d", b'"'), (b"\xe2\x80\x98", b"'"), (b"\xe2\x80\x99", b"'"), (b"\xe2\x80\x90", b"-"), (b"\xe2\x80\x91", b"-"), (b"\xe2\x80\x93", b"-"), (b"\xe2\x80\x94", b" "), (b"\xc2\xa0", b" "))
#: Lines of copyright, and marks of list items and comments, as regular expressions that SQL engines know too.
COPYRIGHT_LINE = r"(?im)^[ \t\r\f\v#*/;%.\-]*(?:(?:copyright\b|\(c\)|©)[^\n]*(?:\d{4}|\(c\)|©|<|\[)[^\n]*|all rights reserved[.! \t\r\f\v]*)$"
LIST_ITEM = r"(?m)^[ \t]*(?:[#*/;%]+|\(?(?:\d{1,2}|[a-hA-H]|[ivxIVX]{1,4})[.)]|(?:[-+o]|•)+)[ \t]+"
COPYRIGHT, LIST_MARK = (re.compile(x.encode()) for x in (COPYRIGHT_LINE, LIST_ITEM))
#: Every known notice has one of these; asserted below.
TRIGGERS = (b"licen", b"spdx", b"public domain", b"cc by", b"cc0", b"creative commons")


def canonical(raw: bytes) -> bytes:
    """The normal form of a text."""
    for a, b in FOREIGN:
        if a in raw:
            raw = raw.replace(a, b)
    raw = LIST_MARK.sub(b"", COPYRIGHT.sub(b"", raw))
    get = EQUIVALENT.get
    return b" ".join([get(w, w) for w in raw.translate(SEPARATES, JOINS).split()])


def digest(raw: bytes) -> bytes:
    return hashlib.md5(canonical(raw), usedforsecurity=False).digest()


def notices(raw: bytes) -> list[bytes]:
    """Digests of the lines that speak of licences, in order."""
    low = raw.lower()
    if not any(t in low for t in TRIGGERS):
        return []
    return [digest(x) for x, y in zip(raw.split(b"\n"), low.split(b"\n")) if any(t in y for t in TRIGGERS)]


_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n' + _AS_IS
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n' + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_WTFPL = "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."

#: Whole texts.
TEXTS = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT],
    "BSD-2-Clause": [_BSD + _BSD_TAIL, "BSD 2-Clause License\n\n" + _BSD + _BSD_TAIL],
    "BSD-3-Clause": [_BSD + _BSD3 + _BSD_TAIL, "BSD 3-Clause License\n\n" + _BSD + _BSD3 + _BSD_TAIL],
    "ISC": [_ISC + _ISC_TAIL, "ISC License\n\n" + _ISC + _ISC_TAIL],
    "0BSD": [_ISC.partition(", provided")[0] + ".\n\n" + _ISC_TAIL, "BSD Zero Clause License\n\n" + _ISC.partition(", provided")[0] + ".\n\n" + _ISC_TAIL],
    "Zlib": [_ZLIB, "zlib License\n\n" + _ZLIB],
    "Unlicense": [_UNLICENSE, _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"],
    "WTFPL": [_WTFPL],
    "Apache-2.0": [_APACHE],
}
_NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
}
_VERBS = ("Licensed under {}", "Licensed under a {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This work is licensed under a {}", "This software is licensed under {}", "This project is licensed under {}", "This file is licensed under {}")
#: Notices of one line.
NOTICES = {k: [v.format(a + n) for n in names for v in _VERBS for a in ("", "the ", "terms of the ", "the terms of the ") if not (" a {" in v and a)] + ([n for n in names if "icense" in n]) + [f"SPDX-License-Identifier: {k}"] for k, names in _NAMES.items()}


#: Digests of long licences, whose texts aren't kept here: the whole text as its publisher gives it.
LONG = {
    "479bd977d91dc2fa5e526e442ea22f02": "Apache-2.0",
    "ed0f0b6358a0b4487d095802293c6f8b": "Artistic-1.0-Perl",
    "669fb5c886d64c4af4448ac0f6641673": "BSD-3-Clause",
    "d7f3e9d4f115e1504ce6b5f89251f020": "CC0-1.0",
    "fe0bcbad7dbc250833793599b06562da": "GFDL-1.2",
    "6cbb92ad941e804833390437ab8cec41": "GFDL-1.3",
    "8795abf07b04c08bd2f0c1e5758de877": "GPL-1.0",
    "8ef1b6fe95d51f64f08183cc3bc4e4e2": "GPL-2.0",
    "204b371d52482d97deb81209976d2b1f": "GPL-3.0",
    "2aca20ce615f2966c6358be810676d16": "LGPL-2.0",
    "fe0f7e30ebb6e2589e73d5f5df5d5f87": "LGPL-2.1",
    "a0778154969eda294c2e16bc2eccbe82": "LGPL-3.0",
    "2ac462a9e1f71b5c0a4d857d84a052f5": "MPL-1.1",
    "96a946b8b3c959927a963b3b2bdc7eae": "MPL-2.0",
}


def known() -> dict[bytes, str]:
    """Digest and name of each known text and notice: a fixed list of some hundred rows."""
    short = {digest(t.encode()): k for table in (NOTICES, TEXTS) for k, texts in table.items() for t in texts}
    return short | {bytes.fromhex(d): k for d, k in LONG.items()}


def scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``docs`` with a struct column license (digest, name, notices); an underscore is appended where that name is taken.

    name is the licence whose text the whole text is, else null: one of ``known``, or of the texts of ``more`` (name, text), of which
    the first by name counts where texts are equal. notices are the licences named by its lines, each once, sorted. A null
    text counts as empty, which is no licence, in ``more`` too. Every row is kept, repeated ones as well.
    """
    assert all(any(t in n.lower().encode() for t in TRIGGERS) for names in NOTICES.values() for n in names)
    names = known()

    @arrow_udf("struct<digest: binary, notices: array<string>>")
    def digests(text: pa.Array) -> pa.Array:
        raw = utf8(text)
        lines = [sorted({names[x] for x in notices(y) if x in names}) for y in raw]
        return pa.StructArray.from_arrays([pa.array([digest(x) for x in raw], pa.binary()), pa.array(lines, pa.list_(pa.string()))], ["digest", "notices"])

    spark = docs.sparkSession
    k, n, d = fresh(docs, "license_digest"), fresh(docs, "license_name"), fresh(docs, "license_digests")
    table = F.broadcast(spark.createDataFrame([(bytearray(a), b) for a, b in sorted(names.items())], f"{k} binary, {n} string"))  # the fixed list above
    if more is not None:
        own = more.select(F.col("name").cast("string").alias(n), digests.asNondeterministic()(F.col("text").cast("string")).alias("d")).select(F.col("d.digest").alias(k), n)
        own = own.where((F.col(k) != F.lit(digest(b""))) & F.col(n).isNotNull()).groupBy(k).agg(F.min(n).alias(n))
        table = own.unionByName(table.join(own, k, "left_anti"))
    met = docs.withColumn(d, digests.asNondeterministic()(F.col("text").cast("string"))).join(table, F.col(f"{d}.digest") == F.col(k), "left")
    made = F.struct(F.lower(F.hex(f"{d}.digest")).alias("digest"), F.col(n).alias("name"), F.col(f"{d}.notices").alias("notices"))
    return met.select(*[docs[c] for c in docs.columns], made.alias(fresh(docs, "license")))
