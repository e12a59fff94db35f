"""Benchmark decontamination by template windows.

A text becomes a sequence of tokens: lower-cased words without punctuation, or typed placeholders for numbers, units
after a number, names (capitalised within a sentence) and capitalised sentence openers; windows with names or openers are also
taken with those as plain words, so a change of case hides nothing. A window that has too few literal words is widened
until it has enough, up to ``WIDEST`` tokens; if numbers and units alone make them too few, it is also taken
with its values as they stand, so an item of three tokens or more has a window whatever it is made of. Windows of ``WINDOW`` tokens
are hashed and joined to those of the benchmark's items; items of fewer tokens are one window. An item of one or two tokens
says nothing within a text: it is found where it is the whole text. A window without slots,
or with the item's own values in them, is a leak by itself. Any other must be consistent along its alignment
of document and item: every value of the item in it stands for one value of the document
and the other way round. So a question with other numbers or names is caught, and chance agreement of templates isn't.

A bitmap of the benchmark's hashes (at most 32 MiB, whatever the benchmark's size) keeps other windows out of the join;
the join itself compares whole templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, utf8

WINDOW = 8
#: Literal words that a window needs: templates of placeholders alone say nothing.
LITERAL = 5
#: Tokens of the widest window, and of the shortest within a text.
WIDEST, LEAST = 32, 3
#: Forms of a window: with placeholders, with names and openers as plain words, with every value as it stands.
TYPED, PLAIN, EXACT = 0, 1, 2
MAX_BITS = 28

NUM, UNIT, NAME, OPEN = 1, 2, 3, 4
MARKS = {NUM: "<num>", UNIT: "<unit>", NAME: "<name>", OPEN: "<open>"}
NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*%?")
FUSED = re.compile(r"([+\-]?[$€£]?\d[\d.,:/]*)([^\W\d_]{1,6})")
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces pound pounds ton tons ml cl l liter liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years mph kmh dollar dollars cent cents euro euros percent degree degrees meter meters metre metres centimeters centimetres kilometers kilometres gram grams kilogram kilograms".split())
SPELLED = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand".split())
ENDS = (".", "!", "?", ":")
CACHE = 1 << 19
SLAB = 1 << 17

U = np.uint64
POWERS = [U(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WIDEST)]


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def _mark_hash(kind: int) -> int:
    return xxhash.xxh3_64_intdigest(MARKS[kind].encode())


def values(word: str) -> tuple[str, str]:
    """What stands in the slot of a word, and in the second if the word is a number with its unit."""
    core = word.strip("".join({c for c in word if not c.isalnum()})).lower()
    fused = FUSED.fullmatch(core)
    return (fused[1], fused[2]) if fused and fused[2] in UNITS else (core, "")


class Words(dict):
    """Numbers of raw words, each of which is analysed once. ``meta`` and ``hash`` hold, by number, what its tokens are."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple] = []  # those that aren't in the arrays yet
        self.meta = np.zeros((0, 5), np.uint8)  # tokens, ends a sentence, is capitalised, kinds of both tokens
        self.hash = np.zeros((0, 3), np.uint64)  # of both tokens, and of the first one's value

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        core = word.rstrip(",.;:!?")
        if core.isalpha() and (low := core.lower()) not in SPELLED:  # the common case of what follows
            self[raw] = at = len(self)
            self.rows.append((1, word[-1] in ENDS, core[0].isupper(), 5 if low in UNITS else 0, xxhash.xxh3_64_intdigest(low.encode()), 0, 0))
            return at
        ends = word.rstrip("\"')]}»”’").endswith(ENDS)
        core = word.strip("".join({c for c in word if not c.isalnum() and c not in "$€£%+-"})).rstrip(".,:/+-$€£").lstrip("%.,:/")
        fused = FUSED.fullmatch(core)
        # count of tokens, whether a sentence ends, whether it is capitalised, kinds and hashes of the tokens
        if fused and fused[2].lower() in UNITS:
            row = (2, ends, 0, NUM, _mark_hash(NUM), 5, xxhash.xxh3_64_intdigest(fused[2].lower().encode()))
        elif NUMBER.fullmatch(core) or core.lower() in SPELLED:
            row = (1, ends, 0, NUM, _mark_hash(NUM), 0, 0)
        else:
            plain = "".join(c for c in core if c.isalnum())
            if not plain:
                row = (0, ends, 0, 0, 0, 0, 0)
            else:
                low = plain.lower()
                row = (1, ends, plain[0].isupper(), 5 if low in UNITS else 0, xxhash.xxh3_64_intdigest(low.encode()), 0, 0)
        if row[3] == NUM:
            row = (*row, xxhash.xxh3_64_intdigest(values(word)[0].encode()))
        self[raw] = at = len(self)
        self.rows.append(row)
        return at

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
            self.__init__()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.rows:
            self.meta = np.concatenate((self.meta, np.array([(r[0], r[1], r[2], r[3], r[5]) for r in self.rows], np.uint8)))
            self.hash = np.concatenate((self.hash, np.array([(r[4], r[6], r[7] if len(r) > 7 else r[4]) for r in self.rows], np.uint64)))
            self.rows = []
        return out


    def tokens(self, words: list[bytes]) -> np.ndarray:
        """How many tokens each word has."""
        out = np.empty(len(words), np.int64)
        for at in range(0, len(words), SLAB):
            some = words[at : at + SLAB]
            code = self.codes(some)  # which may replace meta
            out[at : at + len(some)] = self.meta[code, 0]
        return out


_words = Words()


def vocabulary() -> Words:
    """The words of this worker, which its tasks share."""
    return _words


def literal(word: bytes) -> str:
    return "".join(c for c in word.decode("utf-8", "replace").lower() if c.isalnum())


def split(raw: bytes) -> list[bytes]:
    """Words; a line break ends a sentence."""
    return raw.replace(b"\n", b" . ").split()


class Tokens:
    """Tokens of several texts one after another: hash, kind, word, text."""

    def __init__(self, texts: list[list[bytes]], vocab: Words) -> None:
        self.words = [w for t in texts for w in t]
        size = np.array([len(t) for t in texts], np.int64)
        code = vocab.codes(self.words)
        meta, value = vocab.meta[code], vocab.hash[:, 0][code]
        text = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        first = np.ones(len(code), bool)
        if len(code):
            first[1:] = (meta[:-1, 1] > 0) | (text[1:] != text[:-1])
        self.word = np.repeat(np.arange(len(code)), meta[:, 0])
        second = np.zeros(len(self.word), bool)
        second[1:] = self.word[1:] == self.word[:-1]
        kind, self.hash, cap = meta[self.word, 3], value[self.word], meta[self.word, 2] > 0
        if second.any():
            kind[second], self.hash[second] = meta[self.word[second], 4], vocab.hash[code[self.word[second]], 1]
        cap &= (kind == 0) | (kind == 5)
        kind[cap] = np.where(first[self.word[cap]], OPEN, NAME)
        after = np.zeros(len(kind), bool)
        after[1:] = kind[:-1] == NUM
        units = kind == 5
        kind[units] = np.where(after[units], UNIT, 0)
        for k in (NUM, UNIT):
            self.hash[kind == k] = U(_mark_hash(k))
        self.plain = self.hash.copy()
        for k in (NAME, OPEN):
            self.hash[kind == k] = U(_mark_hash(k))
        self.kind, self.second, self.text = kind, second, text[self.word]
        self.code, self.table = code, vocab.hash

    def windows(self, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Form, starts, sizes and hashes of the windows within one text. PLAIN ones are those that have names or openers, EXACT ones those that lack literal words even so."""
        m = len(self.hash) - width + 1
        if m <= 0:
            return
        if width < LEAST:  # whole texts
            first, count = np.unique(self.text, return_index=True, return_counts=True)[1:]
            at = first[count == width]
            yield EXACT, at, np.full(len(at), width), self._exact(at, width)
            return
        least = LITERAL if width == WINDOW else max(3, width - 3)
        whole = self.text[width - 1 :] == self.text[:m]
        cap = self.kind >= NAME
        caps = np.concatenate(([0], np.cumsum(cap, dtype=np.int32)))
        for form, x, word in ((TYPED, self.hash, self.kind == 0), (PLAIN, self.plain, (self.kind == 0) | cap)):
            if width == WINDOW == 8:  # pairs, fours, eights
                h = x
                for k in (1, 2, 4):
                    h = h[:-k] + h[k:] * POWERS[k]
            else:
                h = np.zeros(m, np.uint64)
                for k in range(width):
                    h += x[k : k + m] * POWERS[k]
            sums = np.concatenate(([0], np.cumsum(word, dtype=np.int32)))
            ok = whole & (sums[width:] - sums[:m] >= least)
            few = np.flatnonzero(whole & ~ok)
            if form == PLAIN:
                ok &= caps[width:] > caps[:m]
            at = np.flatnonzero(ok)
            yield form, at, np.full(len(at), width), _stirred(h[at])
            if width == WINDOW and len(few):
                last = np.append(np.flatnonzero(word), np.full(LITERAL, len(word) + WIDEST))  # the LITERALth word ends the window
                size = last[sums[few] + LITERAL - 1] + 1 - few
                fits = size <= WIDEST
                wide, size = few[fits], size[fits]
                fits = self.text[wide + size - 1] == self.text[wide]
                if form == PLAIN:
                    fits &= caps[wide + size] > caps[wide]
                wide, size = wide[fits], size[fits]
                if len(wide):
                    v, open_ = h[wide], np.arange(len(wide))
                    for k in range(WINDOW, int(size.max())):
                        open_ = open_[size[open_] > k]
                        v[open_] += x[wide[open_] + k] * POWERS[k]
                    yield form, wide, size, _stirred(v)
            if form == PLAIN and len(few):
                yield EXACT, few, np.full(len(few), width), self._exact(few, width)

    def _exact(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hashes of windows with every value as it stands."""
        v = np.zeros(len(at), np.uint64)
        for k in range(width):
            t = at + k
            c = self.code[self.word[t]]
            v += np.where(self.second[t], self.table[c, 1], self.table[c, 2]) * POWERS[k]
        return _stirred(v ^ U(_mark_hash(UNIT)))

    def value(self, k: int) -> str:
        """What stands in a slot."""
        return values(self.words[self.word[k]].decode("utf-8", "replace"))[int(self.second[k])]

    def template(self, at: int, width: int, form: int) -> tuple[str, list[str]]:
        """The template, and the slots' values with their types."""
        out, slots = [], []
        if form == EXACT:
            each = ((k, self.kind[k] in (NUM, UNIT) or self.second[k]) for k in range(at, at + width))
            return "= " + " ".join(self.value(k) if slot else literal(self.words[self.word[k]]) for k, slot in each), slots
        for k in range(at, at + width):
            kind = int(self.kind[k])
            if kind and not (form == PLAIN and kind >= NAME):
                mark = MARKS[kind]
                out.append(mark)
                slots.append(mark + self.value(k))
            else:
                out.append(self.value(k) if self.second[k] else literal(self.words[self.word[k]]))
        return " ".join(out), slots


@dataclass
class Piece:
    """Words of a text from ``start`` on, of which windows that begin at ``own`` to ``end`` count here; the others give them their surroundings."""

    row: int
    words: list[bytes]
    start: int
    own: int
    end: int
    whole: bool


def pieces(row: int, words: list[bytes], vocab: Words) -> Iterator[Piece]:
    """A text, in pieces of SLAB words if it is longer. Each window is in one piece only, and is what it is in the whole text."""
    if len(words) <= SLAB:
        yield Piece(row, words, 0, 0, len(words), True)
        return
    count = vocab.tokens(words)
    before = np.concatenate(([0], np.cumsum(count)))
    for own in range(0, len(words), SLAB):
        end = min(own + SLAB, len(words))
        # back to a word that has tokens, on to the word that ends the widest window
        start = max(min(own - 1, int(np.searchsorted(before, before[own], "left")) - 1), 0)
        stop = min(int(np.searchsorted(before, before[end] + WIDEST, "left")) + 1, len(words))
        yield Piece(row, words[start:stop], start, own, end, False)


def slabs(texts: list[bytes], vocab: Words) -> Iterator[list[Piece]]:
    """Texts in runs of about SLAB words."""
    held, size = [], 0
    for k, raw in enumerate(texts):
        for piece in pieces(k, split(raw), vocab):
            held.append(piece)
            size += len(piece.words)
            if size >= SLAB:
                yield held
                held, size = [], 0
    if held:
        yield held


def _bits(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> U(64 - k)).astype(np.int64), (h & U((1 << k) - 1)).astype(np.int64)


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """(hash, item_id, pos, width, template, slots) of every window of every item; an item without tokens has none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary()
        for batch in batches:
            ids, rows = batch.column("item_id").to_pylist(), []
            for item, raw in zip(ids, utf8(batch.column("text"))):
                t = Tokens([split(raw)], vocab)
                width = min(WINDOW, len(t.hash))
                for form, at, n, h in ((f, *x) for f, *some in t.windows(width) for x in zip(*(y.tolist() for y in some))):
                    template, slots = t.template(at, n, form)
                    rows.append((np.uint64(h).astype(np.int64).item(), item, at, width, template, slots))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(KINDS)], names=["hash", "item_id", "pos", "width", "template", "slots"])

    return bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, "hash long, item_id long, pos long, width int, template string, slots array<string>")


KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())]


def bitmap(windows: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """The bitmap, its bits' logarithm and the widths of windows that there are. It comes to the driver as blocks of 64 KiB, 512 at most."""
    n, widths = windows.agg(F.count("*"), F.collect_set("width")).first()
    k = min(MAX_BITS, max(19, (512 * max(n, 1) - 1).bit_length()))
    at = windows.select(F.explode(F.array(F.shiftrightunsigned("hash", 64 - k), F.col("hash").bitwiseAND(F.lit((1 << k) - 1)))).alias("p")).distinct()

    def block(table: pa.Table) -> pa.Table:
        p = table.column("p").to_numpy()
        bits = np.zeros(1 << 19, np.uint8)
        bits[p & ((1 << 19) - 1)] = 1
        return pa.table({"b": pa.array([int(p[0]) >> 19], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (k - 3), np.uint8)
    for b, bits in at.withColumn("b", F.shiftright("p", 19)).groupBy("b").applyInArrow(block, "b long, bits binary").collect():
        out[b << 16 : (b + 1) << 16] = np.frombuffer(bits, np.uint8)
    return out, k, sorted(widths)


def document_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(d, x, hash, pos, template, slots) of the documents' windows that the bitmap lets through; d is the doc_id and x a hash of the text."""
    bits, k_bits, widths = bitmap(windows)
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 32 MiB at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, shared_bits = vocabulary(), shared.value
        for batch in batches:
            ids, keys, rows = batch.column("d"), batch.column("x"), []
            past: dict[int, int] = {}  # tokens of a text before the words that the next piece owns
            for held_pieces in slabs(utf8(batch.column("text")), vocab):
                t = Tokens([x.words for x in held_pieces], vocab)
                sizes = np.array([len(x.words) for x in held_pieces])
                base = np.cumsum(sizes) - sizes
                own = base + np.array([x.own - x.start for x in held_pieces])
                end = base + np.array([x.end - x.start for x in held_pieces])
                first, last = np.searchsorted(t.word, own), np.searchsorted(t.word, end)
                offset = np.zeros(len(held_pieces), np.int64)
                for k, x in enumerate(held_pieces):
                    offset[k] = past.get(x.row, 0) - first[k]
                    past[x.row] = past.get(x.row, 0) + int(last[k] - first[k])
                whole = np.array([x.whole for x in held_pieces])
                for width, (form, at, n, h) in ((w, x) for w in widths for x in t.windows(w)):
                    p, q = _bits(h, k_bits)
                    hit = np.flatnonzero((shared_bits[p >> 3] >> (p & 7).astype(np.uint8)) & (shared_bits[q >> 3] >> (q & 7).astype(np.uint8)) & 1)
                    piece = t.text[at[hit]]
                    mine = (at[hit] >= first[piece]) & (at[hit] < last[piece])
                    if width < LEAST:
                        mine &= whole[piece]
                    hit, piece = hit[mine], piece[mine]
                    for a, size, v, k in zip(at[hit].tolist(), n[hit].tolist(), h[hit].view(np.int64).tolist(), piece.tolist()):
                        template, slots = t.template(a, size, form)
                        row = held_pieces[k].row
                        rows.append((ids[row].as_py(), keys[row].as_py(), v, int(offset[k]) + a, template, slots))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], x) for c, x in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())])], names=["d", "x", "hash", "pos", "template", "slots"])

    d = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("x"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(find, "d long, x long, hash long, pos long, template string, slots array<string>")


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(d, x, items, windows, reparameterised): documents (doc_id and hash of the text) that hold a literal or slot-consistent window of some item.

    A window is literal if its slots hold the item's own values, or if it has none. It is slot-consistent if each of its
    values is paired with one value only in all windows of its alignment (document, item, offset); a conflict
    takes away the windows that hold it, no others. reparameterised says that some slot differs in every item found.
    Null and empty texts and items have no windows. Rows that share a doc_id are judged each by its own text; repeated items
    are found alike.
    """
    b = materialise(benchmark_windows(bench))
    found = document_windows(docs, b)
    item = b.select(F.col("hash").alias("h"), "item_id", F.col("pos").alias("at"), F.col("template").alias("t"), F.col("slots").alias("s"))
    met = found.join(item, (F.col("hash") == F.col("h")) & (F.col("template") == F.col("t")))
    runs = met.groupBy("d", "x", "item_id", (F.col("pos") - F.col("at")).alias("off")).agg(F.collect_set(F.struct("at", "s", "slots")).alias("w"))

    def several(ends: Column) -> Column:
        """Values that stand in more than one pair."""
        by = F.array_sort(ends)
        return F.array_distinct(F.filter(by, lambda v, k: (k > 0) & (v == F.get(by, k - 1))))

    pairs = runs.withColumn("p", F.array_distinct(F.flatten(F.transform("w", lambda w: F.arrays_zip(w["s"].alias("b"), w["slots"].alias("d"))))))
    torn = pairs.select("d", "x", "item_id", "w", several(F.transform("p", lambda z: z["b"])).alias("tb"), several(F.transform("p", lambda z: z["d"])).alias("td"))
    fits = F.filter("w", lambda w: (w["s"] == w["slots"]) | ~(F.arrays_overlap(w["s"], F.col("tb")) | F.arrays_overlap(w["slots"], F.col("td"))))
    fine = torn.select("d", "x", "item_id", fits.alias("w")).where(F.size("w") > 0).withColumn("n", F.size(F.array_distinct(F.transform("w", lambda w: w["at"]))))
    changed = F.exists("w", lambda w: w["s"] != w["slots"])
    return fine.groupBy("d", "x").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.sum("n").alias("windows"), F.min(changed).alias("reparameterised"))


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` with a struct column leak (contaminated, items, windows, reparameterised); an underscore is appended where that name is taken. Every row is kept."""
    hits = materialise(leaks(docs, bench))
    d, x = fresh(docs, "leak_doc"), fresh(docs, "leak_text")
    hits = hits.select(F.col("d").alias(d), F.col("x").alias(x), F.struct(F.lit(True).alias("contaminated"), "items", "windows", "reparameterised").alias("hit"))
    name = fresh(docs, "leak")
    none = F.struct(F.lit(False).alias("contaminated"), F.array().cast("array<bigint>").alias("items"), F.lit(0).cast("long").alias("windows"), F.lit(False).alias("reparameterised"))
    met = docs.join(hits, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(x)), "left")
    return met.select(*[docs[c] for c in docs.columns], F.coalesce("hit", none).alias(name))
