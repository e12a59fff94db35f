"""URL filters: one bit-parallel automaton runs every glob rule over each canonical URL.

All patterns are packed side by side into multiword Shift-And masks. A pattern of m elements takes m + 1 bits; bit i
says that its first i elements are matched, and a ``*`` after element i lets bit i stay. One shift, one AND and one OR
per word and character advance all patterns together.

The canonical URL is the lower-cased host (A-Z only), a separator that no byte equals, and the path. ``*`` before the
separator stays within the host. A null url, or one without ``://``, has an empty host and path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import LOWER, fresh, utf8

SEP = 256


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``; the longest rule wins."""

    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Glob:
    """A block rule of the method itself: globs (``*`` any run, ``?`` any one) over the whole host and the whole path."""

    host: str
    path: str = "*"


def split_url(url: bytes) -> tuple[bytes, bytes]:
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    ends = [k for k in (rest.find(b"/"), rest.find(b"?"), rest.find(b"#")) if k >= 0]
    at = min(ends, default=len(rest))
    path = rest[at:]
    ends = [k for k in (path.find(b"?"), path.find(b"#")) if k >= 0]
    return rest[:at].translate(LOWER), path[: min(ends, default=len(path))]


def _elements(text: str, wild: bool) -> list[int]:
    """Bytes, -1 for ``*`` and -2 for ``?``."""
    return [{42: -1, 63: -2}.get(c, c) if wild else c for c in text.encode()]


class Automaton:
    """Multiword Shift-And over a list of patterns (element lists)."""

    def __init__(self, patterns: list[list[int]]) -> None:
        bits = sum(1 + sum(e != -1 for e in p) for p in patterns)
        self.words = max(1, -(-bits // 64))
        step = np.zeros((SEP + 1, self.words * 64), bool)
        loop, first = np.zeros_like(step), np.zeros(self.words * 64, bool)
        self.final: list[int] = []
        at = 0
        for p in patterns:
            first[at] = True
            host = True
            for e in p:
                if e == -1:
                    loop[:SEP, at] = True
                    loop[SEP, at] |= not host
                    continue
                at += 1
                step[: SEP if e == -2 else 0, at] = True
                if e >= 0:
                    step[e, at] = True
                host &= e != SEP
            self.final.append(at)
            at += 1
        pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view(np.uint64)
        self.step, self.loop, self.first = pack(step), pack(loop), pack(first)

    def run(self, texts: list[np.ndarray]) -> np.ndarray:
        """For each text (symbols) which patterns match it: rows x patterns. All texts advance together, the longest last to end."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        state = np.tile(self.first, (len(texts), 1))
        flat = np.concatenate([*texts, np.zeros(1, np.uint16)])
        begin = (np.cumsum(size) - size)[order]
        ends = -size[order]
        one, top = np.uint64(1), np.uint64(63)
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(ends, -k, "left"))  # those longer than k
            c = flat[begin[:n] + k]
            d = state[:n]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:n] = moved & self.step[c] | d & self.loop[c]
        out = np.empty((len(texts), len(self.final)), bool)
        for j, f in enumerate(self.final):
            out[order, j] = (state[:, f // 64] >> np.uint64(f % 64) & one).astype(bool)
        return out


class UrlFilter:
    def __init__(self, rules: list[Rule], globs: list[Glob]) -> None:
        # the longest rule first; of equal length the longer host, then block before allow
        self.rules = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.action != "block", r.name))
        pats = []
        for r in self.rules:
            tail = [SEP, *_elements(r.path, False), -1]
            pats += [[*_elements(r.host, False), *tail], [-1, *_elements("." + r.host, False), *tail]]
        pats += [[*_elements(g.host, True), SEP, *_elements(g.path, True)] for g in globs]
        self.automaton = Automaton(pats)

    def judge(self, urls: list[bytes]) -> tuple[list[bytes], list[bytes], list[str | None], list[str]]:
        both = [split_url(u) for u in urls]
        texts = [np.concatenate((np.frombuffer(h, np.uint8).astype(np.uint16), np.array([SEP], np.uint16), np.frombuffer(p, np.uint8).astype(np.uint16))) for h, p in both]
        hit = self.automaton.run(texts)
        n = len(self.rules)
        fits = hit[:, : 2 * n].reshape(len(urls), n, 2).any(axis=2)
        bad = hit[:, 2 * n :].any(axis=1)
        which = np.where(fits.any(axis=1), fits.argmax(axis=1), -1).tolist() if n else [-1] * len(urls)
        rule = [self.rules[k].name if k >= 0 else None for k in which]
        verdict = [self.rules[k].action if k >= 0 else "block" if b else "allow" for k, b in zip(which, bad.tolist())]
        return [h for h, _ in both], [p for _, p in both], rule, verdict


#: Block lists of the method, for urls that no rule fits.
SPAM = (Glob("*casino*"), Glob("*-bets*"), Glob("*cheap-pills*"), Glob("ads-*"), Glob("*.ads-*"))


def url_verdicts(pages: DataFrame, rules: list[Rule], globs: list[Glob] | tuple[Glob, ...] = SPAM) -> DataFrame:
    """``pages`` with a struct column url_filter (host, path, rule, verdict); where ``pages`` has a column of that name, an underscore is appended.

    Every row is kept. Only the url column goes through the automaton.
    """
    f = UrlFilter(list(rules), list(globs))

    @arrow_udf("struct<host: string, path: string, rule: string, verdict: string>")
    def judge(url: pa.Array) -> pa.Array:
        host, path, rule, verdict = f.judge(utf8(url))
        return pa.StructArray.from_arrays([pa.array(host, pa.binary()).cast(pa.string()), pa.array(path, pa.binary()).cast(pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["host", "path", "rule", "verdict"])

    return pages.select("*", judge(F.col("url").cast("string")).alias(fresh(pages, "url_filter")))
