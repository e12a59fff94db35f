"""Line dedup: lines that several documents hold stay only in the first of them.

Distinct line hashes are sharded by their upper bits. Each shard builds a minimal perfect hash (one bit array per
level; a key rests at the first level where it alone hits its bit, and its index is the rank of that bit) over
its distinct hashes, which indexes compact arrays of fingerprints, document counts and first documents. The arrays of all
shards are written as a table. Documents then probe them with the packed hashes of their lines and get back those
of repeated lines; lines themselves are never joined.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .chunks import chunked, compare_ids, cuts, load, shards, shards_of, tasks
from .common import LOWER, lean, materialise

SPACES = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys onto 0 to n - 1."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.7) -> None:
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # bits, rank before, words, rank before each word
        rank, left = 0, keys
        while len(left):
            size = max(64, int(len(left) * gamma) + 63 & ~63)
            at = self._slot(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            before = np.cumsum(np.bitwise_count(words)) - np.bitwise_count(words)
            self.levels.append((size, rank, words, before.astype(np.int64)))
            rank += int(alone.sum())
            left = left[~alone[at]]
        self.size = rank

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        z = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1, or that of another key, for one that isn't there."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, rank, words, before) in enumerate(self.levels):
            at = self._slot(keys[open_], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit & np.uint64(1)).astype(bool)
            low = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[here]] = (rank + before[at >> 6] + np.bitwise_count(low))[here]
            open_ = open_[~here]
        return out


class LineIndex:
    """One shard: a perfect hash of its distinct line hashes, and compact arrays that it indexes: fingerprint, document count (2 stands for more) and first document.

    key and print_ are the halves of 128-bit hashes; a line comes once from each chunk that holds it, with the first of the
    chunk's documents that does and whether several do. Counts and first documents are gathered in the arrays, by probing.
    """

    def __init__(self, key: np.ndarray, print_: np.ndarray, doc: np.ndarray, many: np.ndarray) -> None:
        mixed = self.mix(key, print_)
        self.hash = PerfectHash(np.unique(mixed))
        at, n = self.hash(mixed), self.hash.size
        whole = np.zeros(n, np.uint64)
        whole[at] = print_
        self.prints = (whole & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.first, last, several = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, bool)
        np.minimum.at(self.first, at, doc)
        np.maximum.at(last, at, doc)
        several[at[many > 0]] = True
        self.counts = np.where(several | (self.first != last), 2, 1).astype(np.uint8)
        # lines that even the mixture of both halves doesn't tell apart lie beside the arrays
        odd = np.flatnonzero(np.isin(at, at[whole[at] != print_]))
        self.twins: dict[tuple[int, int], tuple[int, int]] = {}
        for k, p, d, m in zip(key[odd].tolist(), print_[odd].tolist(), doc[odd].tolist(), many[odd].tolist()):
            c, f = self.twins.get((k, p), (0, d))
            self.twins[k, p] = (2 if m or c == 2 or (c and f != d) else 1, min(f, d))

    @staticmethod
    def mix(key: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return key * np.uint64(0x9E3779B97F4A7C15) ^ print_

    def probe(self, key: np.ndarray, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count (0: not there) and first document."""
        at = self.hash(self.mix(key, print_))
        there = (at >= 0) & (self.prints[np.maximum(at, 0)] == (print_ & np.uint64(0xFFFFFFFF)).astype(np.uint32)) if len(self.prints) else np.zeros(len(at), bool)
        at = np.where(there, at, 0)
        count = np.where(there, self.counts[at] if len(self.counts) else 0, 0)
        first = self.first[at] if len(self.first) else np.zeros(len(at), np.int64)
        for (k, p), (c, d) in self.twins.items():
            same = (key == np.uint64(k)) & (print_ == np.uint64(p))
            count[same], first[same] = c, d
        return count, first


def line_key(line: bytes, least: int = 10) -> bytes | None:
    """The 128-bit hash of a line's key; none for a key of under ``least`` code points."""
    key = line.strip(SPACES).translate(LOWER)
    if len(key) < least or (len(key) < 4 * least and len(key.translate(None, CONTINUATION)) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def line_dedup(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for each row of ``docs``.

    Lines are split at \\n; their key is stripped of ASCII white space and lower-cased (A-Z). Lines whose key has at
    least ``least`` code points and is found in at least 2 documents are dropped except in the smallest doc_id. A null text
    is one empty line. Rows that share a doc_id are one document here; a null doc_id is one that comes last.
    """
    d, n = chunked(docs)
    m = shards(docs, n, 8)

    def send(table: pa.Table) -> pa.Table:
        chunk, ids, texts = load(table)
        seen: dict[bytes, list] = {}
        for doc, text in zip(compare_ids(ids).tolist(), texts):
            for line in text.split(b"\n"):
                if (h := line_key(line, least)) is not None:
                    if (got := seen.get(h)) is None:
                        seen[h] = [doc, 0]
                    elif got[0] != doc:
                        got[1] = 1
        halves = np.frombuffer(b"".join(seen), ">u8").astype(np.uint64).reshape(-1, 2)
        doc = np.array([x[0] for x in seen.values()], np.int64)
        many = np.array([x[1] for x in seen.values()], np.uint8)
        order = np.argsort(halves[:, 0], kind="stable")
        halves, doc, many = halves[order], doc[order], many[order]
        rows = [(s, chunk, halves[a:b].tobytes(), doc[a:b].tobytes(), many[a:b].tobytes()) for s, a, b in cuts(shards_of(halves[:, 0], m), m)]
        return pa.Table.from_pylist([dict(zip(("shard", "chunk", "keys", "docs", "many"), r)) for r in rows], SENT)

    def build(table: pa.Table) -> pa.Table:
        """The arrays of a shard."""
        get = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        every = get("keys", np.uint64).reshape(-1, 2)
        index = LineIndex(every[:, 0], every[:, 1], get("docs", np.int64), get("many", np.uint8))
        return pa.Table.from_pylist([{"shard": table.column("shard")[0].as_py(), "arrays": pickle.dumps(index)}], INDEX)

    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        """What the arrays say of the lines of each chunk that are in several documents."""
        index = pickle.loads(held.column("arrays")[0].as_py())  # noqa: S301 - written by ``build``
        rows = []
        for c, raw in zip(asked.column("chunk").to_pylist(), asked.column("keys").to_pylist()):
            k = np.frombuffer(raw, np.uint64).reshape(-1, 2)
            count, first = index.probe(k[:, 0], k[:, 1])
            hit = count >= 2
            if hit.any():
                rows.append({"chunk": c, "keys": k[hit].tobytes(), "docs": first[hit].tobytes()})
        return pa.Table.from_pylist(rows, BACK)

    def drop(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return OUT.empty_table()
        _, ids, texts = load(table)
        raw = np.frombuffer(b"".join(back.column("keys").to_pylist()), np.uint64).astype(">u8").tobytes()
        first = dict(zip((raw[k : k + 16] for k in range(0, len(raw), 16)), np.frombuffer(b"".join(back.column("docs").to_pylist()), np.int64).tolist()))
        kept, lines, dropped = [], [], []
        for doc, text in zip(compare_ids(ids).tolist(), texts):
            every = text.split(b"\n")
            stay = [x for x in every if (h := line_key(x, least)) is None or first.get(h, doc) == doc]
            kept.append(b"\n".join(stay) if len(stay) < len(every) else text)
            lines.append(len(every))
            dropped.append(len(every) - len(stay))
        return pa.table([pa.array(ids, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema=OUT)

    sent = materialise(d.groupBy("chunk").applyInArrow(lean(send), "shard int, chunk int, keys binary, docs binary, many binary"))
    index = materialise(sent.repartition(tasks(m), "shard").groupBy("shard").applyInArrow(lean(build), "shard int, arrays binary"))
    asked = sent.select("shard", "chunk", "keys").repartition(tasks(m), "shard").groupBy("shard")
    back = asked.cogroup(index.repartition(tasks(m), "shard").groupBy("shard")).applyInArrow(lean(probe), "chunk int, keys binary, docs binary")
    return d.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lean(drop), "doc_id long, text string, n_lines long, n_dropped long")


INDEX = pa.schema([("shard", pa.int32()), ("arrays", pa.binary())])
SENT = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("many", pa.binary())])
BACK = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
