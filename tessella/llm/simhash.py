"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared as vertical bit planes: one 64-bit word holds the same bit of 64 fingerprints, and
carry-save counters add up 64 distances with a few word operations a plane. A (row, block) comparison is abandoned
as soon as all of its 64 lanes exceed the radius.

Nulls and texts without words have the fingerprint zero. Repeated rows and equal texts share a fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import LOWER, NO_ID, discard, documents, fresh, materialise, parts, utf8
from .components import components

STEP = 1 << 16
LANES = np.uint64(64)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(raw: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``words`` lower-cased words, joined by one space, in blocks; a shorter text is one shingle, an empty one none."""
    ws = raw.translate(LOWER).split()
    if not ws:
        return
    if len(ws) <= words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(ws), 42)], dtype=np.uint64)
        return
    h = xxhash.xxh64_intdigest
    for at in range(0, len(ws) - words + 1, STEP):
        some = ws[at : at + STEP + words - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(some) - words + 1
        yield np.array([h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())], dtype=np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; bytes are summed in runs of 255, which can't overflow."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = len(h) // 255 * 255
    out = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        out += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash that is derived from a 64-bit hash."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(raw: bytes, words: int = 3) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes, repeats included."""
    total, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(raw, words):
        total += bit_counts(h)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]) if n else 0


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of each bit."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def majorities(h: np.ndarray, sizes: np.ndarray, n_words: int) -> np.ndarray:
    """Fingerprints (bytes) of runs of ``sizes`` hashes: each bit of ``n_words`` hashes derived from them is set if it is set in over half of the run.

    The hashes of a run are dealt to columns of 15 at most; carry-save adders count all columns at once, and only the four planes of counts are unpacked.
    """
    columns = -(-sizes // 15)
    first = np.cumsum(columns) - columns
    total = int(columns.sum())
    place, each = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(columns, sizes)
    at = place // each * total + np.repeat(first, sizes) + place % each
    rows, out = np.zeros((15, total), np.uint64), []
    for k in range(n_words):
        rows.reshape(-1)[at] = mixed(h, k)
        ones, twos = zip(*(_add(*rows[x : x + 3]) for x in range(0, 15, 3)))
        x, c = _add(*ones[:3])
        one, d = _add(x, *ones[3:])
        x, e = _add(*twos[:3])
        y, f = _add(*twos[3:], c)
        two, g = _add(x, y, d)
        four, eight = _add(e, f, g)
        count = np.zeros((total, 64), np.uint8)
        for weight, plane in enumerate((one, two, four, eight)):
            count += np.unpackbits(plane.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") << weight
        out.append(2 * np.add.reduceat(count, first, axis=0, dtype=np.int64) > sizes[:, None])
    return np.packbits(np.concatenate(out, axis=1), axis=1, bitorder="little")


def wide_fingerprints(texts: list[bytes], words: int, n_words: int) -> list[tuple[bytes, bytes, int]]:
    """For each text the digest of its shingle set, ``n_words`` 64-bit words of fingerprint over that set, and its size."""
    out: list[tuple[bytes, bytes, int]] = []
    sets: list[np.ndarray] = []

    def flush() -> None:
        full = [x for x in sets if len(x)]
        wide = iter(majorities(np.concatenate(full), np.array([len(x) for x in full]), n_words) if full else ())
        out.extend((xxhash.xxh3_128_digest(x.tobytes()), next(wide).tobytes(), len(x)) if len(x) else (b"", bytes(8 * n_words), 0) for x in sets)
        sets.clear()

    held = 0
    for x in texts:
        sets.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(x, words)])))
        held += len(sets[-1])
        if held >= STEP // 2:
            flush()
            held = 0
    flush()
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp holds the 64 bits as a long."""

    @arrow_udf("long")
    def fp(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x, words) for x in utf8(text)], dtype=np.uint64).view(np.int64))

    return documents(docs).select("doc_id", fp("text").alias("fp"))


# ---------------------------------------------------------------- bit-sliced comparison


def close_pairs(key: np.ndarray, fps: np.ndarray, radius: int, slab: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i < j) with equal ``key`` (rows are sorted by it) whose fingerprints (rows x words of uint64) differ in at most ``radius`` bits.

    Rows are cut into blocks of 64 lanes; every row meets the blocks that hold later rows of its group. Lanes of
    other groups start as exceeded.
    """
    n, width = fps.shape
    if n < 2:
        return
    blocks = -(-n // 64)
    bits = np.zeros((blocks * 64, width * 64), np.uint8)
    bits[:n] = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little").reshape(n, -1)
    planes = np.ascontiguousarray(np.packbits(bits.reshape(blocks, 64, -1).transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[..., 0]  # plane x block
    last = np.concatenate((np.flatnonzero(key[1:] != key[:-1]), [n - 1]))
    end = last[np.searchsorted(last, np.arange(n))] + 1  # of each row's group
    rows = np.flatnonzero(end - np.arange(n) > 1)
    each = (end[rows] - 1) // 64 - rows // 64 + 1
    size = max(1, radius.bit_length())
    start = (1 << size) - 1 - radius  # the counters begin so far up that they overflow beyond the radius
    edges = np.concatenate(([0], np.cumsum(each)))
    done = 0
    while done < len(rows):
        upto = max(done + 1, int(np.searchsorted(edges, edges[done] + slab, "right")) - 1)
        r = np.repeat(rows[done:upto], each[done:upto])
        b = r // 64 + np.arange(len(r)) - np.repeat(edges[done:upto] - edges[done], each[done:upto])
        done = upto
        lo, hi = np.maximum(r + 1 - 64 * b, 0).astype(np.uint64), np.minimum(end[r] - 64 * b, 64).astype(np.uint64)
        over = ~((ALL << np.minimum(lo, np.uint64(63))) * (lo < LANES).astype(np.uint64) & (ALL >> (LANES - hi)))
        count = [np.full(len(r), ALL if start >> k & 1 else 0, np.uint64) for k in range(size)]
        for p in range(width * 64):
            if p % 8 == 0 and p:
                live = np.flatnonzero(over != ALL)
                if not len(live):
                    break
                if len(live) < 0.8 * len(r):
                    r, b, over, count = r[live], b[live], over[live], [c[live] for c in count]
            carry = planes[p][b] ^ (np.uint64(0) - (fps[r, p >> 6] >> np.uint64(p & 63) & np.uint64(1)))
            for k in range(size):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
        else:
            hit = np.flatnonzero(over != ALL)
            if len(hit):
                lanes = np.unpackbits((~over[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                x, lane = np.nonzero(lanes)
                yield r[hit][x], b[hit][x] * 64 + lane


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = parent[up]


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Unites i[k] and j[k] in turn; which k brought two trees together."""
    used = []
    new = np.flatnonzero(_roots(parent, i) != _roots(parent, j))
    for k, a, c in zip(new.tolist(), i[new].tolist(), j[new].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        if a != c:
            parent[max(a, c)] = min(a, c)
            used.append(k)
    return used


def grouped(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[pa.ChunkedArray]]:
    """Runs of whole groups from batches that are sorted by their first column."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
        if kept and kept[-1].column(0)[-1].as_py() != key[0]:
            yield [pa.chunked_array([x.column(c) for x in kept]) for c in columns]
            kept = []
        if cut:
            kept.append(batch.slice(0, cut))
            yield [pa.chunked_array([x.column(c) for x in kept]) for c in columns]
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield [pa.chunked_array([x.column(c) for x in kept]) for c in columns]


def _plan(n: int, bits: int, radius: int) -> list[list[tuple[int, int]]]:
    """Block choices that radius errors can't all hit: of b blocks any b - radius. The fewest blocks for which random fingerprints share a bucket with 256 others at most."""
    for b in range(radius + 1, radius + 9):
        edge = [bits * k // b for k in range(b + 1)]
        if n >> min(63, bits * (b - radius) // b) <= 256 or b == radius + 8:
            return [[(edge[k], edge[k + 1]) for k in c] for c in combinations(range(b), b - radius)]
    raise AssertionError


def _mask(blocks: list[tuple[int, int]]) -> int:
    m = sum((1 << hi) - (1 << lo) for lo, hi in blocks)
    return m - (1 << 64) if m >> 63 else m


def fingerprint_links(fps: DataFrame, radius: int = 3, hot: int = 4096) -> DataFrame:
    """(a, b): a spanning forest of the links (at most ``radius`` differing bits) among the distinct values of ``fps.fp`` in every bucket.

    Two fingerprints within the radius agree on some choice of blocks (pigeonhole), so each table of buckets finds
    links exactly and together they find all. A bucket of over ``hot`` rows is bucketed again by the blocks of its
    other bits, with the same guarantee, so a hot bucket spreads over the cluster.
    """
    one = fps.select("fp").where("fp is not null").distinct()
    n = one.count()
    tables = _plan(n, 64, radius)
    rows = one.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(c)).cast("long")).alias("k")) for t, c in enumerate(tables)])).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("x.k").alias("k"))
    big = rows.groupBy("t", "k").count().where(F.col("count") > hot).select("t", "k", F.lit(True).alias("big"))
    fine = []
    for c in tables:  # the masks of the sub-blocks, over the bits that the table leaves open
        used = {x for lo, hi in c for x in range(lo, hi)}
        free = [x for x in range(64) if x not in used]
        cut = [len(free) * k // (radius + 1) for k in range(radius + 2)]
        fine.append([_mask([(x, x + 1) for x in free[cut[k] : cut[k + 1]]]) for k in range(radius + 1)])
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in f]) for f in fine])
    sub = F.when(F.col("big"), F.transform(F.element_at(masks, F.col("t") + 1), lambda m, i: F.struct((i + 1).alias("s"), F.col("fp").bitwiseAND(m).alias("j")))).otherwise(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("j"))))
    met = rows.join(big, ["t", "k"], "left").select("fp", "t", "k", F.explode(sub).alias("y"))
    keyed = met.select(F.xxhash64("t", "k", "y.s", "y.j").alias("key"), "fp")
    # the key is a 64-bit hash of the bucket; two buckets that meet in it only cost comparisons

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in grouped(batches, "key", "fp"):
            k, f = key.to_numpy(), fp.to_numpy().astype(np.int64)
            parent = np.arange(len(f))
            for i, j in close_pairs(k, f.view(np.uint64).reshape(-1, 1), radius):
                if used := _join(parent, i, j):
                    yield pa.RecordBatch.from_pydict({"a": f[i[used]], "b": f[j[used]]})

    p = parts(fps.sparkSession, n * len(tables), 1 << 18)
    return keyed.repartition(p, "key").sortWithinPartitions("key", "fp").mapInArrow(links, "a long, b long").where("a <> b")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits reach, its own included. A
    null doc_id stays null in its row, links like any other and names a component only if no other id does.
    """
    fps = materialise(fingerprints(docs, words))
    comp = components(fingerprint_links(fps, radius))
    label = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    label = materialise(label)
    least = label.groupBy("component").agg(F.min("least").alias("component_id"))
    named = label.join(least, "component").select(F.col("fp").alias("f"), "component_id")
    return fps.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- near-duplicates by shingle similarity

#: Bytes of text in a tile of a family.
TILE_BYTES = 8 << 20
#: Chance that a pair at exactly the threshold, of the sizes for which bits agree least, meets in no band.
MISS = 0.005


def _bit_error(similarity: float) -> float:
    """Largest chance that a fingerprint bit differs between two sets of at least this Jaccard similarity: that of large sets of equal size, or of small sets, whose majorities are often ties."""
    worst = math.acos(2 * similarity / (1 + similarity)) / math.pi
    chance = lambda n: [math.comb(n, k) / 2**n for k in range(n + 1)]
    for c in range(1, 13):
        for x in range(0, 13 - c):
            for y in range(x, 13 - c - x):
                if c >= similarity * (c + x + y):
                    differ = sum(u * v * w for k, u in enumerate(chance(c)) for i, v in enumerate(chance(x)) for j, w in enumerate(chance(y)) if (2 * (k + i) > c + x) != (2 * (k + j) > c + y))
                    worst = max(worst, differ)
    return worst


class ShingleSets:
    """Sets of shingle hashes, numbered, without the hashes that only one of them holds."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        _, number, times = np.unique(every, return_inverse=True, return_counts=True)
        often = times > 1
        self.size = np.array([len(x) for x in sets], np.int64)
        held = often[number]
        upto = np.concatenate(([0], np.cumsum(held)))[np.concatenate(([0], np.cumsum(self.size)))]
        self.start, self.end = upto[:-1], upto[1:]
        self.numbers = (np.cumsum(often) - 1)[number[held]]
        self.mark = np.zeros(int(often.sum()), np.int32)

    def similar(self, i: int, j: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the sets j (in order) have at least this Jaccard similarity to set i."""
        own = self.numbers[self.start[i] : self.end[i]]
        self.mark[own] = 1
        lo, n = self.start[j[0]], self.end[j] - self.start[j]
        if self.end[j[-1]] - lo <= 4 * n.sum():
            sums = np.concatenate(([0], np.cumsum(self.mark[self.numbers[lo : self.end[j[-1]]]])))
            both = sums[self.end[j] - lo] - sums[self.start[j] - lo]
        else:
            upto = np.cumsum(n)
            sums = np.concatenate(([0], np.cumsum(self.mark[self.numbers[np.repeat(self.end[j] - upto, n) + np.arange(upto[-1])]])))
            both = sums[upto] - sums[upto - n]
        self.mark[own] = 0
        return both >= similarity * (self.size[i] + self.size[j] - both)


def _classes(docs: DataFrame, words: int, similarity: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, x, digest) for each row, x a hash of its text; and (digest, x, least, component) for each distinct shingle set, of which some row (least, x) is the representative."""
    spark = docs.sparkSession
    d = documents(docs).withColumn("x", F.xxhash64("text"))
    p = _bit_error(similarity)
    n_docs = d.count()
    r = min(24, max(10, math.ceil(math.log2(max(n_docs, 1) / 256 + 1))))
    bands = math.ceil(math.log(MISS) / math.log(1 - (1 - p) ** r))
    n_words = max(4, -(-r * bands // 64))
    radius = math.ceil(256 * p + 3 * math.sqrt(256 * p * (1 - p)))

    @arrow_udf("struct<digest: binary, wide: binary, n: int>")
    def wide(text: pa.Array) -> pa.Array:
        rows = wide_fingerprints(utf8(text), words, n_words)
        return pa.StructArray.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.int32())], ["digest", "wide", "n"])

    sig = materialise(d.select("doc_id", "x", wide("text").alias("w")).select("doc_id", "x", "w.digest", "w.wide", "w.n"))
    # a shingle set is a node; its number tells sets apart that share a doc_id
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "x", "doc_id")).alias("least")
    reps = sig.groupBy("digest").agg(least, F.first("wide").alias("wide"), F.first("n").alias("n"))
    reps = materialise(reps.select("digest", F.monotonically_increasing_id().alias("rep"), "least.key", "least.x", F.col("least.doc_id").alias("least"), "wide", "n"))

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints' bytes, and a key for each band."""
        w = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        bits = np.unpackbits(w, axis=1, bitorder="little")[:, : r * bands].reshape(batch.num_rows, bands, r).astype(np.int64)
        return w, (bits << np.arange(r)).sum(axis=2) + (np.arange(bands) << 32)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k, n = np.unique(keys(batch)[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": k, "n": n})

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, key = keys(batch)
            first = [x.tobytes() for x in np.ascontiguousarray(w[:, :32])]
            rep = batch.column("rep").to_numpy()
            for at in range(0, bands, 8):
                k = key[:, at : at + 8]
                m = k.shape[1]
                yield pa.RecordBatch.from_pydict({"key": k.reshape(-1), "rep": np.repeat(rep, m), "f": pa.array([x for x in first for _ in range(m)], pa.binary()), "n": np.repeat(batch.column("n").to_numpy(), m)})

    def near(k: np.ndarray, fps: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows with one key that are within the radius and of sizes that allow the similarity."""
        for i, j in close_pairs(k, fps, radius):
            ok = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
            yield i[ok], j[ok]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each bucket's pairs connect, as stars around the smallest row."""
        for key, rep, f, n in grouped(batches, "key", "rep", "f", "n"):
            k, ids, size = (x.to_numpy() for x in (key, rep, n))
            parent = np.arange(len(ids))
            for i, j in near(k, np.frombuffer(b"".join(f.to_pylist()), np.uint64).reshape(len(k), -1), size):
                _join(parent, i, j)
            root = _roots(parent, np.arange(len(ids)))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            if len(moved):
                yield pa.RecordBatch.from_pydict({"a": ids[root[moved]], "b": ids[moved]})

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of the links in each group, from all pairs within the radius that links found before don't connect. In a group of two tiles only pairs across count."""
        for key, rep, f, n, own, across, text in grouped(batches, "key", "rep", "f", "n", "own", "across", "text"):
            k, ids, size, tile_of, cross = (x.to_numpy() for x in (key, rep, n, own, across))
            sets = ShingleSets([np.unique(np.concatenate([*shingle_hashes(x, words)])) for x in utf8(text)])
            parent = np.arange(len(ids))
            for i, j in near(k, np.frombuffer(b"".join(f.to_pylist()), np.uint64).reshape(len(k), -1), size):
                ok = ~cross[i] | (tile_of[i] != tile_of[j])
                i, j = i[ok], j[ok]
                edge = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
                a, b = [], []
                for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    row, some = int(i[lo]), j[lo:hi]
                    some = some[_roots(parent, some) != _roots(parent, i[lo : lo + 1])]
                    if len(some):
                        some = some[sets.similar(row, some, similarity)]
                        used = _join(parent, np.full(len(some), row), some)
                        a += [ids[row]] * len(used)
                        b += ids[some[used]].tolist()
                if a:
                    yield pa.RecordBatch.from_pydict({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    fps = reps.where("n > 0").select("rep", "wide", "n")
    hot = materialise(fps.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("rows")).where(F.col("rows") > tile))
    any_hot = not hot.isEmpty()

    rows = fps.mapInArrow(banded, "key long, rep long, f binary, n int")
    if any_hot:
        # a bucket of over ``tile`` rows is cut into tiles; every two tiles meet in a task of their own
        tiles = F.ceil(F.col("rows") / tile).cast("int")
        own = F.when(F.col("rows").isNotNull(), F.pmod(F.xxhash64("rep"), tiles).cast("int"))
        met = rows.join(hot, "key", "left").withColumns({"own": own, "other": F.explode(F.when(F.col("rows").isNotNull(), F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(F.lit(0))))})
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        rows = met.select(F.when(F.col("rows").isNull(), F.col("key")).otherwise(pair).alias("key"), "rep", "f", "n")
    buckets = rows.repartition(parts(spark, n_docs * bands, 1 << 17), "key").sortWithinPartitions("key", "rep")
    family = materialise(components(materialise(buckets.mapInArrow(candidates, "a long, b long").distinct())))

    # all pairs of all buckets lie within families, so each family is checked as a whole: its texts travel, its pairs don't
    asked = family.join(reps, F.col("rep") == F.col("node")).select("component", "rep", "key", "x", F.substring("wide", 1, 32).alias("f"), "n")
    texts = d.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "x", "text")
    texts = materialise(texts.join(asked.hint("merge"), ["key", "x"]).select("component", "rep", "f", "n", "text").dropDuplicates(["rep"]))  # one plan at every size: both sides go by key and x
    load = texts.groupBy("component").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("size"))
    load = materialise(load.select(F.col("component").alias("of"), F.greatest(F.ceil(F.col("rows") / tile), F.ceil(F.col("size") / TILE_BYTES)).cast("int").alias("tiles")).where("tiles > 1"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cut = texts.join(load, F.col("component") == F.col("of"), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    groups = cut.select(F.xxhash64("component", low, high).alias("key"), "rep", "f", "n", "own", (low < high).alias("across"), "text")
    held = groups.repartition(parts(spark, total, TILE_BYTES), "key").sortWithinPartitions("key", "rep").mapInArrow(verified, "a long, b long")
    comp = components(held)
    discard(texts)
    label = reps.join(comp, F.col("rep") == F.col("node"), "left").select("digest", "x", "least", F.coalesce("component", "rep").alias("component"))
    return sig.select("doc_id", "x", "digest"), materialise(label)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = 1 << 14) -> DataFrame:
    """(doc_id, class_id) for each row: links are pairs whose sets of ``words``-word shingles have a Jaccard similarity of at least ``similarity``; the class is the smallest doc_id reachable.

    Wide SimHash fingerprints (as many bits as the bands below need) are banded so that a pair at the threshold
    meets in some band with probability 1 - MISS, bit-sliced comparison on 256 of the bits keeps the pairs within the
    radius of the threshold and three deviations. Buckets pass on which rows their pairs connect, and components of that are
    families: every pair of every bucket lies in a family. Then all pairs of a family that are within the radius are checked exactly,
    on the shingle sets, but for those that links found before connect; a large family is cut into tiles, every two of which meet.
    Texts with equal shingle sets are collapsed first, so groups
    of copies cost one row. Null and empty texts and those without words have the empty set and are linked to each
    other. Rows are linked by their texts alone: rows that share a doc_id may be of several classes, and a row without
    a doc_id is of the class of its text (null if no row of the class has a doc_id). An empty table gives no rows.
    """
    rows, label = _classes(docs, words, similarity, tile)
    named = label.groupBy("component").agg(F.min("least").alias("class_id"))
    named = label.join(named, "component").select(F.col("digest").alias("g"), "class_id")
    return rows.join(named, F.col("digest") == F.col("g")).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near-duplicates: of each class of ``near_duplicates`` one row stays, that with the smallest doc_id (null comes last).

    Of rows that share this doc_id the one with the smallest hash of its text stays, and of equal texts the row that sorts first by all columns.
    """
    rows, label = _classes(docs, words, similarity, 1 << 14)
    last = F.struct(F.coalesce("least", F.lit(NO_ID)), "x")
    kept = label.groupBy("component").agg(F.min_by(F.struct("least", "x"), last).alias("row"))
    key, x, row = (fresh(docs, c) for c in ("near_id", "near_text", "near_row"))
    kept = materialise(kept.select(F.col("row.least").alias(key), F.col("row.x").alias(x)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col(x))
    left = docs.join(kept.hint("merge"), same, "left_semi")
    repeated = materialise(rows.groupBy("doc_id", "x").count().where("count > 1").select(F.col("doc_id").alias(key), F.col("x").alias(x)))
    if repeated.isEmpty():
        return left
    # rows may hold maps, which Spark can't sort, so JSON decides; wholly equal rows are interchangeable
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = left.join(repeated, same, "left_semi").groupBy(F.col("doc_id").alias(key), F.xxhash64(F.col("text").cast("string")).alias(x)).agg(F.min_by(every, F.to_json(every)).alias(row))
    return left.join(repeated, same, "left_anti").unionAll(once.select(f"{row}.*"))
