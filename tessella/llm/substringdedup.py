"""Exact substring dedup by suffix sorting: bytes of strings that an earlier document also holds are removed.

Every window of ``LENGTH`` bytes has an anchor: the position in it whose 20 bytes have the least hash. Equal windows
have equal anchors, so only segments (runs of windows with one anchor) whose anchor occurs in two documents can
repeat. Those meet in shards by anchor hash, where the suffixes at their windows are sorted deep-shallow: by
multikey quicksort over 8-byte characters to a shallow depth, then by blind tries (only branching positions and bytes) for
the groups that still agree. Windows that are equal over the whole length form a group, which keeps its smallest doc_id.

Chunks pre-aggregate what they send, so a passage that a third of all documents hold reaches its shard once per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import chunked, compare_ids, cuts, load, shards, shards_of, tasks
from .common import lean

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1
BLOCK = 1 << 18
SHALLOW = 16
SORT = 1 << 17


def _words(raw: bytes) -> np.ndarray:
    """The 8 bytes at each position, as little-endian words; the caller pads."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def _gram_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hash of 20 bytes given as the words at 0, 4 and 12."""
    z = a * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(29)
    z += b * np.uint64(0xC2B2AE3D27D4EB4F)
    z ^= z >> np.uint64(31)
    z += c * np.uint64(0x165667B19E3779F9)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(32)
    return z


class Segments:
    """The segments of a chunk's documents: start, number of windows, anchor and its hash, and document."""

    def __init__(self, texts: list[bytes]) -> None:
        size = np.array([len(x) for x in texts], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.raw = b"".join(texts) + bytes(64)
        n = len(self.raw) - 64
        inside = np.zeros(n + 1, np.int8)
        long_ = size >= LENGTH
        inside[self.starts[long_]] += 1
        inside[self.ends[long_] - LENGTH + 1] -= 1
        inside = np.cumsum(inside, dtype=np.int8)[:n].astype(bool)
        found = [self._block(at, min(at + BLOCK - SPAN, n - LENGTH + 1), inside) for at in range(0, max(n - LENGTH + 1, 0), BLOCK - SPAN)]
        self.at, self.windows, self.anchor, self.hash = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.doc = np.searchsorted(self.ends, self.at, "right")

    def _block(self, lo: int, hi: int, inside: np.ndarray) -> tuple[np.ndarray, ...]:
        """Segments of the windows that start at lo to hi - 1."""
        u = _words(self.raw)
        m = hi - lo + SPAN - 1
        z = _gram_hash(u[lo : lo + m], u[lo + 4 : lo + 4 + m], u[lo + 12 : lo + 12 + m])
        low = np.uint64(BLOCK - 1)
        least = (z & ~low) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: hi - lo], least[SPAN - width : SPAN - width + hi - lo])
        anchor = (least & low).astype(np.int64)
        ok = inside[lo:hi]
        turn = np.empty(hi - lo + 1, bool)
        turn[0] = turn[-1] = True
        turn[1:-1] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
        edge = np.flatnonzero(turn)
        first, count = edge[:-1], np.diff(edge)
        keep = ok[first]
        first, count = first[keep], count[keep]
        # anchors have small hashes by their choice; shards need even ones
        even = z[anchor[first]] * np.uint64(0xBF58476D1CE4E5B9)
        even ^= even >> np.uint64(31)
        return first + lo, count, anchor[first] + lo, even * np.uint64(0x94D049BB133111EB)

    def bytes_of(self, k: np.ndarray) -> list[bytes]:
        raw = self.raw
        return [raw[a:b] for a, b in zip(self.at[k].tolist(), (self.at[k] + self.windows[k] + LENGTH - 1).tolist())]


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... of count[k] each, one after another."""
    if not len(count):
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def quicksort(key_at: Callable[[np.ndarray, np.ndarray], np.ndarray], order: np.ndarray, group: np.ndarray, depth: int, step: int, starts: np.ndarray) -> None:
    """Multikey quicksort of ``order`` by characters of ``step`` bytes, to ``depth`` bytes, within the buckets that begin at ``starts``: each group is split
    by a pivot, the median of three, into smaller, equal and greater characters; the equal ones go on with their next
    character. All groups are split at once. ``group`` gets the place where each element's group of strings that agree to the depth begins.
    """
    n = len(order)
    lo, size = starts, np.diff(np.append(starts, n))
    group[:] = np.repeat(lo, size)
    deep, fresh = np.zeros(len(lo), np.int64), np.ones(len(lo), bool)
    keys = np.empty(n, np.uint64)  # the characters of the elements at their places, read once a depth
    while len(lo := lo[(some := (size > 1) & (deep < depth))]):
        size, deep, fresh = size[some], deep[some], fresh[some]
        at, gid = ragged(lo, size), np.repeat(np.arange(len(lo)), size)
        item, key = order[at], keys[at]
        unread = np.flatnonzero(fresh[gid])
        key[unread] = key_at(item[unread], deep[gid[unread]])
        first = np.cumsum(size) - size
        x, y, z = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[gid]
        sides = (key < pivot, key == pivot, key > pivot)
        begin, parts = lo.copy(), []
        for side, further in zip(sides, (0, step, 0)):
            upto = np.cumsum(side)
            before = upto[first] - side[first]
            count = upto[first + size - 1] - before
            mine = np.flatnonzero(side)
            place = begin[gid[mine]] + upto[mine] - 1 - before[gid[mine]]
            order[place], keys[place] = item[mine], key[mine]
            group[place] = begin[gid[mine]]
            parts.append((begin.copy(), count, deep + further, np.full(len(lo), further > 0)))
            begin = begin + count
        lo, size, deep, fresh = (np.concatenate(x) for x in zip(*parts))


def blind_tries(raw: bytes, at: np.ndarray, order: np.ndarray, group: np.ndarray) -> None:
    """Sorts each group of strings that agree to SHALLOW bytes by a blind trie; all tries grow at once, a level at a time, from the root.

    An inner node is the position at which its strings first differ, with a child for each byte there; strings go down by
    their bytes at the branching positions, blind to all others. A leaf holds equal strings.
    """
    u, b = _words(raw), np.frombuffer(raw, np.uint8)
    lo = np.flatnonzero(group == np.arange(len(group)))
    size = np.diff(np.append(lo, len(group)))
    while len(lo := lo[(some := size > 1)]):
        size = size[some]
        place, first = ragged(lo, size), np.cumsum(size) - size
        item = order[place]
        string = at[item]
        head = np.repeat(string[first], size)
        split, same = np.full(len(item), LENGTH), np.arange(len(item))
        for depth in (*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8):
            x = u[string[same] + depth] ^ u[head[same] + depth]
            differ = x != 0
            x = x[differ]
            split[same[differ]] = depth + (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            same = same[~differ]
        split = np.minimum.reduceat(split, first)
        inner = split < LENGTH
        go = np.repeat(inner, size)
        place, item, string = place[go], item[go], string[go]
        child = np.repeat(np.arange(int(inner.sum())), size[inner]) << 8 | b[string + np.repeat(split[inner], size[inner])]
        by = np.argsort(child, kind="stable")
        order[place], child = item[by], child[by]
        new = np.flatnonzero(np.diff(child, prepend=-1))
        lo, size = place[new], np.diff(np.append(new, len(child)))
        group[place] = np.repeat(lo, size)


def suffix_groups(raw: bytes, at: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings of LENGTH bytes at ``at``: their order, and for each place in it the place where its group of equal strings begins.

    ``starts`` says where buckets begin within which to sort: no string may equal one of another bucket.
    """
    u = _words(raw)
    order, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    if starts is None:
        starts = np.zeros(min(len(at), 1), np.int64)
    quicksort(lambda item, deep: u[at[item] + deep].byteswap(), order, group, SHALLOW, 8, starts)
    blind_tries(raw, at, order, group)
    return order, group


def windows_of(first: np.ndarray, offset: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of about SORT windows of segments that lie in the order of their ``anchor``: segment, place in the segment, and where buckets begin.

    A bucket holds the windows of one anchor that begin as far before it. Equal windows hold the same bytes before the same
    anchor, so they are in one bucket. An anchor of more than SORT windows goes bucket by bucket: a window a segment at most.
    """
    edge = np.flatnonzero(np.diff(anchor, prepend=-1, append=-1))  # where each anchor's segments begin
    upto = np.concatenate(([0], np.cumsum(count)))[edge]
    done = 0
    while done < len(edge) - 1:
        stop = max(done + 1, int(np.searchsorted(upto, upto[done] + SORT, "right")) - 1)
        lo, hi = int(edge[done]), int(edge[stop])
        if upto[stop] - upto[done] > SORT:
            for before in range(SPAN):
                k = offset[lo:hi] - before
                seg = np.flatnonzero((k >= 0) & (k < count[lo:hi]))
                if len(seg) > 1:
                    yield first[lo:hi][seg], k[seg], np.zeros(1, np.int64)
        else:
            seg = np.repeat(np.arange(lo, hi), count[lo:hi])
            k = ragged(np.zeros(hi - lo, np.int64), count[lo:hi])
            bucket = (anchor[seg] - anchor[lo]) * SPAN + offset[seg] - k
            by = np.argsort(bucket, kind="stable")
            yield first[seg[by]], k[by], np.flatnonzero(np.diff(bucket[by], prepend=-1))
        done = stop


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) for each row of ``docs``; kept holds the bytes that are left.

    A byte goes if a LENGTH-byte string over it also starts in a document with a smaller doc_id; strings are judged on
    the whole input texts and never cross documents. Null texts are empty. Rows that share a doc_id are one document
    here; a null doc_id comes after all others.
    """
    d, n = chunked(docs)
    n = shards(docs, n, 2)

    def unique(seg: Segments, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes in order, whether two documents of the chunk have them, and each segment's place among them."""
        order = np.lexsort((doc, seg.hash))
        h, dd = seg.hash[order], doc[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h)) - 1 if len(h) else first
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        return h[first], dd[first] != dd[last], place

    def send(table: pa.Table) -> pa.Table:
        chunk, ids, texts = load(table)
        seg = Segments(texts)
        h, many, _ = unique(seg, compare_ids(ids)[seg.doc])
        short = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6])
        rows = [{"shard": s, "chunk": chunk, "keys": short[a:b].tobytes(), "many": np.packbits(many[a:b]).tobytes()} for s, a, b in cuts(shards_of(h, n), n)]
        return pa.Table.from_pylist(rows, SENT)

    def shared(table: pa.Table) -> pa.Table:
        """Which of the anchors that each chunk sent occur in two documents. A hash that agrees by chance only costs a comparison."""
        keys = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in table.column("keys").to_pylist()]
        every = np.concatenate(keys)
        h = np.zeros((len(every), 8), np.uint8)
        h[:, :6] = every
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("many").to_pylist(), keys)])
        _, place, times = np.unique(h.view(np.uint64)[:, 0], return_inverse=True, return_counts=True)
        often = times >= 2
        often |= np.bincount(place, many, len(times)) > 0
        hit, at = often[place], 0
        rows = []
        for c, s, k in zip(table.column("chunk").to_pylist(), table.column("shard").to_pylist(), keys):
            rows.append({"chunk": c, "shard": s, "kind": 0, "a": np.packbits(hit[at : at + len(k)]).tobytes(), "b": b"", "c": b""})
            at += len(k)
        return pa.Table.from_pylist(rows, BACK)

    def candidates(table: pa.Table, back: pa.Table) -> tuple[int, list, Segments, np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[bytes, int]]:
        """The chunk's segments with shared anchors, and the distinct ones in the order in which they are sent."""
        chunk, ids, texts = load(table)
        seg = Segments(texts)
        doc = compare_ids(ids)[seg.doc]
        h, _, place = unique(seg, doc)
        bits = {s: a for s, k, a in zip(back.column("shard").to_pylist(), back.column("kind").to_pylist(), back.column("a").to_pylist()) if k == 0}
        hit = np.zeros(len(h), bool)
        for s, a, b in cuts(shards_of(h, n), n):
            hit[a:b] = np.unpackbits(np.frombuffer(bits[s], np.uint8), count=b - a)
        some = np.flatnonzero(hit[place])
        some = some[np.argsort(shards_of(seg.hash[some], n), kind="stable")]
        index: dict[bytes, int] = {}
        which = np.fromiter((index.setdefault(x, len(index)) for x in seg.bytes_of(some)), np.int64, len(some))
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc[some])
        first = np.zeros(len(index), np.int64)
        first[which[::-1]] = some[::-1]
        return chunk, ids, seg, some, which, least, first, index

    def spread(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SEGMENTS.empty_table()
        chunk, _, seg, _, _, least, first, index = candidates(table, back)
        text = [*index]
        size = (seg.windows[first] + LENGTH - 1).astype(np.uint8)
        off = (seg.anchor[first] - seg.at[first]).astype(np.uint8)
        rows = [{"shard": s, "chunk": chunk, "text": b"".join(text[a:b]), "size": size[a:b].tobytes(), "off": off[a:b].tobytes(), "docs": least[a:b].tobytes()} for s, a, b in cuts(shards_of(seg.hash[first], n), n)]
        return pa.Table.from_pylist(rows, SEGMENTS)

    def compare(table: pa.Table) -> pa.Table:
        """For each segment that a chunk sent the smallest doc_id with each of its windows, as runs (windows, doc_id); no run: the chunk's own."""
        sent = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "shard", "text", "size", "off", "docs"))))
        sizes = [np.frombuffer(x[3], np.uint8).astype(np.int64) for x in sent]
        docs_ = [np.frombuffer(x[5], np.int64) for x in sent]
        index: dict[bytes, int] = {}
        which = []
        for x, size in zip(sent, sizes):
            ends = np.cumsum(size)
            which.append(np.fromiter((index.setdefault(x[2][a:b], len(index)) for a, b in zip((ends - size).tolist(), ends.tolist())), np.int64, len(size)))
        every = np.concatenate(which)
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, every, np.concatenate(docs_))
        off = np.zeros(len(index), np.int64)
        off[every] = np.concatenate([np.frombuffer(x[4], np.uint8) for x in sent])
        raw = b"".join(index) + bytes(64)
        size = np.fromiter(map(len, index), np.int64, len(index))
        start, windows = np.cumsum(size) - size, size - LENGTH + 1
        u = _words(raw)
        a = start + off
        group = np.unique(_gram_hash(u[a], u[a + 4], u[a + 12]), return_inverse=True)[1]
        value = np.repeat(least, windows)
        base = np.cumsum(windows) - windows
        alike = np.argsort(group, kind="stable")
        for some, k, starts in windows_of(alike, off[alike], windows[alike], group[alike]):
            at, slot = start[some] + k, base[some] + k
            order, head = suffix_groups(raw, at, starts)
            heads = np.flatnonzero(head == np.arange(len(head)))
            low = np.minimum.reduceat(value[slot][order], heads)
            value[slot[order]] = np.repeat(low, np.diff(np.append(heads, len(head))))
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        new[base] = True
        runs = np.flatnonzero(new)
        length, low = np.diff(np.append(runs, len(value))), value[runs]
        first = np.searchsorted(runs, base)
        count = np.diff(np.append(first, len(runs)))
        rows = []
        for x, k, own in zip(sent, which, docs_):
            c = np.where((count[k] == 1) & (low[first[k]] == own), 0, count[k])
            r = ragged(first[k], c)
            rows.append({"chunk": x[0], "shard": x[1], "kind": 1, "a": c.astype(np.uint8).tobytes(), "b": length[r].astype(np.uint8).tobytes(), "c": low[r].tobytes()})
        return pa.Table.from_pylist(rows, BACK)

    def remove(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return OUT.empty_table()
        _, ids, seg, some, which, least, _, _ = candidates(table, back)
        told = sorted((s, a, b, c) for s, k, a, b, c in zip(*(back.column(x).to_pylist() for x in ("shard", "kind", "a", "b", "c"))) if k == 1)
        count = np.frombuffer(b"".join(x[1] for x in told), np.uint8).astype(np.int64)
        length = np.frombuffer(b"".join(x[2] for x in told), np.uint8).astype(np.int64)
        low = np.frombuffer(b"".join(x[3] for x in told), np.int64)
        first = np.cumsum(count) - count
        doc = compare_ids(ids)[seg.doc]
        skip = np.concatenate(([0], np.cumsum(length)))  # windows before each run
        plain = some[count[which] == 0]
        gone = least[which[count[which] == 0]] < doc[plain]
        begin, many = [seg.at[plain][gone]], [seg.windows[plain][gone]]
        mixed, w = some[count[which] > 0], which[count[which] > 0]
        r = ragged(first[w], count[w])
        owner = np.repeat(np.arange(len(mixed)), count[w])
        gone = low[r] < doc[mixed][owner]
        begin.append((seg.at[mixed][owner] + skip[r] - skip[first[w]][owner])[gone])
        many.append(length[r][gone])
        begin, many = np.concatenate(begin), np.concatenate(many)
        total = len(seg.raw) - 64
        mark = np.zeros(total + 1, np.int32)
        np.add.at(mark, begin, 1)
        np.subtract.at(mark, begin + many + LENGTH - 1, 1)
        mask = np.cumsum(mark, out=mark)[:total] > 0
        del mark
        opens = mask.copy()
        opens[1:] &= ~mask[:-1]
        inner = seg.starts[seg.starts < total]
        opens[inner] = mask[inner]

        def within(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(total + 1, np.int32)
            np.cumsum(flags, out=sums[1:])
            return (sums[seg.ends] - sums[seg.starts]).astype(np.int64)

        removed, runs = within(mask), within(opens)
        b = np.frombuffer(seg.raw, np.uint8)
        kept = [seg.raw[s:e] if not k else b[s:e][~mask[s:e]].tobytes() for s, e, k in zip(seg.starts.tolist(), seg.ends.tolist(), removed.tolist())]
        return pa.table([pa.array(ids, pa.int64()), pa.array(kept, pa.binary()), pa.array(seg.ends - seg.starts), pa.array(removed), pa.array(runs)], schema=OUT)

    sent = d.groupBy("chunk").applyInArrow(lean(send), "shard int, chunk int, keys binary, many binary")
    back = "chunk int, shard int, kind int, a binary, b binary, c binary"
    hits = sent.repartition(tasks(n), "shard").groupBy("shard").applyInArrow(lean(shared), back)
    segments = d.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(lean(spread), "shard int, chunk int, text binary, size binary, off binary, docs binary")
    told = segments.repartition(tasks(n), "shard").groupBy("shard").applyInArrow(lean(compare), back)
    return d.groupBy("chunk").cogroup(hits.unionAll(told).groupBy("chunk")).applyInArrow(lean(remove), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


SENT = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])
BACK = pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
SEGMENTS = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("text", pa.binary()), ("size", pa.binary()), ("off", pa.binary()), ("docs", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
