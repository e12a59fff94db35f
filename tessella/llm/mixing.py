"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in shuffled order, form blocks. The i-th block of a source with weight w is released at slot
floor((i - 1) / w) and due at ceil(i / w); at every slot the released block with the earliest deadline goes next. One
processor and weights that sum to 1 make earliest-deadline-first optimal, so at any slot a source has had its weight's
share to within less than one block.

Weights are whole quanta, so the schedule repeats after as many slots as there are quanta: one period is computed on
the driver, and every row finds its place in closed form. When a source runs out, the others go on with their weights
renormalised, from a new period; there are at most as many such phases as named sources.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import arrow_udf

from .common import fresh, materialise


def period(quanta: Mapping[int, int]) -> dict[int, list[int]]:
    """Slots of each class in one period of sum(quanta) slots, by earliest deadline among the released blocks; ties go to the lower class."""
    total = sum(quanta.values())
    slots: dict[int, list[int]] = {c: [] for c in quanta}
    waiting = [(0, c, 1) for c in sorted(quanta)]  # release, class, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, c, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * total // quanta[c]), c, i))
        _, c, i = heapq.heappop(ready)
        slots[c].append(t)
        if i < quanta[c]:
            heapq.heappush(waiting, (i * total // quanta[c], c, i + 1))
    return slots


def quantised(weights: list[float], quanta: int) -> list[int]:
    """Whole quanta in proportion to the weights, by largest remainder, at least one for each positive weight."""
    total = sum(weights)
    exact = [w / total * quanta for w in weights]
    out = [max(1, int(x)) for x in exact]
    for k in sorted(range(len(exact)), key=lambda k: int(exact[k]) - exact[k])[: max(0, quanta - sum(out))]:
        out[k] += 1
    return out


@dataclass
class Plan:
    """Where the blocks of each class go: its phases, and what the short last blocks take off later positions."""

    block: int
    starts: dict[int, list[int]] = field(default_factory=dict)  # class: first block of each phase
    bases: dict[int, list[int]] = field(default_factory=dict)  # class: first slot of each phase
    tables: dict[int, list[np.ndarray]] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)  # slots in a period of each phase
    short: list[tuple[int, int]] = field(default_factory=list)  # slot of a short block, rows that it lacks

    @classmethod
    def make(cls, rows: list[int], quanta: list[int], block: int) -> Plan:
        plan, base = cls(block), 0
        left = {c: -(-n // block) for c, n in enumerate(rows) if n > 0}
        used = dict.fromkeys(left, 0)
        for c in left:
            plan.starts[c], plan.bases[c], plan.tables[c] = [], [], []
        while left:
            q = {c: quanta[c] for c in left}
            total, slots = sum(q.values()), period(q)
            plan.lengths.append(total)
            end, _ = min(((k - 1) // q[c] * total + slots[c][(k - 1) % q[c]] + 1, c) for c, k in left.items())
            for c in list(left):
                plan.starts[c].append(used[c])
                plan.bases[c].append(base)
                plan.tables[c].append(np.array(slots[c], np.int64))
                n = end // total * q[c] + int(np.searchsorted(slots[c], end % total))
                used[c] += n
                left[c] -= n
                if not left[c]:
                    del left[c]
            base += end
        last = []
        for c in plan.starts:
            if rows[c] % block:
                last.append((int(plan.slots(c, np.array([rows[c] // block]))[0]), block - rows[c] % block))
        plan.short = sorted(last)
        return plan

    def slots(self, c: int, blocks: np.ndarray) -> np.ndarray:
        phase = np.searchsorted(self.starts[c], blocks, "right") - 1
        out = np.empty(len(blocks), np.int64)
        for p in np.unique(phase):
            m, table = phase == p, self.tables[c][p]
            j = blocks[m] - self.starts[c][p]
            out[m] = self.bases[c][p] + j // len(table) * self.lengths[self.phase_of(c, p)] + table[j % len(table)]
        return out

    def phase_of(self, c: int, p: int) -> int:
        """Every class is there from the first phase on, so its p-th phase is the p-th of all."""
        return p

    def positions(self, c: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot, and position among all rows, of the rows of a class with these ranks."""
        slot = self.slots(c, ranks // self.block)
        at = np.array([s for s, _ in self.short], np.int64)
        less = np.concatenate(([0], np.cumsum([n for _, n in self.short]))).astype(np.int64)
        return slot, slot * self.block + ranks % self.block - less[np.searchsorted(at, slot, "left")]


def dense_rank(rows: DataFrame, group: Column | None, key: Column, ties: list[Column], name: str, n: int, each: int = 1 << 16) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each group in the order of ``key`` (a long, ordered as unsigned) and ``ties``.

    ``group`` must not be null, so that ranking and the join of the counts share one exchange. Ranks come from counts of key ranges, of about ``each`` rows and never fewer than 64 ranges, so a group that holds
    a third of all rows is spread over the cluster.
    """
    bits = max(6, min(40, (max(n, 1) // each).bit_length()))
    g, b, r, s = (fresh(rows, x) for x in ("rank_group", "rank_range", "rank_in", "rank_from"))
    rows = rows.withColumns({g: group if group is not None else F.lit(0), b: F.shiftrightunsigned(key, 64 - bits)})
    counts = rows.groupBy(g, b).agg(F.count("*").alias(r))
    before = counts.select(F.col(g).alias("g"), F.col(b).alias("b"), (F.sum(r).over(W.partitionBy(g).orderBy(b).rowsBetween(W.unboundedPreceding, -1))).alias(s))
    ranked = rows.withColumn(r, F.row_number().over(W.partitionBy(g, b).orderBy(F.shiftrightunsigned(key, 1), key.bitwiseAND(F.lit(1)), *ties)))
    out = ranked.join(before.hint("merge"), (ranked[g] == before["g"]) & (ranked[b] == before["b"]))
    return out.withColumn(name, F.col(r) - 1 + F.coalesce(F.col(s), F.lit(0))).drop(g, b, r, s, before["g"], before["b"])


def shuffled(doc_id: Column) -> Column:
    """The first 15 hex digits of the MD5 of a doc_id's decimal digits, at the top of a long."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.shiftleft(F.conv(digits, 16, 10).cast("long"), 4)


def stored_order(docs: DataFrame, name: str) -> DataFrame | None:
    """``docs`` with ``name``: each row's place in the Parquet files that it is read from, the files in the order in which they were written. None if ``docs`` isn't read from files.

    The files' row counts are summed on one task: a row for each file.
    """
    part, at, past = (fresh(docs, x) for x in ("stored_part", "stored_at", "stored_past"))
    try:
        rows = docs.withColumns({part: F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"), at: F.col("_metadata.row_index")})
    except AnalysisException:
        return None
    sizes = rows.groupBy(part).agg(F.count("*").alias(past))
    before = sizes.select(F.col(part).alias("p"), F.coalesce(F.sum(past).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(past))
    met = rows.join(F.broadcast(before), F.col(part) == F.col("p"))  # as many rows as files, which the driver lists anyway
    return met.select(*[docs[c] for c in docs.columns], (F.col(past) + F.col(at)).alias(name))


def mix(docs: DataFrame, targets: Mapping[str, float], rest: float = 0.0, block: int = 32, quanta: int = 1000) -> DataFrame:
    """``docs`` with a struct column mix (pool, block, slot, position); an underscore is appended where that name is taken.

    ``targets`` holds the weight of each named source (a parameter, so of bounded number); all other sources, null
    among them, share the pool of weight ``rest`` (of 0: the least weight there is). Every row is kept and has its own
    position, 0 to rows - 1. Rows of a pool are shuffled by the MD5 of doc_id (null: of nothing); equal doc_ids are told apart by their
    text, and wholly equal rows are interchangeable. An empty table gives no rows.
    """
    names = sorted(targets)
    shares = quantised([*(float(targets[k]) for k in names), max(rest, min(targets.values(), default=1.0) / 1000)], quanta)
    pool = F.coalesce(F.create_map(*[x for k, s in enumerate(names) for x in (F.lit(s), F.lit(k))])[F.col("source")], F.lit(len(names))) if names else F.lit(0)
    p = fresh(docs, "mix_pool")
    rows = docs.withColumn(p, pool.cast("int"))
    found = {r[0]: r[1] for r in rows.groupBy(p).count().collect()}  # a row for each named source, and one
    counts = [found.get(k, 0) for k in range(len(names) + 1)]
    plan = Plan.make(counts, shares, block)
    rank = fresh(rows, "mix_rank")
    ranked = dense_rank(rows, F.col(p), shuffled(F.col("doc_id")), [F.col("doc_id"), F.xxhash64("text")], rank, sum(counts))

    @arrow_udf("struct<slot: long, position: long>")
    def place(pools: pa.Array, ranks: pa.Array) -> pa.Array:
        c, k = pools.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        slot, pos = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
        for x in np.unique(c):
            m = c == x
            slot[m], pos[m] = plan.positions(int(x), k[m])
        return pa.StructArray.from_arrays([pa.array(slot), pa.array(pos)], ["slot", "position"])

    at = fresh(ranked, "mix_at")
    ranked = ranked.withColumn(at, place(p, rank))
    label = F.element_at(F.array(*[F.lit(s) for s in names], F.lit(None).cast("string")), F.col(p) + 1)
    made = F.struct(label.alias("pool"), F.floor(F.col(rank) / block).cast("long").alias("block"), F.col(f"{at}.slot").alias("slot"), F.col(f"{at}.position").alias("position"))
    return ranked.select(*[F.col(f"`{c}`") for c in docs.columns], made.alias(fresh(docs, "mix")))


def mixed_order(docs: DataFrame, targets: Mapping[str, float], rest: float = 0.0, block: int = 32, quanta: int = 1000) -> DataFrame:
    """``docs`` itself, in the order of the mixture."""
    m = fresh(docs, "mix")
    done = mix(docs, targets, rest, block, quanta)
    return done.orderBy(F.col(f"{m}.position")).drop(m)
