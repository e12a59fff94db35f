"""Documents in chunks of bounded size that exchange packed messages with shards.

A chunk is a hash class of the documents, about ``CHUNK`` bytes of text. It sends each shard of a key space one row of
packed, pre-aggregated keys; the shard's answer comes back to the chunk as one row. So a passage or line that a third
of all documents hold reaches its shard once per chunk, texts are shuffled once, and no row of a join is a line.

A message holds a key at least, so there are never more of them than keys. A task takes several chunks, one after another,
where there are more than ``TASKS`` of them, so neither memory nor the number of tasks grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, documents, utf8

CHUNK = 16 << 20
TASKS = 1 << 15


def tasks(n: int) -> int:
    """Tasks for ``n`` chunks or shards."""
    return min(n, TASKS)


def chunked(docs: DataFrame, size: int = CHUNK) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) partitioned by chunk, and the number of chunks: at least one a core. The same plan wherever it is used, so its exchange is shared."""
    d = documents(docs)
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // size))
    return d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text").repartition(tasks(n), "chunk"), n


def shards(docs: DataFrame, n: int, chunks_each: int) -> int:
    """Shards for the keys of ``n`` chunks, at least one a core."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // chunks_each))


def load(table: pa.Table) -> tuple[int, list[int | None], list[bytes]]:
    """Chunk number, doc_ids and texts, in an order that doesn't depend on how the rows arrived."""
    ids, texts = table.column("doc_id").to_pylist(), utf8(table.column("text"))
    order = sorted(range(len(ids)), key=lambda k: (NO_ID if ids[k] is None else ids[k], texts[k]))
    return table.column("chunk")[0].as_py(), [ids[k] for k in order], [texts[k] for k in order]


def compare_ids(ids: list[int | None]) -> np.ndarray:
    """doc_ids for comparison: null is later than any."""
    return np.array([NO_ID if x is None else x for x in ids], np.int64)


def cuts(shard: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(shard, start, end) of the runs of a sorted array of shard numbers."""
    if len(shard):
        at = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield int(shard[a]), a, b


def shards_of(h: np.ndarray, n: int) -> np.ndarray:
    """Shard of 64-bit hashes by their upper half, so that sorted hashes have sorted shards."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
