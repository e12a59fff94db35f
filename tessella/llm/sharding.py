"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group that stays in one shard, unless it is larger than a shard; then its pieces are items. Largest
first, each group goes to the shard where the dot product of its vector with the residual capacity is highest among those
that it fits. Groups that matter on their own, a bounded number, are packed first, on the driver. All others are
packed by tasks, some thousand groups in each: a task fills its part of the room that the large groups leave in every shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import materialise, utf8
from .mixing import dense_rank

ROW_BYTES = 16


def pack(items: np.ndarray, shards: int, capacity: np.ndarray | None = None) -> np.ndarray:
    """Shard of each item; items are rows of (bytes, tokens, rows). ``capacity`` (shards x 3) is what each shard has left for them, an even share without it.

    Largest first, each item goes to the shard where the dot product of its vector with the residual capacity is highest among those that it
    fits, or where it leaves most if it fits none.
    """
    total = np.maximum(items.sum(axis=0), 1)
    share = items / total * shards  # a shard's even share is 1 in each dimension
    residual = np.ones((shards, items.shape[1])) if capacity is None else capacity / total * shards
    start = residual.copy()
    out = np.empty(len(items), np.int64)
    for k in np.lexsort((*share.T[::-1], share.max(axis=1)))[::-1]:
        v = share[k]
        fits = (residual >= v - 1e-12).all(axis=1)
        best = int(np.argmax(np.where(fits, residual @ v, -np.inf))) if fits.any() else int(np.argmax((residual - v).min(axis=1)))
        out[k] = best
        residual[best] -= v
    return even_out(share, out, shards, offset=start[:, 0].max() - start[:, 0])


def even_out(share: np.ndarray, where: np.ndarray, shards: int, within: float = 1e-3, offset: np.ndarray | float = 0.0) -> np.ndarray:
    """Swaps items of as many rows between the shards of most and fewest bytes until they are ``within`` a share of each other, or no swap helps: each takes at least a thousandth of the gap. ``offset`` is what the shards hold already."""
    load = np.bincount(where, share[:, 0], shards) + offset
    while True:
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        if gap <= within:
            break
        a, b = np.flatnonzero(where == hi), np.flatnonzero(where == lo)
        gain = share[a, 0][:, None] - share[b, 0][None, :]
        off = np.where(np.abs(share[a, 2][:, None] - share[b, 2][None, :]) < 1e-12, np.abs(gain - gap / 2), np.inf)
        if not off.size or off.min() >= gap / 2 * 0.999:
            break
        i, j = np.unravel_index(int(off.argmin()), off.shape)
        where[a[i]], where[b[j]] = lo, hi
        load[hi] -= gain[i, j]
        load[lo] += gain[i, j]
    return where


def shard(docs: DataFrame, shards: int = 40, fine: int = 256, order: Column | None = None, each: int = 1 << 14) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot) for each row of ``docs``.

    size is the UTF-8 bytes of the text plus 16; a null text counts as empty. slot counts from 0 without gaps in each
    shard, in the order of a hash of doc_id, or of ``order`` (a long from 0 for each row) where that is given. Null and repeated
    doc_ids are rows like any other; an empty table gives no rows. Rows with equal texts are in one shard, unless they are over a shard's share.
    """

    @arrow_udf("struct<size: long, tokens: long, crc: long, digest: binary>")
    def facts(text: pa.Array) -> pa.Array:
        raw = utf8(text)
        return pa.StructArray.from_arrays([pa.array([len(x) + ROW_BYTES for x in raw], pa.int64()), pa.array([len(x.split()) for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary())], ["size", "tokens", "crc", "digest"])

    spark = docs.sparkSession
    place = (F.lit(None) if order is None else order).cast("long").alias("place")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), place)
    f = materialise(d.select("doc_id", "place", facts("text").alias("f")).select("doc_id", "place", "f.*"))
    t = f.agg(F.count("*"), F.sum("size"), F.sum("tokens")).first()
    n, whole = t[0], np.array([max(x or 0, 1) for x in (t[1], t[2], t[0])], float)
    groups = f.groupBy("digest").agg(F.sum("size").alias("s"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    share = F.greatest(F.col("s") / float(whole[0]), F.col("t") / float(whole[1]), F.col("r") / float(whole[2])) * shards
    groups = materialise(groups.withColumn("share", share))
    # at most 3 * shards * fine groups have a share of 1 / fine of a shard in some dimension
    large = groups.where(F.col("share") * fine >= 1).select(F.col("digest").alias("g"), F.when(F.col("share") > 1, F.ceil(F.col("share") * 4)).otherwise(1).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("doc_id", "place"), F.col("pieces"))
    own = f.join(F.broadcast(large), F.col("digest") == F.col("g")).withColumn("item", F.concat(F.hex("digest"), F.lit("/"), piece))
    items = own.groupBy("item").agg(F.sum("size").alias("s"), F.sum("tokens").alias("t"), F.count("*").alias("r")).collect()
    items.sort(key=lambda x: x[0])
    vectors = np.array([x[1:] for x in items], float).reshape(-1, 3)
    # items that fill less than the shards leave the rest of each to the small groups
    room = np.tile(whole / shards, (shards, 1))
    where = pack(vectors, shards, room) if len(items) else np.zeros(0, np.int64)
    for k, v in zip(where, vectors):
        room[k] -= v
    schema = T.StructType([T.StructField("i", T.StringType()), T.StructField("shard", T.IntegerType())])
    placed = spark.createDataFrame([(x[0], int(k)) for x, k in zip(items, where)], schema)
    columns = ["doc_id", "place", "size", "tokens", F.col("crc").alias("text_crc32"), "digest", "shard"]
    first = own.join(F.broadcast(placed), F.col("item") == F.col("i")).select(*columns)
    small = groups.where(F.col("share") * fine < 1)
    buckets = -(-max(small.count(), 1) // each)
    left = np.maximum(whole - vectors.sum(axis=0), 1.0)

    def packed(table: pa.Table) -> pa.Table:
        """Shards of the small groups of a bucket, in the room that its share of all small groups gives it."""
        table = table.sort_by("digest")
        v = np.stack([table.column(c).to_numpy() for c in ("s", "t", "r")], axis=1).astype(float)
        shard_ = pack(v, shards, room * (v.sum(axis=0) / left))
        return pa.table({"g": table.column("digest"), "shard": pa.array(shard_, pa.int32())})

    spread = small.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    chosen = materialise(spread.groupBy("bucket").applyInArrow(packed, "g binary, shard int"))
    rest = f.join(chosen.hint("merge"), F.col("digest") == F.col("g")).select(*columns)
    rows = first.unionAll(rest)
    if order is None:
        key = F.xxhash64("doc_id")
    else:
        top = 64 - max(1, n.bit_length())  # spreads the places over the key ranges
        key = F.shiftleft(F.coalesce("place", F.lit(0)), top)
    done = dense_rank(rows, F.col("shard"), key, [F.col("doc_id"), F.col("digest")], "slot", n)
    return done.select("doc_id", "size", "tokens", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
