"""Mixing, sharding and the pipeline."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tests.llm.conftest import EDGE, prose

import corpus_pipeline
from tessella.llm import mixing, sharding


def test_period_keeps_lags_below_one_block():
    rng = random.Random(1)
    for _ in range(20):
        q = {k: rng.randint(1, 40) for k in range(rng.randint(1, 9))}
        slots, total = mixing.period(q), sum(q.values())
        assert sorted(t for s in slots.values() for t in s) == list(range(total))
        for c, s in slots.items():
            for t in range(total + 1):
                assert abs(sum(x < t for x in s) - Fraction(t * q[c], total)) < 1


def test_mix(table):
    rng = random.Random(2)
    docs = [(k, f"t{k}", "en", rng.choice(["a"] * 6 + ["b", "b", "c", "z", None])) for k in range(900)]
    weights, block = {"a": 0.5, "b": 0.3, "c": 0.15}, 4
    rows = mixing.mix(table(docs, extra=True), weights, 0.05, block=block, quanta=100).collect()
    assert sorted(r["mix_"]["position"] for r in rows) == list(range(900))
    pools = [r["mix_"]["pool"] for r in sorted(rows, key=lambda r: r["mix_"]["position"])]
    # until the first pool runs out every prefix of whole blocks is within one block of the targets
    left = Counter(pools)
    seen = Counter()
    for t, pool in enumerate(pools, 1):
        seen[pool] += 1
        if any(left[k] - seen[k] < block for k in left):
            break
        if t % block == 0:
            for k, w in [*weights.items(), (None, 0.05)]:
                assert abs(seen[k] - w * t) < block
    assert t > 100
    ordered = mixing.mixed_order(table(docs), weights, 0.05, block, 100)
    assert ordered.columns == table(docs).columns and ordered.count() == 900


def test_plan_after_pools_run_out():
    plan = mixing.Plan.make([10, 3, 0, 25], [5, 3, 1, 1], 4)
    got = np.concatenate([plan.positions(c, np.arange(n))[1] for c, n in ((0, 10), (1, 3), (3, 25))])
    assert sorted(got.tolist()) == list(range(38))


def test_shard(table):
    rng = random.Random(3)
    docs = [(k, prose(rng, rng.randint(1, 300))) for k in range(600)]
    docs += [(1000 + k, docs[k % 20][1]) for k in range(60)] + [(2000 + k, "hot copy of a text") for k in range(400)] + [(3000, None), (3001, "")]
    rows = sharding.shard(table(docs), shards=8).collect()
    text = dict(docs)
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    assert len(rows) == len(docs) and set(by) == set(range(8))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    size = [sum(r["size"] for r in part) for part in by.values()]
    assert max(size) - min(size) < 0.05 * sum(size) / 8
    where: dict = {}
    for r in rows:
        where.setdefault(text[r["doc_id"]] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in where.items() if t != "hot copy of a text") and len(where["hot copy of a text"]) > 1


def test_every_group_is_packed(table):
    """With few groups to a task as with many; against packing by hand where one task has them all."""
    rng = random.Random(5)
    docs = [(k, prose(rng, rng.randint(1, 80))) for k in range(500)] + [(1000 + k, prose(random.Random(k % 9), 30)) for k in range(90)]
    size = sorted({t: 0 for _, t in docs})
    for each in (1 << 14, 60):
        rows = sharding.shard(table(docs), shards=5, fine=1, each=each).collect()
        load = Counter()
        for r in rows:
            load[r["shard"]] += r["size"]
        assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 5
        assert max(Counter(r["shard"] for r in rows).values()) < 1.1 * len(rows) / 5
    text = dict(docs)
    digest = {t: xxhash.xxh3_128_digest(t.encode()) for t in size}
    order = sorted(size, key=digest.get)
    many = Counter(text.values())
    vectors = np.array([[many[t] * (len(t.encode()) + 16), many[t] * len(t.split()), many[t]] for t in order], float)
    want = dict(zip(order, sharding.pack(vectors, 5)))
    got = {text[r["doc_id"]]: r["shard"] for r in sharding.shard(table(docs), shards=5, fine=1).collect()}
    assert got == want


def test_pack_by_definition():
    """Each item, largest first, against a plain loop over the shards."""
    rng = np.random.default_rng(3)
    items = rng.integers(1, 100, (60, 3)).astype(float)
    share, left, want = items / items.sum(axis=0) * 4, [[1.0] * 3 for _ in range(4)], {}
    for k in sorted(range(60), key=lambda k: (max(share[k]), *share[k]), reverse=True):
        fit = [s for s in range(4) if all(a >= b - 1e-12 for a, b in zip(left[s], share[k]))]
        best = max(fit, key=lambda s: (sum(a * b for a, b in zip(left[s], share[k])), -s)) if fit else max(range(4), key=lambda s: (min(a - b for a, b in zip(left[s], share[k])), -s))
        want[k] = best
        left[best] = [a - b for a, b in zip(left[best], share[k])]
    at = np.array([want[k] for k in range(60)])
    assert sharding.pack(items, 4).tolist() == sharding.even_out(share, at.copy(), 4).tolist()
    assert Counter(at.tolist()).most_common()[0][1] <= 20


def test_slots_follow_an_order(table):
    docs = table([(k % 7 or None, f"text {k % 11}") for k in range(100)]).withColumn("at", F.monotonically_increasing_id())
    places = {r["at"]: p for p, r in enumerate(docs.orderBy("at").collect())}
    assert len(places) == 100
    rank = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])[F.col("at")]
    rows = sharding.shard(docs, shards=3, order=rank).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 100 and all(sorted(s) == list(range(len(s))) for s in by.values())


def brute_mix(counts, shares, block):
    """Rank of each row of each pool to position, slot by slot."""
    left = {c: -(-n // block) for c, n in enumerate(counts) if n}
    used, out, base = dict.fromkeys(left, 0), {}, 0
    while left:
        total, done, t = sum(shares[c] for c in left), dict.fromkeys(left, 0), 0
        while all(left.values()):
            ready = [c for c in left if done[c] * total // shares[c] <= t]
            c = min(ready, key=lambda c: (-(-(done[c] + 1) * total // shares[c]), c))
            for k in range(used[c] * block, min((used[c] + 1) * block, counts[c])):
                out[c, k] = base
                base += 1
            done[c] += 1
            used[c] += 1
            left[c] -= 1
            t += 1
        left = {c: n for c, n in left.items() if n}
    return out


def test_positions_against_a_simulation():
    rng = random.Random(7)
    for _ in range(30):
        k = rng.randint(1, 6)
        counts, shares, block = [rng.randint(0, 90) for _ in range(k)], [rng.randint(1, 30) for _ in range(k)], rng.randint(1, 5)
        plan, want = mixing.Plan.make(counts, shares, block), brute_mix(counts, shares, block)
        for c, n in enumerate(counts):
            if n:
                assert plan.positions(c, np.arange(n))[1].tolist() == [want[c, r] for r in range(n)]


def test_stored_order_is_the_mixture(spark, table, tmp_path):
    docs = table([(k, f"t{k}", "en", f"s{k % 3}") for k in range(500)], extra=True)
    mixing.mixed_order(docs, {"s0": 0.5, "s1": 0.3}, 0.2, block=4).write.parquet(str(tmp_path / "mixed"))
    want = {r["doc_id"]: r["mix_"]["position"] for r in mixing.mix(docs, {"s0": 0.5, "s1": 0.3}, 0.2, block=4).collect()}
    back = mixing.stored_order(spark.read.parquet(str(tmp_path / "mixed")), "at")
    assert {r["doc_id"]: r["at"] for r in back.collect()} == want
    assert mixing.stored_order(docs, "at") is None


def test_pipeline_of_odd_rows(spark, tmp_path, table):
    rng = random.Random(9)
    a, b, bench = prose(rng, 80), prose(rng, 90), prose(rng, 30)
    rows = [(1, a), (1, b), (2, a), (None, a + " end"), (None, None), (None, ""), (3, prose(rng, 50)), (3, prose(rng, 50)), (4, bench), (5, "x " * 20000)]
    for name, r in (("odd", rows), ("none", [])):
        table(r, extra=True).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    want = [(1, len(a)), (1, len(b)), (3, None), (3, None), (5, 40000), (None, 0)]
    assert sorted((r["doc_id"] or 99) for r in got) == sorted((x or 99) for x, _ in want)
    assert {(r["doc_id"], r["size"] - 16) for r in got} >= {w for w in want if w[1] is not None}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_edges(table):
    docs, none = table(EDGE, extra=True), table([])
    for f in (lambda d: mixing.mix(d, {"src0": 1.0}), lambda d: mixing.mix(d, {}), sharding.shard):
        assert f(docs).count() == len(EDGE) and f(none).count() == 0


def test_pipeline(spark, tmp_path, table):
    rng = random.Random(4)
    clean = [(k, "\n".join(prose(rng, 30) for _ in range(4)), "en", f"src{k % 5}") for k in range(300)]
    bench = prose(rng, 40)
    toxic = [(400 + k, prose(rng, 40) + " you vermin " + prose(rng, 20)) for k in range(60)]
    copies = [(500 + k, clean[k][1], "en", "src1") for k in range(30)] + [(600 + k, clean[k][1].replace(clean[k][1].split()[7], "edited", 1)) for k in range(30, 50)]
    leaked = [(700 + k, prose(rng, 60) + " " + bench + " " + prose(rng, 20)) for k in range(10)]
    table([*clean, *toxic, *copies, *leaked]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(400 <= k < 460)) for k, *_ in [*clean, *toxic]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(300))
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
