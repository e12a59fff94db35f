from pyspark.sql import functions as F

from tessella.operators import elementwise as e
from tessella.operators import reduce as r
from tessella.sources import arrays as a
from tessella.streaming import seq


def test_sequences(spark):
    m = a.enum_from_n(spark, (3, 4), 0)
    rows = seq.to_seq_outer2(m)
    assert [a.to_list(x) for x in seq.map_seq(r.sum, rows)] == [[6], [22], [38]]
    assert a.to_list(seq.fold_seq(lambda x, y: x + y, F.lit(100).cast("long"), seq.map_seq(r.sum, rows))) == [166]
    states = [a.to_list(x)[0] for x in seq.scan_seq(lambda x, y: x + y, F.lit(0).cast("long"), seq.generate_seq(spark, 3, lambda i: i))]
    assert states == [0, 0, 1, 3]
    both = seq.zip_with_seq(lambda x, y: e.zip_with(lambda p, q: p - q, x, y), rows, seq.to_seq_inner(m))
    assert [len(a.to_list(x)) for x in both] == [3, 3, 3]
    shapes, elems = seq.from_seq(seq.to_seq(m, 1, 3))
    assert shapes == [(3, 3), (3, 1)] and a.to_list(elems) == [0, 1, 2, 4, 5, 6, 8, 9, 10, 3, 7, 11]
    total = seq.fold_seq_flatten(lambda acc, ext, v: e.zip_with(lambda p, q: p + q, acc, r.sum(v)), a.unit(spark, F.lit(0).cast("long")), rows, chunk=2)
    assert a.to_list(total) == [66] and len(seq.collect(rows)) == 3
    assert a.to_list(next(iter(seq.stream_in([m])))) == list(range(12))


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.range(4 * k, 4 * k + 4).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("x")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = seq.read_stream(spark, str(tmp_path / "in"), "k long, t long, x double")
    total = seq.collect_stream(seq.fold_stream(seq.map_stream(lambda d: d.where("x > 0"), df), [], s=F.sum("x")), "fold_total", str(tmp_path / "c1"), "complete")
    assert total.first()[0] == 66
    run = seq.collect_stream(seq.scan_stream(df, "k", "t", "x", lambda p, q: p + q, 0.0), "scan_run", str(tmp_path / "c2"))
    last = {row["k"]: row["m"] for row in run.groupBy("k").agg(F.max("x").alias("m")).collect()}
    assert last == {0: 30.0, 1: 36.0} and run.count() == 12
    seq.drain(df, str(tmp_path / "out"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
