"""One query for each training-data operator, with production parameters over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, linededup, mixing, quality, sharding, simhash, sql, substringdedup, toxicity, urlfilter

#: Target weights of the mixture: the large source is held down, a few are raised, the rest get an even share.
MIX_TARGETS = {"src0": 0.12, "src1": 0.08, "src2": 0.08, "src3": 0.06, "src4": 0.06} | {f"src{k}": 0.04 for k in range(5, 20)}
MIX_REST = 0.02

#: Score from which a document counts as toxic.
TOXIC = 0.3

URL_RULES = [
    urlfilter.Rule("com", "/en/", "block"),
    urlfilter.Rule("example.com", "/en/7", "allow"),
    urlfilter.Rule("net", "/de/", "allow"),
    urlfilter.Rule("example.net", "/de/8", "block"),
    urlfilter.Rule("org", "/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substringdedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "leak.*")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.line_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.url_verdicts(pages, URL_RULES).select("page_id", "url_filter.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = toxicity.toxicity(docs, _table(spark, sf_dir, "labels"))
    score = F.col("toxicity.score")
    bad = F.filter("toxicity.sentences", lambda s: s["score"] >= TOXIC)
    return done.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= TOXIC, 1).otherwise(0).alias("predicted"), F.transform(bad, lambda s: s["number"]).alias("sentences"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, MIX_TARGETS, MIX_REST).select("doc_id", "source", "mix.*")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(_table(spark, sf_dir, "documents"), shards=40)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = licenses.scan(docs).select("doc_id", "license.*")
    return done.withColumn("notices", F.array_join("notices", ","))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_license_scan": op10_license_scan,
}

_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"

ORACLE: dict[str, str] = {
    "op4_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, least IS NOT NULL AND doc_id <> least AS gone FROM k LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op5_url_filter": f"""
WITH a AS (SELECT page_id, {_REST} AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, '.' || host AS h FROM c),
e AS (SELECT page_id, host, path,
        CASE WHEN h LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
             WHEN h LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
             WHEN h LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
             WHEN h LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
             WHEN h LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM d)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN host LIKE '%casino%' OR host LIKE '%-bets%' OR host LIKE '%cheap-pills%' OR '.' || host LIKE '%.ads-%' THEN 'block'
            ELSE 'allow' END AS verdict
FROM e""",
    "op1_simhash": sql.simhash(),
    "op2_substring_dedup": sql.substring_dedup(),
    "op8_mixing": sql.mixing(MIX_TARGETS, MIX_REST),
    "op10_license_scan": sql.license_scan(),
}
