"""Quality rules: base rules, then robust multivariate outliers per language and source.

Each text's statistics become a vector: the logarithm of the mean word length, and square roots of the shares of
symbols, duplicate lines and repeated words (square roots make the noise of a count the same at every rate). For all rows, every
language and every (language, source) a minimum-covariance-determinant estimate is found among the rows that pass the
base rules: of all subsets of three quarters of the rows that whose covariance has the least determinant. Concentration
steps go on from several starts until nothing changes, and the least determinant of all wins. Rows far from the
estimate, by Mahalanobis distance, are rejected.

An estimate rests on its rows and on ``PRIOR`` rows' weight of its parent's estimate (a source's is its language's, a language's
is that of all rows), so small groups lean on their language by degrees, without a size at which the model changes. What one
event more in a text (a symbol, a duplicate line, a repeated window, a letter) does to the statistics, on average over
the group, is added to the covariance as the noise of measurement; it is no other floor.

No group of rows is ever gathered: rows are pre-aggregated to the cells of a fixed grid (counts, sums and products),
``LEVELS`` cells at most for a group of any size, and the estimate is found over whole cells in one task a group.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fresh, materialise, utf8

SPACES = b" \t\n\r\x0b\x0c"
#: All bytes but the first of each code point that isn't white space.
NOT_IN_WORDS = bytes(range(0x80, 0xC0)) + SPACES
SYMBOLS = b"#*$%&|<>"
DIMS = 4
#: 1 - 1e-6 quantile of chi-square with 4 degrees of freedom.
CUT = 33.377
#: Share of the rows that the estimate rests on, and what makes the covariance of that share consistent for normal rows.
SHARE, CONSISTENT = 0.75, 1.4869
#: Rows' weight of the parent's estimate.
PRIOR = 40.0
#: The grid: width of a cell and number of cells in each dimension. Values beyond it are in its last cells; sums are exact everywhere.
GRID = ((1 / 128, 1024), (1 / 16, 16), (1 / 8, 8), (1 / 8, 8))
LEVELS = math.prod(n for _, n in GRID)
RANDOM_STARTS, BEST = 24, 6

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
STATS = "struct<" + ", ".join(f"{c}: long" for c in FIELDS) + ">"


def statistics(raw: bytes) -> tuple[int, int, int, int, int, int]:
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n - 2:
            often = Counter(windows)
            at = np.flatnonzero(np.fromiter((often[x] > 1 for x in windows), bool, n - 2))
            covered = np.zeros(n, bool)
            covered[at] = covered[at + 1] = covered[at + 2] = True
            repeated = int(covered.sum())
    return n, len(raw.translate(None, NOT_IN_WORDS)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def _stats(text: pa.Array) -> pa.Array:
    rows = np.array([statistics(x) for x in utf8(text)], np.int64).reshape(-1, len(FIELDS))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(FIELDS))], list(FIELDS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics x0 to x3. The mean word length is drawn to 5 by 100 words' weight, so that short texts don't vary more than long ones."""
    n = F.col("n_words")
    return [
        F.log2((F.col("word_chars") + 500) / (n + 100)).alias("x0"),
        F.sqrt(F.col("n_symbols") / (n + 20)).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 3)).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / (n + 50)).alias("x3"),
    ]


def noise() -> list[Column]:
    """The squares of what one event more does to x0 to x3: a letter, a symbol, a duplicate line, a window of three words that is there twice."""
    n = F.col("n_words")
    return [
        F.pow(1 / (math.log(2) * (F.col("word_chars") + 500)), F.lit(2.0)).alias("v0"),
        (1 / (n + 20)).alias("v1"),
        (1 / (F.col("n_lines") + 3)).alias("v2"),
        (6 / (n + 50)).alias("v3"),
    ]


PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
X = [f"x{i}" for i in range(DIMS)]
V = [f"v{i}" for i in range(DIMS)]
SUMS = [*(f"s{i}" for i in range(DIMS)), *(f"s{i}{j}" for i, j in PAIRS), *(f"n{i}" for i in range(DIMS))]


def cells(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, cell, w, sums) of ``rows`` (keys, x0 to x3, v0 to v3): counts and sums in each cell of the grid."""
    place = F.lit(0)
    for x, (width, count) in zip(X, GRID):
        place = place * count + F.least(F.greatest(F.floor(F.col(x) / width), F.lit(0)), F.lit(count - 1))
    sums = [*(F.sum(x) for x in X), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in PAIRS), *(F.sum(v) for v in V)]
    return rows.groupBy(*keys, place.cast("long").alias("cell")).agg(F.count("*").cast("double").alias("w"), *[x.alias(c) for x, c in zip(sums, SUMS)])


class Prior:
    """``weight`` rows with this mean, covariance (of a subset, without noise) and noise."""

    def __init__(self, weight: float, mean: np.ndarray, cov: np.ndarray, noise: np.ndarray) -> None:
        self.weight, self.mean, self.cov, self.noise = weight, mean, cov, noise


NONE = Prior(0.0, np.zeros(DIMS), np.zeros((DIMS, DIMS)), np.zeros(DIMS))


def mcd(w: np.ndarray, mean: np.ndarray, cov: np.ndarray, noise: np.ndarray, prior: Prior = NONE, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, raw covariance and log-determinant of the subset of ``share`` of the rows that has the least determinant.

    Rows come in cells: ``w`` rows with a mean and a covariance each (one row with covariance zero is a cell too). A subset takes
    whole cells, nearest first, and of the last one a part. The determinant is that of the covariance of the subset
    and the prior's rows, plus the noise. A concentration step never makes it larger, and each start goes on until it
    stays the same.
    """
    h = share * w.sum()
    total = h + prior.weight
    base = np.diag(noise)

    def fit(take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = (take @ mean + prior.weight * prior.mean) / total
        d = mean - m
        s = np.einsum("k,kij->ij", take, cov) + (d * take[:, None]).T @ d
        e = prior.mean - m
        return m, (s + prior.weight * (prior.cov + np.outer(e, e))) / total

    def nearest(m: np.ndarray, c: np.ndarray) -> np.ndarray:
        p = np.linalg.inv(c)
        d = mean - m
        far = np.einsum("ki,ij,kj->k", d, p, d) + np.einsum("ij,kij->k", p, cov)
        order = np.argsort(far, kind="stable")
        before = np.cumsum(w[order]) - w[order]
        take = np.empty(len(w))
        take[order] = np.clip(h - before, 0, w[order])
        return take

    def measure(c: np.ndarray) -> float:
        return float(np.linalg.slogdet(c + base)[1])

    def step(state: tuple) -> tuple:
        m, c = fit(nearest(state[0], state[1] + base))
        return m, c, measure(c)

    every = w * share
    whole = fit(every)
    order = [np.argsort(mean[:, i], kind="stable") for i in range(DIMS)]
    middle = np.array([mean[o, i][min(np.searchsorted(np.cumsum(w[o]), w.sum() / 2), len(w) - 1)] for i, o in enumerate(order)])
    spread = np.diag((np.abs(mean - middle) * w[:, None]).sum(axis=0) / w.sum()) ** 2
    starts = [whole, (middle, spread), (middle, np.zeros((DIMS, DIMS))), (mean[np.argmax(w)], np.zeros((DIMS, DIMS)))]
    if prior.weight:
        starts.append((prior.mean, prior.cov))
    rng = np.random.default_rng(len(w))
    chance = w / w.sum()
    for _ in range(RANDOM_STARTS):
        some = rng.choice(len(w), min(DIMS + 1, len(w)), replace=False, p=chance)
        m = mean[some].mean(axis=0)
        starts.append((m, (mean[some] - m).T @ (mean[some] - m) / len(some)))
    states = sorted((step(step((*s, 0.0))) for s in starts), key=lambda s: s[2])[:BEST]
    best = None
    for s in states:
        for _ in range(10000):
            t = step(s)
            if t[2] >= s[2] - 1e-12 * max(1.0, abs(s[2])):
                break
            s = t
        else:
            raise RuntimeError("concentration steps don't end")
        if best is None or s[2] < best[2]:
            best = s
    return best


ESTIMATE = "m array<double>, p array<double>, c array<double>, v array<double>, n double"
_LIST = pa.list_(pa.float64())


def estimate(table: pa.Table, prior: Prior) -> dict[str, list]:
    """The estimate of one group's cells: mean, inverse covariance (upper triangle, off-diagonal ones twice), raw covariance, noise and rows."""
    order = np.argsort(table.column("cell").to_numpy())  # the result doesn't depend on how the cells arrived
    get = lambda c: table.column(c).to_numpy()[order]
    w = get("w")
    mean = np.stack([get(f"s{i}") for i in range(DIMS)], axis=1) / w[:, None]
    cov = np.empty((len(w), DIMS, DIMS))
    for i, j in PAIRS:
        cov[:, i, j] = cov[:, j, i] = get(f"s{i}{j}") / w - mean[:, i] * mean[:, j]
    cov[w == 1] = 0  # but for rounding
    for i in range(DIMS):
        cov[:, i, i] = np.maximum(cov[:, i, i], 0)
    v = (np.array([get(f"n{i}").sum() for i in range(DIMS)]) + prior.weight * prior.noise) / (w.sum() + prior.weight)
    m, c, _ = mcd(w, mean, cov, v / CONSISTENT, prior)
    inv = np.linalg.inv(CONSISTENT * c + np.diag(v))
    return {"m": [m.tolist()], "p": [[float(inv[i, j] * (1 if i == j else 2)) for i, j in PAIRS]], "c": [[float(c[i, j]) for i, j in PAIRS]], "v": [v.tolist()], "n": [float(w.sum())]}


def _prior(m: list[float], c: list[float], v: list[float]) -> Prior:
    cov = np.zeros((DIMS, DIMS))
    for x, (i, j) in zip(c, PAIRS):
        cov[i, j] = cov[j, i] = x
    return Prior(PRIOR, np.array(m), cov, np.array(v))


def _fit(found: DataFrame, key: str) -> DataFrame:
    """(key, estimate) of each group of cells; columns pm, pc and pv are the parent's estimate (null: none)."""

    def run(table: pa.Table) -> pa.Table:
        first = [table.column(c)[0].as_py() for c in ("pm", "pc", "pv")]
        out = estimate(table, _prior(*first) if first[0] else NONE)
        return pa.table({"key": pa.array([table.column(key)[0].as_py()], pa.string()), **{c: pa.array(x, pa.float64() if c == "n" else _LIST) for c, x in out.items()}})

    return materialise(found.groupBy(key).applyInArrow(run, f"key string, {ESTIMATE}"))


def _under(found: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Cells with the estimate of their parent ``key``."""
    return found.join(parents.select(F.col("key").alias(key), F.col("m").alias("pm"), F.col("c").alias("pc"), F.col("v").alias("pv")), key)


def estimates(rows: DataFrame) -> DataFrame:
    """(key, m, p, c, v, n) of each value of ``rows.g1`` (a source within a language), under its ``g0`` (a language), under all rows. ``rows``: g0, g1, x0 to x3, v0 to v3."""
    fine = materialise(cells(rows, "g0", "g1"))
    again = lambda *keys: fine.groupBy(*keys, "cell").agg(*[F.sum(c).alias(c) for c in ("w", *SUMS)])
    none = [F.lit(None).cast("array<double>").alias(c) for c in ("pm", "pc", "pv")]
    root = _fit(again().select(F.lit("all").alias("top"), "*", *none), "top")
    mid = _fit(_under(again("g0").withColumn("top", F.lit("all")), root, "top"), "g0")
    return _fit(_under(fine, mid, "g0"), "g1")


def _distance() -> Column:
    y = [F.col(f"x{i}") - F.element_at("m", i + 1) for i in range(DIMS)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        out = out + F.element_at("p", k + 1) * y[i] * y[j]
    return F.greatest(out, F.lit(0.0))


def _group(*columns: str) -> Column:
    """A name for the values of ``columns``, nulls among them, that no other values have."""
    part = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(c).cast("string"), F.lit(":"), F.col(c)))
    return F.concat(*[part(c) for c in columns])


def quality(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, distance, kept) for each row of ``docs``.

    Null and empty texts have no words, so they fail the base rules; those rows have no distance and no part in any
    estimate. Null languages and sources form groups like any other. Repeated rows count as often as they are there. An empty
    table gives no rows, and a row that alone passes the base rules is kept.
    """
    text = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text, arrow_udf(_stats, STATS)(F.col("text").cast("string")).alias("s"))
    stats = materialise(stats.select("doc_id", "lang", "source", "s.*"))
    x = stats.select("doc_id", *FIELDS, base_failed().alias("base_failed"), _group("lang").alias("g0"), _group("lang", "source").alias("g1"), *vector(), *noise())
    est = estimates(x.where(~F.col("base_failed")).select("g0", "g1", *X, *V)).select(F.col("key").alias("g1"), "m", "p")
    far = F.when(~F.col("base_failed"), _distance()).alias("distance")
    met = x.join(est, "g1", "left").select("doc_id", *FIELDS, "base_failed", far)
    return met.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cut))
