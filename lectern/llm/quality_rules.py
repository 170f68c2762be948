"""Operator 1: quality rules. Robust multivariate outliers by minimum covariance determinant.

Every document gives a vector of transformed statistics. A location and scatter are estimated by the minimum covariance determinant
for each language and source, for each language and for all documents, side by side: from three deterministic starts (quartile ranges; correlations of
squashed scores; all rows) concentration steps keep the share ``H_SHARE`` of rows nearest in Mahalanobis distance and re-estimate from these,
until the logarithm of the determinant falls by less than ``LEAST_FALL`` (``MOST_STEPS`` at most); the start with the least determinant counts. Every group is then
drawn towards its language and every language towards all, as if ``PRIOR`` rows of the larger group were added, so small groups
lean on their language without a bound where the rule changes. Rows within the chi-square 97.5% point give the final estimates in the same way.
A document is rejected where its squared distance exceeds ``CUTOFF``.

A step is one aggregation: rows are summed by (group, start, distance bin), partly before the shuffle, and the
nearest bins that hold the share are added up, so no group ever meets in one task, whatever its size.
Bins are 1/16 of an octave wide; the last bin is taken whole.

Defined results: null text counts as empty (all statistics 0, base_failed). A null language or source is a
group of its own, apart from the empty one. Documents that fail the base rules don't take part in estimates. Repeated
rows and ids give a row each. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_rows, keyed, materialize, table, trimmed

FEATURES = ("word_length", "symbols", "duplicate_lines", "repeats", "capitals", "punctuation", "digits", "variety")
P = len(FEATURES)
#: Smallest spread that counts, by feature: what chance alone moves a clean text of some fifty words by.
FLOOR = np.array([0.06, 0.10, 0.25, 0.15, 0.06, 0.10, 0.10, 0.03])
H_SHARE, MOST_STEPS, LEAST_FALL, PRIOR = 0.75, 30, 1e-3, 50.0
#: Squared distance beyond which a document is rejected: about two in 100,000 for a normal vector of 8.
CUTOFF = 36.0
_CHI2_975 = 17.534546  # of 8 degrees of freedom

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>"
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _SYMBOL)


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more, first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(seen) + ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(key, twice)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def statistics(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, *features) of a whole text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, _SYMBOL))
    lines, seen, dup = 0, set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    again = repeated_words(words)
    if not n:
        return (0, 0, symbols, 0, 0, *[0.0] * P)
    share = lambda drop: (len(data) - len(data.translate(None, drop))) / chars
    return (
        n, chars, symbols, dup, again,
        math.log(chars / n), math.sqrt(symbols / n), math.sqrt(dup / lines), math.sqrt(again / n),
        math.sqrt(share(_UPPER)), math.sqrt(share(_PUNCT) * chars / n), math.sqrt(share(_DIGIT)),
        math.log(len(set(words)) + 1) / math.log(n + 1),
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@trimmed
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t.as_py()) for t in b.column(1)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * (len(_COUNTS) + P)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), b.column(3), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.float64()) for c in cols[5:])],
            names=["doc_id", "lang", "source", *_COUNTS, *(f"x{i}" for i in range(P))],
        )


def measure(docs: DataFrame) -> DataFrame:
    schema = "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", " + ", ".join(f"x{i} double" for i in range(P))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(_measure, schema).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def _gammp(a: float, x: float) -> float:
    term = total = 1 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def consistency(share: float) -> float:
    """What a scatter of the nearest ``share`` of normal rows is multiplied by."""
    lo, hi = 1e-6, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gammp(P / 2, mid / 2) < share else (lo, mid)
    return share / _gammp(P / 2 + 1, lo / 2)


def whitener(cov: np.ndarray) -> list[float]:
    """Lower triangle, row by row, of the inverse Cholesky factor of the scatter with the floors added."""
    inv = np.linalg.inv(np.linalg.cholesky(cov + np.diag(FLOOR**2)))
    return [float(inv[i, j]) for i in range(P) for j in range(i + 1)]


def _log_determinant(cov: np.ndarray) -> float:
    return float(np.linalg.slogdet(cov + np.diag(FLOOR**2))[1])


_FITTED = "n bigint, k double, mu array<double>, cov array<double>, w array<double>, logdet double"
_NAMES = [x.split()[0] for x in _FITTED.split(", ")]


def _fitted(n: int, k: float, mu: np.ndarray, cov: np.ndarray) -> tuple:
    return int(n), float(k), mu.tolist(), cov.ravel().tolist(), whitener(cov), _log_determinant(cov)


def _per_row(keys: str, make):
    """mapInPandas over rows of groups: the keys and what ``make`` gives for each row."""
    names = [x.split()[0] for x in keys.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([(*(r[c] for c in names), *make(r)) for r in pdf.to_dict("records")], columns=[*names, *_NAMES])

    return lambda df: df.mapInPandas(run, f"{keys}, {_FITTED}")


_MOMENTS = [*((f"s{i}", lambda i=i: F.col(f"x{i}")) for i in range(P)), *((f"s{i}_{j}", lambda i=i, j=j: F.col(f"x{i}") * F.col(f"x{j}")) for i in range(P) for j in range(i, P))]


def _sums() -> list:
    return [F.sum(f()).alias(c) for c, f in _MOMENTS]


def _moments(r: dict) -> tuple[np.ndarray, np.ndarray]:
    m = np.array([r[f"s{i}"] for i in range(P)]) / r["k"]
    cov = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(P)] for i in range(P)]) / r["k"] - np.outer(m, m)
    w, v = np.linalg.eigh(cov)
    return m, (v * np.maximum(w, 0)) @ v.T


def _solve(factor: float, keys: str):
    def make(r: dict) -> tuple:
        m, cov = _moments(r)
        return _fitted(r["n"], r["k"], m, factor * cov)

    return _per_row(keys, make)


def _distance(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with d2; the side of the parameters holds a row for each group and start, and Spark picks the join by its size."""
    joined = rows.join(params, "grp", how)
    total = F.lit(0.0)
    for i in range(P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col("w")[i * (i + 1) // 2 + j] * (F.col(f"x{j}") - F.col("mu")[j])
        total = total + y * y
    return joined.withColumn("d2", total).drop("mu", "w")


def _leveled(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``good`` once with the group of all, and with the groups of its language and of its language and source."""
    x = [f"x{i}" for i in range(P)]
    return good.select(F.lit("*").alias("grp"), *x), good.select(F.explode(F.array("language", "grp")).alias("grp"), *x)


def _both(levels: tuple[DataFrame, DataFrame], params: DataFrame) -> DataFrame:
    """Rows with their distances; the few rows for the group of all are broadcast, as all rows join them."""
    whole = params.where("grp = '*'").limit(3)
    return _distance(levels[0], F.broadcast(whole)).unionByName(_distance(levels[1], params.where("grp <> '*'")))


def _starts(levels: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Three starts for each group: 0 from quartile ranges, 1 with the correlations of scores squashed by tanh, 2 from all rows."""
    quarters = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(P)]
    every = levels[0].unionByName(levels[1])
    by = materialize(every.groupBy("grp").agg(F.count("*").alias("n"), *quarters, *_sums()), "op1-quarters")
    narrow = by.select("grp", *(F.col(f"q{i}") for i in range(P)))
    z = lambda i: F.tanh((F.col(f"x{i}") - F.col(f"q{i}")[1]) / (F.col(f"q{i}")[2] - F.col(f"q{i}")[0] + float(FLOOR[i])))
    met = levels[0].join(F.broadcast(narrow.where("grp = '*'").limit(1)), "grp").unionByName(levels[1].join(narrow.where("grp <> '*'"), "grp"))
    squashed = met.groupBy("grp").agg(*(F.sum(z(i) * z(j)).alias(f"t{i}_{j}") for i in range(P) for j in range(i, P)))

    def make(r: dict) -> tuple:
        q = np.array([r[f"q{i}"] for i in range(P)])
        mu, spread = q[:, 1], (q[:, 2] - q[:, 0]) / 1.349
        if r["start"] == 2:
            mu, cov = _moments(r | {"k": r["n"]})
        elif r["start"] == 1:
            t = np.array([[r[f"t{min(i, j)}_{max(i, j)}"] for j in range(P)] for i in range(P)]) + 1e-9 * np.eye(P)
            spread = spread + FLOOR
            cov = t / np.sqrt(np.outer(np.diag(t), np.diag(t))) * np.outer(spread, spread)
        else:
            cov = np.diag(spread**2)
        n, k, mu, cov, w, _ = _fitted(r["n"], r["n"], mu, cov)
        return n, k, mu, cov, w, float("inf")

    return _per_row("grp string, start int", make)(by.join(squashed, "grp").withColumn("start", F.explode(F.array(*map(F.lit, range(3))))))


def _concentrate(levels: tuple[DataFrame, DataFrame], params: DataFrame) -> DataFrame:
    binned = _both(levels, params.select("grp", "start", "n", "mu", "w")).withColumn("bin", F.floor(16 * F.log2(F.col("d2") + 1e-6)).cast("int"))
    sums = binned.groupBy("grp", "start", "n", "bin").agg(F.count("*").alias("k"), *_sums())
    before = F.coalesce(F.sum("k").over(Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = sums.withColumn("before", before).where(F.col("before") < H_SHARE * F.col("n"))
    return _solve(consistency(H_SHARE), "grp string, start int")(near.groupBy("grp", "start", "n").agg(F.sum("k").alias("k"), *(F.sum(c).alias(c) for c, _ in _MOMENTS)))


def estimates(good: DataFrame) -> DataFrame:
    """The minimum covariance determinant estimate of each group of ``good`` (grp, language, x0, ...): the best of its starts."""
    levels = _leveled(good)
    state = materialize(_starts(levels).withColumn("done", F.lit(False)), "op1-start")
    for _ in range(MOST_STEPS):
        moved = _concentrate(levels, state.where("not done")).select("grp", "start", F.struct(*_NAMES).alias("new"))
        better = F.col("new").isNotNull() & (F.col("new.logdet") < F.col("logdet") - LEAST_FALL)
        state = state.join(moved, ["grp", "start"], "left").select("grp", "start", *(F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in _NAMES), (~better).alias("done"))
        state = materialize(state, "op1-step")
        if state.where("not done").isEmpty():
            break
    return state.groupBy("grp").agg(F.min_by(F.struct(*_NAMES), F.struct("logdet", "start")).alias("best")).select("grp", "best.*")


def _drawn(own: DataFrame, above: DataFrame, on: str) -> DataFrame:
    """``own`` drawn towards the groups above (their name in column ``on``), as if PRIOR of their rows were added."""

    def make(r: dict) -> tuple:
        share = r["k"] / (r["k"] + PRIOR)
        mu = share * np.array(r["mu"]) + (1 - share) * np.array(r["up_mu"])
        cov = share * np.array(r["cov"]) + (1 - share) * np.array(r["up_cov"])
        return _fitted(r["n"], r["k"], mu, cov.reshape(P, P))

    return _per_row("grp string, language string", make)(own.join(above.select(F.col("grp").alias(on), F.col("mu").alias("up_mu"), F.col("cov").alias("up_cov")), on))


def _shrunk(fitted: DataFrame, groups: DataFrame) -> DataFrame:
    """Final estimates of the groups (grp, language) from those of all levels."""
    whole = fitted.where("grp = '*'")
    tongues = fitted.join(groups.select(F.col("language").alias("grp")).distinct(), "grp").withColumns({"language": F.col("grp"), "up": F.lit("*")})
    tongues = materialize(_drawn(tongues, whole, "up").drop("language"), "op1-languages")
    return materialize(_drawn(fitted.join(groups, "grp"), tongues, "language"), "op1-groups")


def assess(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row for each document: counts, base_failed, kept, distance2 (null where its group has no document that passes the base rules)."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    named = measure(docs).withColumn("language", F.concat(F.lit("l"), name("lang")))
    rows = materialize(named.withColumn("grp", F.concat(F.lit("s"), F.col("language"), F.lit("\x1f"), name("source"))).drop("lang", "source"), "op1-stats")
    good = rows.where("not base_failed").select("grp", "language", *(f"x{i}" for i in range(P)))
    groups = materialize(good.select("grp", "language").distinct(), "op1-names")
    params = _shrunk(estimates(good), groups)
    near = _distance(good, params.select("grp", "mu", "w")).where(F.col("d2") <= _CHI2_975).groupBy("grp", "language").agg(F.count("*").alias("k"), *_sums())
    near = materialize(near, "op1-near")
    add = [F.sum(c).alias(c) for c in ("k", *(c for c, _ in _MOMENTS))]
    columns = ["grp", "k", *(c for c, _ in _MOMENTS)]
    levels = near.select(*columns).unionByName(near.groupBy(F.col("language").alias("grp")).agg(*add)).unionByName(near.agg(*add).withColumn("grp", F.lit("*")).where("k > 0"))
    again = materialize(_solve(consistency(0.975), "grp string")(levels.withColumn("n", F.col("k"))), "op1-final")
    # a group none of whose rows is near has its language's estimate
    alone = groups.join(again.select("grp"), "grp", "left_anti")
    final = _shrunk(again, groups.join(again.select("grp"), "grp", "left_semi"))
    tongue = again.join(groups.select(F.col("language").alias("grp")).distinct(), "grp").select(F.col("grp").alias("language"), "mu", "w")
    final = final.select("grp", "mu", "w").unionByName(alone.join(tongue, "language").select("grp", "mu", "w"))
    out = _distance(rows, final, "left")
    return out.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"), F.col("d2").alias("distance2"))


def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, all their columns as they were."""
    rows = keyed(docs, "op1-rows")
    found = assess(rows.select(F.col("__row").alias("doc_id"), "__doc.text", "__doc.lang", "__doc.source"))
    return drop_rows(rows, found.where("not kept").select("doc_id"))
