"""Operator 8: mixing sources to target weights by Poisson replication.

Each document is repeated by a Poisson count whose mean is its source's repetition rate
(target share * budget / documents of the source). The count comes from inverting the Poisson distribution at
a uniform number hashed from the seed and the id, so any row can be recomputed anywhere. A rate over ``MOST_RATE`` is split into equal parts
of at most that, each with a uniform number of its own (hashed with the part's number from the second on): their sum is Poisson with the whole rate. Copies are dealt out
by a hash of seed, id and copy, which is also the order inside the partitions: a global shuffle.

Target shares default to the temperature rule share ~ documents ** ``ALPHA`` and the budget to the number of
documents; both are parameters. The rates, a row for each source, are written to shared storage and joined by their measured
size: broadcast while they are under Spark's threshold, sorted beyond it.

Defined results: a null source is a source of its own. A null id hashes as an empty id. Rows that repeat an id
get the same count each. A source with target 0 (or none named in ``targets``) has no copies. An empty table
gives an empty result. All columns of the documents are returned, ``replica`` (1, 2, ...) and ``shuffle_key``
are added and replace columns of these names. Empty and null texts are mixed like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table

ALPHA, SEED = 0.5, 42
#: Largest rate that is inverted at once: up to it the distribution beyond ``_TERMS`` copies has under 1e-17.
MOST_RATE = 16.0
_TERMS = 80


def uniform(key: Column) -> Column:
    """52 bits of md5, plus a half step: in (0, 1)."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def _poisson(rate: Column, u: Column) -> Column:
    """Smallest k whose cumulative probability reaches u."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))
    step = lambda s, i: F.when(s["c"] >= u, s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["p"] * rate / i).alias("p"), (s["c"] + s["p"] * rate / i).alias("c")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, step, lambda s: s["k"])


def _copies(rate: Column, ident: Column) -> Column:
    """A Poisson count of any rate: the sum of independent ones of at most MOST_RATE."""
    parts = F.greatest(F.ceil(rate / MOST_RATE), F.lit(1)).cast("int")
    own = lambda j: F.when(j == 0, ident).otherwise(F.concat(ident, F.lit(":part:"), j.cast("string")))
    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, j: n + _poisson(rate / parts, uniform(own(j))))


def rates(docs: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """__source, __rate: a row for each source."""
    n = docs.groupBy(F.col("source").alias("__source")).agg(F.count("*").cast("double").alias("n"))
    if targets is None:
        n = n.withColumn("w", F.pow("n", F.lit(alpha)))
    else:
        pairs = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv)) if targets else F.lit(None).cast("map<string,double>")
        n = n.withColumn("w", F.coalesce(F.try_element_at(pairs, F.col("__source")).cast("double"), F.lit(0.0)))
    total = n.agg(F.sum("w").alias("w_all"), F.sum("n").alias("n_all"))
    size = F.col("n_all") if budget is None else F.lit(float(budget))
    return n.join(F.broadcast(total)).select("__source", F.when(F.col("w_all") > 0, F.col("w") / F.col("w_all") * size / F.col("n")).otherwise(0.0).alias("__rate"))


def replicate(docs: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    docs = docs.drop("replica", "shuffle_key")
    rate = materialize(rates(docs, targets, budget, alpha), "op8-rates")  # written, so the join is picked by its measured size and texts stay where they are
    ident = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("__doc.doc_id").cast("string"), F.lit("")))
    copies = _copies(F.col("__rate"), ident)
    # one row whose fields are the document, so no column of it can clash with ours
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"))
    counted = own.join(rate, F.col("__doc.source").eqNullSafe(rate["__source"])).withColumn("__n", copies).where("__n > 0")
    out = counted.select("__doc", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("replica"))
    key = F.md5(F.concat_ws(":", ident, F.col("replica").cast("string")).cast("binary"))
    return out.select("__doc.*", "replica", key.alias("shuffle_key")).repartition(shuffle_partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return replicate(docs)


#: Body over a relation {docs} with the columns of documents: a Poisson count of any rate is the sum of those of equal parts of at most 16.
SQL = """
WITH n AS (SELECT source, count(*)::DOUBLE AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM {docs} GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
p AS (SELECT d.*, greatest(ceil(rate / 16.0), 1)::INT AS parts, rate / greatest(ceil(rate / 16.0), 1) AS lam, '42:' || coalesce(doc_id::VARCHAR, '') AS ident
      FROM {docs} d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
u AS (SELECT p.*, list_transform(range(0, parts), lambda j:
        (('0x' || substr(md5(ident || CASE WHEN j = 0 THEN '' ELSE ':part:' || j::VARCHAR END), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS us,
        list_transform(range(0, 80), lambda i: list_sum(list_transform(range(0, i + 1), lambda j: exp(-lam + j * ln(lam) - lgamma(j + 1))))) AS cdf FROM p),
k AS (SELECT u.* EXCLUDE (parts, lam, ident, us, cdf), ident, list_sum(list_transform(us, lambda u: len(list_filter(cdf, lambda c: u > c)))) AS copies FROM u)
SELECT k.* EXCLUDE (copies, ident), replica::INT AS replica, md5(ident || ':' || replica::VARCHAR) AS shuffle_key
FROM k, LATERAL (SELECT unnest(range(1, copies::BIGINT + 1)) AS replica)
"""
ORACLE = SQL.format(docs="documents")
