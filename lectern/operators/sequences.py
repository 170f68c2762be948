"""Concordances, inventories and melodies: facets, division, successors, placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records


def known(c: Column) -> Column:
    """Blank and missing values as "?"."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("?"))


def facets(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(facet, value, n, first): counts of each column's values in one pass over the rows; first: the smallest ``order`` of a value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), known(F.col(c).cast("string")).alias("value")) for c in columns)))
    return rows.select(order, pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"), F.min(order).alias("first"))


def top_facets(counts: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` most frequent values of each facet, earliest first among equals."""
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "first", "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def _wanted(rows: DataFrame, item: str, ids: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The rows with one of the ids (None: with any), and one row with the number of the ids."""
    if ids is not None:
        return rows.where(F.col(item).isin(*ids)), rows.sparkSession.createDataFrame([(len(set(ids)),)], "n_ids bigint")
    rows = rows.where(F.col(item).isNotNull())
    return rows, rows.agg(F.count_distinct(item).alias("n_ids"))


def full_runs(rows: DataFrame, owner: str, item: str, ids: list[str] | None = None) -> DataFrame:
    """Owners that hold every id, or every item there is (relational division); repeated ids count once."""
    own, n = _wanted(rows, item, ids)
    return own.groupBy(owner).agg(F.count_distinct(item).alias("n")).join(F.broadcast(n)).where(F.col("n") == F.col("n_ids")).select(owner)


def held_histogram(rows: DataFrame, owner: str, item: str, ids: list[str] | None = None) -> DataFrame:
    """(n_held, owners): how many owners hold how many of the ids."""
    per = _wanted(rows, item, ids)[0].groupBy(owner).agg(F.count_distinct(item).alias("n_held"))
    return per.groupBy("n_held").agg(F.count("*").alias("owners"))


def missing(rows: DataFrame, owner: str, item: str, ids: list[str] | None = None) -> DataFrame:
    """(item, owners): what owners that lack one id at most lack. An item is lacked by all such owners less those that hold it."""
    own, n = _wanted(rows, item, ids)
    own = own.select(owner, item).distinct()
    close = own.groupBy(owner).agg(F.count("*").alias("k")).join(F.broadcast(n)).where(F.col("k") >= F.col("n_ids") - 1).select(owner)
    every = own.select(item).distinct() if ids is None else rows.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], [item])
    holding = own.join(close, owner).groupBy(item).agg(F.count("*").alias("holding"))
    out = every.join(holding, item, "left").join(F.broadcast(close.agg(F.count("*").alias("all"))))
    return out.select(item, (F.col("all") - F.coalesce("holding", F.lit(0))).alias("owners")).where("owners > 0")


def successors(rows: DataFrame, owner: str, item: str, order: list[str]) -> DataFrame:
    """(item, next, n): what follows what in each owner's sequence. An owner's sequence is one window partition."""
    w = Window.partitionBy(owner).orderBy(*order)
    return rows.withColumn("next", F.lead(item).over(w)).where("next is not null").groupBy(item, "next").agg(F.count("*").alias("n"))


def first_links(rows: DataFrame, owner: str, link: str, order: str) -> DataFrame:
    return rows.groupBy(owner).agg(F.min_by(link, order).alias(link))


def distinct_results(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Results by link: the first row's fields and all queries that found it."""
    rest = [c for c in rows.columns if c not in ("result_url", "retrieved_by")]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("r")
    return rows.groupBy("result_url").agg(first, F.sort_array(F.collect_set("retrieved_by")).alias("retrieved_by")).select("result_url", "r.*", "retrieved_by")


def rollup_status(requests: DataFrame, by: str) -> DataFrame:
    """(by, status, complete, truncated) of requests (ok, truncated): all, some or none answered are told apart."""
    out = requests.groupBy(by).agg(F.count_if("ok").alias("k"), F.count("*").alias("n"), F.bool_or("truncated").alias("truncated"))
    status = F.when(F.col("k") == F.col("n"), "ok").when(F.col("k") > 0, "partial").otherwise("unavailable")
    return out.select(by, status.alias("status"), ((F.col("k") == F.col("n")) & ~F.col("truncated")).alias("complete"), "truncated")


def melody_placements(melodies: DataFrame) -> DataFrame:
    """(melody_id, shift, query): every placement on the keyboard of melodies (melody_id, volpiano); insecure ones are left out."""
    notes = melodies.withColumn("notes", records.notes_of(F.col("volpiano"))).where("notes is not null")
    return notes.select("melody_id", F.explode(records.placements(F.col("notes"))).alias("p")).select("melody_id", "p.shift", records.melody(F.col("p.notes")).alias("query"))


def regest_hits(rows: DataFrame, words: list[str], fields: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose fields together hold every word and whose date interval touches [start, end]; open ends reach everywhere."""
    body = F.lower(F.concat_ws(" ", *(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"<[^>]+>", ""), r"\s+", " ")) for c in fields)))
    for w in words:
        rows = rows.where(F.contains(body, F.lit(w.lower())))
    if start:
        rows = rows.where(F.coalesce(F.nullif(F.col("end_date"), F.lit("")), F.lit("9999")) >= start)
    if end:
        rows = rows.where(F.coalesce(F.nullif(F.col("start_date"), F.lit("")), F.lit("0000")) <= end)
    return rows
