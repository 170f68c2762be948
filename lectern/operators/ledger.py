"""Research ledger: append, upsert, constraints, lineage, publication, worklists, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records
from .order import numbered

# Which confidence a status may have, kinds of identified texts, paths that must not be published
STATUS = {"identified": ("high",), "partial": ("medium", "low"), "unidentified": ("none",)}
KINDS = ("theology", "law", "science", "arts", "liturgy", "document")
LOCAL_PATH = r"/Users/|/home/|/tmp/|/private/"
# Keys and configuration files that must not be published, forms of ids and checksums, names of images
SECRET = r"AIza[0-9A-Za-z_-]{20,}|\.mcp\.json"
FRAGMENT, SLUG, DIGEST, IMAGE = r"^F-[a-z0-9]{4}$", r"^[a-z0-9][a-z0-9_-]{0,79}$", r"^[0-9a-f]{64}$", r"^image-\d{3}\.(jpg|jpeg|png|tif|tiff)$"


def unlisted(candidates: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return candidates.join(ledger.select(key), key, "left_anti")


def append(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger and the rows not in it yet, in the order of their ids, numbered on from the highest ``order``."""
    fresh = unlisted(new, ledger, "id").dropDuplicates(["id"])
    top = ledger.agg(F.coalesce(F.max("order"), F.lit(0)).alias("top"))
    fresh = numbered(fresh.drop("order"), "id", "k").join(F.broadcast(top)).withColumn("order", (F.col("top") + F.col("k")).cast("bigint")).drop("k", "top")
    return ledger.unionByName(fresh, allowMissingColumns=True)


def violations(rows: DataFrame) -> DataFrame:
    """(id, rule) for every broken constraint of ledger rows."""
    c = F.col
    identified = c("status") == "identified"
    pairs = F.array(*(F.struct(F.lit(s), F.lit(x)) for s, xs in STATUS.items() for x in xs))
    rules = {
        "confidence": ~F.array_contains(pairs, F.struct(c("status").alias("col1"), c("confidence").alias("col2"))),
        "kind": identified & ~F.coalesce(c("kind").isin(*KINDS), F.lit(False)),
        "kind-without-identification": ~identified & c("kind").isNotNull(),
        "document": identified & ((c("kind") == "document") != F.coalesce(c("document"), F.lit(False))),
        "dates": identified & ~F.coalesce(c("identified_on") <= c("examined"), F.lit(False)),
        "date-without-identification": ~identified & c("identified_on").isNotNull(),
        "known-without-identification": ~identified & c("known_from").isNotNull(),
        "record": ~F.coalesce(F.startswith(c("record"), F.lit("https://")), F.lit(False)),
        "local-path": F.coalesce(F.regexp_like("note", F.lit(LOCAL_PATH)), F.lit(False)),
    }
    broken = rows.select("id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(True)), k) for k, v in rules.items())))).alias("rule"))
    twice = rows.groupBy("id").count().where("count > 1").select("id", F.lit("unique").alias("rule"))
    return broken.union(twice)


def upsert(ledger: DataFrame, results: DataFrame, today: str) -> DataFrame:
    """The ledger with results (id, status, confidence, identification, note, kind, document, known_from) applied.

    Everything is checked before anything is returned, so a bad row changes nothing. The first identification date stays."""
    bad = results.where(~F.coalesce(F.array_contains(F.array(*(F.lit(f"{s}:{x}") for s, xs in STATUS.items() for x in xs)), F.concat_ws(":", "status", "confidence")), F.lit(False)))
    if first := bad.first():
        raise ValueError(f"{first['id']}: {first['status']} cannot have confidence {first['confidence']}")
    new = results.select(*(F.col(c).alias(f"n_{c}") for c in ("id", "status", "confidence", "identification", "note", "kind", "document", "known_from")))
    both = ledger.join(new, ledger["id"] == new["n_id"], "left")
    hit, ident = F.col("n_id").isNotNull(), F.col("n_status") == "identified"
    pick = lambda c, v: F.when(hit, v).otherwise(F.col(c)).alias(c)
    changed = {
        **{c: pick(c, F.col(f"n_{c}")) for c in ("status", "confidence", "identification", "note")},
        "examined": pick("examined", F.lit(today)),
        "identified_on": pick("identified_on", F.when(ident, F.coalesce("identified_on", F.lit(today)))),
        "kind": pick("kind", F.when(ident, F.when(F.col("n_document"), "document").otherwise(F.col("n_kind")))),
        "document": pick("document", F.when(F.col("n_document").isNull(), F.col("document")).when(F.col("n_document"), True)),
        "known_from": pick("known_from", F.when(ident, F.col("n_known_from"))),
    }
    return both.select(*(changed.get(c, F.col(c)) for c in ledger.columns))


def private(texts: DataFrame, *columns: str) -> DataFrame:
    """Rows of texts that name local paths or secrets in one of the columns."""
    return texts.where(F.concat_ws("\n", *columns).rlike(f"{LOCAL_PATH}|{SECRET}"))


def registered(rows: DataFrame, ledger: DataFrame, key: str = "fragment") -> tuple[DataFrame, DataFrame]:
    """Rows whose fragment is in the ledger, and the others."""
    ids = ledger.select(F.col("id").alias(key))
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")


def reading_violations(readings: DataFrame) -> DataFrame:
    """(id, rule) for everything that is wrong with readings as they stand; lineage is checked apart."""
    c = F.col
    no = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    unlike = lambda x, p: ~F.coalesce(x.rlike(p), F.lit(False))
    images = F.coalesce(c("packet.images"), F.array())
    names = F.transform(images, lambda i: i["name"])
    first, revised, recognised = (c("kind") == k for k in ("image-only", "source-assisted", "htr"))
    rules = {
        "schema": ~c("schema_version").eqNullSafe(F.lit(1)),
        "id": unlike(c("fragment"), FRAGMENT) | unlike(c("id"), SLUG),
        "empty": no(c("reader")) | no(c("text")),
        "timezone": unlike(c("captured_at"), r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d.*(Z|[+-]\d\d:?\d\d)$"),
        "checksum": ~F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).eqNullSafe(c("text_sha256")),
        "kind": ~F.coalesce(first | revised | recognised, F.lit(False)),
        "isolation": first & (~F.coalesce("isolation_attested", F.lit(False)) | no(c("session"))),
        "packet": first & (no(c("packet.prompt")) | (F.size(images) == 0)),
        "image": first & (F.exists(images, lambda i: unlike(i["name"], IMAGE) | unlike(i["sha256"], DIGEST) | no(i["source"])) | (F.size(F.array_distinct(names)) < F.size(names))),
        "first-reading": revised & (unlike(c("first_reading"), SLUG) | unlike(c("first_sha256"), DIGEST)),
        "reason": revised & (no(c("reason")) | (F.size(F.coalesce("sources", F.array())) == 0) | F.exists(F.coalesce("sources", F.array()), no)),
        "purpose": recognised & ~F.coalesce(c("purpose").isin("tool-validation", "independent-reading"), F.lit(False)),
        "recognised-text": recognised & ~c("text").eqNullSafe(c("htr.text")),
        "image-sources": recognised & ((F.size(F.coalesce("image_sources", F.array())) != F.size(F.coalesce("htr.pages", F.array()))) | F.exists(F.coalesce("image_sources", F.array()), no)),
    }
    broken = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    return readings.select("id", F.explode(broken).alias("rule"))


def facets_in_order(rows: DataFrame, holdings: str, kind: str, menu: list[str]) -> DataFrame:
    """(facet, value, n, place): holdings by number, and kinds in the order of the menu, zero rows included."""
    held = rows.where(F.col(holdings).isNotNull()).groupBy(F.col(holdings).alias("value")).agg(F.count("*").alias("n"), F.min("order").alias("first"))
    held = held.withColumn("place", F.row_number().over(Window.partitionBy(F.lit("holding")).orderBy(F.desc("n"), "first", "value")))
    kinds = status_counts(rows.select(F.col(kind).alias("state")), menu)
    out = held.select(F.lit("holding").alias("facet"), "value", "n", F.col("place").cast("bigint").alias("place"))
    return out.unionByName(kinds.select(F.lit("kind").alias("facet"), F.col("state").alias("value"), "n", (F.col("ord") + 1).cast("bigint").alias("place")))


def lineage_violations(readings: DataFrame) -> DataFrame:
    """(id, rule): revisions must name an existing first reading, carry its hash, and not be older."""
    base = readings.select(F.col("id").alias("b_id"), F.col("fragment").alias("b_fragment"), F.col("sha256").alias("b_sha"), F.col("captured_at").alias("b_at"), F.col("kind").alias("b_kind"))
    both = readings.where("first_reading is not null").join(base, (F.col("first_reading") == F.col("b_id")) & (F.col("fragment") == F.col("b_fragment")), "left")
    rule = F.when(F.col("b_id").isNull(), "missing").when(F.col("b_kind") == "source-assisted", "kind").when(~F.col("first_sha256").eqNullSafe(F.col("b_sha")), "sha256").when(F.col("captured_at") < F.col("b_at"), "order")
    return both.select("id", rule.alias("rule")).where("rule is not null")


def publishable(row_status: Column, confidence: Column, known_from: Column) -> Column:
    return (row_status == "identified") & (confidence == "high") & (F.coalesce(known_from, F.lit("")) == "")


def state(status: Column, confidence: Column, known_from: Column) -> Column:
    """What a worklist shows: Identified, Partial, Examined or Open (no ledger row)."""
    return F.when(publishable(status, confidence, known_from), "identified").when(status.isNull(), "open").when(F.coalesce(known_from, F.lit("")) != "", "examined").when(status == "partial", "partial").otherwise("examined")


def worklist(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, the first source that has a key wins; columns may differ."""
    out = None
    for k, df in enumerate(sources):
        df = df.withColumn("source_rank", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    best = Window.partitionBy(key).orderBy("source_rank")
    return out.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")


def status_counts(states: DataFrame, labels: list[str]) -> DataFrame:
    """(state, n) with zero rows, in the order of the labels."""
    spark = states.sparkSession
    menu = spark.createDataFrame([(k, x) for k, x in enumerate(labels)], "ord int, state string")
    return menu.join(states.groupBy("state").agg(F.count("*").alias("n")), "state", "left").fillna(0, ["n"])


def merge_terms(hits: DataFrame) -> DataFrame:
    """(id, fields, terms, scope): hits (id, ord, term, fields) of several searches, first seen first, and what kind of match they are."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "term", "fields")))
    out = hits.groupBy("id").agg(ordered.alias("h"))
    fields, terms = F.array_distinct(F.flatten(F.transform("h", lambda x: x["fields"]))), F.array_distinct(F.transform("h", lambda x: x["term"]))
    return out.select("id", fields.alias("fields"), terms.alias("terms")).withColumn("scope", records.scope(F.col("fields"), F.col("terms")))


def siblings(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, sibling): ledger rows of the same institution that share a shelfmark; either may be a list ("a, b").

    rows: id, shelfmark "institution, shelfmark"; ledger: id, institution, shelfmark. Lists are matched by their first item, so the join has a key."""
    theirs = ledger.where("institution is not null and shelfmark is not null").select(F.col("id").alias("sibling"), "institution", F.col("shelfmark").alias("theirs"))
    inst = theirs.select("institution").distinct()
    heads = rows.select("id", F.col("shelfmark").alias("full"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("shelfmark", ", ")) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split("shelfmark", ", "), F.lit(1), k), ", "))).alias("institution")).join(inst, "institution", "left_semi")
    ours = heads.select("id", "institution", F.expr("substring(full, length(institution) + 3)").alias("ours"))
    key = lambda df, c: df.withColumn("item", F.explode(F.array_distinct(F.split(c, ", "))))
    both = key(ours, "ours").join(key(theirs, "theirs"), ["institution", "item"])
    wrap = lambda c: F.concat(F.lit(", "), F.col(c), F.lit(", "))
    return both.where(F.contains(wrap("theirs"), wrap("ours")) | F.contains(wrap("ours"), wrap("theirs"))).select("id", "sibling").distinct()
