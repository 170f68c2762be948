"""Files as DataFrames: corpora with checksums, record lines, delimited tables, ledgers, immutable readings, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "text string, shelfmark string, record_id string, manifest string, not_before string, pages int, scope_content string"
LEDGER = (
    "id string, institution string, shelfmark string, catalogue_title string, catalogue_date string, status string, confidence string, identification string, note string, "
    "verify string, record string, manifest string, thumbnail string, `order` bigint, examined string, identified_on string, kind string, document boolean, known_from string, dimensions string"
)
READING = (
    "schema_version int, fragment string, id string, captured_at string, kind string, reader string, text string, text_sha256 string, first_reading string, first_sha256 string, "
    "sources array<string>, reason string, session string, isolation_attested boolean, packet struct<prompt:string,images:array<struct<name:string,sha256:string,source:string>>>, "
    "purpose string, htr struct<text:string,pages:array<string>>, image_sources array<string>"
)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out over all cores where its files make partitions for less than half of them: small files are one partition whatever there is to do with them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def exact_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, text): whole files, newlines as they are; bytes that aren't UTF-8 are an error."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def record_lines(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """One JSON record for each line; lines that can't be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table with a header, all strings; fields may hold quotes, line breaks and any length."""
    return spark.read.options(header=True, sep=sep, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1).csv(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).option("multiLine", True).json(path)


def readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings with the path and the hash of each file's own bytes, which revisions refer to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.from_json(F.decode("content", "UTF-8"), READING).alias("r")).select("path", "sha256", "r.*")


def corpus(spark: SparkSession, manifest: str, texts: str) -> DataFrame:
    """(doc_id, source, sha256, pages, text) of a manifest's documents; a text whose checksum differs, or is missing, is an error."""
    page = "struct<start:int,end:int,locus:string,url:string>"
    listed = spark.read.schema(f"documents array<struct<id:string,path:string,source:string,sha256:string,pages:array<{page}>>>").option("multiLine", True).json(manifest)
    listed = listed.select(F.explode("documents").alias("d")).select(F.col("d.id").alias("doc_id"), "d.path", "d.source", "d.sha256", "d.pages")
    found = exact_text(spark, texts).select(F.col("sha256").alias("have"), "text", F.element_at(F.split("path", "/"), -1).alias("name"))
    both = listed.join(found, F.element_at(F.split("path", "/"), -1) == F.col("name"), "left")
    fits = F.col("text").isNotNull() & (F.col("sha256").isNull() | (F.col("sha256") == F.col("have")))
    return both.select("doc_id", "source", F.col("have").alias("sha256"), "pages", F.when(fits, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("missing or changed text: "), F.col("doc_id"))).cast("string")).alias("text"))


def page_violations(docs: DataFrame) -> DataFrame:
    """(doc_id, rule): page ranges must lie in the text, be ordered and disjoint."""
    p = docs.select("doc_id", F.length("text").alias("n"), F.posexplode("pages").alias("k", "p"))
    from pyspark.sql import Window

    before = F.lag("p.end").over(Window.partitionBy("doc_id").orderBy("k"))
    rule = F.when((F.col("p.start") < 0) | (F.col("p.end") > F.col("n")) | (F.col("p.start") >= F.col("p.end")), "range").when(before > F.col("p.start"), "overlap")
    return p.select("doc_id", rule.alias("rule")).where("rule is not null")


def parts_that_differ(present: DataFrame, indexed: DataFrame, column: str = "part") -> DataFrame:
    """(part, where) of parts that only one side has: none if a corpus and its index agree."""
    a, b = present.select(column).distinct().withColumn("p", F.lit(True)), indexed.select(column).distinct().withColumn("i", F.lit(True))
    return a.join(b, column, "full").where(F.col("p").isNull() | F.col("i").isNull()).select(column, F.when(F.col("p"), "not indexed").otherwise("not present").alias("where"))


def latest(spark: SparkSession, path: str, all_: bool = False) -> DataFrame:
    """Rows of the last snapshot by file name, or of all with their rank from the last."""
    rows = spark.read.options(header=True, multiLine=True, escape='"').csv(path).withColumn("snapshot", F.col("_metadata.file_name"))
    names = rows.select("snapshot").distinct()
    if all_:
        from pyspark.sql import Window

        rank = names.withColumn("snapshot_rank", F.row_number().over(Window.orderBy(F.desc("snapshot"))))
        return rows.join(F.broadcast(rank), "snapshot")
    return rows.join(F.broadcast(names.agg(F.max("snapshot").alias("snapshot"))), "snapshot")
