"""Search in noisy transcriptions: reduced tokens, rarity weights, exact, near and prefix matches, chains, null margins.

The corpus' distinct tokens are counted and reduced once; the words of a query are a small table that meets this vocabulary, and what
its tokens may stand for goes to the executors, where one pass over the texts finds hits with their offsets and chains them document by document.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans, text
from ..sources.shared import materialize

# Rate of words too common to search, and the weights of the kinds of match
MAX_RATE = 5e-5
EXACT, EXACT_SHORT, NEAR, PREFIX = 1.0, 0.9, 0.8, 0.6
LEAST_LETTERS, NEAR_LETTERS, MOST_POSITIONS = 4, 6, 40
STRETCH = 2000
#: Rows of a query's side that are handed to the driver and sent out; more are joined, or taken in blocks of items.
MOST_SENT = 200_000
#: Distinct tokens that are counted at once before their counts go on.
MOST_HELD = 200_000


def raw_tokens(docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(ident, ti, token): tokens numbered from 0."""
    return docs.select(ident, F.posexplode(F.regexp_extract_all("text", F.lit(f"({text.TOKEN_JAVA})"), F.lit(1))).alias("ti", "token"))


def reduced_tokens(items: DataFrame, ident: str = "item_id") -> DataFrame:
    """(ident, ti, letters, short) of texts that are few."""
    return raw_tokens(items, ident).select(ident, "ti", text.letters(F.col("token")).alias("letters"), text.abbreviated(F.col("token")).alias("short"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens with their counts; a token comes again where the counts are handed on before the last text."""
    token, held = re.compile(text.TOKEN), Counter()
    made = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["token", "n"])
    for b in batches:
        for raw in b.column(0):
            held.update(token.findall(raw.as_py() or ""))
            if len(held) >= MOST_HELD:
                yield made()
                held.clear()
    yield made()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token, n, letters, short): the distinct tokens, each reduced once."""
    counts = docs.select("text").mapInArrow(_counted, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return counts.select("token", "n", text.letters(F.col("token")).alias("letters"), text.abbreviated(F.col("token")).alias("short"))


def letter_counts(known: DataFrame) -> DataFrame:
    """(letters, n): the counts of a vocabulary by reduced tokens."""
    return known.where("letters <> ''").groupBy("letters").agg(F.sum("n").alias("n"))


def frequencies(docs: DataFrame) -> DataFrame:
    """(letters, n): exact counts of reduced tokens."""
    return letter_counts(vocabulary(docs))


def rarity(freq: DataFrame) -> DataFrame:
    """letters, n, weight = ln((T + 1) / (n + 1)) / ln T."""
    total = freq.agg(F.sum("n").alias("t"))
    return freq.join(F.broadcast(total)).withColumn("weight", F.log((F.col("t") + 1) / (F.col("n") + 1)) / F.log("t"))


def usable(queries: DataFrame) -> DataFrame:
    """Queries (text, perhaps usable) without those marked as not usable and those without a word; only false itself marks."""
    out = queries.where(F.coalesce(F.col("usable"), F.lit(True))) if "usable" in queries.columns else queries
    return out.where(F.size(F.filter(F.regexp_extract_all("text", F.lit(f"({text.TOKEN_JAVA})"), F.lit(1)), lambda t: text.letters(t) != "")) > 0)


def query_words(items: DataFrame, freq: DataFrame) -> DataFrame:
    """(item_id, pos, letters, n, t, weight): an item's words worth searching, by their place in it. Items marked as not usable have none."""
    own = reduced_tokens(usable(items)).select("item_id", F.col("ti").alias("pos"), "letters")
    own = small(own.where((F.length("letters") >= LEAST_LETTERS) & ~F.col("letters").isin(*text.STOP)))
    total = freq.agg(F.sum("n").alias("t"))
    out = own.join(freq.join(own.select("letters").distinct(), "letters", "left_semi"), "letters", "left").fillna(0, ["n"]).join(F.broadcast(total)).where(F.col("n") / F.col("t") <= MAX_RATE)
    return out.withColumn("weight", F.log((F.col("t") + 1) / (F.col("n") + 1)) / F.log("t")).select("item_id", "pos", "letters", "n", "t", "weight")


def small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df`` worked out once and marked for broadcast if it has so many rows at most; else as it is."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def heads(query: DataFrame, freq: DataFrame, most: int | None = None) -> DataFrame:
    """(head, word): prefixes that may stand for query words (item_id, pos, letters, t): not common words themselves, and of less than ``most`` places if that is given."""
    every = query.select("item_id", "pos", F.col("letters").alias("word"), "t", F.explode(text.prefixes(F.col("letters"))).alias("head"))
    few = every.groupBy("head").agg(F.count("*").alias("k"), F.first("t").alias("t"))
    few = few.where(F.col("k") < most) if most else few
    freq = freq.select(F.col("letters").alias("head"), "n").join(few.select("head"), "head", "left_semi")
    few = few.join(freq, "head", "left").where(F.coalesce("n", F.lit(0)) / F.col("t") < MAX_RATE)
    return every.select("head", "word").distinct().join(few.select("head"), "head")


def word_matches(query: DataFrame, reduced: DataFrame, verified: bool = True, begin: DataFrame | None = None) -> DataFrame:
    """(letters, short, word, kind, strength): query words (column word) that a token of the corpus (letters, short) may stand for.

    Only the best kind of a token counts. Near words share a string with one letter taken out, or are that string; ``verified`` asks for
    edit distance 1 besides, else the looser symmetric rule holds. Both words need ``NEAR_LETTERS`` letters but for one missing in the token.
    Prefixes are those of ``begin`` (head, word), else all of the words."""
    words = query.select("word").distinct()
    plain, short = reduced.where("not short"), reduced.where("short")
    exact = reduced.where(F.length("letters") >= LEAST_LETTERS).join(words, F.col("letters") == F.col("word")).select("letters", "short", "word", F.lit("exact").alias("kind"), F.when(F.col("short"), EXACT_SHORT).otherwise(EXACT).alias("strength"))
    keys = lambda df, c: df.select("*", F.explode(F.array_union(F.array(c), text.deletions(F.col(c)))).alias("key"))
    near = keys(plain.where(F.length("letters") >= NEAR_LETTERS - 1), "letters").join(keys(words.where(F.length("word") >= NEAR_LETTERS), "word"), "key").where(F.col("letters") != F.col("word"))
    if verified:
        near = near.where(F.levenshtein("letters", "word") <= 1)
    near = near.select("letters", "short", "word", F.lit("near").alias("kind"), F.lit(NEAR).alias("strength")).distinct()
    if begin is None:
        begin = words.select("word", F.explode(text.prefixes(F.col("word"))).alias("head"))
    found = short.where(F.length("letters") >= 3).join(begin, F.col("letters") == F.col("head")).select("letters", "short", "word", F.lit("prefix").alias("kind"), F.lit(PREFIX).alias("strength"))
    found = exact.union(near).union(found)
    return found.withColumn("top", F.max("strength").over(Window.partitionBy("letters", "short"))).where("strength = top").drop("top")


def exact_places(known: DataFrame, query: DataFrame) -> DataFrame:
    """(token, item_id, pos, value): where tokens of a vocabulary stand in the query, letter for letter."""
    return known.join(small(query), "letters").select("token", "item_id", "pos", F.col("weight").alias("value"))


def places(known: DataFrame, query: DataFrame, verified: bool = True) -> DataFrame:
    """(token, item_id, pos, value): where tokens of a vocabulary may stand in the query, by all kinds of match."""
    query = small(query)
    begin = heads(query, known.where("letters <> ''").groupBy("letters").agg(F.sum("n").alias("n")))
    kinds = word_matches(query.select(F.col("letters").alias("word")), known.select("letters", "short").distinct(), verified, begin)
    met = kinds.join(query.select("item_id", "pos", F.col("letters").alias("word"), "weight"), "word")
    return known.join(met, ["letters", "short"]).select("token", "item_id", "pos", (F.col("strength") * F.col("weight")).alias("value"))


def _blocks(found: DataFrame) -> Iterator[dict[str, list[tuple[int, int, float]]]]:
    """The places by token, in blocks of items of about MOST_SENT rows: what is sent out is bounded by that and one item's rows."""
    block: dict[str, list[tuple[int, int, float]]] = {}
    rows = found.limit(MOST_SENT + 1).collect()
    if len(rows) > MOST_SENT:
        rows = materialize(found, "places").orderBy("item_id").toLocalIterator()
    last, n = None, 0
    for r in rows:
        if n >= MOST_SENT and r.item_id != last:
            yield block
            block, n = {}, 0
        block.setdefault(r.token, []).append((r.item_id, r.pos, r.value))
        last, n = r.item_id, n + 1
    yield block


def _scanned(docs: DataFrame, found: DataFrame, schema: str, rows) -> DataFrame:
    """One pass over the texts for each block of places; ``rows`` makes rows of a document's hits {item: [(ti, pos, value, start, end, token)]}."""
    spark = docs.sparkSession
    out = None
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    for block in _blocks(found):
        sent = spark.sparkContext.broadcast({k: sorted(v) for k, v in block.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            token, known = re.compile(text.TOKEN), sent.value
            for b in batches:
                made = []
                for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    raw = raw.as_py() or ""
                    if known.keys().isdisjoint(token.findall(raw)):
                        continue
                    hits: dict[int, list[tuple]] = {}
                    for ti, m in enumerate(token.finditer(raw)):
                        for item, pos, value in known.get(m.group(), ()):
                            hits.setdefault(item, []).append((ti, pos, value, m.start(), m.end(), m.group()))
                    for item, own in hits.items():
                        made += [(doc, item, *r) for r in rows(own)]
                cols = list(zip(*made, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        part = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def token_hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, item_id, ti, pos, value, start, end, token): tokens of documents at the query places they may stand for, with their characters."""
    return _scanned(docs, found, "doc_id bigint, item_id bigint, ti int, pos int, value double, start int, end int, token string", lambda own: own)


def windows(hits: DataFrame, window: int = 150, least: int = 3) -> DataFrame:
    """(doc_id, item_id, ti, positions): for each hit the distinct query places among hits of the last ``window`` tokens, where
    there are ``least`` or more."""
    w = Window.partitionBy("doc_id", "item_id").orderBy("ti").rangeBetween(-window, 0)
    out = hits.dropna(subset=["doc_id", "item_id"]).withColumn("positions", F.size(F.array_distinct(F.collect_list("pos").over(w))).cast("bigint"))
    return out.where(F.col("positions") >= least).select("doc_id", "item_id", "ti", "positions").distinct()


def chains(docs: DataFrame, found: DataFrame, window: int = 150, least: int = 3) -> DataFrame:
    """(doc_id, item_id, ti, score, chain, first, offset, end): the heaviest run of rising query places that ends at each hit and starts at most
    ``window`` tokens before; places as of ``places``. offset and end are characters of the text. Each document is chained where it is read."""

    def rows(own: list[tuple]) -> Iterator[tuple]:
        if len({h[1] for h in own}) < least:
            return
        for score, chain in spans.rising_runs([h[:3] for h in own], window, least):
            first, last = own[chain[0]], own[chain[-1]]
            yield last[0], score, len(chain), first[0], first[3], last[4]

    return _scanned(docs, found, "doc_id bigint, item_id bigint, ti int, score double, chain int, first int, offset int, end int", rows)


def stretch_dedupe(found: DataFrame, stretch: int = STRETCH, keep: int = 15) -> DataFrame:
    """The best row of each (item_id, doc_id, stretch of so many characters), then the best ``keep`` of each item; ties by document and place."""
    best = Window.partitionBy("item_id", "doc_id", F.floor(F.col("offset") / stretch)).orderBy(F.desc("score"), "offset", "ti")
    top = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "offset")
    out = found.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")
    return out.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= keep)


def excerpts(found: DataFrame, docs: DataFrame, around: int = 300) -> DataFrame:
    """Rows (doc_id, offset, end) with the text around them and their place in it as a share of its length."""
    start = F.greatest(F.col("offset") - around, F.lit(0))
    met = found.join(docs.select("doc_id", "text"), "doc_id")
    return met.withColumns({"excerpt": F.substring(F.col("text"), start + 1, F.col("end") + around - start), "position": F.bround(F.col("offset") / F.greatest(F.length("text"), F.lit(1)), 3)}).drop("text")


def shuffled(items: DataFrame, seed: int = 0) -> DataFrame:
    """Each item's words in a shuffled order that depends on seed and item alone: the null that real scores are held against."""

    def run(it):
        for pdf in it:
            out = []
            for ident, words in zip(pdf["item_id"], pdf["text"], strict=True):
                words = (words or "").split()
                random.Random(f"{seed}:{ident}").shuffle(words)
                out.append(" ".join(words))
            yield pd.DataFrame({"item_id": pdf["item_id"], "text": out})

    return items.select("item_id", "text").mapInPandas(run, "item_id bigint, text string")


def margins(real: DataFrame, null: DataFrame) -> DataFrame:
    """Rows of ``real`` with the item's best null score (0 without any) and how far they are above it."""
    top = null.groupBy("item_id").agg(F.max("score").alias("null_top"))
    return real.join(top, "item_id", "left").fillna(0.0, ["null_top"]).withColumn("margin", F.col("score") - F.col("null_top"))


def context(docs: DataFrame, shelfmark: str, find: str | None = None, offset: int = 0, before: int = 200, after: int = 200) -> DataFrame:
    """Text around an offset, or around every place of ``find``, in each document of a shelfmark."""
    own = docs.where(F.col("shelfmark") == shelfmark)
    if find is None:
        start = max(0, offset - before)
        return own.select("shelfmark", F.lit(offset).alias("offset"), F.substring("text", F.lit(start + 1), F.lit(max(0, offset + after - start))).alias("context"))
    size = len(find)
    parts = F.split(F.col("text"), F.regexp_replace(F.lit(find), r"([\\.*+?^$|()\[\]{}-])", r"\\$1"), -1)
    begin = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    places_ = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), begin, lambda s, p: F.struct((s["n"] + F.length(p) + size).alias("n"), F.concat(s["at"], F.array(s["n"] + F.length(p))).alias("at")), lambda s: s["at"])
    around = lambda at, start: F.struct(at.alias("offset"), F.substring(F.col("text"), start + 1, at + size + after - start).alias("context"))
    return own.select("shelfmark", F.explode(F.transform(places_, lambda at: around(at, F.greatest(at - before, F.lit(0))))).alias("c")).select("shelfmark", "c.*")
