"""Registered queries over the standard tables and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, records, text
from ..operators import images, ledger, noisy, order, reporting, retrieval, sequences
from ..sources import files, responses
from ..sources.shared import materialize

QUERIES: dict = {}
#: Tables whose rows take long to work through.
TEXTS = ("documents", "pages")
ORACLES: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return files.spread(df) if name in TEXTS and {"text", "html"} & set(df.columns) else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.folded(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "folded")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.folded(table(spark, sf_dir, "benchmark", "item_id", "text")).select("item_id", "folded")


# SQL for the column functions


def sql_fold(c: str) -> str:
    joined = c
    for _ in range(2):
        joined = rf"regexp_replace({joined}, '([\p{{L}}\p{{N}}_])[-\x{{ad}}][ \t]*\r?\n[ \t]*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    letters = f"translate(replace(replace(lower({joined}), 'æ', 'ae'), 'œ', 'oe'), 'ſjv', 'siu')"
    return rf"trim(regexp_replace(regexp_replace({letters}, '[^\p{{L}}\p{{N}}\p{{M}}*]+', ' ', 'g'), '[ao]e', 'e', 'g'))"


_TOKEN = r"[^\s.,;:!?/()\[\]''\"·¶|*+=<>0-9-]+"


def sql_letters(c: str) -> str:
    plain = f"replace(replace(replace(lower({c}), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss')"
    return f"regexp_replace(translate(strip_accents({plain}), 'ſvjȝ', 'suiz'), '[^a-z]', '', 'g')"


D = f"d AS (SELECT doc_id, {sql_fold('text')} AS folded FROM documents)"
B = f"b AS (SELECT item_id, {sql_fold('text')} AS folded FROM benchmark)"
PAIRS = f"""{D}, {B}, p AS (SELECT doc_id, item_id, ((length(' ' || d.folded || ' ') - length(replace(' ' || d.folded || ' ', ' ' || b.folded || ' ', '')))
    // length(' ' || b.folded || ' '))::BIGINT AS n FROM d JOIN b ON b.folded <> '' AND contains(' ' || d.folded || ' ', ' ' || b.folded || ' '))"""
TOKENS = f"t AS (SELECT doc_id, unnest(range(len(w)))::BIGINT AS ti, unnest(w) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS w FROM documents))"
REDUCED = f"{TOKENS}, r AS (SELECT doc_id, ti, {sql_letters('token')} AS letters FROM t)"
FREQ = f"{REDUCED}, f AS (SELECT letters, count(*) AS n FROM r WHERE letters <> '' GROUP BY 1)"
_STOP = ", ".join(f"'{w}'" for w in text.STOP)
QWORDS = f"""{FREQ}, total AS (SELECT sum(n) AS t FROM f),
q0 AS (SELECT item_id, unnest(range(len(w)))::BIGINT AS pos, unnest(w) AS token FROM (SELECT item_id, regexp_extract_all(text, '{_TOKEN}') AS w FROM benchmark)),
q AS (SELECT item_id, pos, letters, coalesce(n, 0) AS n, ln((t + 1) / (coalesce(n, 0) + 1)) / ln(t) AS weight
      FROM (SELECT item_id, pos, {sql_letters('token')} AS letters FROM q0) LEFT JOIN f USING (letters), total
      WHERE length(letters) >= 4 AND letters NOT IN ({_STOP}) AND coalesce(n, 0) / t <= 5e-5)"""


def _one_byte(c: str) -> str:
    """DuckDB's levenshtein counts bytes: letters of two bytes become capitals, which folded words don't have."""
    return f"translate({c}, 'äöüßéèêçñóíáúâîôûàëïù', 'ABCDEFGHIJKLMNOPQRSTU')"


# Retrieval


@query(f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT doc_id, item_id, n FROM p")
def passage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.containing(documents(spark, sf_dir), items(spark, sf_dir))


PATTERNS = ("th*tion", "de*", "*keit")


@query(
    f"WITH {D}, x AS (SELECT unnest(['th*tion', 'de*', '*keit']) AS pattern), y AS (SELECT pattern, '(?:^| )' || replace(pattern, '*', '[\\p{{L}}\\p{{N}}]*') || '(?: |$)' AS re FROM x) "
    "SELECT doc_id, pattern FROM d JOIN y ON regexp_matches(folded, re)"
)
def wildcard_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.col("folded").rlike(text.wildcard(p)), p) for p in PATTERNS)))
    return documents(spark, sf_dir).select("doc_id", F.explode(found).alias("pattern"))


@query(
    f"WITH {PAIRS}, g AS (SELECT item_id, count(DISTINCT doc_id) AS df FROM p GROUP BY 1) "
    "SELECT item_id, coalesce(df, 0) AS df, 1 + ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(df, 0))) AS weight FROM benchmark LEFT JOIN g USING (item_id)"
)
def doc_frequency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents", "doc_id").agg(F.count("*").alias("n_docs"))
    return retrieval.document_frequency(passage_exact(spark, sf_dir), items(spark, sf_dir).select("item_id"), n)


@query(f"WITH {PAIRS}, g AS (SELECT item_id, sum(n)::BIGINT AS hits, count(*) AS docs FROM p GROUP BY 1) SELECT item_id, coalesce(hits, 0) AS hits, coalesce(docs, 0) AS docs FROM benchmark LEFT JOIN g USING (item_id)")
def anchor_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passage_exact(spark, sf_dir).groupBy("item_id").agg(F.sum("n").alias("hits"), F.count("*").alias("docs"))
    return table(spark, sf_dir, "benchmark", "item_id").join(found, "item_id", "left").fillna(0)


def benchmark_anchors(spark: SparkSession, sf_dir: str) -> list[dict]:
    """The benchmark's items as anchors, in order of their ids; anchor_hits checks that they are few."""
    rows = table(spark, sf_dir, "benchmark", "item_id", "text").orderBy("item_id").limit(retrieval.MOST_ANCHORS + 1).collect()
    return [{"id": str(r.item_id), "variants": [{"text": r.text}]} for r in rows]


@query()
def fuzzy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.anchor_hits(table(spark, sf_dir, "documents", "doc_id", "text"), benchmark_anchors(spark, sf_dir), edits=1)


def gapped_anchors(spark: SparkSession, sf_dir: str) -> list[dict]:
    """Each item's first and last three words, with up to 400 characters between."""
    out = []
    for a in benchmark_anchors(spark, sf_dir):
        words = a["variants"][0]["text"].split()
        if len(words) >= 8:
            out.append({"id": a["id"], "variants": [{"parts": [" ".join(words[:3]), " ".join(words[-3:])], "gaps": [(1, 400)]}]})
    return out


@query()
def bounded_gap_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.anchor_hits(table(spark, sf_dir, "documents", "doc_id", "text"), gapped_anchors(spark, sf_dir))


@query()
def ordered_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains over halves of the items: each item is two anchors that should follow each other."""
    anchors = []
    for a in benchmark_anchors(spark, sf_dir):
        words = a["variants"][0]["text"].split()
        half = len(words) // 2
        if half:
            anchors += [{"id": f"{a['id']}{x}", "variants": [{"text": " ".join(w)}]} for x, w in (("a", words[:half]), ("b", words[half:]))]
    return retrieval.search(table(spark, sf_dir, "documents", "doc_id", "text"), anchors)


@query(
    rf"""WITH {D}, {B}, x AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(folded, ' ')) AS w FROM d) WHERE length(w) >= 6),
y AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(folded, ' ')) AS w FROM b) WHERE length(w) >= 6)
SELECT y.w AS query_word, x.w AS word, levenshtein({_one_byte('x.w')}, {_one_byte('y.w')}) AS edits FROM x JOIN y ON abs(length(x.w) - length(y.w)) <= 1 AND levenshtein({_one_byte('x.w')}, {_one_byte('y.w')}) <= 1"""
)
def bounded_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters or more within one edit: both sides meet at the strings with one letter taken out."""
    words = lambda df: df.select(F.explode(F.array_distinct(text.words(F.col("folded")))).alias("w")).where(F.length("w") >= 6).distinct()
    keys = lambda df, c: df.select(F.col("w").alias(c), F.explode(F.array_union(F.array("w"), text.deletions(F.col("w")))).alias("key"))
    both = keys(words(documents(spark, sf_dir)), "word").join(keys(words(items(spark, sf_dir)), "query_word"), "key").select("query_word", "word").distinct()
    return both.withColumn("edits", F.levenshtein("word", "query_word").cast("bigint")).where("edits <= 1")


@query(f"WITH {PAIRS}, s AS (SELECT doc_id, item_id, strpos(' ' || d.folded || ' ', ' ' || b.folded || ' ') - 1 AS start, length(b.folded) AS len FROM p JOIN d USING (doc_id) JOIN b USING (item_id)), "
    "g AS (SELECT s.doc_id, item_id, start, start + len AS stop, k AS page, k * 1000 AS page_start, (k + 1) * 1000 AS page_end FROM s, LATERAL (SELECT unnest(range(start // 1000, (start + len - 1) // 1000 + 1)) AS k)) "
    "SELECT doc_id, item_id, page, greatest(start, page_start) AS \"from\", least(stop, page_end) AS \"to\" FROM g")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hits against pages of 1,000 characters: which pages a hit touches, and where."""
    hits = materialize(retrieval.contained(documents(spark, sf_dir), items(spark, sf_dir)).where("doc_id is not null"), "contained")
    pages = hits.select("doc_id", "size").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / 1000))).alias("page")).select("doc_id", "page", (F.col("page") * 1000).alias("page_start"), ((F.col("page") + 1) * 1000).alias("page_end"))
    out = retrieval.page_overlaps(hits, pages)
    return out.select("doc_id", "item_id", *(F.col(c).cast("bigint") for c in ("page", "from", "to")))


@query(
    "SELECT doc_id, strpos(text, '.') - 1 AS start, CASE WHEN strpos(text, '.') > 0 THEN length(left(text, strpos(text, '.') - 1)) - length(replace(left(text, strpos(text, '.') - 1), chr(10), '')) + 1 END AS line, "
    "CASE WHEN contains(text, chr(12)) AND strpos(text, '.') > 0 THEN length(left(text, strpos(text, '.') - 1)) - length(replace(left(text, strpos(text, '.') - 1), chr(12), '')) + 1 END AS page FROM documents"
)
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and page of each text's first full stop."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("start", F.instr("text", ".") - 1)
    there = F.col("start") >= 0
    return docs.select("doc_id", F.col("start").cast("bigint").alias("start"), F.when(there, text.line_number(F.col("text"), F.col("start"))).cast("bigint").alias("line"), F.when(there, text.page_number(F.col("text"), F.col("start"))).cast("bigint").alias("page"))


# Noisy search


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


@query(f"WITH {FREQ} SELECT letters, n FROM f")
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy.frequencies(_documents(spark, sf_dir))


@query(f"WITH {FREQ} SELECT letters, n, ln(((SELECT sum(n) FROM f) + 1) / (n + 1)) / ln((SELECT sum(n) FROM f)) AS weight FROM f")
def rarity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy.rarity(_counts(spark, sf_dir)).select("letters", "n", "weight")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of reduced tokens, for queries that read them several times."""
    return materialize(token_frequencies(spark, sf_dir), "counts")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(noisy.vocabulary(_documents(spark, sf_dir)), "vocabulary")


def _query_words(spark: SparkSession, sf_dir: str, freq: DataFrame) -> DataFrame:
    return noisy.query_words(table(spark, sf_dir, "benchmark", "item_id", "text"), freq)


@query(f"WITH {QWORDS} SELECT item_id, pos, letters, n, weight FROM q")
def searchable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query_words(spark, sf_dir, _counts(spark, sf_dir)).select("item_id", F.col("pos").cast("bigint").alias("pos"), "letters", "n", "weight")


def _without_one(c: str) -> str:
    return f"unnest(list_prepend({c}, list_transform(range(1, length({c}) + 1), lambda i: left({c}, i - 1) || substr({c}, i + 1))))"


@query(
    f"""WITH {QWORDS}, v AS (SELECT DISTINCT letters FROM r WHERE length(letters) >= 4), w AS (SELECT DISTINCT letters AS word FROM q),
e AS (SELECT letters, word, 'exact' AS kind FROM v JOIN w ON letters = word),
kv AS (SELECT letters, {_without_one('letters')} AS key FROM v WHERE length(letters) >= 5), kw AS (SELECT word, {_without_one('word')} AS key FROM w WHERE length(word) >= 6),
n1 AS (SELECT DISTINCT letters, word, 'near' AS kind FROM kv JOIN kw USING (key) WHERE levenshtein(letters, word) = 1)
SELECT * FROM e UNION ALL SELECT * FROM n1 WHERE letters NOT IN (SELECT letters FROM e)"""
)
def one_letter_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus for words of the items, as if no token were abbreviated."""
    freq = _counts(spark, sf_dir)
    reduced = freq.select("letters", F.lit(False).alias("short"))
    return noisy.word_matches(noisy.small(_query_words(spark, sf_dir, freq).select(F.col("letters").alias("word")).distinct()), reduced).select("letters", "word", "kind")


@query(
    f"""WITH {QWORDS}, w AS (SELECT DISTINCT letters AS word FROM q), h AS (SELECT word, left(word, k) AS head FROM w, LATERAL (SELECT unnest(range(3, length(word))) AS k)),
use AS (SELECT head FROM h JOIN q ON q.letters = h.word GROUP BY head HAVING count(*) < 40)
SELECT head, word FROM h WHERE head IN (SELECT head FROM use) AND coalesce((SELECT n FROM f WHERE f.letters = head), 0) / (SELECT t FROM total) < 5e-5"""
)
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes that may stand for query words: not common words themselves, and of few places."""
    freq = _counts(spark, sf_dir)
    return noisy.heads(noisy.small(_query_words(spark, sf_dir, freq)), freq, noisy.MOST_POSITIONS)


#: Hits with the characters that they start and end at: a token's place is the length of all before it, separators included.
HITS = f"""{QWORDS}, pieces AS (SELECT doc_id, unnest(range(len(w)))::BIGINT AS ti, unnest(w) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '(?s).*?{_TOKEN}') AS w FROM documents)),
ends AS (SELECT doc_id, ti, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ti) AS stop FROM pieces),
h AS (SELECT r.doc_id, r.ti, q.item_id, q.pos, q.weight AS value, (stop - length(t.token))::BIGINT AS start, stop::BIGINT AS stop
      FROM r JOIN q USING (letters) JOIN t ON t.doc_id = r.doc_id AND t.ti = r.ti JOIN ends ON ends.doc_id = r.doc_id AND ends.ti = r.ti)"""


def _exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir)
    return noisy.token_hits(_documents(spark, sf_dir).where("doc_id is not null"), noisy.exact_places(known, _query_words(spark, sf_dir, noisy.letter_counts(known))))


@query(
    f"""WITH {HITS} SELECT a.doc_id, a.item_id, a.ti, count(DISTINCT b.pos) AS positions FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.ti BETWEEN a.ti - 150 AND a.ti
GROUP BY 1, 2, 3 HAVING count(DISTINCT b.pos) >= 3"""
)
def window_min_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy.windows(_exact_hits(spark, sf_dir)).withColumn("ti", F.col("ti").cast("bigint"))


@query(f"WITH {HITS} SELECT doc_id, item_id, ti, pos, start, stop, substr(text, start + 1, stop - start) AS token FROM h JOIN documents USING (doc_id)")
def hit_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their characters, and the token that stands there."""
    out = _exact_hits(spark, sf_dir)
    return out.select("doc_id", "item_id", *(F.col(c).cast("bigint") for c in ("ti", "pos", "start")), F.col("end").cast("bigint").alias("stop"), "token")


@query()
def ordered_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three kinds of match, chained: the best chain of each stretch, the best 15 of each item."""
    known = _known(spark, sf_dir)
    return noisy.stretch_dedupe(noisy.chains(_documents(spark, sf_dir), noisy.places(known, _query_words(spark, sf_dir, noisy.letter_counts(known)))))


@query(
    f"""WITH {HITS}, g AS (SELECT doc_id, item_id, start // 2000 AS stretch, count(DISTINCT pos) AS score, min(start) AS first FROM h GROUP BY 1, 2, 3)
SELECT * FROM (SELECT item_id, doc_id, first, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, first) AS rank FROM g) WHERE rank <= 15"""
)
def stretch_dedupe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each stretch of 2,000 characters, by distinct query places; the 15 best of each item."""
    found = _exact_hits(spark, sf_dir).groupBy("doc_id", "item_id", F.floor(F.col("start") / noisy.STRETCH).alias("s")).agg(F.count_distinct("pos").alias("score"), F.min("start").alias("offset"))
    out = noisy.stretch_dedupe(found.withColumn("ti", F.col("offset")))
    return out.select("item_id", "doc_id", F.col("offset").cast("bigint").alias("first"), "score", F.col("rank").cast("bigint").alias("rank"))


@query()
def shuffled_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain scores against each item's words in a shuffled order; the corpus' words are counted once for both."""
    docs, bench = _documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text")
    known = _known(spark, sf_dir)
    freq = noisy.letter_counts(known)
    found = [noisy.stretch_dedupe(noisy.chains(docs, noisy.places(known, noisy.query_words(q, freq)))) for q in (bench, noisy.shuffled(bench))]
    return noisy.margins(*found)


# Sequences


@query(
    "SELECT facet, value, count(*) AS n FROM (SELECT unnest(['status', 'priority']) AS facet, unnest([coalesce(nullif(trim(o_orderstatus), ''), '?'), coalesce(nullif(trim(o_orderpriority), ''), '?')]) AS value FROM orders) GROUP BY 1, 2"
)
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return sequences.facets(rows, ["status", "priority"], "o_orderkey").drop("first")


@query(
    "SELECT facet, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, first, value) AS rank FROM (SELECT facet, value, count(*) AS n, min(p_partkey) AS first FROM "
    "(SELECT p_partkey, unnest(['brand', 'type', 'size']) AS facet, unnest([coalesce(nullif(trim(p_brand), ''), '?'), coalesce(nullif(trim(p_type), ''), '?'), p_size::VARCHAR]) AS value FROM part) GROUP BY 1, 2)) WHERE rank <= 5"
)
def topn_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    return sequences.top_facets(sequences.facets(rows, ["brand", "type", "size"], "p_partkey"), 5).select("facet", "value", "n", F.col("rank").cast("bigint").alias("rank"))


RUN = ["click", "purchase", "view", "signup", "logout"]
_RUN = ", ".join(f"'{x}'" for x in RUN)


@query(f"SELECT user_id FROM events WHERE event_type IN ({_RUN}) GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events WHERE event_type IN ({_RUN}))")
def full_run_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with every event type of the run that occurs at all."""
    rows = table(spark, sf_dir, "events", "user_id", "event_type").where(F.col("event_type").isin(*RUN))
    return sequences.full_runs(rows, "user_id", "event_type")


@query("SELECT n_held, count(*) AS owners FROM (SELECT user_id, count(DISTINCT event_type) AS n_held FROM events WHERE event_type IS NOT NULL GROUP BY 1) GROUP BY 1")
def held_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.held_histogram(table(spark, sf_dir, "events", "user_id", "event_type"), "user_id", "event_type")


@query(
    "WITH e AS (SELECT DISTINCT c_nationkey, c_mktsegment || ' ' || c_custkey % 40 AS kind FROM customer), k AS (SELECT DISTINCT kind FROM e), "
    "u AS (SELECT c_nationkey FROM e GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM k) - 1) "
    "SELECT kind, count(*) AS owners FROM (SELECT c_nationkey, kind FROM u, k EXCEPT SELECT * FROM e) GROUP BY 1"
)
def missing_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of customers that nations with all kinds but one lack."""
    kind = F.concat_ws(" ", "c_mktsegment", F.col("c_custkey") % 40).alias("kind")
    return sequences.missing(table(spark, sf_dir, "customer").select("c_nationkey", kind), "c_nationkey", "kind")


@query("SELECT event_type, next, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL GROUP BY 1, 2")
def next_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.successors(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.first_links(table(spark, sf_dir, "events", "event_id", "user_id", "event_type"), "user_id", "event_type", "event_id")


@query(
    "SELECT event_type AS result_url, min(event_id) AS ord, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS retrieved_by FROM events GROUP BY 1"
)
def provenance_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("result_url"), F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("retrieved_by"))
    return sequences.distinct_results(rows).withColumn("retrieved_by", F.array_join("retrieved_by", ","))


@query(
    "SELECT conv_id, CASE WHEN k = n THEN 'ok' WHEN k > 0 THEN 'partial' ELSE 'unavailable' END AS status, k = n AND NOT truncated AS complete, truncated FROM "
    "(SELECT conv_id, count(*) FILTER (length(text) > 40) AS k, count(*) AS n, bool_or(length(text) > 2000) AS truncated FROM conversations GROUP BY 1)"
)
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.length("text") > 40).alias("ok"), (F.length("text") > 2000).alias("truncated"))
    return sequences.rollup_status(rows, "conv_id")


MELODIES = ((1, "1--ddC---f--7g--hG--5"), (2, "9--a-b-c-d"), (3, "k-l-m-n-o-p-q"), (4, "1---g--gh--k-h-g---4"), (5, "dd"), (6, "d-x-f-g"))


@query(
    r"""WITH m(melody_id, volpiano) AS (VALUES (1, '1--ddC---f--7g--hG--5'), (2, '9--a-b-c-d'), (3, 'k-l-m-n-o-p-q'), (4, '1---g--gh--k-h-g---4'), (5, 'dd'), (6, 'd-x-f-g')),
c AS (SELECT melody_id, list_filter(string_split(regexp_replace(lower(volpiano), '[-13457]', '', 'g'), ''), lambda x: x <> '') AS l FROM m WHERE regexp_full_match(lower(volpiano), '[9a-hj-q13457-]+')),
u AS (SELECT melody_id, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]) AS l FROM c), k AS (SELECT melody_id, list_transform(l, lambda x: strpos('9abcdefghjklmnopq', x)) AS p FROM u WHERE len(l) BETWEEN 4 AND 14)
SELECT melody_id::INT AS melody_id, s AS shift, '1-' || array_to_string(list_transform(p, lambda x: '9abcdefghjklmnopq'[x + s]), '-') AS query FROM k, LATERAL (SELECT unnest(range(1 - list_min(p), 18 - list_max(p))) AS s)"""
)
def pitch_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.melody_placements(spark.createDataFrame(MELODIES, "melody_id int, volpiano string")).withColumn("shift", F.col("shift").cast("bigint"))


# Catalogue


def sql_lines(c: str) -> str:
    for tag in ("script", "style", "nav", "header", "footer"):
        c = rf"regexp_replace({c}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
    c = rf"regexp_replace({c}, '(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/dt|/dd)\b[^>]*>', chr(10), 'g')"
    c = f"regexp_replace({c}, '(?s)<[^>]+>', ' ', 'g')"
    for name, ch in text.ENTITIES.items():
        c = f"replace({c}, '{name}', {'chr(160)' if ch == chr(160) else 'chr(39)' if ch == chr(39) else repr(ch)})"
    return rf"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


@query(f"SELECT page_id, {sql_lines('html')} AS body FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.visible_lines(F.col("html")).alias("body"))


@query(
    "WITH p AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages), u AS (SELECT page_id, unnest(l) AS link, unnest(range(len(l))) AS k FROM p) "
    "SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY min(k)) - 1 AS ord FROM u GROUP BY page_id, link"
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.links(F.col("html"))).alias("ord", "link")).withColumn("ord", F.col("ord").cast("bigint"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unexamined_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.unlisted(table(spark, sf_dir, "documents", "doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records: the shelfmark of each is a list of two numbers, its own and the next."""
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("nation "), "s_nationkey").alias("institution"), F.concat("s_suppkey", F.lit(", "), F.col("s_suppkey") + 1).alias("shelfmark"))


@query(
    "WITH s AS (SELECT s_suppkey AS id, 'nation ' || s_nationkey AS inst, s_suppkey || ', ' || (s_suppkey + 1) AS mark FROM supplier), c AS (SELECT c_custkey AS id, 'nation ' || c_nationkey AS inst, c_custkey::VARCHAR AS mark FROM customer) "
    "SELECT c.id, s.id AS sibling FROM c JOIN s ON c.inst = s.inst AND (contains(', ' || s.mark || ', ', ', ' || c.mark || ', ') OR contains(', ' || c.mark || ', ', ', ' || s.mark || ', '))"
)
def sibling_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("nation "), "c_nationkey", F.lit(", "), "c_custkey").alias("shelfmark"))
    return ledger.siblings(rows, _marks(spark, sf_dir))


_FIELD = "CASE event_type WHEN 'view' THEN 'Title' WHEN 'click' THEN 'host volume note' ELSE event_type END"
_TERM = "CASE WHEN value > 50 THEN 'known' ELSE 'unknown' END"


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("user_id AS id", "event_id AS ord", f"{_TERM} AS term", f"array({_FIELD}) AS fields")
    return ledger.merge_terms(e)


_MERGE = f"""WITH e AS (SELECT user_id AS id, event_id AS ord, {_TERM} AS term, {_FIELD} AS field FROM events),
f AS (SELECT id, list(field ORDER BY o) AS fields FROM (SELECT id, field, min(ord) AS o FROM e GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT id, list(term ORDER BY o) AS terms FROM (SELECT id, term, min(ord) AS o FROM e GROUP BY 1, 2) GROUP BY 1)"""


@query(f"{_MERGE} SELECT id, array_to_string(fields, '; ') AS fields, array_to_string(terms, '; ') AS terms FROM f JOIN t USING (id)")
def term_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("id", F.array_join("fields", "; ").alias("fields"), F.array_join("terms", "; ").alias("terms"))


@query(
    f"""{_MERGE} SELECT id, CASE WHEN terms = ['unknown'] AND NOT list_has_any(fields, ['Title', 'Subtitle', 'Text title of the content item']) THEN 'host'
WHEN list_has_any(fields, ['Title', 'Subtitle', 'Text title of the content item', 'Document summary']) THEN 'title'
WHEN fields = ['host volume note'] THEN 'host' ELSE 'description' END AS scope FROM f JOIN t USING (id)"""
)
def scope_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("id", "scope")


@query("SELECT p_partkey, density, row_number() OVER (ORDER BY density DESC NULLS LAST, p_partkey) AS rank FROM (SELECT p_partkey, round_even(p_size * 100 / (p_size + 0.5), 1) AS density FROM part)")
def density_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels for each millimetre of parts "s x s,5 mm" whose image is 100 s pixels; ranked over all parts in ranges."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("mm", records.millimetres(F.concat("p_size", F.lit(" x "), "p_size", F.lit(",5 mm"))))
    d = p.select("p_partkey", records.density(F.col("p_size") * 100, F.col("mm.long")).alias("density"))
    down = d.withColumn("down", F.coalesce(-F.col("density"), F.lit(float("inf"))))
    return order.numbered(down, "down", "rank", "p_partkey").select("p_partkey", "density", "rank")


@query("SELECT p_partkey, CASE WHEN p_size * 30 < 1200 THEN CASE WHEN p_size % 2 = 0 THEN 'SMALL; DESC' ELSE 'SMALL' END WHEN p_size % 2 = 0 THEN 'DESC' ELSE '' END AS flags FROM part")
def candidate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = records.flags(F.col("p_size") * 30, F.col("p_size") % 2 == 0, F.lit(False), F.lit(False))
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.array_join(f, "; ").alias("flags"))


@query(
    "SELECT doc_id FROM (SELECT doc_id, lower(text) AS body, strftime(DATE '1400-01-01' + (doc_id % 20000)::INT, '%Y-%m-%d') AS a, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE strftime(DATE '1400-01-01' + (doc_id % 20000)::INT + 30, '%Y-%m-%d') END AS z FROM documents) "
    "WHERE contains(body, 'the') AND contains(body, 'tion') AND coalesce(z, '9999') >= '1400-06-01' AND a <= '1402-12-31'"
)
def interval_overlap_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("1400-01-01").cast("date"), (F.col("doc_id") % 20000).cast("int"))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumns({"start_date": day.cast("string"), "end_date": F.when(F.col("doc_id") % 7 != 0, F.date_add(day, 30).cast("string"))})
    return sequences.regest_hits(docs, ["The", "tion"], ["text"], "1400-06-01", "1402-12-31").select("doc_id")


# Ledger

_LEDGER = """SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'identified' WHEN quality = 0 THEN 'partial' ELSE 'unidentified' END AS status,
CASE WHEN toxic = 1 THEN CASE WHEN doc_id % 5 = 0 THEN 'medium' ELSE 'high' END WHEN quality = 0 THEN 'low' ELSE 'none' END AS confidence,
CASE WHEN toxic = 1 AND doc_id % 3 <> 0 THEN 'law' END AS kind, CASE WHEN toxic = 1 AND doc_id % 11 = 0 THEN true END AS document,
CASE WHEN toxic = 1 THEN '2026-01-01' END AS identified_on, CASE WHEN doc_id % 2 = 0 THEN '2026-02-01' ELSE '2025-12-01' END AS examined,
CASE WHEN toxic = 1 AND doc_id % 4 = 0 THEN 'a study' END AS known_from, CASE WHEN doc_id % 13 = 0 THEN 'http://example.org' ELSE 'https://example.org' END AS record,
CASE WHEN doc_id % 17 = 0 THEN 'seen in /tmp/x' ELSE 'a note' END AS note, 'text' AS identification, doc_id AS "order" FROM labels"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "labels").createOrReplaceTempView("lectern_labels")
    return spark.sql(_LEDGER.replace("FROM labels", "FROM lectern_labels").replace('"order"', "`order`"))


@query(
    f"""WITH l AS ({_LEDGER}) SELECT id, rule FROM (SELECT id, unnest([
CASE WHEN NOT ((status = 'identified' AND confidence = 'high') OR (status = 'partial' AND confidence IN ('medium', 'low')) OR (status = 'unidentified' AND confidence = 'none')) THEN 'confidence' END,
CASE WHEN status = 'identified' AND kind IS NULL THEN 'kind' END, CASE WHEN status <> 'identified' AND kind IS NOT NULL THEN 'kind-without-identification' END,
CASE WHEN status = 'identified' AND (kind IS NULL OR coalesce(document, false)) THEN 'document' END,
CASE WHEN status = 'identified' AND identified_on > examined THEN 'dates' END, CASE WHEN record NOT LIKE 'https://%' THEN 'record' END, CASE WHEN note LIKE '%/tmp/%' THEN 'local-path' END]) AS rule FROM l) WHERE rule IS NOT NULL"""
)
def ledger_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.violations(_ledger(spark, sf_dir))


@query(
    f"""WITH l AS ({_LEDGER}) SELECT id, CASE WHEN id % 6 = 0 THEN 'identified' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN 'high' ELSE confidence END AS confidence,
CASE WHEN id % 6 = 0 THEN 'science' ELSE kind END AS kind, CASE WHEN id % 6 = 0 THEN coalesce(identified_on, '2026-11-26') ELSE identified_on END AS identified_on,
CASE WHEN id % 6 = 0 THEN '2026-11-26' ELSE examined END AS examined, CASE WHEN id % 6 = 0 THEN NULL ELSE known_from END AS known_from FROM l"""
)
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledger(spark, sf_dir)
    new = rows.where("id % 6 = 0").selectExpr("id", "'identified' AS status", "'high' AS confidence", "'new' AS identification", "note", "'science' AS kind", "CAST(NULL AS BOOLEAN) AS document", "CAST(NULL AS STRING) AS known_from")
    return ledger.upsert(rows, new, "2026-11-26").select("id", "status", "confidence", "kind", "identified_on", "examined", "known_from")


@query(f"WITH l AS ({_LEDGER}), t AS (SELECT max(\"order\") AS top FROM l), n AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT id FROM l)) SELECT id, \"order\" FROM l UNION ALL SELECT id, top + k FROM n, t")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledger(spark, sf_dir).select("id", "order")
    return ledger.append(rows, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("bigint").alias("order")))


@query(f"WITH l AS ({_LEDGER}) SELECT id FROM l WHERE status = 'identified' AND confidence = 'high' AND known_from IS NULL")
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).where(ledger.publishable(F.col("status"), F.col("confidence"), F.col("known_from"))).select("id")


@query(
    f"""WITH l AS ({_LEDGER}) SELECT state, count(l2.state2) AS n FROM (SELECT unnest(['identified', 'partial', 'examined', 'open']) AS state) LEFT JOIN
(SELECT CASE WHEN status = 'identified' AND confidence = 'high' AND known_from IS NULL THEN 'identified' WHEN status IS NULL THEN 'open' WHEN known_from IS NOT NULL THEN 'examined' WHEN status = 'partial' THEN 'partial' ELSE 'examined' END AS state2
 FROM documents LEFT JOIN l ON doc_id = id) l2 ON state = state2 GROUP BY 1"""
)
def status_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _ledger(spark, sf_dir).select(F.col("id").alias("doc_id"), "status", "confidence", "known_from")
    rows = ledger.worklist([table(spark, sf_dir, "documents", "doc_id"), done.select("doc_id")], "doc_id").join(done, "doc_id", "left")
    return ledger.status_counts(rows.select(ledger.state(F.col("status"), F.col("confidence"), F.col("known_from")).alias("state")), ["identified", "partial", "examined", "open"]).select("state", "n")


@query(
    """WITH x AS (SELECT doc_id, rint(35 * (CASE WHEN lang = 'en' THEN 1 ELSE 0.25 END) + 30 * least(1.0, log10(greatest(n_chars::DOUBLE, 100.0)) / 5) + 25 * (CASE doc_id % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.9 ELSE 0.5 END)
+ (CASE WHEN """.replace("rint(", "round_even(")
    + " OR ".join(f"contains(lower(text), '{g}')" for g in records.GENRES)
    + """ THEN 10 ELSE 0 END), 0)::BIGINT AS priority FROM documents) SELECT doc_id, priority, row_number() OVER (PARTITION BY priority ORDER BY doc_id) AS place FROM x"""
)
def priority_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars")
    century = F.concat(F.lit("12th or "), F.col("doc_id") % 5 + 13, F.lit("th century"))
    p = records.priority(F.when(F.col("lang") == "en", "Latin").otherwise(F.col("lang")), century, F.col("n_chars").cast("double"), F.col("text"))
    w = Window.partitionBy("priority").orderBy("doc_id")
    return docs.select("doc_id", p.alias("priority")).withColumn("place", F.row_number().over(w).cast("bigint"))


@query(
    """WITH c AS (SELECT conv_id, turn, sha256(text) AS sha, CASE WHEN (conv_id + turn) % 9 = 0 THEN 'x' ELSE lag(sha256(text)) OVER w END AS first_sha, lag(turn) OVER w AS prev FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id || '/' || turn AS id, 'sha256' AS rule FROM c WHERE prev IS NOT NULL AND (conv_id + turn) % 9 = 0"""
)
def lineage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as readings: each names the turn before and its hash; every ninth hash is wrong."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256)).withColumn("prev", F.lag("turn").over(w)).withColumn("psha", F.lag("sha256").over(w))
    readings = c.select(
        F.concat("conv_id", F.lit("/"), "turn").alias("id"), F.col("conv_id").alias("fragment"), "sha256", F.col("turn").alias("captured_at"), F.lit("image-only").alias("kind"),
        F.when(F.col("prev").isNotNull(), F.concat("conv_id", F.lit("/"), "prev")).alias("first_reading"), F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, "x").otherwise(F.col("psha")).alias("first_sha256"),
    )
    return ledger.lineage_violations(readings)


# Calculators

FEASTS = (
    (1454, "Montag vor Jacobi"), (1446, "Samstag vor Judica"), (1451, "Eritag nach Assumptio"), (1601, "Ostern"), (1583, "Pfinztag nach Sannt Michels tag"), (1500, "Weihnachten"), (1700, "Mittwoch vor Fronleichnam"),
)


@query(
    """WITH f(year, kind, val, wanted, dir) AS (VALUES (1454, 'fixed', 725, 1, -1), (1446, 'movable', -14, 6, -1), (1451, 'fixed', 815, 2, 1), (1601, 'movable', 0, NULL, 0), (1583, 'fixed', 929, 4, 1), (1500, 'fixed', 1225, NULL, 0), (1700, 'movable', 60, 3, -1)),
e AS (SELECT *, year >= 1584 AS greg, (19 * (year % 19) + 15) % 30 AS jd, year % 19 AS a, year // 100 AS b, year % 100 AS c FROM f),
g AS (SELECT *, (2 * (year % 4) + 4 * (year % 7) - jd + 34) % 7 AS je, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e),
i AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM g),
s AS (SELECT *, CASE WHEN greg THEN h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 ELSE jd + je + 114 END AS s FROM i),
m AS (SELECT *, CASE WHEN kind = 'fixed' THEN val // 100 ELSE s // 31 END AS mo, CASE WHEN kind = 'fixed' THEN val % 100 ELSE s % 31 + 1 END AS dd FROM s),
y AS (SELECT *, year + 4800 - (14 - mo) // 12 AS yy, mo + 12 * ((14 - mo) // 12) - 3 AS mm FROM m),
n AS (SELECT *, dd + (153 * mm + 2) // 5 + 365 * yy + yy // 4 - (CASE WHEN greg THEN yy // 100 - yy // 400 + 32045 ELSE 32083 END) + (CASE WHEN kind = 'movable' THEN val ELSE 0 END) AS feast FROM y)
SELECT year, feast AS feast_number, CASE dir WHEN 0 THEN feast WHEN 1 THEN feast + 1 + ((wanted - (feast + 2) % 7 + 7) % 7) ELSE feast - 1 - ((feast % 7 - wanted + 7) % 7) END AS day_number FROM n"""
)
def feast_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.resolve(spark.createDataFrame(FEASTS, "year int, expr string")).select("year", "feast_number", "day_number")


MARKS = ("lat. 14174", "Nouvelle acquisition latine 999", "n.a.l. 999", "nouv. acq. fr. 12", "fr. 123", "Latin  77a", "Other 5")


@query("SELECT * FROM (VALUES ('lat. 14174', 'Latin 14174'), ('Nouvelle acquisition latine 999', 'NAL 999'), ('n.a.l. 999', 'NAL 999'), ('nouv. acq. fr. 12', 'NAF 12'), ('fr. 123', 'Français 123'), ('Latin  77a', 'Latin 77a'), ('Other 5', 'Other 5')) t(cited, shelfmark)")
def canonical_shelfmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in MARKS], "cited string").withColumn("shelfmark", records.shelfmark(F.col("cited")))


@query(
    "WITH p AS (SELECT p_partkey, p_size * 100 AS s FROM part), n AS (SELECT *, CASE WHEN s <= 1500 THEN 1 ELSE ceil((s - 200) / 1300.0)::BIGINT END AS n FROM p) "
    "SELECT p_partkey, k, CASE WHEN n = 1 THEN 0 ELSE floor(k * (s - 1500) / (n - 1))::BIGINT END AS top, CASE WHEN n = 1 THEN s ELSE floor(k * (s - 1500) / (n - 1))::BIGINT + 1500 END AS bottom FROM n, LATERAL (SELECT unnest(range(0, n)) AS k)"
)
def image_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (F.col("p_size") * 100).alias("height"))
    return images.strips(p, 1500, 200).select(F.col("image").alias("p_partkey"), *(F.col(c).cast("bigint") for c in ("k", "top", "bottom")))


@query(
    """WITH i AS (SELECT p_partkey, (p_size * 300)::BIGINT AS w, (p_size * 200)::BIGINT AS h FROM part), s AS (SELECT floor(1500 * pow(1.5, k))::BIGINT AS t FROM range(0, 13) x(k)),
c AS (SELECT *, CASE WHEN w <= t THEN 1 ELSE ceil((w - 200) / (t - 200))::BIGINT END AS nx, CASE WHEN h <= t THEN 1 ELSE ceil((h - 200) / (t - 200))::BIGINT END AS ny FROM i, s),
f AS (SELECT p_partkey, min(t) AS t FROM c WHERE nx * ny <= 40 GROUP BY 1), b AS (SELECT p_partkey, w, h, t, nx, ny, unnest(range(0, nx)) AS x FROM c JOIN f USING (p_partkey, t)), e AS (SELECT *, unnest(range(0, ny)) AS y FROM b),
g AS (SELECT p_partkey, CASE WHEN nx = 1 THEN 0 ELSE floor(x * (w - t) / (nx - 1))::BIGINT END AS x0, CASE WHEN ny = 1 THEN 0 ELSE floor(y * (h - t) / (ny - 1))::BIGINT END AS y0,
      CASE WHEN nx = 1 THEN w ELSE floor(x * (w - t) / (nx - 1))::BIGINT + t END AS x1, CASE WHEN ny = 1 THEN h ELSE floor(y * (h - t) / (ny - 1))::BIGINT + t END AS y1 FROM e)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY y0, x0) - 1 AS k, x0, y0, x1, y1 FROM g"""
)
def tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (F.col("p_size") * 300).alias("width"), (F.col("p_size") * 200).alias("height"))
    return images.tiles(p).select(F.col("image").alias("p_partkey"), *(F.col(c).cast("bigint").alias(n) for c, n in (("k", "k"), ("left", "x0"), ("top", "y0"), ("right", "x1"), ("bottom", "y1"))))


@query("SELECT p_partkey, k // 20 AS page, k // 4 % 5 AS sheet_row, k % 4 AS sheet_column FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part)")
def contact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), F.col("p_partkey").alias("ord"))
    return images.sheet(p).select(F.col("image").alias("p_partkey"), *(F.col(c).cast("bigint").alias(n) for c, n in (("page", "page"), ("row", "sheet_row"), ("column", "sheet_column"))))


# Access and stored responses


@query(
    """WITH d AS (SELECT source AS shelfmark, text, string_split(text, 'the') AS w FROM documents WHERE source = 'src0'), p AS (SELECT *, unnest(range(1, len(w))) AS k FROM d),
o AS (SELECT shelfmark, text, (list_sum(list_transform(w[1:k], lambda x: length(x))) + (k - 1) * 3)::BIGINT AS place FROM p)
SELECT shelfmark, place, substring(text, greatest(place - 20, 0) + 1, place + 23 - greatest(place - 20, 0)) AS context FROM o"""
)
def context_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("shelfmark"), "text")
    return noisy.context(docs, "src0", "the", before=20, after=20).select("shelfmark", F.col("offset").cast("bigint").alias("place"), "context")


@query(f"WITH {PAIRS} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM p)")
def unmatched_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(spark, sf_dir)
    return found.select("item_id").join(retrieval.containing(documents(spark, sf_dir), found), "item_id", "left_anti")


@query(f"WITH {B} SELECT item_id, '\"(?i)' || replace(folded, ' ', '\" \"(?i)') || '\"' AS cql FROM b WHERE folded <> ''")
def word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("folded <> ''").select("item_id", records.word_query(F.split("folded", " ")).alias("cql"))


_URL = "CASE WHEN page_id % 3 = 0 THEN replace(url, '://', '://user:word@') WHEN page_id % 5 = 0 THEN replace(url, 'http', 'ftp') WHEN page_id % 7 = 0 THEN 'no link' ELSE url END"


@query(f"SELECT page_id, regexp_matches({_URL}, '^https?://[^/@?#]+(/|[?]|#|$)') AS public FROM pages")
def public_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", records.public_url(F.expr(_URL)).alias("public"))


@query(
    "SELECT page_id::VARCHAR AS url, CASE WHEN page_id % 10 = 0 THEN 'no receipt' ELSE 'changed' END AS rule FROM pages WHERE html IS NOT NULL AND (page_id % 10 = 0 OR page_id % 9 = 0) "
    "UNION ALL SELECT page_id::VARCHAR, 'no body' FROM pages WHERE html IS NULL"
)
def receipt_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored responses; every tenth has no receipt and every ninth a wrong one."""
    sha = F.when(F.col("page_id") % 10 == 0, None).when(F.col("page_id") % 9 == 0, "x").otherwise(F.sha2(F.encode("html", "UTF-8"), 256))
    return responses.receipt_violations(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), F.col("html").alias("body"), sha.alias("sha256")))


@query(
    "WITH r AS (SELECT DISTINCT event_type AS query, n_name AS volume FROM events JOIN nation ON n_nationkey = user_id % 40) "
    "SELECT query, volume, CASE WHEN r.query IS NULL THEN 'unavailable' ELSE 'ok' END AS status FROM (SELECT DISTINCT event_type AS query FROM events) q CROSS JOIN (SELECT n_name AS volume FROM nation) v LEFT JOIN r USING (query, volume)"
)
def volume_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of event as queries and nations as volumes, of which each kind has answers for some."""
    e, n = table(spark, sf_dir, "events", "event_type", "user_id"), table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    stored = e.join(n, F.col("n_nationkey") == F.col("user_id") % 40).groupBy(F.col("event_type").alias("query"), F.col("n_name").alias("volume")).agg(F.lit("{}").alias("body"))
    return responses.volume_fan(e.select(F.col("event_type").alias("query")).distinct(), n.select(F.col("n_name").alias("volume")), stored).select("query", "volume", "status")


@query("SELECT k.conv_id AS conv_id, k.turn AS turn, k.text AS original, a.role || ': ' || a.text AS answers FROM conversations k LEFT JOIN (SELECT * FROM conversations WHERE turn % 2 = 1) a USING (conv_id, turn)")
def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a key; the odd ones have their own speaker's answer."""
    c = table(spark, sf_dir, "conversations").withColumnsRenamed({"conv_id": "set", "turn": "file"})
    found = reporting.paired(c.select("set", "file", F.col("text").alias("original")), c.where("file % 2 = 1").select("set", "file", F.col("role").alias("reader"), F.col("text").alias("words")))
    joined = F.array_join(F.transform("answers", lambda a: F.concat(a["reader"], F.lit(": "), a["words"])), "; ")
    return found.select(F.col("set").alias("conv_id"), F.col("file").alias("turn"), "original", joined.alias("answers"))
