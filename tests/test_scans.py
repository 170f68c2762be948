"""Queries read their texts as often as they must and not more; what is counted, found or parsed once is kept."""

import os
import re

import pytest

from lectern.operators import images, noisy, retrieval
from lectern.plans import stored  # noqa: F401
from lectern.plans.catalogue import QUERIES
from lectern.sources import responses

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def scans(df, name):
    """How often the plan reads a table."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"{name}.parquet")


def test_counts_of_tokens_that_are_handed_on_before_the_last_text(spark, monkeypatch):
    monkeypatch.setattr(noisy, "MOST_HELD", 2)
    docs = spark.createDataFrame([(1, "una duo una"), (2, None), (3, "Tres\x1funa, ıæ")], "doc_id bigint, text string").coalesce(1)
    counted = lambda: {(b["token"][k].as_py(), b["n"][k].as_py()) for b in noisy._counted(iter(docs.select("text").toArrow().to_batches())) for k in range(len(b))}
    assert counted() == {("una", 2), ("duo", 1), ("Tres", 1), ("una", 1), ("ıæ", 1)}
    assert {(r.token, r.n, r.letters) for r in noisy.vocabulary(docs).collect()} == {("una", 3, "una"), ("duo", 1, "duo"), ("Tres", 1, "tres"), ("ıæ", 1, "ae")}


@needs_tables
@pytest.mark.parametrize("name", ["searchable_words", "prefix_match", "one_letter_match", "hit_offsets", "window_min_hits", "stretch_dedupe_topk", "ordered_chain", "shuffled_margin"])
def test_counts_are_made_once(spark, name):
    passes = {"searchable_words": 0, "prefix_match": 0, "one_letter_match": 0, "shuffled_margin": 2}  # that find hits
    assert scans(QUERIES[name](spark, SF), "documents") == passes.get(name, 1)


def test_prefixes_of_many_places_stand_for_all_of_them(spark):
    rows = [(k, 0, f"abc{chr(97 + k // 26)}{chr(97 + k % 26)}", 0, 1_000_000, 1.0) for k in range(45)]
    query = spark.createDataFrame(rows, "item_id bigint, pos int, letters string, n bigint, t bigint, weight double")
    known = spark.createDataFrame([("abc̄", 1, "abc", True), ("x", 1, "x", False)], "token string, n bigint, letters string, short boolean")
    assert {r.item_id for r in noisy.places(known, query).collect()} == set(range(45))


def test_hits_of_a_response_do_not_carry_the_whole_of_it(spark):
    df = spark.createDataFrame([("a", '{"total":2,"docs":[{"id":"1"},{"id":"2"}],"objects":[],"hits":[]}')], "url string, body string")
    for parser in (responses.digitised, responses.portal, responses.keyword_in_context):
        plan = parser(df)._jdf.queryExecution().optimizedPlan().toString()
        (line,) = [x for x in plan.splitlines() if "Generate posexplode" in x]
        (child,) = re.findall(r"hits#\d+", line.split("), ")[0])
        assert not re.search(r"[\[ ](j|body)#", line) and child, line


def test_melody_pages_of_more_rows_than_they_report(spark, tmp_path):
    spark.range(1200).selectExpr("id + 1 AS s_suppkey", "concat('S', id) AS s_name", "int(id % 1150 = 0) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r.url, r.reported, r.returned, r.truncated) for r in QUERIES["stored_melodies"](spark, str(tmp_path)).collect()}
    assert got == {("0", 1000, 1198, True), ("1", 1000, 2, True)}


@needs_tables
@pytest.mark.parametrize(("name", "most"), [("passage_exact", 1), ("anchor_hit_counts", 1), ("page_ranges", 0), ("doc_frequency_weights", 2), ("ordered_passages", 1)])
def test_passages_are_looked_for_once(spark, name, most):
    """Weights count the documents besides."""
    assert scans(QUERIES[name](spark, SF), "documents") == most


def test_items_are_found_in_blocks_and_in_rows_that_repeat_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a b a"), (1, "a b"), (None, "b a b"), (3, None), (4, "ab ba")], "doc_id bigint, folded string")
    items = spark.createDataFrame([(7, "a"), (8, "b a"), (9, "b a"), (10, ""), (11, "c")], "item_id bigint, folded string")
    want = [(1, 7, 1, 0), (1, 7, 3, 0), (1, 8, 1, 2), (1, 9, 1, 2), (None, 7, 1, 2), (None, 8, 1, 0), (None, 9, 1, 0)]
    for size in (1, 1000):
        monkeypatch.setattr(retrieval, "BLOCK", size)
        got = [(r.doc_id, r.item_id, r.n, r.start) for r in retrieval.contained(docs, items).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert retrieval.containing(docs, items.limit(0)).collect() == []


def test_boxes_are_numbered_without_a_shuffle_of_boxes(spark):
    sizes = spark.createDataFrame([("a", 2000, 1000), ("b", 100, 1600), ("b", 1600, 100), ("c", None, 5)], "image string, width int, height int")
    got = images.tiles(sizes)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == [("a", 0, 0, 0, 1500, 1000), ("a", 1, 500, 0, 2000, 1000), ("b", 0, 0, 0, 1500, 100), ("b", 1, 0, 0, 100, 1500), ("b", 2, 100, 0, 1600, 100), ("b", 3, 0, 100, 100, 1600)]
