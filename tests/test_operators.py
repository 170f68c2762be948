import random
import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import records
from lectern.operators import images, ledger, noisy, order, reporting, retrieval, sequences
from lectern.sources import files, responses, sinks

ANCHORS = [{"id": "a", "variants": [{"text": "alpha beta"}]}, {"id": "b", "variants": [{"parts": ["gamma", "delta"], "gaps": [{"min": 1, "max": 9}]}]}, {"id": "c", "variants": [{"text": "nowhere"}]}]
ANCHORS[1]["variants"][0]["gaps"] = [(1, 9)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "Alpha beta, then gamma x delta."), (2, "delta gamma"), (3, None), (4, "alpha betta\nalpha beta")], "doc_id bigint, text string")


def test_search_end_to_end(spark, docs):
    got = retrieval.search(docs, ANCHORS).collect()
    assert [(r.doc_id, r.matched, r.anchors) for r in got] == [(1, 2, [0, 1]), (4, 1, [0])]
    import math

    assert got[0].score == pytest.approx(1 + math.log(5 / 3) + 1 + math.log(5 / 2), abs=1e-6) and got[0].gaps == [7]
    hits = retrieval.anchor_hits(docs, ANCHORS, edits=1)
    assert sorted((r.doc_id, r.anchor, r.edits, r.matched, r.line) for r in hits.where("doc_id = 4").collect()) == [(4, 0, 0, "alpha beta", 2), (4, 0, 1, "alpha betta", 1)]
    counts = retrieval.hit_counts(hits, spark.createDataFrame([(0,), (1,), (2,)], "anchor int"))
    assert {(r.anchor, r.df) for r in counts.collect()} == {(0, 2), (1, 1), (2, 0)}


def test_bad_queries_are_refused(docs):
    for bad in ([{"id": "a", "variants": [{"parts": ["x", "y"], "gaps": [(3, 1)]}]}], [ANCHORS[0], ANCHORS[0]]):
        with pytest.raises(ValueError):
            retrieval.anchor_hits(docs, bad)
    with pytest.raises(ValueError):
        retrieval.search(docs, ANCHORS, window=0)


def test_containing_and_pages(spark, docs):
    items = spark.createDataFrame([(7, "alpha beta"), (8, "zzz"), (9, "")], "item_id bigint, text string")
    got = retrieval.containing(retrieval.folded(docs).select("doc_id", "folded"), retrieval.folded(items).select("item_id", "folded"))
    assert {tuple(r) for r in got.collect()} == {(1, 7, 1), (4, 7, 1)}
    pages = spark.createDataFrame([(1, 0, 5), (1, 5, 40)], "doc_id bigint, page_start int, page_end int")
    over = retrieval.page_overlaps(spark.createDataFrame([(1, 3, 8)], "doc_id bigint, start int, `end` int"), pages)
    assert {(r["from"], r["to"]) for r in over.collect()} == {(3, 5), (5, 8)}


def test_witness_beats_decoy_and_null(spark):
    words = [f"{c}{d}orbusque{c}" for c in "bcdfghklmn" for d in "aeio"]
    mixed = words[:]
    random.Random(3).shuffle(mixed)
    filler = " ".join(f"lorem{k % 9} ipsum{k % 7}" for k in range(60_000))
    rows = [(1, " ".join(words)), (2, " ".join(mixed)), (3, filler)]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string")
    query = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    freq = noisy.frequencies(corpus)
    known = noisy.vocabulary(corpus)
    find = lambda q: noisy.stretch_dedupe(noisy.chains(corpus, noisy.places(known, noisy.query_words(q, freq))))
    got = noisy.margins(find(query), find(noisy.shuffled(query))).orderBy("rank").collect()
    assert got[0].doc_id == 1 and got[0].chain == 40 and got[0].margin > 3
    best = noisy.excerpts(find(query).where("rank = 1"), corpus, around=5).first()
    assert (best.offset, best.end, best.position) == (0, len(rows[0][1]), 0.0) and best.excerpt == rows[0][1]


def test_items_that_are_not_usable_drop_out(spark):
    corpus = spark.createDataFrame([(1, "quorumbus sanctorumque praeclara " * 3 + "lorem " * 200_000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "sanctorumque praeclara", None), (2, "sanctorumque praeclara", False), (3, "praeclara", True), (4, "... 12", True)], "item_id bigint, text string, usable boolean")
    assert {r.item_id for r in noisy.usable(items).collect()} == {1, 3}
    assert {r.item_id for r in noisy.query_words(items, noisy.frequencies(corpus)).collect()} == {1, 3}


def test_blocks_of_items_find_what_one_pass_finds(spark, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(8)) for _ in range(300)]
    corpus = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(200))) for k in range(30)], "doc_id bigint, text string")
    items = spark.createDataFrame([(k, " ".join(rng.sample(words, 30))) for k in range(12)], "item_id bigint, text string")
    query = items.select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "letters")).withColumns({"n": F.lit(1).cast("bigint"), "t": F.lit(10**6).cast("bigint"), "weight": F.lit(1.0)})
    known = noisy.vocabulary(corpus)
    find = lambda: sorted(map(tuple, noisy.chains(corpus, noisy.places(known, query)).collect()))
    whole = find()
    monkeypatch.setattr(noisy, "MOST_SENT", 40)
    assert find() == whole and len(whole) > 50


def test_sequences(spark):
    rows = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("t", "a", 1), ("t", "a", 3), ("u", " ", 1)], "owner string, item string, ord int")
    assert [r[0] for r in sequences.full_runs(rows, "owner", "item", ["a", "b", "a"]).collect()] == ["s"]
    assert {tuple(r) for r in sequences.missing(rows, "owner", "item", ["a", "b"]).collect()} == {("b", 1)}
    assert {tuple(r) for r in sequences.held_histogram(rows, "owner", "item", ["a", "b"]).collect()} == {(1, 1), (2, 1)}
    top = sequences.top_facets(sequences.facets(rows, ["item"], "ord"), 5).orderBy("rank").collect()
    assert [(r.value, r.n) for r in top] == [("a", 3), ("?", 1), ("b", 1)]
    req = spark.createDataFrame([("x", True, False), ("x", False, False), ("y", False, None), ("z", True, True)], "m string, ok boolean, truncated boolean")
    assert {(r.m, r.status, r.complete) for r in sequences.rollup_status(req, "m").collect()} == {("x", "partial", False), ("y", "unavailable", False), ("z", "ok", False)}
    regest = spark.createDataFrame([("1", "1410-01-01", None, "A <b>Wien</b> deed"), ("2", None, "1399-01-01", "Wien")], "id string, start_date string, end_date string, summary string")
    assert [r.id for r in sequences.regest_hits(regest, ["wien", "deed"], ["summary"], "1400-01-01", "1500-01-01").collect()] == ["1"]


LEDGER = [("F-a", "unidentified", "none", None, None, 1), ("F-b", "identified", "high", "law", "2026-01-01", 2)]


def rows(spark):
    df = spark.createDataFrame(LEDGER, "id string, status string, confidence string, kind string, identified_on string, `order` bigint")
    return df.withColumns({"examined": F.lit("2026-01-02"), "known_from": F.lit(None).cast("string"), "document": F.lit(None).cast("boolean"), "identification": F.lit("x"), "note": F.lit("n"), "record": F.lit("https://r.example")})


def result(spark, *values):
    return spark.createDataFrame([values], "id string, status string, confidence string, identification string, note string, kind string, document boolean, known_from string")


def test_ledger(spark):
    base = rows(spark)
    assert ledger.violations(base).count() == 0
    got = {r.id: r for r in ledger.upsert(base, result(spark, "F-b", "partial", "low", "y", "m", None, None, None), "2026-03-01").collect()}
    assert (got["F-b"].kind, got["F-b"].identified_on, got["F-b"].examined, got["F-a"].examined) == (None, None, "2026-03-01", "2026-01-02")
    kept = ledger.upsert(base, result(spark, "F-b", "identified", "high", "y", "m", "arts", None, None), "2026-03-01").where("id = 'F-b'").first()
    assert (kept.identified_on, kept.kind) == ("2026-01-01", "arts")
    with pytest.raises(ValueError):
        ledger.upsert(base, result(spark, "F-a", "identified", "low", "y", "m", "law", None, None), "2026-03-01")
    bad = base.withColumn("record", F.lit("http://r")).union(base.where("id = 'F-a'"))
    assert {tuple(r) for r in ledger.violations(bad).collect()} == {("F-a", "record"), ("F-b", "record"), ("F-a", "unique")}
    more = ledger.append(base.select("id", "order"), spark.createDataFrame([("F-b", 0), ("F-d", 0), ("F-c", 0)], "id string, `order` bigint"))
    assert {tuple(r) for r in more.collect()} == {("F-a", 1), ("F-b", 2), ("F-c", 3), ("F-d", 4)}
    counts = ledger.status_counts(base.select(ledger.state(F.col("status"), F.col("confidence"), F.col("known_from")).alias("state")), ["identified", "partial", "examined", "open"])
    assert {(r.state, r.n) for r in counts.collect()} == {("identified", 1), ("partial", 0), ("examined", 1), ("open", 0)}


def test_lineage(spark):
    cols = "id string, fragment string, sha256 string, captured_at string, kind string, first_reading string, first_sha256 string"
    data = [("1", "f", "h", "2026-01-02", "image-only", None, None), ("2", "f", "i", "2026-01-03", "source-assisted", "1", "h"), ("3", "f", "j", "2026-01-01", "source-assisted", "1", "h"), ("4", "f", "k", "2026-01-05", "source-assisted", "1", "x"), ("5", "g", "l", "2026-01-05", "source-assisted", "1", "h"), ("6", "f", "m", "2026-01-06", "source-assisted", "2", "i")]
    assert {tuple(r) for r in ledger.lineage_violations(spark.createDataFrame(data, cols)).collect()} == {("3", "order"), ("4", "sha256"), ("5", "missing"), ("6", "kind")}


def test_sweep_merge_and_siblings(spark):
    hits = spark.createDataFrame([("F-1", 2, "unknown", ["host volume"]), ("F-1", 1, "unknown", ["Notes"]), ("F-2", 3, "law", ["Title"]), ("F-3", 4, "law", ["host volume x"])], "id string, ord int, term string, fields array<string>")
    got = {r.id: r for r in ledger.merge_terms(hits).collect()}
    assert got["F-1"].fields == ["Notes", "host volume"] and [got[f"F-{k}"].scope for k in (1, 2, 3)] == ["host", "title", "host"]
    sweep = spark.createDataFrame([("x", "Lib A, Album II, nr. 3"), ("y", "Lib A, MS 1")], "id string, shelfmark string")
    own = spark.createDataFrame([("F-1", "Lib A", "MS 1, MS 2"), ("F-2", "Lib A", "Album II, nr. 8"), ("F-3", None, "MS 1")], "id string, institution string, shelfmark string")
    assert {tuple(r) for r in ledger.siblings(sweep, own).collect()} == {("y", "F-1")}


def test_worklist_precedence(spark):
    a, b = spark.createDataFrame([(1, "new")], "k int, v string"), spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    assert {(r.k, r.v) for r in ledger.worklist([a, b], "k").collect()} == {(1, "new"), (2, "old")}


def test_numbered(spark):
    got = order.numbered(spark.range(5000).select((F.col("id") * 37 % 5000).alias("v")), "v", "n").collect()
    assert all(r.n == r.v + 1 for r in got)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"text": "a b", "shelfmark": "m", "pages": 2}\nnot json\n{"text": "c"}\n')
    assert files.record_lines(spark, str(tmp_path / "r.jsonl")).count() == 2
    (tmp_path / "t.tsv").write_text('id\tsummary\n1\t"x\ny"\n')
    assert files.delimited(spark, str(tmp_path / "t.tsv"), "\t").first().summary == "x\ny"
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.txt").write_bytes("é\r\n\fb".encode())
    import hashlib

    sha = hashlib.sha256("é\r\n\fb".encode()).hexdigest()
    manifest = {"documents": [{"id": "a", "path": "texts/a.txt", "source": "s", "sha256": sha, "pages": [{"start": 0, "end": 3}, {"start": 2, "end": 9}]}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    corpus = files.corpus(spark, str(tmp_path / "m.json"), str(tmp_path / "texts"))
    assert corpus.first().text == "é\r\n\fb" and {r.rule for r in files.page_violations(corpus).collect()} == {"range"}
    manifest["documents"][0]["sha256"] = "0"
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    with pytest.raises(Exception, match="changed text"):
        files.corpus(spark, str(tmp_path / "m.json"), str(tmp_path / "texts")).collect()
    docs = spark.createDataFrame([("1", "x", "s"), ("2", "x", "s")], "doc_id string, text string, source string")
    store = str(tmp_path / "store")
    assert sinks.add_texts(store, docs).count() >= 0 and spark.read.parquet(f"{store}/texts").count() == 1
    with pytest.raises(ValueError):
        sinks.add_texts(store, docs.withColumn("text", F.lit("other")))
    sinks.create_new(docs, str(tmp_path / "out"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.create_new(docs, str(tmp_path / "out"))
    sinks.sweep_table(spark.createDataFrame([("F-1", ["a", "b"])], "id string, terms array<string>"), str(tmp_path / "sweep"))
    back = files.latest(spark, str(tmp_path / "sweep")).first()
    assert back.terms == "a; b" and back.id == "F-1"


def test_responses(spark):
    body = lambda **x: json.dumps(x)
    df = spark.createDataFrame([("u", body(items=[{"id": "i", "volumeInfo": {"title": "T", "authors": ["A", "B"], "publishedDate": "1901-02"}, "searchInfo": {"textSnippet": "<b>x</b> &amp; y"}}])), ("v", None), ("w", body(items=[]))], "url string, body string")
    got = {r.url: r for r in responses.volumes(df).collect()}
    assert (got["u"].authors, got["u"].year, got["u"].snippet) == ("A; B", "1901", "x & y") and got["v"].status == "unavailable" and got["w"].status == "ok" and got["w"].ord is None
    page = '<div class="search-result row"><div class="document-title">My title</div><div class="document-title">F-ab12</div><div class="document-headline">Latin · 20 x 10 mm</div><p class="serif x">Lib, 5</p><span class="found-in">Found in: Title</span></div><div class="search-result row">none</div>'
    [r] = responses.result_blocks(spark.createDataFrame([("u", page)], "url string, body string")).collect()
    assert (r.id, r.title, r.dimensions_mm, r.found_in, r.shelfmark) == ("F-ab12", "My title", "20 x 10 mm", ["Title"], "Lib, 5")
    melody = spark.createDataFrame([("a", "<p>2 results</p><tr><td>x</td><td>y</td></tr>"), ("b", "<p>oops</p>"), ("c", "<p>0 results</p>"), ("d", "<p>3 results</p>")], "url string, body string")
    assert {(r.url, r.status, r.truncated) for r in responses.melody_rows(melody).collect()} >= {("a", "ok", True), ("c", "ok", False), ("d", "unavailable", True)}
    table = "<table><tbody><tr>" + "".join(f"<td> c{k} </td>" for k in range(8)) + "</tr><tr><td>1</td></tr></tbody></table>"
    assert [r.cells[7] for r in responses.table_rows(spark.createDataFrame([("u", table)], "url string, body string")).collect()] == ["c7"]
    man = body(sequences=[{"canvases": [{"label": "1r", "width": 5, "height": 6, "images": [{"resource": {"service": {"@id": "b/1"}}}]}]}])
    assert tuple(responses.canvases(spark.createDataFrame([("u", man)], "url string, body string")).first())[2:] == ("1r", "b/1", 5, 6)
    fan = responses.volume_fan(spark.createDataFrame([("q",)], "query string"), spark.createDataFrame([(1,), (2,)], "volume int"), spark.createDataFrame([("q", 1, "b")], "query string, volume int, body string"))
    assert {(r.volume, r.status) for r in fan.collect()} == {(1, "ok"), (2, "unavailable")}
    for f, b in ((responses.full_text, body(hits=[{"identifier": "i", "title": "t", "highlight": ["a", "b", "c", "d"]}])), (responses.digitised, body(total=1, docs=[{"id": "i", "title": "t", "snippets": ["<i>a</i>"]}])), (responses.portal, body(objects=[{"id": "o", "label": "l", "descriptions": ["d"]}], digitized={"o": "y"}, highlighting={"d": {"f": ["1", "2", "3"]}})), (responses.keyword_in_context, body(hits=[{"docPid": "p", "left": ["a"], "match": ["m"], "right": []}], docInfos={"p": {"title": "T"}})), (responses.within_volume, body(search_results=[{"page_number": "3", "snippet_text": "x"}])), (responses.chants, body(chants=[{"siglum": "s"}]))):
        assert f(spark.createDataFrame([("u", b), ("v", None)], "url string, body string")).orderBy("url").collect()[0].status == "ok"
    xml = '<r total="2"><hit><author>A</author><work>W</work><year>9</year><text>t</text></hit></r>'
    assert responses.corpus_hits(spark.createDataFrame([("u", xml)], "url string, body string")).first().author == "A"
    assert responses.heading_links(spark.createDataFrame([("u", '<h1>H</h1><a href="https://own.example/1"><a href="https://o.example/2">')], "url string, body string"), "own.example").first().links == ["https://o.example/2"]


def test_reports(spark):
    base = rows(spark).withColumns({"institution": F.lit("L"), "shelfmark": F.lit("M")})
    assert set(reporting.site(base, {"F-b": "# R"})) == {"index.html", "F-b.html"}
    sheets = spark.createDataFrame([("s", "r", "=== c-1.png ===\nab  c\n=== c-2.png ===\nd")], "set string, reader string, text string")
    got = reporting.sections(sheets)
    assert {(r.file, r.words, r.status) for r in got.collect()} == {("c-1.png", "ab c", "ok"), ("c-2.png", "d", "ok")}
    key = spark.createDataFrame([("s", "c-1.png", "o1"), ("s", "c-3.png", "o3")], "set string, file string, original string")
    assert [None if r.answers is None else r.answers[0].words for r in reporting.paired(key, got).collect()] == ["ab c", None]
    assert sorted(r.place for r in reporting.blinded(key).collect()) == [1, 2]


def test_pages_are_published_and_stale_ones_deleted(spark, tmp_path):
    rows = spark.createDataFrame([("F-b", "open", 3), ("F-a", "open", 3), ("F-c", "partial", 9)], "id string, state string, priority int")
    page = reporting.burndown(rows)
    assert [page.index(x) for x in ("F-c", "F-a", "F-b")] == sorted(page.index(x) for x in ("F-c", "F-a", "F-b"))
    (tmp_path / "old.html").write_text("x")
    (tmp_path / "data.csv").write_text("x")
    assert reporting.publish({"index.html": "i", "burndown.html": page}, str(tmp_path)) == ["old.html"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["burndown.html", "data.csv", "index.html"]


def test_images_are_measured_where_they_are_read(spark, tmp_path):
    import numpy as np

    gray = np.full((60, 40), 230, np.uint8)
    gray[5::12, 4:36] = gray[6::12, 4:36] = 20
    (tmp_path / "a.pgm").write_bytes(b"P5\n# made\n40 60\n255\n" + gray.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"not an image")
    files_ = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in images.measured(files_).collect()}
    assert got["a.pgm"].status == "ok" and got["a.pgm"].pitch == 12 and got["a.pgm"].parts == 5 and got["a.pgm"].ink == pytest.approx(10 * 32 / 2400)
    assert got["b.pgm"].status.startswith("unreadable") and got["b.pgm"].ink is None


def test_image_links_are_rebuilt_for_another_number(spark):
    import base64

    link = lambda key: "https://img.example/iiif/" + base64.b64encode(json.dumps({"key": key, "width": 7}, separators=(",", ":")).encode()).decode().replace("=", "%3D").replace("+", "%2B").replace("/", "%2F")
    df = spark.createDataFrame([(link("book_0007_MAS.jp2"),), ("https://img.example/plain",)], "u string")
    got = [r[0] for r in df.select(records.rebuilt_token(F.col("u"), F.lit(12))).collect()]
    assert got == [link("book_0012_MAS.jp2"), None]


def test_a_manifest_of_version_three_and_missing_sizes(spark):
    body = json.dumps({"items": [{"label": {"none": ["1r"]}, "width": 5, "height": 6, "items": [{"items": [{"body": {"id": "https://i.example/1/full/max/0/default.jpg", "service": [{"id": "https://s.example/1"}]}}]}]}, {"label": {"none": ["1v"]}, "items": [{"items": [{"body": {"id": "https://i.example/2.jpg", "service": [{"id": "https://s.example/2"}]}}]}]}]})
    known = spark.createDataFrame([("https://s.example/2", 70, 80)], "base string, w int, h int")
    rows = responses.canvases(spark.createDataFrame([("u", body)], "url string, body string"), known).orderBy("ord").collect()
    assert [tuple(r)[2:] for r in rows] == [("1r", "https://i.example/1", 5, 6), ("1v", "https://s.example/2", 70, 80)]
