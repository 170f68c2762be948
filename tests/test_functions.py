import random
import unicodedata
from pyspark.sql import functions as F

from lectern.functions import calendar, records, spans, text
from lectern.operators import images, noisy, reporting


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_fold_equals_the_spans_view(spark):
    raws = ["Præfatio iusta", "ma-\nter ae oe aoe", "A*b  c", "", "x-\ny-\nz ſo Jus", "Ünïcode ÉÈ 12"]
    rows = spark.createDataFrame([(r,) for r in raws], "t string").select("t", text.fold(F.col("t")).alias("f")).collect()
    assert all(r.f == spans.fold_spans(r.t)[0] for r in rows)


def test_words_and_letters(spark):
    assert one(spark, text.deletions(F.lit("abb"))) == ["bb", "ab"]
    assert one(spark, text.deletions(F.lit(""))) == []
    assert one(spark, text.prefixes(F.lit("abcde"))) == ["abc", "abcd"]
    assert one(spark, F.struct(text.letters(F.lit("Vꝓꝯiũ")), text.abbreviated(F.lit("Vꝓꝯiũ")))) == ("uproconiu", True)
    assert one(spark, F.struct(text.letters(F.lit("Jesvs")), text.abbreviated(F.lit("Jesvs")))) == ("iesus", False)
    assert one(spark, text.occurrences(F.lit("a b a"), F.lit("a"))) == 2


def test_html(spark):
    page = "<html><script>x</script><nav>menu</nav><p>A &amp; <b>b</b></p><div>c</div></html>"
    assert one(spark, text.visible_lines(F.lit(page))) == "A & b\nc"
    assert one(spark, text.strip_tags(F.lit(" <i>x</i>&nbsp; y "))) == "x y"
    assert one(spark, text.links(F.lit('<a href="u"><a href="v"><a href="u">'))) == ["u", "v"]


def test_records(spark):
    assert one(spark, records.millimetres(F.lit("205,5 x 140 mm (88)"))) == (205.5, 140.0)
    assert one(spark, records.millimetres(F.lit("205"))) is None
    assert one(spark, records.shelfmark(F.lit("nouv. acq. lat. 999"))) == "NAL 999"
    assert one(spark, records.shelfmark(F.lit("Clm  5"))) == "Clm 5"
    assert one(spark, records.melody(F.lit("1--ddC---f--7g--hG--5"))) == "1-d-c-f-g-h-g"
    assert one(spark, records.notes_of(F.lit("dd"))) is None and one(spark, records.notes_of(F.lit("d-x-f-g"))) is None
    shifts = one(spark, records.placements(F.lit("dcfg")))
    assert (shifts[0].notes, shifts[-1].notes, len(shifts)) == ("a9cd", "nmpq", 13)
    assert one(spark, records.first_century(F.lit("13th or 14th"))) == 13 and one(spark, records.latest_century(F.lit("13th or 14th"))) == 14
    assert one(spark, records.public_url(F.lit("https://a.example/x"))) and not one(spark, records.public_url(F.lit("https://u:p@a.example")))
    assert not one(spark, records.public_url(F.lit("ftp://a.example"))) and not one(spark, records.public_url(F.lit(None).cast("string")))
    assert one(spark, records.flags(F.lit(800), F.lit(True), F.lit(False), F.lit(True))) == ["SMALL", "DESC", "SIB"]
    assert one(spark, records.flags(F.lit(800), F.lit(True), F.lit(True), F.lit(False))) == ["ERR", "DESC"]
    assert one(spark, records.word_query(F.array(F.lit("a"), F.lit("b")))) == '"(?i)a" "(?i)b"'


def test_day_numbers_there_and_back(spark):
    days = spark.range(2_000_000, 2_600_000, 997).select(F.col("id"), F.explode(F.array(F.lit(True), F.lit(False))).alias("g"))
    back = days.withColumn("d", calendar.date_of(F.col("id"), F.col("g"))).withColumn("n", calendar.day_number(F.col("d.year"), F.col("d.month"), F.col("d.day"), F.col("g")))
    assert back.where("n <> id").count() == 0


def test_feasts(spark):
    rows = [(1446, "Samstag vor Judica"), (1601, "Ostern"), (1454, "montags vor sant Jacobs tag"), (1454, "Montag vor Nirgends"), (1454, "Xtag vor Jacobi")]
    got = {(r.year, r.expr): r for r in calendar.resolve(spark.createDataFrame(rows, "year int, expr string")).collect()}
    assert tuple(got[rows[0]].date) == (1446, 4, 2)
    assert tuple(got[rows[1]].date) == (1601, 4, 22)
    assert tuple(got[rows[2]].date) == (1454, 7, 22)
    assert got[rows[3]].status == "unknown feast" and got[rows[3]].date is None
    assert got[rows[4]].status == "unknown weekday" and got[rows[4]].date is None


def test_letters_against_decomposition(spark):
    rng = random.Random(4)
    pool = "abvjyzJV" + "".join(text.SIGNS) + "".join(text.PLAIN) + "éàüñçÉÜǖǟẽỹệſß" + "\u0303\u0305\u0328\uf1ac\ue5dc" + "ḱśłæǽøij"
    words = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(400)]

    def plain(word):
        out, sign = "", False
        for c in unicodedata.normalize("NFD", word.lower()):
            sign |= c in text.SIGNS or unicodedata.category(c) == "Mn" or "\ue000" <= c <= "\uf8ff"
            out += text.SIGNS.get(c, text.PLAIN.get(c, c))
        return "".join(c for c in out if "a" <= c <= "z"), sign

    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.letters(F.col("w")), text.abbreviated(F.col("w")))
    assert [tuple(r[1:]) for r in df.collect()] == [plain(w) for w in words]


def test_easter_and_dates_against_published_values(spark):
    rows = [(1446, False, (1446, 4, 17)), (1500, False, (1500, 4, 19)), (1601, True, (1601, 4, 22)), (1818, True, (1818, 3, 22)), (1943, True, (1943, 4, 25)), (1954, True, (1954, 4, 18)), (1981, True, (1981, 4, 19)), (2000, True, (2000, 4, 23)), (2049, True, (2049, 4, 18)), (2076, True, (2076, 4, 19))]
    df = spark.createDataFrame([r[:2] for r in rows], "y bigint, g boolean")
    got = df.select(calendar.date_of(calendar.easter_number(F.col("y"), F.col("g")), F.col("g")).alias("d")).collect()
    assert [tuple(r.d) for r in got] == [r[2] for r in rows]
    known = [(1582, 10, 4, False, 2299160), (1582, 10, 15, True, 2299161), (1066, 10, 14, False, 2110701), (2000, 1, 1, True, 2451545), (1200, 2, 29, False, 2159417)]
    days = spark.createDataFrame(known, "y bigint, m bigint, d bigint, g boolean, n bigint")
    assert all(r.n == r.got for r in days.withColumn("got", calendar.day_number(F.col("y"), F.col("m"), F.col("d"), F.col("g"))).collect())


def test_near_words_are_verified(spark):
    query = spark.createDataFrame([("bcdefg",)], "word string")
    vocabulary = spark.createDataFrame([("abcdef", False), ("bcdxfg", False), ("bcdefg", False), ("bcd", True)], "letters string, short boolean")
    assert {(r.letters, r.kind) for r in noisy.word_matches(query, vocabulary).collect()} == {("bcdxfg", "near"), ("bcdefg", "exact"), ("bcd", "prefix")}
    assert ("abcdef", "near") in {(r.letters, r.kind) for r in noisy.word_matches(query, vocabulary, verified=False).collect()}


def test_context(spark):
    docs = spark.createDataFrame([("m", "aXbXc"), ("n", "X")], "shelfmark string, text string")
    assert sorted((r.offset, r.context) for r in noisy.context(docs, "m", "X", before=1, after=1).collect()) == [(1, "aXb"), (3, "bXc")]
    assert noisy.context(docs, "m", offset=2, before=1, after=2).first().context == "XbX"


def test_context_keeps_documents_apart(spark):
    docs = spark.createDataFrame([("m", "X123456789"), ("m", "ab.X"), ("m", None), ("m", "none"), ("n", "X")], "shelfmark string, text string")
    assert sorted((r.offset, r.context) for r in noisy.context(docs, "m", "X", before=2, after=3).collect()) == [(0, "X123"), (3, "b.X")]
    assert [r.offset for r in noisy.context(docs, "m", "b.", before=0, after=0).collect()] == [1]
    assert sorted(r.context or "" for r in noisy.context(docs, "m", offset=1, before=5, after=2).collect()) == ["", "X12", "ab.", "non"]


def test_markdown():
    got = reporting.markdown("# A *b*\n\ntext [l](https://a.example) <x>\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n<c>\n```\n> said")
    assert got.split("\n") == [
        "<h1>A <em>b</em></h1>", '<p>text <a href="https://a.example">l</a> &lt;x&gt;</p>', "<ul><li>one</li><li>two</li></ul>",
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "<pre><code>&lt;c&gt;</code></pre>", "<blockquote>said</blockquote>",
    ]


def test_image_measures():
    import numpy as np

    img = np.full((120, 80, 3), 230, np.uint8)
    for top in range(10, 110, 12):
        img[top : top + 4, 10:70] = 20
    got = images.measure(img)
    assert got["pitch"] == 12 and got["parts"] == 9 and got["largest"] == 240 and got["saturation"] == 0
    assert images.component_sizes(np.array([[1, 0, 1], [1, 0, 0], [0, 1, 1]], bool)).tolist() == [2, 2, 1]


def test_tiles_and_sheets(spark):
    got = images.tiles(spark.createDataFrame([("a", 2000, 1000)], "image string, width int, height int"), 1500, 200).collect()
    assert [(r.left, r.right, r.top, r.bottom) for r in got] == [(0, 1500, 0, 1000), (500, 2000, 0, 1000)]
    places = images.sheet(spark.createDataFrame([(k, k) for k in range(23)], "image int, ord int"), 4, 5).where("image = 22").first()
    assert (places.page, places.row, places.column) == (1, 0, 2)


def test_repeated_images(spark):
    rows = [("u", 0, "b/10", 5, 5), ("u", 1, "b/11", 5, 5), ("u", 2, "b/11", 6, 6), ("u", 3, "b/13", 5, 5)]
    got = images.repeated_images(spark.createDataFrame(rows, "url string, ord int, base string, width int, height int"), spark.createDataFrame([("b/12", 6, 6)], "base string, w int, h int")).collect()
    assert {(r.ord, r.fixed, r.note) for r in got} == {(1, None, "FAULT"), (2, "b/12", "corrected")}
