import hashlib
import itertools
import math
import os
import pickle
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, language_id, mixing, mixing_lm, quality_classifier, quality_rules, registry, simhash, suffix_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt labore magna aliqua".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = prose(99, 40_000)
ROWS = [
    (1, prose(1, 120), "en", "a", 1), (2, prose(1, 120), "en", "a", 1), (2, prose(1, 120), "en", "a", 1), (3, None, "en", "a", None), (4, "", None, None, 0), (5, "  \n\t ", "de", "b", 4),
    (None, prose(6, 80), "de", "b", 2), (7, LONG, "de", None, 9), (8, "Zwei Wörter", None, "b", 3), (9, "x" * 5000, "fr", "c", 5000), (10, "🙂 é ß 1 2", "fr", "c", 8), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(messy):
    extra = "kept base_failed grp n mu w d2 fp root node low component_id los his dk replica shuffle_key score held_out lang_pred words block __n x0 rate".split()
    return messy.select("*", *(F.lit("own").alias(c) for c in extra))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with the operators' tables: messy rows with further columns, and empty ones."""
    out = {}
    for name, rows in (("messy", ROWS), ("empty", [])):
        d = str(tmp_path_factory.mktemp(name))
        docs = spark.createDataFrame(rows, SCHEMA)
        docs.select("*", F.lit("own").alias("kept"), F.lit("own").alias("score"), F.lit("own").alias("fp")).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (99, 1, 1), (None, 0, 0), (7, 0, 1)] if rows else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, prose(6, 80)[40:240]), (2, None), (3, ""), (4, "?!"), (1, "twice"), (None, "none of this")] if rows else [], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        out[name] = d
    return out


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_query_stands_messy_and_empty_tables(spark, tables, name):
    rows = registry.QUERIES[name](spark, tables["messy"]).collect()
    if name.startswith(("op1_", "op2_", "op4_", "op5_", "op6_", "op7_", "op10_")):
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    assert registry.QUERIES[name](spark, tables["empty"]).collect() == []


@pytest.mark.parametrize("module", [quality_rules, simhash, suffix_dedup, decontaminate, mixing])
def test_every_stage_keeps_columns_and_stands_messy_tables(spark, clashing, tables, module):
    got = module.stage(spark, clashing, tables["messy"])
    rows = got.collect()
    if module is mixing:
        assert set(clashing.columns) <= set(got.columns)
    else:
        assert got.columns == clashing.columns
        assert all(r["kept"] == "own" and r["x0"] == "own" for r in rows)
    assert module.stage(spark, clashing.limit(0), tables["empty"]).collect() == []


# 1


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if at[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_statistics_against_brute_force():
    r = random.Random(4)
    for k in range(300):
        text = "".join(r.choice("ab cé\n#|\t  ") for _ in range(r.randint(0, 80)))
        assert quality_rules.statistics(text)[:5] == brute_counts(text), k
    assert quality_rules.statistics(None)[:5] == (0, 0, 0, 0, 0)


FLOORS = [0.06, 0.10, 0.25, 0.15, 0.06, 0.10, 0.10, 0.03]


def plain_features(text):
    """The eight statistics, counted with regular expressions."""
    n, chars, symbols, dup, again = brute_counts(text)
    if not n:
        return [0.0] * 8
    count = lambda c: sum(ch in c for ch in text)
    marks = count("!\"'()+,-./:;=?@[\\]^_`{}~")
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    upper, digits = sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text)
    distinct = len(set(re.findall(r"[^\x20\x09-\x0D]+", text)))
    return [math.log(chars / n), math.sqrt(symbols / n), math.sqrt(dup / lines), math.sqrt(again / n), math.sqrt(upper / chars), math.sqrt(marks / n), math.sqrt(digits / chars), math.log(distinct + 1) / math.log(n + 1)]


def scale_factor(share):
    """What the scatter of the nearest share of normal rows is multiplied by, from the chi-square distribution by numerical integration."""
    x = np.linspace(1e-9, 120, 2_000_001)
    density = x**3 * np.exp(-x / 2) / (2**4 * math.gamma(4))
    mass = np.cumsum(density) * (x[1] - x[0])
    k = int(np.searchsorted(mass, share))
    return 8 * share / ((density[:k] * x[:k]).sum() * (x[1] - x[0]))


FACTORS = scale_factor(0.75), scale_factor(0.975)


def floored(cov):
    return cov + np.diag(np.square(FLOORS))


def squared(x, mu, cov):
    return np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(floored(cov)), x - mu)


def brute_mcd(x):
    """(rows in the subset, mean, scaled scatter) of the least determinant from three starts."""
    rank = lambda q: np.sort(x, 0)[max(0, math.ceil(q * len(x)) - 1)]
    q1, q2, q3 = rank(0.25), rank(0.5), rank(0.75)
    t = np.tanh((x - q2) / (q3 - q1 + FLOORS))
    t = t.T @ t + 1e-9 * np.eye(8)
    spread = (q3 - q1) / 1.349
    r = t / np.sqrt(np.outer(np.diag(t), np.diag(t)))
    starts = [(q2, np.diag(spread**2)), (q2, r * np.outer(spread + FLOORS, spread + FLOORS)), (x.mean(0), np.cov(x.T, bias=True).reshape(8, 8))]
    best = (math.inf,)
    for mu, cov in starts:
        last = math.inf
        for _ in range(30):
            bins = np.floor(16 * np.log2(squared(x, mu, cov) + 1e-6))
            near = x[bins <= np.sort(bins)[math.ceil(0.75 * len(x)) - 1]]
            new = near.mean(0), FACTORS[0] * np.cov(near.T, bias=True).reshape(8, 8)
            logdet = np.linalg.slogdet(floored(new[1]))[1]
            if logdet >= last - 1e-3:
                break
            last, (mu, cov) = logdet, new
            if logdet < best[0]:
                best = logdet, len(near), mu, cov
    return best[1:]


def drawn(own, above):
    k, mu, cov = own
    share = k / (k + 50)
    return k, share * mu + (1 - share) * above[1], share * cov + (1 - share) * above[2]


def leveled(make, rows, groups):
    """Estimates of the groups drawn towards their languages, and those towards all."""
    whole = make(rows)
    tongues = {lang: drawn(make(rows[[g[0] == lang for g in groups]]), whole) for lang in {g[0] for g in groups}}
    return {g: drawn(make(rows[[h == g for h in groups]]), tongues[g[0]]) for g in set(groups)}


def brute_quality(docs):
    """{row number: kept} of (doc_id, text, lang, source)."""
    counts = [brute_counts(t) for _, t, *_ in docs]
    kept = [c[0] >= 50 and 100 * c[4] <= 50 * c[0] for c in counts]
    at = [i for i, k in enumerate(kept) if k]
    if not at:
        return kept
    rows, groups = np.array([plain_features(docs[i][1]) for i in at]), [docs[i][2:4] for i in at]
    first = leveled(brute_mcd, rows, groups)
    near = np.array([squared(x[None], *first[g][1:])[0] for x, g in zip(rows, groups, strict=True)]) <= 17.534546
    again = lambda x: (len(x), x.mean(0), FACTORS[1] * np.cov(x.T, bias=True).reshape(8, 8))
    final = leveled(again, rows[near], [g for g, n in zip(groups, near, strict=True) if n])
    for i, x, g in zip(at, rows, groups, strict=True):
        if g in final:
            kept[i] = bool(squared(x[None], *final[g][1:])[0] <= 36)
        else:  # none of the group is near: its language as it is
            own = [n and h[0] == g[0] for h, n in zip(groups, near, strict=True)]
            kept[i] = not any(own) or bool(squared(x[None], *again(rows[own])[1:])[0] <= 36)
    return kept


def sample(spark, sf, *columns):
    return spark.read.parquet(f"{sf}/documents.parquet").select(*columns).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_mcd_against_numpy(spark, sf):
    docs = [tuple(r) for r in sample(spark, sf, "doc_id", "text", "lang", "source")]
    want = {d[0]: k for d, k in zip(docs, brute_quality(docs), strict=True)}
    got = {r.doc_id: r.kept for r in quality_rules.op1_mcd_quality(spark, sf).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_determinant_is_as_low_as_from_random_starts(spark):
    """Some rows are far off; concentration from 200 random starts finds no lower determinant."""
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 8)) @ np.triu(r.normal(0.3, 0.2, (8, 8)) + np.eye(8))
    x[:110] += 6
    good = spark.createDataFrame([("sg", "lg", *map(float, v)) for v in x], "grp string, language string, " + ", ".join(f"x{i} double" for i in range(8)))
    got = {e.grp: e for e in quality_rules.estimates(good).collect()}
    assert set(got) == {"*", "lg", "sg"} and got["sg"].logdet == pytest.approx(got["*"].logdet)
    best = math.inf
    for _ in range(200):
        near = x[r.choice(600, 9, replace=False)]
        for _ in range(40):
            cov = floored(np.cov(near.T, bias=True))
            d = np.einsum("ij,jk,ik->i", x - near.mean(0), np.linalg.inv(cov), x - near.mean(0))
            near = x[np.argsort(d)[:450]]
        best = min(best, np.linalg.slogdet(floored(FACTORS[0] * np.cov(near.T, bias=True)))[1])
    assert got["sg"].logdet < best + 0.1
    assert np.linalg.norm(np.array(got["sg"].mu) - x[110:].mean(0)) < 0.6


def test_small_groups_lean_on_their_language_and_null_is_apart(spark):
    rows = [(k, prose(k, 100), "en", "big") for k in range(120)] + [(500 + k, prose(500 + k, 100), "en", f"small{k}") for k in range(4)]
    rows += [(900, "### $$$ %%% " * 40 + prose(900, 60), "en", "small0"), (901, prose(901, 100), None, None), (902, prose(902, 100), "", ""), (903, prose(903, 100), None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.assess(docs).collect()}
    assert [i for i, r in got.items() if not r.kept] == [900]
    alone = {r.doc_id: r for r in quality_rules.assess(docs.where("doc_id <> 902")).collect()}
    assert got[901].distance2 == pytest.approx(alone[901].distance2, rel=0.2) and all(r.distance2 is not None for r in got.values())


def test_consistency_factor():
    x = np.random.default_rng(1).normal(size=(400_000, quality_rules.P))
    d = (x**2).sum(1)
    near = x[d <= np.quantile(d, 0.75)]
    assert quality_rules.consistency(0.75) * near.var() == pytest.approx(1, rel=0.02)
    assert quality_rules.consistency(0.75) == pytest.approx(FACTORS[0], rel=1e-4)


# 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_lm_base_and_gain(spark):
    docs = sample(spark, SF, "doc_id", "text")
    words = {r.doc_id: r.text.encode().translate(LOWER).split() for r in docs}
    seen, ends = Counter(), 0
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 10:
            seen.update(w)
            ends += 1
    n, v = sum(seen.values()) + ends, len(seen) + 1
    rows = mixing_lm.op2_context_mixing(spark, SF).collect()
    p = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    for r in rows:
        own = words[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.n_tokens == len(own) + 1 and r.train_tokens == n
        assert r.n_known == sum(w in seen for w in own) + 1 and r.base_score == pytest.approx(sum(p(seen[w]) for w in own) + p(ends), rel=1e-9)
    assert all(r.score < 0 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_lm_beats_the_base_on_held_out_texts_however_rows_are_dealt(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).alias("held_out"), "text")
    whole = {r.doc_id: r for r in mixing_lm.score(docs.coalesce(1)).collect()}
    held = [r for r in whole.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        dealt = {r.doc_id: r for r in mixing_lm.score(docs.repartition(11)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(dealt[i].score == pytest.approx(r.score, rel=1e-9) and dealt[i].base_score == pytest.approx(r.base_score, rel=1e-12) for i, r in whole.items())


def lm_rows(n):
    r = random.Random(n)
    return [(k, False, " ".join(r.choice(["aa", "b", "abc", "long-word", "long-ward", "c"]) for _ in range(r.randint(0, 30)))) for k in range(n)]


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_probabilities_add_up_to_one_at_most(spark, parts):
    """All words that follow some words, the end, and all new words: the mass of what may come next."""
    docs = spark.createDataFrame(lm_rows(300), "doc_id bigint, held_out boolean, text string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        model = mixing_lm.learn(docs)[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    counts = Counter(w for *_, t in lm_rows(300) for w in t.encode().split())
    known = list(counts)
    ahead = [mixing_lm.form(w) for w in (b"b", b"abc")]
    leaf = np.array([x for k in range(mixing_lm.FORMS) for x in (*ahead, k)])
    sizes = np.full(mixing_lm.FORMS, 3)
    each = np.exp(model.words.online(leaf, *mixing_lm.form_contexts(leaf, sizes), sizes)[2::3])
    assert each.sum() == pytest.approx(1, abs=1e-5)
    inside = np.exp(model.inside(known, np.array([counts[w] for w in known])))
    total = sum(each[mixing_lm.form(w)] * p for w, p in zip(known, inside, strict=True)) + each[mixing_lm.END]
    letters = [bytes([k]) for k in range(256) if bytes([k]) not in b" \t\n\x0b\x0c\r"]
    new = [w for w in [*letters, *(a + b for a in letters for b in letters)] if w not in counts]
    total += sum(each[mixing_lm.form(w)] * p for w, p in zip(new, np.exp(model.inside(new, np.zeros(len(new), int))), strict=True))
    assert 0.7 < total <= 1 + 1e-9


def test_words_in_order_score_better_than_shuffled(spark):
    r = random.Random(2)
    chain = {w: [r.choice(WORDS), r.choice(WORDS)] for w in WORDS}

    def text(k):
        out = [r.choice(WORDS)]
        while len(out) < 80:
            out.append(r.choice(chain[out[-1]]))
        return " ".join(out)

    texts = [text(k) for k in range(400)]
    mixed = [" ".join(r.sample(t.split(), 80)) for t in texts[:40]]
    rows = [(k, k < 40, t) for k, t in enumerate(texts)] + [(1000 + k, True, t) for k, t in enumerate(mixed)]
    got = {x.doc_id: x.score for x in mixing_lm.score(spark.createDataFrame(rows, "doc_id bigint, held_out boolean, text string")).collect()}
    assert sum(got[k] for k in range(40)) > 0.7 * sum(got[1000 + k] for k in range(40))


def test_a_tree_codes_every_leaf_and_its_tables_meet_the_counts():
    r = np.random.default_rng(0)
    for tree in (mixing_lm.Tree(r.integers(0, 50, 64) + 0.5), mixing_lm.Tree(np.ones(64), huffman=False)):
        paths = [tuple(zip(tree.nodes[a : a + n], tree.bits[a : a + n], strict=True)) for a, n in zip(tree.start, tree.depth, strict=True)]
        assert len(set(paths)) == 64
        counts = r.integers(0, 9, (3, 64)).astype(float)
        for got, bit in zip(tree.counts(counts), (0, 1), strict=True):
            assert (got == [[sum(row[x] for x in range(64) if (node, bit) in paths[x]) for node in range(63)] for row in counts]).all()


def test_training_words_are_worked_through_side_by_side():
    words = [f"▁{a}{b}" for a in ("the", "straße", "қ", "x" * 40) for b in ("", "s", "ing", "ment")]
    counts = np.arange(1.0, len(words) + 1)
    frames = [pd.DataFrame({"word": words[k : k + 3], "n": counts[k : k + 3]}) for k in range(0, len(words), 3)]
    got = list(language_id.gathered(iter(frames), 7))
    assert [len(x) for x in got] == [9, 7]  # frames of Arrow's size by language cost some five times as much a word
    assert [w for x in got for w in x["word"]] == words
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(language_id.pieces(language_id.VOCABULARY).size)))
    single = sum(language_id.expected_counts([w], counts[k : k + 1], logp) for k, w in enumerate(words))
    assert np.allclose(language_id.expected_counts(words, counts, logp), single, rtol=1e-9)



def test_mixing_lm_sends_tables_pressed(spark):
    tree = mixing_lm.Tree(np.ones(256), huffman=False)
    tables = np.zeros((4, mixing_lm.CELLS), np.int8)
    tables[:, ::1001] = 7
    model = mixing_lm.Model(*[mixing_lm.Mixer(tree, tree.plain(np.ones(256)), tables)] * 2, np.zeros(mixing_lm.FORMS), np.zeros(mixing_lm.FORMS))
    data = pickle.dumps(model)
    assert len(data) < 1 << 20  # 16 MB and more on the disks of the driver and each executor before
    got = pickle.loads(data)
    assert (got.words.tables == tables).all() and (got.words.weights == model.words.weights).all()
    sent, broadcast = [], type(spark.sparkContext).broadcast
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
        names = spark.createDataFrame([(2, b"abc abd")], "n int, a binary")
        mixing_lm._fit(model.letters, names, mixing_lm._read_names)
    assert len(sent) == 1  # once for all rounds


def test_long_words_are_spelled():
    tree = mixing_lm.Tree(np.ones(256), huffman=False)
    letters = mixing_lm.Mixer(tree, tree.plain(np.ones(256)), np.zeros((4, mixing_lm.CELLS), np.int8))
    model = mixing_lm.Model(None, letters, np.zeros(mixing_lm.FORMS), np.zeros(mixing_lm.FORMS))
    got = model.inside([b"ab", b"q" * 300_000, b"ab" * 5], np.zeros(3, int))
    assert np.allclose(got, [-8 * 3 * math.log(2), -8 * 300_001 * math.log(2), -8 * 11 * math.log(2)], rtol=1e-4)


def test_blocks_hold_the_forms_of_their_words(monkeypatch):
    """Passes over blocks take a word's form from the block; nothing works it out again."""
    block = mixing_lm._Block(0)
    for doc, role, text in [(1, mixing_lm.TABLES, "b abc Longer words, longer ones b"), (2, mixing_lm.HELD, None), (3, mixing_lm.WEIGHTS, "abc \u00e4 b")]:
        block.add(doc, role, text)
    row = next(mixing_lm._rows(iter([block.row()])))
    words = row["words"].split(b" ")
    want = mixing_lm.forms(words)
    monkeypatch.setattr(mixing_lm, "form", None)
    leaf, tokens, sizes = mixing_lm._stream(row, None)
    assert sizes.tolist() == [8, 1, 4] and leaf.tolist() == np.append(want, mixing_lm.END)[tokens].tolist()
    assert mixing_lm._stream(row, mixing_lm.WEIGHTS)[0].tolist() == leaf[-4:].tolist()
    empty = mixing_lm._Block(1)
    empty.add(1, mixing_lm.HELD, "")
    assert mixing_lm._stream(next(mixing_lm._rows(iter([empty.row()]))), None)[0].tolist() == [mixing_lm.END]


def test_newton_sums_and_paths_against_plain_sums():
    r = np.random.default_rng(5)
    tree = mixing_lm.Tree(r.integers(1, 500, mixing_lm.FORMS).astype(float))
    mixer = mixing_lm.Mixer(tree, r.normal(size=mixing_lm.FORMS).astype(np.float32), r.integers(-90, 90, (4, mixing_lm.CELLS)).astype(np.int8))
    leaf = r.integers(0, mixing_lm.FORMS, 300)
    rows, place = [r.integers(0, 2048, 300) for _ in range(4)], r.integers(0, 5, 300)
    first, token, sign, gate, x = mixer.bits(leaf, rows, place)
    x = np.stack([*x, np.ones(len(sign))]).astype(float)
    z = np.clip((mixer.weights.astype(float)[gate].T * x).sum(0), -20, 20)
    miss, want = sign / (1 + np.exp(z * sign)), np.zeros((mixer.GATES, 27))
    for k in range(len(sign)):
        pair = abs(miss[k]) * (1 - abs(miss[k])) * np.outer(x[:, k], x[:, k])
        want[gate[k]] += [*(miss[k] * x[:, k]), *(pair[i, j] for i in range(6) for j in range(i, 6))]
    assert mixer.sums(leaf, rows, place) == pytest.approx(want, rel=1e-4, abs=1e-3)
    odds = np.exp(-z * sign).astype(np.float32)
    ln = -np.bincount(token, np.log1p(odds.astype(float)), 300)
    assert mixer.paths(odds, first) == pytest.approx(ln, rel=1e-12)
    deep = mixing_lm.Mixer(mixing_lm.Tree(2.0 ** np.arange(64)), mixer.plain, mixer.tables)  # 63 bits: a product of their odds has no place in a double
    n = deep.tree.depth[[0]]
    assert n[0] > mixing_lm.DEEPEST and deep.paths(np.full(n[0], np.exp(np.float32(20))), np.array([0])) == pytest.approx(-20 * n[0], rel=1e-6)


def test_document_mixture_by_hand():
    got = mixing_lm.refine(np.array([0, 0, 1, -1, 0, -1]), np.array([4, 2]), np.log([0.5, 0.5, 0.25, 0.1, 0.5, 0.2]))
    want = 0.0
    for s in mixing_lm.SHARES:
        want += 0.5 * ((1 - s) * 0.5 + s * 1) * ((1 - s) * 0.25 + 0) * (1 - s) * 0.1
    assert 10 ** got[0] == pytest.approx(want / len(mixing_lm.SHARES))
    assert 10 ** got[1] == pytest.approx(0.5 * 0.2 * np.mean([1 - s for s in mixing_lm.SHARES]))


# 3


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_matches_against_full_dynamic_programme():
    r = random.Random(2)
    items = [(k, "".join(r.choice("abcd ") for _ in range(r.randint(14, 60))).strip()) for k in range(12)]
    items = [(k, decontaminate.normalise(t)) for k, t in items]
    matcher = decontaminate.Matcher(items, 0.2)
    hits = 0
    for _ in range(150):
        t = list(r.choice(items)[1])
        for _ in range(r.randint(0, 12)):
            t[r.randrange(len(t))] = r.choice(["", "a", "bb", " "])
        text = "dd " + "".join(t) + " abab"
        norm = decontaminate.normalise(text)
        want = {(k, d) for k, it in items if (d := least_distance(it, norm)) <= int(0.2 * len(it))}
        assert {(k, d) for k, d, _ in matcher.matches(text)} == want
        hits += len(want)
    assert hits > 50


def test_case_and_punctuation_do_not_hide_a_leak(spark):
    item = prose(5, 30)
    docs = spark.createDataFrame([(1, "Intro: " + item.upper().replace(" ", "\n") + "!"), (2, item[: len(item) // 2]), (3, item.replace("lorem", "lorme", 1))], "doc_id bigint, text string")
    got = {r.doc_id: r.distance for r in decontaminate.matches(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert set(got) == {1, 3} and got[1] == 0


# 4


def brute_cut(texts):
    data = [(t or "").encode() for t in texts]
    n = suffix_dedup.LENGTH
    seen = Counter(d[p : p + n] for d in data for p in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for p in range(len(d) - n + 1):
            if seen[d[p : p + n]] > 1:
                gone[p] += 1
                gone[p + n] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        out.append((np.frombuffer(d, np.uint8)[~gone].tobytes(), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())))
    return out


def test_suffix_query_against_its_sql(spark, tables):
    docs = spark.read.parquet(f"{tables['messy']}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(20, prose(1, 120)[100:500] + "é" * 150, None, None, 0), (21, "é" * 150 + "tail", None, None, 0), (22, "q" * 199, None, None, 0), (23, "q" * 199, None, None, 0)], SCHEMA), allowMissingColumns=True)
    path = f"{tables['messy']}-sql"
    docs.write.parquet(f"{path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    got = registry.QUERIES["op4_suffix_dedup"](spark, path)
    want = c.sql(f"select {', '.join(got.columns)} from ({registry.ORACLES['op4_suffix_dedup']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 5000


def test_cut_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    parts = ["".join(r.choice("abcdé ") for _ in range(r.randint(150, 420))) for _ in range(12)]
    texts = ["".join(r.choice(parts) if r.random() < 0.5 else "".join(r.choice("xyz ") for _ in range(r.randint(1, 260))) for _ in range(r.randint(0, 5))) for _ in range(60)]
    texts += [None, "", "ab" * 400, "q" * 201, "q" * 200, texts[3], texts[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [suffix_dedup.is_scan(d) for d in (read, read.select("text"), docs, read.limit(3), read.repartition(2))] == [True, True, False, False, False]
    cut = {x.doc_id: x.text for x in suffix_dedup.deduplicate(docs).collect()}
    for i, (kept, removed, spans) in enumerate(brute_cut(texts)):
        assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (removed, spans, hashlib.sha256(kept).hexdigest()), i
        assert (cut[i] or "") == kept.decode("utf-8", "ignore")


def test_runs_lie_in_the_order_of_their_suffixes():
    r = np.random.default_rng(2)
    data = r.integers(0, 256, 20_000).astype(np.uint8)
    key, _, first, last = suffix_dedup.slice_runs(data, np.ones(len(data) - suffix_dedup.LENGTH, bool))
    order = np.argsort(key.view(np.int64), kind="stable")
    heads = key[order] ^ np.uint64(1 << 63)
    tokens = [int(h).to_bytes(8, "big")[:4] for h in heads]
    assert tokens == sorted(tokens)
    raw = data.tobytes()
    assert all(raw.find(t, int(a), int(b) + suffix_dedup.LENGTH) >= 0 for t, a, b in zip(tokens, first[order], last[order], strict=True))


def test_multikey_quicksort():
    r = np.random.default_rng(3)
    cols = [r.integers(0, 4, 500) for _ in range(4)]
    order = suffix_dedup.multikey_quicksort(cols)
    assert (np.stack([c[order] for c in cols], 1) == np.stack([c[np.lexsort(cols[::-1])] for c in cols], 1)).all()


# 5


def test_forward_sums_all_segmentations():
    r = np.random.default_rng(0)
    p = language_id.pieces(language_id.VOCABULARY)
    logp = np.log(r.dirichlet(np.ones(p.size), 2).T)
    at = {name: k for k, name in enumerate(p.names)}
    words = ["▁the", "▁tion", "▁éx", "ກa", "aກa"]

    def ways(word):
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in itertools.pairwise(edges)]
            if all(x in at or len(x) == 1 for x in parts):
                yield [k for x in parts for k in ([at[x]] if x in at else [len(p.names) + c for c in x.encode()])]

    weight = lambda way, lang: math.exp(sum(logp[k, lang] for k in way))
    got = language_id.score_words(words, logp)
    assert np.allclose(got, [[math.log(sum(weight(y, k) for y in ways(w))) for k in range(2)] for w in words])
    for word in ("▁the", "aກa"):
        use, want = language_id.expected_counts([word], np.array([3.0]), logp[:, 0]), np.zeros(p.size)
        for y in ways(word):
            np.add.at(want, y, 3 * weight(y, 0) / sum(weight(z, 0) for z in ways(word)))
        assert np.allclose(use, want)


def test_words_of_any_length_are_summed_whole(monkeypatch):
    """One by one in logarithms, and side by side, words score alike; a long word isn't cut."""
    r = np.random.default_rng(1)
    p = language_id.pieces(language_id.VOCABULARY)
    logp = np.log(r.dirichlet(np.ones(p.size), 2).T)
    words = ["▁internationalisation", "▁abab", "▁" + "tion" * 7]
    side = language_id.score_words(words, logp)
    counts = language_id.expected_counts(words, np.ones(3), logp[:, 1])
    monkeypatch.setattr(language_id, "LONG", 2)
    assert np.allclose(language_id.score_words(words, logp), side)
    assert np.allclose(language_id.expected_counts(words, np.ones(3), logp[:, 1]), counts)
    assert np.isfinite(language_id.score_words(["▁" + "x" * 3000], logp)).all()


def test_texts_without_a_letter_are_undetermined(spark):
    docs = spark.createDataFrame([(k, prose(k, 30), "en" if k % 2 else "de", False) for k in range(8)] + [(20, "½ ² Ⅷ 12 _", "en", True), (21, "ab½", None, True)], "doc_id bigint, text string, lang string, held_out boolean")
    got = {x.doc_id: x for x in language_id.predict(docs.drop("lang"), *language_id.fit(docs.where("not held_out"))).collect()}
    assert (got[20].lang_pred, got[20].score) == ("und", 0.0) and got[21].lang_pred in ("en", "de")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_language_accuracy(spark):
    want = {r.doc_id: r.lang for r in sample(spark, SF, "doc_id", "lang")}
    rows = [r for r in language_id.op5_marginal_language_id(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


# 6


def brute_components(fps):
    """{row: smallest id reachable} of [(doc_id, fp)]."""
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if bin(fps[a][1] ^ fps[b][1]).count("1") <= 2:
            root[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(fps):
        low[find(k)] = min(low.get(find(k), i), i)
    return [low[find(k)] for k in range(n)]


def test_fingerprint_against_plain_code():
    import xxhash

    def plain(text):
        w = (text or "").encode().translate(LOWER).split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    for text in [None, "", "One", "One two", "a b c", "a b c d", prose(3, 70), "É x É x É x"]:
        assert simhash.fingerprint(text) == plain(text)


@pytest.mark.parametrize("wide", [2048, 3])
def test_links_against_all_pairs(spark, monkeypatch, wide):
    monkeypatch.setattr(simhash, "WIDE", wide)
    r = random.Random(6)
    fps = [r.getrandbits(64) for _ in range(60)]
    for _ in range(140):
        x = r.choice(fps)
        for _ in range(r.randint(1, 3)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    rows = [(k * 7 % 1009, x if x < 1 << 63 else x - (1 << 64)) for k, x in enumerate(fps + fps[:9])]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id bigint, fp bigint"))
    have = {x.fp: x.component_id for x in got.collect()}
    assert [have[fp] for _, fp in rows] == brute_components([(i, x & (1 << 64) - 1) for i, x in rows])


def test_a_crowd_of_near_fingerprints_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE", 10)
    r = random.Random(1)
    base = r.getrandbits(62)
    fps = sorted({base ^ (1 << r.randrange(62)) ^ (1 << r.randrange(62)) for _ in range(300)})
    far = base ^ (1 << 62) - 1
    got = simhash.classes(spark.createDataFrame([(k, x) for k, x in enumerate([*fps, far])], "doc_id bigint, fp bigint")).collect()
    want = dict(zip([*fps, far], brute_components(list(enumerate([*fps, far]))), strict=True))
    assert {x.fp: x.component_id for x in got} == want and sum(v == 0 for v in want.values()) > 100


def test_pivot_tables_and_keys():
    r = random.Random(8)
    fps = [r.getrandbits(64) for _ in range(400)]
    near = [x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in fps]
    a, b = (np.array(x, np.uint64) for x in (fps, near))
    refs = simhash._REFS.ravel().tolist()
    table = simhash.coordinates(a)
    assert table.shape == (400, simhash.PIVOTS) and (table[:5] == [[bin(x ^ p).count("1") for p in refs] for x in fps[:5]]).all()
    keys, others = simhash.bucket_keys(table), simhash.bucket_keys(simhash.coordinates(b))
    assert (keys == others).any(1).all()
    far = simhash.bucket_keys(simhash.coordinates(np.array([r.getrandbits(64) for _ in range(400)], np.uint64)))
    assert (keys == far).any(1).mean() < 0.01
    inside = [bin((fps[0] ^ int(simhash._REFS[blk, k, 0])) & simhash._BLOCK[blk]).count("1") for blk in simhash._CHOICES[3] for k in range(simhash.EACH)]
    packed = int(keys[0, 3])
    got = [packed >> (16 * (3 - n // 4) + 4 * (n % 4)) & 15 for n in range(16)]
    assert got == inside


# 7


def test_attention_gradients():
    m = quality_classifier.Attention()
    codes = quality_classifier.Codes()
    bags = [quality_classifier.passages(quality_classifier.encode(prose(k, 130 + 40 * k), codes)) for k in range(3)]
    words = np.concatenate([b[0] for b in bags])
    shift = np.cumsum([0, *(len(b[0]) for b in bags)])
    starts = np.concatenate([b[1] + o for b, o in zip(bags, shift, strict=False)])
    which, y = np.repeat(np.arange(3), [len(b[1]) for b in bags]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = m.pool(m.forward(words, starts, which), which, 3)
        return float((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z).sum())

    s = m.forward(words, starts, which)
    g = m.gradients(s, which, 1 / (1 + np.exp(-m.pool(s, which, 3))) - y)
    assert np.bincount(which, s["alpha"]) == pytest.approx(np.ones(3))
    for name in m.p:
        at = np.unravel_index(int(np.argmax(np.abs(g[name]))), g[name].shape)
        old = m.p[name][at]
        m.p[name][at] = old + 1e-5
        up = loss()
        m.p[name][at] = old - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-7), name
        m.p[name][at] = old


def test_one_document_scores_alike_in_any_company():
    m, codes = quality_classifier.Attention(), quality_classifier.Codes()
    found = [quality_classifier.encode(t, codes) for t in (prose(1, 10), "", prose(2, 450), None)]
    assert m.scores(found) == pytest.approx([m.score(w) for w in found])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("query,label,least", [(quality_classifier.op7_attention_quality, "quality", 0.9), (toxicity.op10_blockmax_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    sf = SF.replace("0.001", "0.01")
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in query(spark, sf).collect() if r.held_out and r.doc_id in y]
    assert len(rows) > 40 and np.mean([r.predicted == y[r.doc_id] for r in rows]) > least


# 8


def mixed_both_ways(spark, path):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}'")
    want = Counter((r[0], r[1], r[2]) for r in c.sql(f"select doc_id, replica, shuffle_key from ({mixing.ORACLE})").fetchall())
    got = Counter((r.doc_id, r.replica, r.shuffle_key) for r in mixing.replicate(spark.read.parquet(path.replace("/*.parquet", ""))).collect())
    assert got == want
    return got


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_mix_against_sql(spark):
    mixed_both_ways(spark, f"{SF}/documents.parquet")


def test_mix_against_sql_at_high_rates(spark, tmp_path):
    rows = spark.range(20_000).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.when(F.col("id") < 8, F.lit(None)).when(F.col("id") < 60, "small").otherwise("large").alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixed_both_ways(spark, f"{tmp_path}/documents.parquet/*.parquet")
    assert max(k[1] for k in got) > 40


def test_counts_are_poisson_and_meet_targets(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    out = mixing.replicate(docs, {"a": 1.0, "b": 3.0}).groupBy("source", "doc_id").count()
    n = {r.source: r for r in out.groupBy("source").agg(F.sum("count").alias("s"), F.count("*").alias("k")).collect()}
    assert n["a"].s == pytest.approx(10_000, rel=0.05) and n["b"].s == pytest.approx(30_000, rel=0.05)
    assert 36_000 - n["a"].k == pytest.approx(36_000 * math.exp(-10 / 36), rel=0.02)


def test_counts_are_poisson_at_rates_over_most_rate(spark):
    docs = spark.range(8_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "b").otherwise("a").alias("source"))
    for rate in (22.0, 100.0):
        out = mixing.replicate(docs, {"a": 1.0, "b": 0.0}, budget=4_000 * rate).groupBy("doc_id").count()
        n = np.array([r["count"] for r in out.collect()])
        assert n.mean() == pytest.approx(rate, rel=0.02) and n.var() == pytest.approx(rate, rel=0.1)
        pmf = np.exp([k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(400)])
        assert np.abs(np.cumsum(np.bincount(n, minlength=400)[:400]) / 4_000 - np.cumsum(pmf)).max() < 0.03


# 9


def test_attribution_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        text = "".join(r.choice(["a", "the ", "\n", "é", "🙂", " x", "\n\n", "12"]) for _ in range(r.randint(0, 60)))
        starts, ends = token_counts.token_spans(text)
        lo, hi = token_counts.lines(text)
        assert lo[0] == 0 and hi[-1] == len(text) and (lo[1:] == hi[:-1]).all()
        for rule in ("majority", "start", "split"):
            counts, crossing, none = token_counts.attribute(starts, ends, lo, hi, rule)
            want, cross = np.zeros(len(lo)), np.zeros(len(lo), int)
            for a, z in zip(starts, ends, strict=True):
                parts = [max(0, min(h, z) - max(low, a)) for low, h in zip(lo, hi, strict=True)]
                touched = [k for k, p in enumerate(parts) if p]
                if len(touched) > 1:
                    cross[touched] += 1
                if rule == "split":
                    want += np.array(parts) / (z - a)
                else:
                    want[touched[0] if rule == "start" else int(np.argmax(parts))] += 1
            assert np.allclose(counts, want) and (crossing == cross).all() and none == 0
            assert counts.sum() == pytest.approx(len(starts))


def test_tokens_outside_of_fields_are_counted_apart():
    starts, ends = np.array([0, 4, 8, 12]), np.array([4, 8, 12, 16])
    counts, crossing, none = token_counts.attribute(starts, ends, np.array([2, 13]), np.array([9, 14]), "majority")
    assert counts.tolist() == [3, 1] and none == 0 and crossing.tolist() == [2, 1]
    assert token_counts.attribute(starts, ends, np.array([5]), np.array([6]))[2] == 3


# 10


def test_block_max_search_is_exact():
    r = random.Random(3)

    def vector():
        ks = sorted(r.sample(range(40), r.randint(1, 8)))
        xs = [r.random() for _ in ks]
        norm = math.sqrt(sum(x * x for x in xs))
        return np.array(ks), np.array([x / norm for x in xs])

    vectors = [vector() for _ in range(500)]
    queries = [vector() for _ in range(60)]
    empty = (np.zeros(0, np.int64), np.zeros(0))
    for dense in (0, 5, 40):
        index = toxicity.BlockMaxIndex(vectors, 40, block=16, dense=dense)
        for q, (ids, got) in zip(queries, index.nearest(queries), strict=True):
            sims = [sum(x * dict(zip(*v, strict=True)).get(k, 0) for k, x in zip(*q, strict=True)) for v in vectors]
            want = sorted((-round(s, 12), i) for i, s in enumerate(sims) if s > 0)[:15]
            assert ids.tolist() == [i for _, i in want] and np.allclose(got, [-s for s, _ in want])
        assert index.nearest([vectors[7]], without=[7])[0][0][0] != 7
        assert len(index.nearest([empty])[0][0]) == 0


def test_search_is_exact_with_short_and_long_lists():
    r = random.Random(4)

    def vector():
        ks = sorted({min(int(r.paretovariate(0.5)), 900) for _ in range(r.randint(1, 30))})
        xs = [r.random() for _ in ks]
        norm = math.sqrt(sum(x * x for x in xs))
        return np.array(ks), np.array([x / norm for x in xs])

    vectors, queries = [vector() for _ in range(700)], [vector() for _ in range(70)]
    whole = np.zeros((len(vectors), 901))
    for row, (ks, xs) in zip(whole, vectors, strict=True):
        row[ks] = xs
    for dense in (0, 5):
        index = toxicity.BlockMaxIndex(vectors, 901, block=16, dense=dense)
        assert 0 < len(index.most) < (index.term_start[1:] > index.term_start[:-1]).sum()
        for without in (None, list(range(70))):
            for i, ((ks, xs), (ids, got)) in enumerate(zip(queries, index.nearest(queries, without=without), strict=True)):
                sims = whole[:, ks] @ xs
                if without:
                    sims[i] = 0
                want = sorted((-round(s, 12), j) for j, s in enumerate(sims.tolist()) if s > 0)[:15]
                assert ids.tolist() == [j for _, j in want] and np.allclose(got, [-s for s, _ in want])


def test_terms_of_few_examples_do_not_open_blocks(monkeypatch):
    monkeypatch.setattr(toxicity, "FIRST", 1)
    own, pair = np.full(9, 1 / 3), np.array([0.6, 0.8])
    vectors = [(np.arange(9), own)] + [(np.array([0]), np.ones(1))] * 7 + [(np.array([0, j]), pair) for _ in range(5) for j in range(1, 9)]
    index, read, plain = toxicity.BlockMaxIndex(vectors, 9, block=8, dense=0), [], toxicity.BlockMaxIndex._read
    monkeypatch.setattr(toxicity.BlockMaxIndex, "_read", lambda self, scores, start, size, x: read.append(int(size.sum())) or plain(self, scores, start, size, x))
    ids, sims = index.nearest([(np.arange(9), own)], k=1)[0]
    assert ids.tolist() == [0] and np.allclose(sims, 1)
    assert read == [8 * 6, 8, 0]  # lists of 6 postings, then the frequent term in the first block: their maxima, of different examples, opened all blocks


def test_terms_are_runs_of_letters(monkeypatch):
    plain = toxicity.letter_runs
    every = "".join(map(chr, range(0x3000)))
    odd = [None, "", " ", "a1b_c", "Ünï—cödé… “x” €5", "İstanbul ΑΒΓΣ", "x\u00a0y\u2003z\x85w\x1cv", "½a² Ⅷb ٣c", "ne\u0301e", "\ud800a", every, *(every[k : k + 8] + "end" for k in range(0, 0x3000, 8))]
    for text in odd:
        assert toxicity.terms_of(text) == plain((text or "").lower())
    calls = []
    monkeypatch.setattr(toxicity, "letter_runs", lambda text: calls.append(text) or plain(text))
    assert toxicity.terms_of("Über 12 Wörter – “so”, a_b.") == ["über", "wörter", "so", "a", "b"] and not calls  # ordinary texts need no regular expression


def test_equal_neighbours_come_in_order():
    v = (np.array([0, 1]), np.array([0.6, 0.8]))
    ids, sims = toxicity.BlockMaxIndex([v] * 100, 2, block=8, dense=1).nearest([v])[0]
    assert ids.tolist() == list(range(15)) and np.allclose(sims, 1)


def test_every_text_with_a_term_is_searched(spark):
    docs = spark.createDataFrame([(k, f"{prose(k, 30)} own{chr(97 + k)}") for k in range(20)] + [(90, ""), (91, "12 ?")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 4)) for k in range(20)] + [(90, 0), (91, 0)], "doc_id bigint, y int")
    rows = toxicity.score_documents(docs.withColumn("held_out", F.lit(True)), *toxicity.train(docs, labels)).collect()
    assert all((r.evidence[:1] == [r.doc_id]) if r.doc_id < 90 else not r.evidence for r in rows) and len(rows) == 22
