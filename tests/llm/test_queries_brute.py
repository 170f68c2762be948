"""Whole queries of operators 3, 5 and 9 against plain code over small tables."""

import base64
import math
import random
import unicodedata
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from test_llm_operators import least_distance, prose

from lectern.llm import decontaminate, language_id, token_counts


def written(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_decontamination_query(spark, tmp_path):
    r = random.Random(3)
    items = [(1, prose(1, 9)), (2, "Ab ab, AB"), (3, "x"), (4, None), (5, "?!"), (6, prose(6, 14)), (7, prose(1, 9))]
    docs = [(0, None), (1, ""), (2, "ab-ab... ab"), (None, prose(6, 14).upper())]
    for k in range(10, 40):
        t = list(r.choice([prose(1, 9), prose(6, 14)]))
        for _ in range(r.randint(0, 14)):
            t[r.randrange(len(t))] = r.choice(["", "q", "zz", " "])
        docs.append((k, prose(k, 8) + " " + "".join(t) + " " + prose(k, 5)))
    written(spark, tmp_path, "documents", docs, "doc_id bigint, text string")
    written(spark, tmp_path, "benchmark", items, "item_id bigint, text string")
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    want = set()
    for doc, text in docs:
        for item, part in items:
            a, b = plain(part), plain(text)
            if a and b and (d := least_distance(a, b)) <= int(0.08 * len(a)):
                want.add((doc, item, d, int(0.08 * len(a))))
    got = {tuple(x) for x in decontaminate.op3_pigeonhole_decontaminate(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 10 and {w[0] for w in want} >= {None, 2}


def test_token_attribution_query(spark, tmp_path):
    r = random.Random(4)
    docs = [(k, "".join(r.choice(["a", "the ", "\n", "é", "🙂", " x", "\n\n", "12", "日本", "\r\n"]) for _ in range(r.randint(0, 50)))) for k in range(60)] + [(None, "a\nb"), (7, None), (8, "")]
    written(spark, tmp_path, "documents", docs, "doc_id bigint, text string")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text in docs:
        text = text or ""
        owner, spans, at = [k for k, c in enumerate(text) for _ in c.encode()], [], 0
        for token in encoding.decode_tokens_bytes(encoding.encode_ordinary(text)):
            spans.append((owner[at], owner[at + len(token) - 1] + 1))
            at += len(token)
        edges = [0] + [k + 1 for k, c in enumerate(text) if c == "\n"]
        edges += [len(text)] if edges[-1] < len(text) or not text else []
        sections = list(zip(edges, edges[1:], strict=False))
        n, cross = [0.0] * len(sections), [0] * len(sections)
        for a, z in spans:
            shares = [max(0, min(z, hi) - max(a, lo)) for lo, hi in sections]
            n[shares.index(max(shares))] += 1
            if sum(s > 0 for s in shares) > 1:
                cross = [c + (s > 0) for c, s in zip(cross, shares, strict=True)]
        want += [(doc, k, lo, hi, n[k], cross[k]) for k, (lo, hi) in enumerate(sections)]
    got = [tuple(x) for x in token_counts.op9_token_attribution(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_language_query(spark, tmp_path):
    """Three rounds of expectation-maximisation by dictionaries and plain forward and backward sums."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    known = set(names)
    r = random.Random(9)
    stems = {"de": ["wasser", "straße", "übung", "haus"], "en": ["water", "street", "training", "house"], "am": ["ሰላም", "ውሃ", "ቤት"]}
    docs = []
    for k in range(48):
        lang = r.choice(["de", "en", "am"])
        docs.append((k, " ".join(r.choice(stems[lang]) + r.choice(["", "s", "2", "."]) for _ in range(r.randint(1, 8))), lang))
    docs += [(100, None, "de"), (101, "½ 12 _", "en"), (102, "house", None), (103, "", "en")]
    written(spark, tmp_path, "documents", docs, "doc_id bigint, text string, lang string")

    def words(text):
        return ["▁" + w for w in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()]

    def arcs(word):
        for j in range(1, len(word) + 1):
            for i in range(j):
                if word[i:j] in known:
                    yield i, j, (word[i:j],)
            if word[j - 1] not in known:
                yield j - 1, j, tuple(word[j - 1].encode())

    def sums(word, p):
        n = len(word)
        ways = [(i, j, keys, math.prod(p[k] for k in keys)) for i, j, keys in arcs(word)]
        ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for i, j, _, w in ways:
            ahead[j] += ahead[i] * w
        for i, j, _, w in reversed(ways):
            back[i] += back[j] * w
        return ways, ahead, back

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    langs = sorted({x for i, _, x in docs if x and not held(i)})
    size = len(names) + 256
    probs = {}
    for lang in langs:
        p = defaultdict(lambda: 1 / size)
        for _ in range(3):
            use = defaultdict(float)
            for i, t, x in docs:
                if x == lang and not held(i):
                    for w in words(t):
                        ways, ahead, back = sums(w, p)
                        for a, b, keys, weight in ways:
                            for k in keys:
                                use[k] += ahead[a] * weight * back[b] / ahead[-1]
            total = sum(use.values()) + 0.1 * size
            p = defaultdict(lambda t=total: 0.1 / t, {k: (v + 0.1) / total for k, v in use.items()})
        probs[lang] = p
    got = {x.doc_id: x for x in language_id.op5_marginal_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        ws = words(t)
        assert got[i].held_out == held(i)
        if not ws:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        score = [sum(math.log(sums(w, probs[lang])[1][-1]) for w in ws) for lang in langs]
        best = score.index(max(score))
        assert got[i].lang_pred == langs[best]
        assert got[i].score == pytest.approx(1 / sum(math.exp(s - score[best]) for s in score), rel=1e-6)
