"""Whole queries that SQL can't express, against plain Python over all rows of the smallest tables."""

import itertools
import math
import os
import random
import re
import unicodedata
from collections import Counter, defaultdict
from os.path import commonprefix

import pytest

from lectern.functions import text
from lectern.operators import noisy
from lectern.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()}


def folded(raw):
    """The search view, for texts whose characters are composed."""
    out = re.sub(r"(?<=\w)[-\xad][ \t]*\r?\n[ \t]*(?=\w)", "", raw).lower()
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ſ", "s"), ("j", "i"), ("v", "u")):
        out = out.replace(a, b)
    out = "".join(c if c.isalnum() or c == "*" or unicodedata.category(c)[0] == "M" else " " for c in out)
    return re.sub("[ao]e", "e", re.sub(" +", " ", out)).strip()


def stretches(hay):
    """Starts and ends of the words."""
    return [m.span() for m in re.finditer(r"\S+", hay)]


def exactly(hay, needle):
    return [(m.start(), m.start() + len(needle)) for m in re.finditer(f"(?={re.escape(needle)})", hay) if (" " + hay + " ")[m.start()] == " " == (" " + hay + " ")[m.start() + len(needle) + 1]]


def test_fuzzy_hits(spark, docs, items):
    got = {(r.doc_id, r.anchor, r.start, r.end, r.edits) for r in QUERIES["fuzzy_hits"](spark, SF).collect()}
    want = set()
    for doc, raw in docs.items():
        hay = folded(raw)
        words = stretches(hay)
        ends = {z for _, z in words}
        for k, item in enumerate(map(folded, items.values())):
            n = len(item)
            for a, _ in words:
                for z in (a + n - 1, a + n, a + n + 1):
                    if z in ends and z > a:
                        there = hay[a:z]
                        if there[:4] != item[:4] and there[-4:] != item[-4:]:
                            continue
                        # one edit at most leaves all but one character to the common beginning and end
                        same = len(commonprefix([there, item])) + len(commonprefix([there[::-1], item[::-1]]))
                        if there == item or (same >= max(len(there), n) - 1 and abs(len(there) - n) <= 1):
                            want.add((doc, k, a, z, int(there != item)))
    assert got == want and len(want) > 2


def test_bounded_gap_hits(spark, docs, items):
    got = {(r.doc_id, r.anchor, r.start, r.end, r.edits) for r in QUERIES["bounded_gap_hits"](spark, SF).collect()}
    long = [t.split() for t in items.values() if len(t.split()) >= 8]
    want = set()
    for doc, raw in docs.items():
        hay = folded(raw)
        for k, words in enumerate(long):
            first, last = (exactly(hay, folded(" ".join(w))) for w in (words[:3], words[-3:]))
            want |= {(doc, k, a[0], b[1], 0) for a in first for b in last if 1 <= b[0] - a[1] <= 400}
    assert got == want and len(want) > 2


def test_ordered_passages(spark, docs, items):
    rows = QUERIES["ordered_passages"](spark, SF).collect()
    halves = []
    for t in items.values():
        w = t.split()
        halves += [folded(" ".join(x)) for x in (w[: len(w) // 2], w[len(w) // 2 :]) if len(w) > 1]
    hits = {doc: [(k, *at) for k, h in enumerate(halves) for at in exactly(folded(raw), h)] for doc, raw in docs.items()}
    df = Counter(k for own in hits.values() for k in {h[0] for h in own})
    weight = {k: 1 + math.log((1 + len(docs)) / (1 + df[k])) for k in range(len(halves))}
    best = {r.doc_id: r for r in rows if r["rank"] == 1}
    assert set(best) == {d for d, own in hits.items() if own}
    for doc, row in best.items():
        own = sorted(hits[doc], key=lambda h: h[1])
        top = max(sum(weight[h[0]] for h in c) for n in range(1, min(len(own), 6) + 1) for c in itertools.combinations(own, n) if all(a[2] <= b[1] and a[0] < b[0] for a, b in itertools.pairwise(c)))
        # no text here is so long that the window of 1,800 characters cuts a chain of neighbouring halves
        assert row.score <= top + 1e-6 and (len(own) > 2 or row.score == pytest.approx(top, abs=1e-6))


def letters(token):
    out, sign = "", False
    for c in unicodedata.normalize("NFD", token.lower()):
        sign |= c in text.SIGNS or unicodedata.category(c) == "Mn" or "" <= c <= ""
        out += text.SIGNS.get(c, text.PLAIN.get(c, c))
    return "".join(c for c in out if "a" <= c <= "z"), sign


def within_one(a, b):
    same = len(commonprefix([a, b])) + len(commonprefix([a[::-1], b[::-1]]))
    return a != b and abs(len(a) - len(b)) <= 1 and same >= max(len(a), len(b)) - 1


def chained(docs, items):
    """{(item, rank): (doc, ti, score, chain, offset)} by the plain rules."""
    tokens = {d: [(m.group(), *m.span()) for m in re.finditer(text.TOKEN, raw)] for d, raw in docs.items()}
    reduced = {t: letters(t) for own in tokens.values() for t, *_ in own}
    freq = Counter(reduced[t][0] for own in tokens.values() for t, *_ in own)
    del freq[""]
    total = sum(freq.values())
    query = [(i, pos, w) for i, t in items.items() for pos, w in enumerate(letters(m)[0] for m in re.findall(text.TOKEN, t)) if len(w) >= 4 and w not in text.STOP and freq[w] / total <= 5e-5]
    words = {w for *_, w in query}
    heads = Counter(w[:k] for *_, w in query for k in range(3, len(w)))
    heads = {h for h, n in heads.items() if n < 40 and freq[h] / total < 5e-5}
    meant = {}
    for form, sign in set(reduced.values()):
        if form in words and len(form) >= 4:
            meant[form, sign] = {form}, 0.9 if sign else 1.0
        elif sign:
            meant[form, sign] = ({w for w in words if form in heads and w.startswith(form) and w != form}, 0.6) if len(form) >= 3 else (set(), 0)
        else:
            meant[form, sign] = ({w for w in words if len(w) >= 6 and len(form) >= 5 and within_one(form, w)}, 0.8)
    at = defaultdict(list)
    for i, pos, w in query:
        at[w].append((i, pos, math.log((total + 1) / (freq[w] + 1)) / math.log(total)))
    found = []
    for doc, own in tokens.items():
        hits = defaultdict(list)
        for ti, (t, a, z) in enumerate(own):
            ws, strength = meant[reduced[t]]
            for w in ws:
                for i, pos, weight in at[w]:
                    hits[i].append((ti, pos, strength * weight, a, z))
        for i, hs in hits.items():
            for last in hs:
                near = sorted(h for h in hs if last[0] - 150 <= h[0] < last[0] and h[1] < last[1]) + [last]
                if len({h[1] for h in near}) < 3:
                    continue
                best = []
                for k, h in enumerate(near):
                    before = max((best[j] for j in range(k) if near[j][0] < h[0] and near[j][1] < h[1]), default=(0.0, 0, 0), key=lambda b: (b[0], b[1], -b[2]))
                    best.append((before[0] + h[2], before[1] + 1, before[2] if before[1] else h[3]))
                if best[-1][1] >= 3:
                    found.append((i, doc, last[0], best[-1][0], best[-1][1], best[-1][2]))
    stretch = {}
    for r in found:
        key = (r[0], r[1], r[5] // 2000)
        stretch[key] = min(stretch.get(key, r), r, key=lambda x: (-x[3], x[5], x[2]))
    out = defaultdict(list)
    for r in sorted(stretch.values(), key=lambda x: (-round(x[3], 9), x[1], x[5])):
        if len(out[r[0]]) < 15:
            out[r[0]].append(r[1:])
    return out


def test_ordered_chain_and_margins(spark, docs, items):
    scores = lambda rows: {i: sorted(round(r[2], 6) for r in own) for i, own in rows.items()}

    def given(rows):
        out = defaultdict(list)
        for r in rows:
            out[r.item_id].append((r.doc_id, r.ti, r.score, r.chain, r.offset))
        return out

    want = chained(docs, items)
    got = given(QUERIES["ordered_chain"](spark, SF).collect())
    assert scores(got) == scores(want) and sum(map(len, want.values())) > 20
    assert all({x[0] for x in got[i]} == {x[0] for x in own} for i, own in want.items() if len(own) < 15)
    mixed = {}
    for i, t in items.items():
        mixed[i] = t.split()
        random.Random(f"0:{i}").shuffle(mixed[i])
    null = chained(docs, {i: " ".join(w) for i, w in mixed.items()})
    top = {i: max((r[2] for r in own), default=0.0) for i, own in null.items()}
    margins = QUERIES["shuffled_margin"](spark, SF).collect()
    assert scores(given(margins)) == scores(want)
    assert all(r.null_top == pytest.approx(top.get(r.item_id, 0.0)) and r.margin == pytest.approx(r.score - r.null_top) for r in margins)
    assert noisy.NEAR == 0.8
