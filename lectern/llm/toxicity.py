"""Operator 10: toxicity by nearest labelled examples, exact TF-IDF cosine over a block-max inverted index.

Terms are runs of letters, lower case. The vocabulary is every term of the examples, without a bar: a term that no example has can't add to
a cosine. A term's weight is (1 + ln tf) * idf * (``FLOOR`` + what is left of the log ratio of its smoothed frequencies under the two labels after
``TRUST`` standard errors), with document frequencies counted over all labelled training documents, so terms that don't tell the labels
apart for certain weigh little but are searched. A document's vector has length 1 over the vocabulary.

Examples are a bounded sample of labelled training documents (``SAMPLE`` of each label with a term, first by hash of the
id; a parameter). Their postings lie in blocks of ``BLOCK`` examples; for each block of a term the largest weight is
kept. The ``DENSE`` terms that most examples have are kept as columns instead and are added up for 64 queries at once. Terms of fewer postings than a block
has examples have no maxima, a query adds up all their postings. A block's bound is the best of its examples by all these and the sum of the query's
weights times the maxima of all other terms. A query reads the postings of the ``FIRST`` blocks by bound, and then of all blocks whose bound reaches the
K-th best cosine: nothing else can enter, so the K nearest are exact. Ties go to the smaller example number.

The vote is the sum of cosine**POWER over toxic neighbours against all, shrunk to the share of toxic documents by ``PRIOR``; a Platt
curve fitted on the examples with each example left out itself makes it a probability. A text without any
term gets the share of toxic labels among the training documents without one, a text that shares none with an example the calibrated vote of no neighbours. Evidence: the ids of the nearest examples.

Defined results: null and empty texts have no term. Null labels are left out; several labels of one id count by their
largest. With no labels all scores are 0.5, with labels of one kind only that share. A null id counts as an empty id. Rows
that repeat an id give a row each. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, letter_runs, materialize, table

SAMPLE, BLOCK, K, POWER, PRIOR, THRESHOLD = 4096, 64, 15, 2.0, 0.3, 0.7
FLOOR, TRUST, DENSE, FIRST = 0.05, 0.5, 512, 8
#: Queries that are searched at once.
QUERIES = 64
#: Documents whose terms are counted at once, and scores of texts that a task keeps.
ROWS, KEPT = 512, 5_000
#: ASCII without letters as spaces; different other signs that are replaced one by one.
_GAPS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
SIGNS = 32


def terms_of(text: str | None) -> list[str]:
    """The runs of letters of a text, lower case, as ``letter_runs`` finds them."""
    text = (text or "").lower()
    if not text.isascii():
        signs = [c for c in set(text) if c > "\x7f" and not c.isalpha()]
        if len(signs) > SIGNS or any(map(str.isalnum, signs)):
            return letter_runs(text)
        for c in signs:
            text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(_GAPS).decode("utf-8", "surrogatepass").split()


Vector = tuple[np.ndarray, np.ndarray]


class Vectors:
    """TF-IDF vectors over a vocabulary {term: number}; weights by number."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights

    def of(self, words: list[str]) -> Vector:
        counts = Counter(words)
        ks, ns = np.fromiter(map(self.vocabulary.get, counts, repeat(-1)), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
        order = np.argsort(ks)
        order = order[np.searchsorted(ks, 0, sorter=order) :]
        if not len(order):
            return np.zeros(0, np.int64), np.zeros(0)
        ks, ns = ks[order], ns[order]
        x = (1 + np.log(ns)) * self.weights[ks]
        return ks, x / np.sqrt((x * x).sum())


class BlockMaxIndex:
    """Postings by term and example. Frequent terms are columns; long lists have, for each block, their largest weight and the place of their first posting."""

    def __init__(self, vectors: list[Vector], n_terms: int, block: int = BLOCK, dense: int = DENSE):
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block)
        sizes = np.array([len(ks) for ks, _ in vectors], np.int64)
        term = np.concatenate([ks for ks, _ in vectors]) if self.n else np.zeros(0, np.int64)
        weight = np.concatenate([xs for _, xs in vectors]) if self.n else np.zeros(0)
        example = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        often = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:dense]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.columns = np.zeros((len(often), self.blocks * block))
        common = self.column[term] >= 0
        self.columns[self.column[term[common]], example[common]] = weight[common]
        term, weight, example = term[~common], weight[~common], example[~common]
        order = np.argsort(term, kind="stable")
        term, self.weight, self.example = term[order], weight[order], example[order]
        self.term_start = np.searchsorted(term, np.arange(n_terms + 1)).astype(np.int32)
        long = np.flatnonzero(np.diff(self.term_start) >= block)
        self.row = np.full(n_terms, -1, np.int32)
        self.row[long] = np.arange(len(long))
        row = self.row[term]
        own = row >= 0
        row, at = row[own], self.example[own] // block
        self.most = np.zeros((len(long), self.blocks), np.float32)
        np.maximum.at(self.most, (row, at), np.nextafter(self.weight[own].astype(np.float32), np.float32(2)))
        sizes = np.bincount(row.astype(np.int64) * self.blocks + at, minlength=len(long) * self.blocks).reshape(len(long), self.blocks)
        self.block_start = np.concatenate((np.zeros((len(long), 1), np.int64), sizes.cumsum(1)), 1).astype(np.int32) + self.term_start[long][:, None]

    def nearest(self, queries: list[Vector], k: int = K, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the numbers and cosines of the k nearest examples with cosine over 0."""
        out = []
        for a in range(0, len(queries), QUERIES):
            out += self._search(queries[a : a + QUERIES], k, without[a : a + QUERIES] if without else None)
        return out

    def _search(self, queries: list[Vector], k: int, without: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        own, rest = np.zeros((len(queries), len(self.columns))), []
        for row, (ks, xs) in zip(own, queries, strict=True):
            column = self.column[ks]
            common = column >= 0
            row[column[common]] = xs[common]
            rest.append((ks[~common], xs[~common]))
        return [self._finish(scores, *v, k, w) for scores, v, w in zip(own @ self.columns, rest, without or [None] * len(queries), strict=True)]

    def _read(self, scores: np.ndarray, start: np.ndarray, size: np.ndarray, x: np.ndarray) -> None:
        """Adds x times each posting of the ranges to the scores."""
        spot = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        scores += np.bincount(self.example[spot], np.repeat(x, size) * self.weight[spot], len(scores))

    def _finish(self, scores: np.ndarray, ks: np.ndarray, xs: np.ndarray, k: int, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of a query whose terms without a column are ks; ``scores`` holds the columns' part."""
        row = self.row[ks]
        long = row >= 0
        start = self.term_start[ks[~long]]
        self._read(scores, start, self.term_start[ks[~long] + 1] - start, xs[~long])
        row, xs, by_block = row[long], xs[long], scores.reshape(self.blocks, self.block)
        starts = self.block_start[row]

        def read(blocks: np.ndarray) -> None:
            start = starts[:, blocks]
            self._read(scores, start.ravel(), (starts[:, blocks + 1] - start).ravel(), np.repeat(xs, len(blocks)))
            if without is not None:
                scores[without] = 0.0

        bound, first = by_block.max(1) + xs @ self.most[row], min(FIRST, self.blocks)
        promising = np.argpartition(-bound, first - 1)[:first]
        read(promising)
        seen = by_block[promising].ravel()
        mark = max(np.partition(seen, len(seen) - k)[len(seen) - k], 0.0) if len(seen) >= k else 0.0
        later = (bound >= mark - 1e-12) & (bound > 0)
        later[promising] = False
        read(np.flatnonzero(later))
        ids = np.flatnonzero(scores >= max(mark - 1e-12, 1e-300))  # what isn't read whole is under its block's bound, and that under the mark
        ids = ids[np.lexsort((ids, -np.round(scores[ids], 12)))[:k]]
        return ids, scores[ids]


class Voter:
    def __init__(self, vectors: list[Vector], labels: list[int], ids: list[int], n_terms: int, base: float, empty: float):
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][int(np.argmax(vectors[i][1]))]), labels[i], ids[i]))  # alike examples share blocks
        self.labels, self.ids = np.array([labels[i] for i in order], float), [ids[i] for i in order]
        vectors, self.base, self.empty = [vectors[i] for i in order], base, empty
        self.index = BlockMaxIndex(vectors, n_terms)
        self.curve = (1.0, 0.0)
        if len(order) and 0 < self.labels.mean() < 1:
            raw = np.array([self.vote(*found) for found in self.index.nearest(vectors, without=list(range(len(vectors))))])
            self.curve = self._platt(raw, self.labels)

    @staticmethod
    def _logit(p: np.ndarray | float) -> np.ndarray | float:
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def _platt(self, raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        x = np.stack([self._logit(raw), np.ones(len(raw))], 1)
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (goal - p) - 1e-3 * (w - [1, 0]))
        return max(float(w[0]), 0.05), float(w[1])

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        w = sims**POWER
        return float(((w * self.labels[ids]).sum() + PRIOR * self.base) / (w.sum() + PRIOR))

    def scores(self, vectors: list[Vector], filled: list[bool]) -> list[tuple[float, list[int]]]:
        """Score and evidence of each vector; filled: whether its text has a term at all."""
        out: list[tuple[float, list[int]]] = [(self.empty, [])] * len(vectors)
        own = [i for i, f in enumerate(filled) if f and len(self.ids)]
        for i, (ids, sims) in zip(own, self.index.nearest([vectors[i] for i in own]), strict=True):
            raw = self.vote(ids, sims)
            out[i] = float(1 / (1 + np.exp(-(self.curve[0] * self._logit(raw) + self.curve[1])))), [self.ids[j] for j in ids[:3]]
        return out


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th and the distinct terms of the text, pressed; null without any."""
    press = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        found = [set(terms_of(t.as_py())) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press(" ".join(f).encode()) if f else None for f in found], pa.binary())], names=["doc_id", "th", "terms"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor().decompress
    for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        all_, bad = Counter(), Counter()
        for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = open_(t.as_py()).decode().split(" ")
            all_.update(own)
            if y:
                bad.update(own)
        names = list(all_)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([all_[w] for w in names], pa.int64()), pa.array([bad[w] for w in names], pa.int64())], names=["term", "n", "bad"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in b.column(0) for w in terms_of(t.as_py())}), pa.string())], names=["term"])


def weigh_terms(labelled: DataFrame, examples: DataFrame, n: int, bad: int) -> Vectors:
    """The vectors over all terms of the examples; frequencies are those in all labelled documents."""
    counts = labelled.where("terms is not null").select("y", "terms").mapInArrow(_term_counts, "term string, n bigint, bad bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    own = examples.select("text").mapInArrow(_terms, "term string").distinct()
    found = counts.join(own, "term").orderBy("term").toPandas()
    share, all_, in_bad = bad / n, found["n"].to_numpy(float), found["bad"].to_numpy(float)
    toxic, clean = in_bad + share, all_ - in_bad + 1 - share
    ratio = np.abs(np.log(toxic / (bad + 1) * (n - bad + 1) / clean)) - TRUST * np.sqrt(1 / toxic + 1 / clean)
    often = np.argsort(-all_, kind="stable")  # frequent terms lie side by side in memory; their numbers go by name
    return Vectors(dict(zip(found["term"].to_numpy()[often].tolist(), often.tolist(), strict=True)), (np.log((1 + n) / (1 + all_)) + 1) * (FLOOR + np.maximum(ratio, 0)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Vectors, Voter]:
    """Vectors and voter from ``docs`` (doc_id, text) and ``labels`` (doc_id, y)."""
    known = labels.where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    docs = docs.where("doc_id is not null").withColumn("th", F.xxhash64("text"))
    marked = docs.select("doc_id", "th", "text").mapInArrow(_distinct_terms, "doc_id bigint, th bigint, terms binary")
    rows = materialize(marked.join(known.hint("merge"), "doc_id"), "op10-rows")  # labels have no bound: never broadcast
    n, bad, n_none, bad_none = (int(x or 0) for x in rows.agg(F.count("*"), F.sum("y"), F.count_if(F.col("terms").isNull()), F.sum(F.when(F.col("terms").isNull(), F.col("y")))).first())
    base = bad / n if n else 0.5
    empty = (bad_none + base) / (n_none + 1)
    if not 0 < bad < n:
        return Vectors({}, np.zeros(0)), Voter([], [], [], 1, base, empty)
    first = [F.xxhash64("doc_id"), "doc_id", "th"]
    keys = [rows.where(F.col("terms").isNotNull() & (F.col("y") == y)).orderBy(*first).limit(sample).select("doc_id", "th", "y") for y in (0, 1)]
    keys = materialize(keys[0].union(keys[1]).distinct(), "op10-keys")  # at most 2 * sample rows: broadcast, so only their texts are moved
    found = docs.join(F.broadcast(keys), ["doc_id", "th"])
    examples = [found.where(F.col("y") == y).orderBy(*first).limit(sample).select("doc_id", "th", "y", "text") for y in (0, 1)]
    examples = materialize(examples[0].union(examples[1]), "op10-examples")
    vectors = weigh_terms(rows, examples, n, bad)
    picked = [(r.doc_id, r.y, vectors.of(terms_of(r.text))) for r in examples.orderBy("y", *first).toLocalIterator()]
    return vectors, Voter([v for *_, v in picked], [y for _, y, _ in picked], [i for i, *_ in picked], len(vectors.vocabulary), base, empty)


def score_documents(docs: DataFrame, vectors: Vectors, voter: Voter) -> DataFrame:
    """``docs`` (doc_id, held_out, text) as doc_id, held_out, score, evidence."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, voter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, voter = sent.value
        seen: dict[bytes, tuple[float, list[int]]] = {}
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            if len(seen) > KEPT:
                seen.clear()
            keys, new, filled = [], {}, []
            for t in b.column("text"):
                text = t.as_py() or ""
                keys.append(md5(text.encode()).digest())
                if keys[-1] not in seen and keys[-1] not in new:
                    words = terms_of(text)
                    new[keys[-1]] = vectors.of(words)
                    filled.append(bool(words))
            seen.update(zip(new, voter.scores(list(new.values()), filled), strict=True))
            out = [seen[k] for k in keys]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))], names=["doc_id", "held_out", "score", "evidence"])

    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, score double, evidence array<bigint>")


def op10_blockmax_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    found = train(docs.where("not held_out").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")))
    return score_documents(docs, *found).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
