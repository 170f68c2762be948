"""Operator 7: quality classifier by gated attention over passages (multiple-instance learning).

A document is a bag of passages of ``WORDS`` words; every passage of the whole text is encoded: mean
embeddings of hashed words and of word shapes, joined to a few ratios (repeats, symbols, capitals, digits, length), through
a tanh layer. Gated attention (tanh times sigmoid) gives each passage a weight, the weights sum to 1, and the
weighted passage representation is scored by a logistic unit. All of it is learned together from document labels only.

Training takes a bounded sample of labelled documents, all passages of each: ``SAMPLE`` rows, the first by hash of id and text, of texts of up to
``SAMPLE_BYTES``; the bounds are parameters. Scoring covers every passage of every document and
handles one document at a time in blocks of passages, so memory doesn't grow with a text.

Defined results: null, empty and wordless texts are a bag of one empty passage and get its score. Labels that
are null are left out; several labels of one id count by their largest. A label without document teaches
nothing. With no labels, or labels of one kind, all scores are the share of label 1 (0.5 without any). A null id
counts as an empty id. Rows that repeat an id give a row each. An empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table

SAMPLE, SAMPLE_BYTES, WORDS = 6000, 1 << 18, 100
LEXICAL, SHAPES, D, H, A, RATIOS = 1 << 14, 1 << 10, 12, 16, 8, 6
EPOCHS, BATCH, RATE, SEED, THRESHOLD = 10, 64, 0.01, 7, 0.3
#: Words whose codes a task keeps.
KEPT = 500_000

_SHAPE = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"(.)\1+"), rb"\1")]


def _code(word: bytes) -> int:
    """Hashed word, hashed shape and three flags (symbols, capitals, digits) in one number."""
    shape = word
    for pattern, by in _SHAPE:
        shape = pattern.sub(by, shape)
    flags = (any(c in b"#*$%&|<>" for c in word)) | (word.isupper() << 1) | (any(48 <= c <= 57 for c in word) << 2)
    return (zlib.crc32(word.lower()) % LEXICAL) | (zlib.crc32(shape) % SHAPES) << 14 | flags << 24


class Codes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        self[word] = code = _code(word)
        return code


def encode(text: str | None, codes: Codes) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(codes.__getitem__, words), np.int32, len(words))


def passages(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes and the start of each passage."""
    return words, np.arange(0, max(len(words), 1), WORDS)


def _ratios(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each passage: adjacent repeats, distinct words, symbols, capitals, digits, log length."""
    sizes = np.diff(np.append(starts, len(words)))
    where = np.repeat(np.arange(len(starts)), sizes)
    n = np.maximum(sizes, 1)
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (where[1:] == where[:-1])
    distinct = np.bincount(np.unique(where * (1 << 27) + words.astype(np.int64)) >> 27, minlength=len(starts)) if len(words) else np.zeros(len(starts))
    count = lambda x: np.bincount(where, x, len(starts)) / n
    return np.stack([4 * count(again), 4 * distinct / n, *(2 * count(words >> 24 + k & 1) for k in range(3)), np.log1p(sizes) / 5], 1)


def _means(table_: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), table_.shape[1]), table_.dtype)
    full = sizes > 0
    if full.any():
        starts = np.cumsum(sizes) - sizes
        out[full] = np.add.reduceat(table_[ids], starts[full]) / sizes[full, None]
    return out


class Attention:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"lex": r.normal(0, 0.1, (LEXICAL, D)), "shape": r.normal(0, 0.1, (SHAPES, D)), "w": g(2 * D + RATIOS, H), "b": np.zeros(H), "v": g(H, A), "u": g(H, A), "a": g(A), "c": g(H), "d": np.zeros(1)}

    def forward(self, words: np.ndarray, starts: np.ndarray, bags: np.ndarray) -> dict:
        """bags: the document of each passage, in order from 0 without gaps."""
        p, s = self.p, {}
        s["sizes"] = np.diff(np.append(starts, len(words)))
        s["lex"], s["shape"] = words & (LEXICAL - 1), words >> 14 & (SHAPES - 1)
        s["x"] = np.hstack([_means(p["lex"], s["lex"], s["sizes"]), _means(p["shape"], s["shape"], s["sizes"]), _ratios(words, starts)])
        s["h"] = np.tanh(s["x"] @ p["w"] + p["b"])
        s["t"], s["g"] = np.tanh(s["h"] @ p["v"]), 1 / (1 + np.exp(-(s["h"] @ p["u"])))
        s["e"] = (s["t"] * s["g"]) @ p["a"]
        return s

    def pool(self, s: dict, bags: np.ndarray, n: int) -> np.ndarray:
        top = np.full(n, -np.inf)
        np.maximum.at(top, bags, s["e"])
        w = np.exp(s["e"] - top[bags])
        s["alpha"] = w / np.bincount(bags, w, n)[bags]
        s["z"] = np.zeros((n, H))
        np.add.at(s["z"], bags, s["alpha"][:, None] * s["h"])
        return s["z"] @ self.p["c"] + self.p["d"]

    def gradients(self, s: dict, bags: np.ndarray, dlogit: np.ndarray) -> dict:
        p, g = self.p, {}
        g["c"], g["d"] = s["z"].T @ dlogit, dlogit.sum(keepdims=True)
        dz = (dlogit[:, None] * p["c"])[bags]
        dalpha = (dz * s["h"]).sum(1)
        mean = np.bincount(bags, s["alpha"] * dalpha, len(dlogit))[bags]
        de = s["alpha"] * (dalpha - mean)
        g["a"] = (s["t"] * s["g"]).T @ de
        dtg = de[:, None] * p["a"]
        dt, dg = dtg * s["g"] * (1 - s["t"] ** 2), dtg * s["t"] * s["g"] * (1 - s["g"])
        g["v"], g["u"] = s["h"].T @ dt, s["h"].T @ dg
        dh = (s["alpha"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - s["h"] ** 2)
        g["w"], g["b"] = s["x"].T @ dh, dh.sum(0)
        dx = (dh @ p["w"].T)[:, : 2 * D] / np.maximum(s["sizes"], 1)[:, None]
        where = np.repeat(np.arange(len(s["sizes"])), s["sizes"])
        for k, name in enumerate(("lex", "shape")):
            full = np.zeros_like(p[name])
            np.add.at(full, s[name], dx[where, k * D : (k + 1) * D])
            g[name] = full
        return g

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> None:
        r = np.random.default_rng(SEED)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                part = order[k : k + BATCH]
                words = np.concatenate([bags[i][0] for i in part])
                shift = np.cumsum([0, *(len(bags[i][0]) for i in part)])
                starts = np.concatenate([bags[i][1] + o for i, o in zip(part, shift, strict=False)])
                which = np.repeat(np.arange(len(part)), [len(bags[i][1]) for i in part])
                s = self.forward(words, starts, which)
                p1 = 1 / (1 + np.exp(-self.pool(s, which, len(part))))
                step += 1
                for name, g in self.gradients(s, which, (p1 - labels[part]) / len(part)).items():
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.999 * m2[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - RATE * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)

    def score(self, words: np.ndarray) -> float:
        words, starts = passages(words)
        parts = []
        for k in range(0, len(starts), 4096):
            own = starts[k : k + 4096]
            s = self.forward(words[own[0] : own[-1] + WORDS], own - own[0], np.zeros(len(own), int))
            parts.append((s["h"], s["e"]))
        s = {"h": np.vstack([x[0] for x in parts]), "e": np.concatenate([x[1] for x in parts])}
        return float(1 / (1 + np.exp(-self.pool(s, np.zeros(len(s["e"]), int), 1)[0])))

    def scores(self, found: list[np.ndarray]) -> list[float]:
        """Of several documents at once, long ones on their own."""
        out, part, size = [0.0] * len(found), [], 0

        def flush() -> None:
            nonlocal part, size
            if part:
                cut = [passages(found[i]) for i in part]
                shift = np.cumsum([0, *(len(w) for w, _ in cut)])
                which = np.repeat(np.arange(len(part)), [len(x) for _, x in cut])
                s = self.forward(np.concatenate([w for w, _ in cut]), np.concatenate([x + o for (_, x), o in zip(cut, shift, strict=False)]), which)
                for i, z in zip(part, self.pool(s, which, len(part)), strict=True):
                    out[i] = float(1 / (1 + np.exp(-z)))
            part, size = [], 0

        for i, words in enumerate(found):
            if len(words) > 100_000:
                out[i] = self.score(words)
                continue
            part.append(i)
            size += len(words)
            if size > 100_000:
                flush()
        flush()
        return out


def training_bags(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[list, np.ndarray]:
    """The bounded sample: passages and labels of ``sample`` rows, first by hash of id and text."""
    known = labels.where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").cast("double").alias("y"))
    order = [F.xxhash64("doc_id", "th"), "doc_id", "th"]
    marked = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= sample_bytes).withColumn("th", F.xxhash64("text"))
    keys = marked.select("doc_id", "th").join(known, "doc_id").orderBy(*order).limit(sample).distinct()
    chosen = marked.join(F.broadcast(keys), ["doc_id", "th"]).orderBy(*order).limit(sample)  # repeated rows count each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([encode(t.as_py(), codes).tobytes() for t in b.column(2)], pa.binary())], names=["doc_id", "y", "words"])

    rows = chosen.select("doc_id", "y", "text").mapInArrow(run, "doc_id bigint, y double, words binary")
    rows = sorted(rows.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.words))
    return [passages(np.frombuffer(r.words, np.int32)) for r in rows], np.array([r.y for r in rows])


def score_documents(docs: DataFrame, bags: list, labels: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, held_out, text) as doc_id, held_out, score."""
    model, flat = Attention(), float(labels.mean()) if len(labels) else 0.5
    if 0 < flat < 1:
        model.fit(bags, labels)
    sent = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float64) for k, v in model.p.items()})
    learned = len(labels) > 0 and 0 < flat < 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes = Attention(), Codes()
        model.p = sent.value
        for b in batches:
            found = [encode(t.as_py(), codes) for t in b.column("text")] if learned else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.scores(found) if learned else [flat] * b.num_rows, pa.float64())], names=["doc_id", "held_out", "score"])

    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, score double")


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    bags, y = training_bags(docs.where("not held_out"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")))
    return score_documents(docs, bags, y).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
