"""Operator 5: language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word (a run of letters, lower
case, with the vocabulary's word mark before it) has as its probability the sum over all its segmentations
into pieces of the product of their probabilities, found by a forward pass. The probabilities come from
``ROUNDS`` rounds of expectation-maximisation over the counts of all words of all training documents: a
forward-backward pass gives each piece's expected count. Characters outside the vocabulary are spelled by its byte pieces, whose
probabilities are learned like all others. Words of up to ``LONG`` characters in the vocabulary are summed side by side,
others one by one in logarithms; both sum all segmentations of the whole word.

The text's language is the one with the highest total log-probability (the first by name of equals) and the
score is its share against all languages at equal priors. Training counts (language, word) are summed partly
before the shuffle and dealt out evenly for the rounds; what reaches the driver is one number for each language and piece.

Defined results: ``und`` with score 0 for null, empty and letterless texts, and for all texts if nothing
can be learned. A null language teaches nothing. A null id counts as an empty id. Rows that repeat
an id give a row each. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, letter_runs, materialize, shuffle_partitions, table

VOCABULARY, ROUNDS, LONG, SMOOTH = "piece_bpe_32k.model", 3, 32, 0.1
#: Distinct words that a task keeps scored.
KEPT = 400_000
#: Training words that a round works through at once.
MANY = 100_000
#: Documents whose words are held at once.
ROWS = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARK = "▁"


def words_of(text: str | None) -> list[str]:
    return letter_runs((text or "").lower())


def _scramble(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32)) ^ np.uint64(0x2545F4914F6CDD1D)


class Pieces:
    """The vocabulary's pieces behind a hash of their code points: ids of many substrings at once. Byte pieces have the 256 ids after the names."""

    def __init__(self, names: list[str]):
        self.names = names
        self.size = len(names) + 256
        self.letters = {name for name in names if len(name) == 1}
        self.longest = max(map(len, names))
        self.powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(LONG, self.longest) + 1, _BASE))))
        hashes = np.zeros(len(names), np.uint64)
        for k, name in enumerate(names):
            h = 0
            for c in _scramble(np.array([ord(c) for c in name], np.uint32)).tolist():
                h = (h * int(_BASE) + c) % 2**64
            hashes[k] = h
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        self.bits = np.uint64(64 - 22)
        self.slot = np.full(1 << 22, -1, np.int32)
        self.slot[(self.hashes >> self.bits).astype(np.int64)[::-1]] = np.arange(len(names), dtype=np.int32)[::-1]
        self.there = self.slot >= 0
        self.run = int(np.bincount((self.hashes >> self.bits).astype(np.int64)).max())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places where there is a piece, and its ids. Few hashes meet a slot in use; only those are compared."""
        slot = (h >> self.bits).view(np.int64)
        some = np.flatnonzero(self.there.take(slot))
        h, at = h[some], self.slot[slot[some]]
        out = np.full(len(h), -1, np.int32)
        for k in range(self.run):
            near = np.minimum(at + k, len(self.hashes) - 1)
            hit = self.hashes[near] == h
            out[hit] = self.ids[near[hit]]
        met = out >= 0
        return some[met], out[met]

    def plain(self, word: str) -> bool:
        return len(word) <= LONG and self.letters.issuperset(word)

    def segments(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, list]]:
        """For plain words, by length: their indexes, the length and [(start, end, rows, piece ids)]."""
        sizes = np.array([len(w) for w in words])
        for n in np.unique(sizes):
            for rows in np.array_split(which := np.flatnonzero(sizes == n), max(1, len(which) * int(n) // 150_000)):
                codes = np.frombuffer("".join([words[k] for k in rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), n)
                scrambled = _scramble(codes)
                prefix = np.zeros((n + 1, len(rows)), np.uint64)
                for k in range(n):
                    prefix[k + 1] = prefix[k] * _BASE + scrambled[:, k]
                arcs = []
                for i in range(n):
                    for j in range(i + 1, min(n, i + self.longest) + 1):
                        hit, ids = self.find(prefix[j] - prefix[i] * self.powers[j - i])
                        if len(hit):
                            arcs.append((i, j, hit, ids))
                yield rows, int(n), arcs

    def lattice(self, word: str) -> Iterator[list[tuple[int, list[int]]]]:
        """For each place from 1 on, the pieces that end there: (start, ids); a character outside the vocabulary is its byte pieces."""
        known, longest = self.numbers, self.longest
        for j in range(1, len(word) + 1):
            own = [(i, [k]) for i in range(max(0, j - longest), j) if (k := known.get(word[i:j])) is not None]
            if word[j - 1] not in self.letters:
                own.append((j - 1, [len(self.names) + b for b in word[j - 1].encode("utf-8", "replace")]))
            yield own

    @cached_property
    def numbers(self) -> dict[str, int]:
        return {name: k for k, name in enumerate(self.names)}


@lru_cache(2)
def pieces(vocabulary: str) -> Pieces:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    return Pieces([model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))])


def _sorted_out(words: list[str], known: Pieces) -> tuple[list[int], list[int]]:
    """The numbers of plain words and of others."""
    plain = [known.plain(w) for w in words]
    return [k for k, p in enumerate(plain) if p], [k for k, p in enumerate(plain) if not p]


def _forward(word: str, known: Pieces, logp: np.ndarray) -> Iterator[tuple[np.ndarray, list]]:
    """For each place from 1 on, the logarithm of the sum over all segmentations up to there, by language, and the pieces that end there."""
    alpha = [np.zeros(logp.shape[1])]  # of the last places that a piece can start at
    for j, own in enumerate(known.lattice(word), 1):
        x = np.stack([alpha[i - j] + logp[ids].sum(0) for i, ids in own])
        top = x.max(0)
        alpha.append(top + np.log(np.exp(x - top).sum(0)))
        yield alpha[-1], own
        del alpha[: -known.longest]


def score_words(words: list[str], logp: np.ndarray, vocabulary: str = VOCABULARY) -> np.ndarray:
    """log-probability of each word, summed over its segmentations, in each language. logp: pieces x languages."""
    known, probs = pieces(vocabulary), np.exp(logp)
    out = np.zeros((len(words), logp.shape[1]))
    plain, others = _sorted_out(words, known)
    for rows, n, arcs in known.segments([words[k] for k in plain]):
        alpha = np.zeros((n + 1, len(rows), logp.shape[1]))
        alpha[0] = 1
        for i, j, hit, ids in arcs:
            alpha[j, hit] += alpha[i, hit] * probs[ids]
        out[np.array(plain)[rows]] = np.log(np.maximum(alpha[n], 1e-300))
    for k in others:
        for alpha, _ in _forward(words[k], known, logp):
            out[k] = alpha
    return out


def expected_counts(words: list[str], counts: np.ndarray, logp: np.ndarray, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Expected number of uses of each piece in words of one language."""
    known, probs = pieces(vocabulary), np.exp(logp)
    total = np.zeros(len(probs))
    plain, others = _sorted_out(words, known)
    some = counts[plain]
    for rows, n, arcs in known.segments([words[k] for k in plain]):
        alpha, beta = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
        alpha[0] = beta[n] = 1
        for i, j, hit, ids in arcs:
            alpha[j, hit] += alpha[i, hit] * probs[ids]
        for i, j, hit, ids in reversed(arcs):
            beta[i, hit] += beta[j, hit] * probs[ids]
        weight = some[rows] / np.maximum(alpha[n], 1e-300)
        used = [alpha[i, hit] * probs[ids] * beta[j, hit] * weight[hit] for i, j, hit, ids in arcs]
        total += np.bincount(np.concatenate([ids for *_, ids in arcs]), np.concatenate(used), len(probs))
    for k in others:
        met = [(np.zeros(1), []), *_forward(words[k], known, logp[:, None])]
        alpha = np.array([float(a[0]) for a, _ in met])
        beta = np.full(len(alpha), -np.inf)
        beta[-1] = 0.0
        for j in range(len(met) - 1, 0, -1):
            for i, ids in met[j][1]:
                step = logp[ids].sum()
                beta[i] = np.logaddexp(beta[i], beta[j] + step)
                np.add.at(total, ids, counts[k] * np.exp(alpha[i] + step + beta[j] - alpha[-1]))
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counter in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter), pa.string()), pa.array([_MARK + w for w in counter], pa.string()), pa.array(list(counter.values()), pa.int64())], names=["lang", "word", "n"])
        found.clear()

    for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            found.setdefault(lang, Counter()).update(words_of(text.as_py()))
        if sum(map(len, found.values())) > KEPT:
            yield from rows()
    yield from rows()


def gathered(frames: Iterator[pd.DataFrame], most: int = MANY) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``most`` rows and more: what words cost side by side depends little on how many they are."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        held.append(pdf)
        if sum(map(len, held)) >= most:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def fit(training: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and the pieces' log-probabilities (pieces x languages)."""
    spark = training.sparkSession
    training = training.where("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = training.mapInArrow(_count, "lang string, word string, n bigint").repartition(shuffle_partitions(spark), "lang", "word")
    counts = materialize(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "op5-words")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    size = pieces(vocabulary).size
    logp = np.full((size, len(langs)), -np.log(size))
    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast(logp)

        def run(it: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total = np.zeros((size, len(langs)))
            for pdf in gathered(it):
                for lang, own in pdf.groupby("lang"):
                    k = langs.index(lang)
                    total[:, k] += expected_counts(own["word"].tolist(), own["n"].to_numpy(float), sent.value[:, k], vocabulary)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        rows = counts.mapInPandas(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(logp.shape, SMOOTH)
        total[rows["piece"], rows["lang"]] += rows["n"]
        logp = np.log(total / total.sum(0))
    return langs, logp


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, lang_pred, score; further columns of ``docs`` besides text are handed on."""
    sent = docs.sparkSession.sparkContext.broadcast((langs, logp))
    others = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = sent.value
        known: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            found = [words_of(t.as_py()) if langs else [] for t in b.column("text")]
            if len(known) > KEPT:
                known, scores = {}, np.zeros((0, len(langs)))
            new = [w for w in dict.fromkeys(w for ws in found for w in ws) if w not in known]
            if new:
                scores = np.vstack([scores, score_words([_MARK + w for w in new], logp, vocabulary)])
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            names, values = [], []
            for ws in found:
                if not ws:
                    names.append("und")
                    values.append(0.0)
                    continue
                total = scores[[known[w] for w in ws]].sum(0)
                best = int(np.argmax(total))
                names.append(langs[best])
                values.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[*(f.name for f in others), "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "lang_pred string", "score double"])
    return docs.mapInArrow(run, schema)


def op5_marginal_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    langs, logp = fit(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), langs, logp)
