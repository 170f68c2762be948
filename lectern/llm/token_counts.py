"""Operator 9: token counts by section through offset-mapped attribution.

Each document is encoded once, as a whole, with a public byte-level vocabulary. The tokens' byte lengths give
byte spans, and the text's UTF-8 gives character spans from these: a token covers every character of which it
holds a byte. Sections are disjoint character intervals in order; both lists are sorted, so the interval join
is two binary searches for each token. A token whose characters lie in several sections is allocated by a rule:

* ``majority`` (used by the query): to the section with most of its characters, the earliest of equals;
* ``start``: to the section of its first character;
* ``split``: a share to each section, by characters.

By default the sections are the lines, each with its line break, so they cover the text and the counts add up
to the document's. Fields are given as sections in ``attribute``; tokens that lie in none are counted apart.

Defined results: null and empty texts have one empty section 0 with no token. Strings that look like special
tokens are ordinary text. Rows that repeat an id give their own rows. An empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY, RULE = "byte_bpe_50k.tiktoken", "majority"


@lru_cache(2)
def encoder(vocabulary: str):
    """The encoding and its tokens' byte lengths. vocabulary: a path, or the name of a file of the installed public vocabularies."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        sizes[k] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last, for each token of the whole text."""
    encoding, sizes = encoder(vocabulary)
    ends = np.cumsum(sizes[np.asarray(encoding.encode_ordinary(text), np.int64)])
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) != len(text):
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1
    return starts, ends


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str = RULE) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens and crossing tokens of each section [lo, hi), and the tokens that belong to none."""
    counts, crossing = np.zeros(len(lo)), np.zeros(len(lo), np.int64)
    if not len(lo) or not len(starts):
        return counts, crossing, float(len(starts))
    first = np.searchsorted(hi, starts, "right")  # first section that ends after the token's start
    last = np.searchsorted(lo, ends, "left") - 1  # last section that starts before its end
    inside = (first == last) & (lo[np.minimum(first, len(lo) - 1)] <= starts) & (hi[last] >= ends)
    counts += np.bincount(first[inside], minlength=len(lo))
    none = 0.0
    for t in np.flatnonzero(~inside):
        touched = [s for s in range(first[t], last[t] + 1) if lo[s] < ends[t] and hi[s] > starts[t]]
        if not touched:
            none += 1
            continue
        crossing[touched] += 1
        parts = [min(hi[s], ends[t]) - max(lo[s], starts[t]) for s in touched]
        if rule == "split":
            for s, n in zip(touched, parts, strict=True):
                counts[s] += n / (ends[t] - starts[t])
            none += 1 - sum(parts) / (ends[t] - starts[t])
        elif rule == "start":
            if lo[touched[0]] <= starts[t]:
                counts[touched[0]] += 1
            else:
                none += 1
        else:
            counts[touched[int(np.argmax(parts))]] += 1
    return counts, crossing, none


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character intervals of the lines, each with its line break."""
    cuts = np.cumsum([len(x) + 1 for x in text.split("\n")])
    cuts[-1] -= 1
    if len(cuts) > 1 and cuts[-1] == cuts[-2]:
        cuts = cuts[:-1]
    return np.concatenate(([0], cuts[:-1])), cuts


def section_counts(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = RULE) -> DataFrame:
    """doc_id, section (0, 1, ...), char_start, char_end, n_tokens, n_crossing for every line of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts = [], []
            for doc, cell in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = cell.as_py() or ""
                lo, hi = lines(text)
                counts, crossing, _ = attribute(*token_spans(text, vocabulary), lo, hi, rule)
                ids += [doc] * len(lo)
                parts.append((np.arange(len(lo)), lo, hi, counts, crossing))
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    schema = "doc_id bigint, section bigint, char_start bigint, char_end bigint, n_tokens double, n_crossing bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def op9_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
