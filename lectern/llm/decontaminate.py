"""Operator 3: benchmark decontamination by pigeonhole edit matching.

Items and documents are normalised alike: lower case, every run of characters that are neither letters nor
digits becomes one space. An item of m characters has a budget of k = floor(``RATE`` * m) edits and is split into
k + 1 pieces of equal length (to one character). k edits can't touch all pieces, so any place within the
budget holds some piece unchanged. All pieces go into one Aho-Corasick automaton, each piece hit proposes a
stretch of the document, and Myers' bit-parallel distance verifies the stretch. Each document and item with a
place within the budget gives a row with the least distance.

The items are a stated query set and are taken in blocks of at most ``BLOCK`` characters; each block is a pass
over the documents, and only a block's items are sent out.

Defined results: null and empty documents hold nothing. Items that are null or have no letter or digit match
nothing; items of under ``1 / RATE`` characters have budget 0 and match exactly. A match may start or end
inside a word. Repeated items match by their
own ids; rows that repeat a document id are merged in the report and all go in the stage. A null document id
is reported as null and the stage keeps it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_rows, keyed, table, trimmed

RATE, BLOCK = 0.08, 4_000_000

_GAPS = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAPS.sub(" ", (text or "").lower()).strip()


class Item:
    def __init__(self, ident: int | None, text: str, rate: float):
        self.ident, self.text, self.m = ident, text, len(text)
        self.budget = int(rate * self.m)
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i

    def pieces(self) -> list[tuple[str, int]]:
        n = self.budget + 1
        edges = [self.m * i // n for i in range(n + 1)]
        return [(self.text[a:b], a) for a, b in zip(edges, edges[1:], strict=False)]

    def distance(self, text: str) -> int:
        """Least edit distance of the item to any stretch of ``text`` (Myers 1999)."""
        get, m = self.masks.get, self.m
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best = full, 0, m, m
        for c in text:
            eq = get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | (full & ~(xh | up))
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
            ph <<= 1
            up = (mh << 1 | (full & ~(xv | ph))) & full
            down = ph & xv & full
        return best


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.items = [Item(i, t, rate) for i, t in items if t]
        found: dict[str, list] = defaultdict(list)
        for k, item in enumerate(self.items):
            for piece, at in item.pieces():
                found[piece].append((k, at, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, where)
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item, least distance, budget) of every item within its budget."""
        text = normalise(text)
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, where in self.automaton.iter(text):
            for k, at, size in where:
                starts[k].add(end + 1 - size - at)
        out = []
        for k, found in starts.items():
            item = self.items[k]
            if any(s >= 0 and text.startswith(item.text, s) for s in found):
                out.append((item.ident, 0, item.budget))
                continue
            best, spots, i = item.m, sorted(found), 0
            while i < len(spots):
                j = i
                while j + 1 < len(spots) and spots[j + 1] - spots[j] <= item.budget:
                    j += 1
                best = min(best, item.distance(text[max(0, spots[i] - item.budget) : spots[j] + item.m + item.budget]))
                i = j + 1
            if best <= item.budget:
                out.append((item.ident, best, item.budget))
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator():
        text = normalise(r[1])
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append((r[0], text))
        size += len(text)
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, budget: each pair within the budget once."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, distance bigint, budget bigint"
    out = spark.createDataFrame([], schema)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    for block in _blocks(items):
        sent = spark.sparkContext.broadcast(block)

        @trimmed
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for b in batches:
                rows = [(doc, *m) for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in matcher.matches(text.as_py())]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "distance", "budget"])

        out = out.union(docs.mapInArrow(run, schema))
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("budget").alias("budget"))


def op3_pigeonhole_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item."""
    rows = keyed(docs, "op3-rows")
    found = matches(rows.select(F.col("__row").alias("doc_id"), "__doc.text"), table(spark, sf_dir, "benchmark"))
    return drop_rows(rows, found.select("doc_id"))
