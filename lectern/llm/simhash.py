"""Operator 6: SimHash near-duplicates by tables of distances to pivots.

Fingerprints: words of the lower-cased (A-Z) text, 3-word shingles with repeats, XXH64 with seed 42; a bit
is 1 if set in over half the hashes. Fingerprints link at ``LIMIT`` (2) or fewer differing bits.

Pivots. A fingerprint's coordinates are its Hamming distances to ``PIVOTS`` (48) fixed references. They come in pairs that differ in one of
``BLOCKS`` (6) blocks of bits, ``EACH`` (4) pairs for each block: half the difference of a pair's distances is the distance to the reference inside that block,
so the table tells for each block how far a fingerprint is from four references there. Two fingerprints within LIMIT differ in two blocks at
most and agree in these coordinates of four others. They meet in the bucket of these: a fingerprint goes to its 15 choices of 4 blocks, under
the 16 coordinates of each choice. Inside a bucket rows are ordered by their first coordinate, only rows within LIMIT in it are paired, a pair is discarded
if its largest coordinate difference is over LIMIT, and the survivors are verified by XOR and bit count. (Coordinates are worked out again from the
fingerprint inside a bucket: the 8 bytes are sent, not the 48.)

A bucket gives one row per fingerprint, the smallest one it reaches there, never its pairs. A bucket of over ``WIDE`` fingerprints isn't brought into
one task at all: each of its fingerprints goes to the words one bit away in its free blocks (and to itself), and fingerprints that share such a
word are within 2 bits. These meet by word, 23 at most, so a crowd is dealt out over all tasks and the work stays linear. Both ways find every link.
Copies collapse before: only distinct fingerprints enter. Links are closed by
min-label propagation with pointer jumping over distinct fingerprints, each round written to shared storage.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other. Texts of 1
or 2 words hash as one shingle. Rows that repeat an id give a row each; a null id has a row, takes its
component's id, and never is that id unless all are null (then component_id is null). An empty table gives
an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, drop_rows, keyed, materialize, table, trimmed

LIMIT, BLOCKS, EACH, WIDE = 2, 6, 4, 2048
PIVOTS = 2 * EACH * BLOCKS
SEED, SHINGLE = 42, 3
_EDGES = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
_BLOCK = [((1 << (b - a)) - 1) << a for a, b in zip(_EDGES, _EDGES[1:], strict=False)]
_CHOICES = list(combinations(range(BLOCKS), BLOCKS - LIMIT))
#: By block, reference and whether the block's bits are turned over.
_REFS = np.array([[[r, r ^ m] for r in (xxhash.xxh64_intdigest(f"{b}:{k}", seed=SEED) for k in range(EACH))] for b, m in enumerate(_BLOCK)], np.uint64)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(words)
    joined = b" ".join(words)
    if n <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count, ones = n - SHINGLE + 1, np.zeros(64, np.int64)
    pairs = zip(starts[:count].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, count)
    for k in range(0, count, 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


@trimmed
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in b.columns[-1]), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints)], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number)."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n, over links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def coordinates(fps: np.ndarray) -> np.ndarray:
    """The table: distances of fingerprints to all pivots, one row each."""
    return np.bitwise_count(fps[:, None] ^ _REFS.reshape(1, -1)).astype(np.int8)


def bucket_keys(table: np.ndarray) -> np.ndarray:
    """For each row of the table its key in each choice of blocks: the 16 coordinates inside these blocks, four bits each."""
    pairs = table.reshape(-1, BLOCKS, EACH, 2).astype(np.int64)
    inside = (pairs[..., 0] - pairs[..., 1] + np.diff(_EDGES)[None, :, None]) // 2
    code = (inside << np.arange(0, 4 * EACH, 4)).sum(2).astype(np.uint64)
    width = np.uint64(4 * EACH)
    out = np.zeros((len(table), len(_CHOICES)), np.uint64)
    for k, blocks in enumerate(_CHOICES):
        for b in blocks:
            out[:, k] = out[:, k] << width | code[:, b]
    return out


def bucket_links(fps: np.ndarray) -> np.ndarray:
    """The smallest fingerprint that each of a bucket's distinct fingerprints reaches inside the bucket."""
    fps = np.sort(fps)
    n, coords = len(fps), coordinates(fps)
    order = np.argsort(coords[:, 0], kind="stable")
    last = np.searchsorted(coords[order, 0], coords[order, 0].astype(np.int64) + LIMIT, "right")
    left, right = [], []
    for i in range(n - 1):
        near = order[i + 1 : last[i]]
        if len(near):
            near = near[np.abs(coords[near] - coords[order[i]]).max(1) <= LIMIT]
            near = near[np.bitwise_count(fps[near] ^ fps[order[i]]) <= LIMIT]
            left.append(np.full(len(near), order[i]))
            right.append(near)
    a, b = (np.concatenate(x) if x else np.array([], np.int64) for x in (left, right))
    return fps[_roots(n, a, b)]


@trimmed
def _spread(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        keys = bucket_keys(coordinates(fps))
        yield pd.DataFrame({"choice": np.tile(np.arange(len(_CHOICES), dtype=np.int32), len(fps)), "key": keys.ravel().view(np.int64), "fp": np.repeat(fps, len(_CHOICES)).view(np.int64)})


@trimmed
def _link(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        out_a, out_b = [], []
        for arr in pdf["fps"]:
            fps = np.sort(np.asarray(arr, np.int64).view(np.uint64))
            low = bucket_links(fps)
            moved = low != fps
            out_a.append(fps[moved])
            out_b.append(low[moved])
        a, b = (np.concatenate(x).view(np.int64) if x else np.array([], np.int64) for x in (out_a, out_b))
        yield pd.DataFrame({"a": a, "b": b})


@trimmed
def _midpoints(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each fingerprint of a crowded bucket with itself and the words one bit away in its choice's free blocks."""
    turns = [np.array([0, *(1 << k for b in set(range(BLOCKS)) - set(blocks) for k in range(_EDGES[b], _EDGES[b + 1]))], np.uint64) for blocks in _CHOICES]
    for pdf in it:
        for choice, own in pdf.groupby("choice"):
            fps = own["fp"].to_numpy().view(np.uint64)
            words = fps[:, None] ^ turns[choice][None, :]
            yield pd.DataFrame({"fp": np.repeat(fps, words.shape[1]).view(np.int64), "word": words.ravel().view(np.int64)})


def links(distinct: DataFrame) -> DataFrame:
    """Links a-b between distinct fingerprints (column fp) whose closure is that of all pairs within LIMIT."""
    rows = materialize(distinct.mapInPandas(_spread, "choice int, key bigint, fp bigint"), "op6-buckets")
    wide = materialize(rows.groupBy("choice", "key").count().where(F.col("count") > WIDE).select("choice", "key"), "op6-wide")
    found = None
    if wide.isEmpty():
        narrow = rows
    else:
        narrow = rows.join(wide, ["choice", "key"], "left_anti")
        met = rows.join(wide, ["choice", "key"]).select("choice", "fp").mapInPandas(_midpoints, "fp bigint, word bigint").distinct()
        low = met.groupBy("word").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        found = low.select(F.explode("fps").alias("a"), "b").where("a <> b")
    buckets = narrow.groupBy("choice", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    near = buckets.select("fps").mapInPandas(_link, "a bigint, b bigint")
    return (near if found is None else near.union(found)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, root for every node of links (a, b): min-label propagation with pointer jumping, a node pair at a time."""
    label = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "op6-links")
    label = materialize(label, "op6-label")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("low")), "b").groupBy("a").agg(F.min("low").alias("low"))
        step = label.join(near, label["node"] == near["a"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("low", "root")).alias("root"))
        jump = step.select(F.col("node").alias("at"), F.col("root").alias("next"))
        new = materialize(step.join(jump, step["root"] == jump["at"]).select("node", "old", F.least("root", "next").alias("root")), "op6-label")
        if not new.where("old <> root").limit(1).count():
            return new.select("node", "root")
        label = new.select("node", "root")


def classes(prints: DataFrame) -> DataFrame:
    """fp, component_id for every distinct fingerprint of ``prints`` (doc_id, fp)."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "op6-nodes")
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return materialize(named.join(ids, "root").select("fp", "component_id"), "op6-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of ``docs``."""
    prints = materialize(fingerprints(docs), "op6-prints")
    return prints.join(classes(prints), "fp").select("doc_id", "fp", "component_id")


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each component stays: that of the smallest id, of several the first; a null id comes last."""
    rows = keyed(docs, "op6-rows")
    own = rows.select(F.col("__doc.doc_id").cast("bigint").alias("doc_id"), "__row", F.col("__doc.text").cast("string").alias("text"))
    prints = materialize(own.mapInArrow(_fingerprints, "doc_id bigint, __row bigint, fp bigint"), "op6-prints")
    # classes take the smallest of these in the place of the smallest id
    named = prints.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("doc_id"), "fp")
    found = prints.join(classes(named), "fp")
    return drop_rows(rows, found.where(F.col("__row") != F.col("component_id")["__row"]).select("__row"))
