"""Operator 4: removal of repeated 200-byte strings by a distributed suffix order.

Texts are UTF-8 bytes. A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere
else, in another document or in the same one. Matches never cross documents.

Tokens. A suffix is compared by tokens instead of single bytes, and only suffixes at anchors are ordered. Each string of LENGTH bytes picks an anchor:
the least of the 8-byte hashes that start at its bytes LEFT to LEFT+MIDDLE-1 (the first of equals). Equal
strings pick the same place. Consecutive strings with one anchor, and with it in the same half, form a run. The
leading token is the first four bytes of the suffix at the anchor as they are, so runs lie in the order of their suffixes' bytes, and then half a fingerprint of what
all strings of such a run share around the anchor (LEFT bytes before it and half of LENGTH after it, or half before and RIGHT
after); equal strings have equal leading tokens too. The run's second token is
the fingerprint of all its bytes: from the fifth byte on the order is that of fingerprints.

Round 1 orders all runs by (token, second token, document, position): splitters that Spark samples from all
of these leading tokens range-partition them, so even one token that a third of all runs hold is dealt over
many buckets; each bucket is sorted by multikey quicksort and neighbours are compared. Runs whose second
token equals a neighbour's repeat as a whole; runs with only the first token equal go on, with one run for
each second token beside them; runs at a bucket's edge whose neighbour is elsewhere go on too, as the next
round decides exactly. Round 2 orders the strings of what went on by two fingerprints (96 bits together) in the
same way and compares across bucket boundaries as well: the first and last row of each bucket, two rows for
each bucket, meet at the driver.

Memory: a bucket holds rows / spark.sql.shuffle.partitions; each document's own spans come together, nothing
else does.

Defined results: null text counts as empty. Texts under LENGTH bytes stay whole. Exact copies lose all bytes
if they have LENGTH or more. Rows that repeat an id give a row each. Null ids are kept. Empty tables give empty results.
Equal fingerprints are taken as equal strings. Documents are told apart by their rows' own numbers in the scan. The stage decodes what is left and drops the rest of characters cut
in two; it leaves a null text null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread
from .common import materialize, shuffle_partitions, sweep, trimmed

LENGTH, LEFT, MIDDLE = 200, 17, 150
RIGHT = LENGTH - (LEFT + MIDDLE - 1)
#: Window starts that are handled at once: bounds the arrays whatever a document's length.
SLICE = 1 << 19

_SPAN = SLICE + 2 * LENGTH + 16
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(0, 2**64, (2, 256), np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_tables: list = []


def _powers() -> list:
    """Powers of both bases and of their inverses modulo 2**64, made once in each process."""
    if not _tables:
        for base in _BASES:
            for x in (base, pow(base, -1, 1 << 64)):
                p = np.empty(_SPAN + 1, np.uint64)
                p[0] = 1
                p[1:] = np.multiply.accumulate(np.full(_SPAN, x, np.uint64))
                _tables.append(p)
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prints:
    """Fingerprints of ranges of some bytes, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.inverse = _powers()[2 * which + 1]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * _powers()[2 * which][: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def slice_runs(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(token, second token, first, last) of the runs of window starts in ``valid``; data: their bytes and those after."""
    n = len(valid)
    data = np.concatenate([data, np.zeros(max(0, n + LENGTH + 8 - len(data)), np.uint8)])
    words = np.ndarray((n + LEFT + MIDDLE,), "<u8", np.ascontiguousarray(data).data, 0, (1,))
    low = mix(words ^ np.uint64(0x5851F42D4C957F2D))
    low &= np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(len(low), dtype=np.uint64)
    width = 1
    while 2 * width <= MIDDLE:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (MIDDLE - width)], low[MIDDLE - width :])
    anchor = (low[LEFT : LEFT + n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.empty(n, bool)
    cut[0] = True
    late = anchor - np.arange(n) >= LENGTH // 2
    cut[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (late[1:] != late[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    at, prints = anchor[first], Prints(data)
    bounds = mix(((at - first).astype(np.uint64) << np.uint64(32)) | (at - last).astype(np.uint64))
    late = late[first]
    lead = prints.of(np.where(late, at - LENGTH // 2, at - LEFT), np.where(late, at + RIGHT, at + LENGTH - LENGTH // 2 + 1))
    ahead = words[at].byteswap() & np.uint64(0xFFFFFFFF00000000)  # the suffix's first four bytes, in their order
    key = ahead | (lead ^ late.astype(np.uint64)) >> np.uint64(32)
    return key ^ np.uint64(1 << 63), prints.of(first, last + LENGTH) ^ bounds, first, last  # signed numbers order like the bytes


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and the offsets of its rows."""
    column = pa.array(column.fill_null(""), pa.large_string()) if not pa.types.is_large_string(column.type) else column.fill_null("")
    column = pa.concat_arrays([column]) if column.offset == 0 else pa.array(column.to_pylist(), pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


@trimmed
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = _texts(b.column("text"))
        ids = b.column("dk").to_numpy(zero_copy_only=False)
        total = int(offsets[-1])
        for s in range(0, total, SLICE):
            e = min(total, s + SLICE)
            own = slice(int(np.searchsorted(offsets, s, "right")) - 1, int(np.searchsorted(offsets, e, "left")))
            first = offsets[:-1][own]
            steps = np.zeros(e - s + 1, np.int32)
            np.add.at(steps, np.clip(first - s, 0, e - s), 1)
            np.add.at(steps, np.clip(np.maximum(first, offsets[1:][own] - LENGTH + 1) - s, 0, e - s), -1)
            valid = np.cumsum(steps[:-1]) > 0
            if not valid.any():
                continue
            key, full, first, last = slice_runs(data[s : min(total, e + LENGTH + 8)], valid)
            doc = np.searchsorted(offsets, first + s, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(full.view(np.int64)), pa.array(ids[doc]), pa.array((first + s - offsets[doc]).astype(np.int32)), pa.array((last + s - offsets[doc]).astype(np.int32))],
                names=["key", "full", "dk", "lo", "hi"],
            )


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns. As in multikey quicksort, a level looks at one column only, and only rows that are equal so far go down to the next."""
    order = np.argsort(columns[0], kind="quicksort")
    value = columns[0][order]
    new = value[1:] != value[:-1]
    for c in columns[1:]:
        tied = np.zeros(len(order), bool)
        tied[1:] |= ~new
        tied[:-1] |= ~new
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.concatenate(([0], np.cumsum(new)))[at]
        sub = order[at]
        order[at] = sub[np.lexsort((c[sub], group))]
        value = c[order]
        new |= value[1:] != value[:-1]
    return order


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


RESOLVED, OPEN = 1, 2


@trimmed
def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column text as zstd frames, in which it is shuffled; null stays null."""
    press = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        at = b.schema.get_field_index("text")
        data = pa.array([None if (x := t.as_py()) is None else press(x.encode()) for t in b.column(at)], pa.binary())
        yield pa.RecordBatch.from_arrays([data if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)


def _bytes(cell: pa.Scalar, open_) -> bytes | None:
    data = cell.as_py()
    return None if data is None else open_(data)


def pressed(docs: DataFrame) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_press, schema)


@trimmed
def _compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = _whole(batches)
    if t is None:
        return
    cols = {n: t.column(n).to_numpy() for n in t.column_names}
    order = multikey_quicksort([cols[n] for n in ("key", "full", "dk", "lo")])
    key, full = cols["key"][order], cols["full"][order]
    n = len(order)
    same_key, same_full = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # of each row with the row before
    same_key[1:n] = key[1:] == key[:-1]
    same_full[1:n] = same_key[1:n] & (full[1:] == full[:-1])
    start = np.flatnonzero(~same_key[:n])
    group = np.cumsum(~same_key[:n]) - 1
    kinds = np.add.reduceat((~same_full[:n]).astype(np.int64), start)
    kinds[[0, -1]] += 1  # the rest of these groups may be in the next bucket
    many = (kinds > 1)[group]
    repeated = same_full[:n] | same_full[1:]
    state = np.where(repeated, RESOLVED, 0)
    state |= np.where(many & ~same_full[:n], OPEN, 0)
    keep = (same_key[:n] | same_key[1:] | (group == 0) | (group == group[-1])) & (state > 0)
    at = order[keep]
    yield pa.RecordBatch.from_arrays([pa.array(cols["dk"][at]), pa.array(cols["lo"][at]), pa.array(cols["hi"][at]), pa.array(state[keep].astype(np.int32))], names=["dk", "lo", "hi", "state"])


@trimmed
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor().decompress
    for b in batches:
        out: list[list] = [[], [], [], []]
        size = 0
        for dk, text, los, his, states in zip(b.column("dk").to_pylist(), b.column("text"), *(b.column(c).to_pylist() for c in ("los", "his", "states")), strict=True):
            data = np.frombuffer(_bytes(text, open_) or b"", np.uint8)
            for s in range(0, len(data), SLICE):
                spots = [np.arange(max(lo, s), min(hi + 1, s + SLICE)) * 2 + (state != OPEN) for lo, hi, state in set(zip(los, his, states, strict=True)) if lo < s + SLICE and hi >= s]
                p = np.unique(np.concatenate(spots)) if spots else np.zeros(0, np.int64)
                p, known = p >> 1, p & 1
                fits = p + LENGTH <= len(data)
                p, known = p[fits], known[fits]
                if not len(p):
                    continue
                a, z = int(p[0]), int(p[-1]) + LENGTH
                part = data[a:z]
                out[0].append(Prints(part).of(p - a, p - a + LENGTH).view(np.int64))
                out[1].append((Prints(part, 1).of(p - a, p - a + LENGTH) >> np.uint64(34)).astype(np.int32) * 2 + known.astype(np.int32))
                out[2].append(np.full(len(p), dk, np.int64))
                out[3].append(p.astype(np.int32))
                size += len(p)
                if size > SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["h", "g", "dk", "p"])
                    out, size = [[], [], [], []], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["h", "g", "dk", "p"])


@trimmed
def _compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = _whole(batches)
    if t is None:
        return
    h, g, dk, p = (t.column(n).to_numpy() for n in ("h", "g", "dk", "p"))
    order = multikey_quicksort([h, g >> 1, dk, p])
    h, g, dk, p = h[order], g[order], dk[order], p[order]
    known, g = g & 1, g >> 1  # the last bit only tells that the string's run is known to repeat
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    found = (same[1:] | same[:-1]) & (known == 0)
    edge = np.zeros(len(h), np.int32)
    edge[[0, -1]] = TaskContext.get().partitionId() + 1
    keep = found | (edge > 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(dk[keep]), pa.array(p[keep]), pa.array(found[keep]), pa.array(edge[keep]), pa.array(h[keep], mask=edge[keep] == 0), pa.array(g[keep], mask=edge[keep] == 0)],
        names=["dk", "p", "found", "edge", "h", "g"],
    )


def _across(found: DataFrame) -> list[tuple[int, int]]:
    """(dk, p) of the rows at bucket boundaries that equal the row across: two rows for each bucket are looked at."""
    rows = sorted((r.edge, r.h, r.g, r.dk, r.p) for r in found.where("edge > 0").collect())
    pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] != b[0] and a[1:3] == b[1:3]]
    return [(x[3], x[4]) for pair in pairs for x in pair]


def _merge(los: list[int], his: list[int]) -> list[tuple[int, int]]:
    """Removed byte runs [a, b) from ranges of window starts."""
    out: list[list[int]] = []
    for lo, hi in sorted(zip(los, his, strict=True)):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + LENGTH)
        else:
            out.append([lo, hi + LENGTH])
    return [(a, b) for a, b in out]


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with dk, the row's number in the scan. docs must be a plain scan of files: every scan of these gives a row the same number."""
    return docs.withColumn("dk", F.monotonically_increasing_id())


def repeated_starts(docs: DataFrame) -> DataFrame:
    """dk, los, his: for each document with any, the ranges of starts of strings that start elsewhere too. docs: dk, text."""
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    runs = docs.mapInArrow(_runs, "key bigint, full bigint, dk bigint, lo int, hi int")
    first = materialize(runs.repartitionByRange(n, "key", "full", "dk", "lo").mapInArrow(_compare_runs, "dk bigint, lo int, hi int, state int"), "op4-runs")
    sweep(spark)  # a round's shuffles go before the next one's come
    still = first.where(F.col("state") >= OPEN).groupBy("dk").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"), F.collect_list("state").alias("states"))
    windows = pressed(docs).join(still, "dk").mapInArrow(_windows, "h bigint, g int, dk bigint, p int")
    second = materialize(windows.repartitionByRange(n, "h", (F.col("g") / 2).cast("int"), "dk", "p").mapInArrow(_compare_windows, "dk bigint, p int, found boolean, edge int, h bigint, g int"), "op4-windows")
    sweep(spark)
    across = spark.createDataFrame(_across(second), "dk bigint, lo int")
    starts = first.where(F.col("state") != OPEN).select("dk", "lo", "hi").union(second.where("found").select("dk", "p", "p")).union(across.select("dk", "lo", "lo"))
    return starts.groupBy("dk").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (a plain scan), the text as zstd frames, and the columns los, his (null: nothing to remove)."""
    docs = numbered(docs)
    return pressed(spread(docs)).join(repeated_starts(spread(docs.select("dk", "text"))), "dk", "left")


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)], strict=True))


@trimmed
def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor().decompress
    for b in batches:
        rows = []
        for doc, text, los, his in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            data, spans = _bytes(text, open_) or b"", _merge(los or [], his or [])
            rows.append((doc, len(data), sum(y - x for x, y in spans), len(spans), hashlib.sha256(_cut(data, spans)).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "text", "los", "his")
    return found.mapInArrow(_report, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` only reads columns of files: no other operator stands in its plan."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project" and plan.deterministic():
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


@trimmed
def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor().decompress
    for b in batches:
        texts = [None if (x := _bytes(t, open_)) is None else _cut(x, _merge(lo or [], hi or [])).decode("utf-8", "ignore") for t, lo, hi in zip(b.column("text"), b.column("los").to_pylist(), b.column("his").to_pylist(), strict=True)]
        at = b.schema.get_field_index("text")
        keep = [i for i, n in enumerate(b.schema.names) if n not in ("los", "his")]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else b.column(i) for i in keep], names=[b.schema.names[i] for i in keep])


def deduplicate(docs: DataFrame, scan: bool = False) -> DataFrame:
    """``docs`` with the repeated strings cut from text, and n_chars (if there is such a column) counted again. What isn't a plain ``scan`` of files is written first."""
    docs = docs if scan else materialize(docs, "op4-docs")
    schema = docs.schema
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"c{i}") for i, c in enumerate(names)))
    out = with_spans(own).drop("dk").mapInArrow(_shorten, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema))
    out = out.toDF(*names)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's documents are a plain scan of what the stage before wrote; anything else is written first, so that rows can be numbered."""
    return deduplicate(docs, scan=is_scan(docs))


#: The contract in SQL: strings are compared as such and counted over all starts.
ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
q AS (SELECT r, o, array_slice(b, o + 1, o + 1223) AS c FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199, 1024)) AS o FROM d)),
p AS (SELECT r, o, c, unnest(range(1, least(1024, octet_length(c) - 199) + 1)) AS p FROM q),
n AS (SELECT r, o + p AS p, count(*) OVER (PARTITION BY array_slice(c, p, p + 199)) AS n FROM p),
g AS (SELECT r, p, p > lag(p, 1, -200) OVER (PARTITION BY r ORDER BY p) + 200 AS new FROM n WHERE n > 1),
k AS (SELECT r, p, count_if(new) OVER (PARTITION BY r ORDER BY p) AS k FROM g),
s AS (SELECT r, min(p) AS a, max(p) + 200 AS z, 1 AS one FROM k GROUP BY r, k
      UNION ALL SELECT r, octet_length(b) + 1, octet_length(b) + 1, 0 FROM d),
c AS (SELECT r, a, z, one, lag(z, 1, 1) OVER (PARTITION BY r ORDER BY a, z) AS f FROM s)
SELECT any_value(doc_id) AS doc_id, any_value(octet_length(b))::BIGINT AS n_bytes, sum(z - a)::BIGINT AS n_removed, sum(one)::BIGINT AS n_spans,
       sha256(unhex(string_agg(CASE WHEN a > f THEN hex(array_slice(b, f, a - 1)) ELSE '' END, '' ORDER BY a, z))) AS kept_sha256
FROM c JOIN d USING (r) GROUP BY r
"""
