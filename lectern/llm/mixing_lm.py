"""Operator 2: language-model scores by online logistic context mixing.

Tokens are the words of the text (A-Z lower-cased) and one end for each document. A token is coded as binary decisions, in two parts:

* its form: words of up to ``SHORT`` bytes are hashed as a whole and longer ones by their last ``TAIL`` bytes into
  ``FORMS`` forms (the end is one of its own), and the form's path in a Huffman tree over the training counts is coded bit by bit;
* the word among those of its form: by its training count, or, after an escape with the weight of the form's words
  seen once, spelled byte by byte and bit by bit, closed by a space.

Each bit of a path has several predictors. For forms: the counts without context, and those after the last form, the one before it, the third
last, and the last two hashed together. For spelling: without context, and after the last 1 to 4 bytes of the word. Contexts are hashed into rows of
tables of counts, whose size is fixed (2**22 cells each). A predictor is the log-odds of its counts, shrunk to those without context; the mixer
adds them up with weights picked by a gate (the depth in the tree and the place in the document or word), and the logistic function of the sum
is the bit's probability.

Weights are fitted on an eighth of the training documents (and of the words) by hash, whose counts are kept out of the tables of contexts: two Newton steps
over exact sums. From there each document refines them online as it is read: after 64, 128, 256, ... tokens (``LONGEST`` at most)
its own weights move along the gradient of what was coded. A last stage refines the words' probabilities: a Bayesian mixture over ``SHARES`` of
the words seen so far in the document, which follows what predicted best up to there.

Every decision's two probabilities add up to 1, and the words of a form and its escape do, so all texts together have a probability of at most
1. The statistics are sums over all training documents and a document's score depends on them and its own text alone, not on how rows are dealt out.

How it runs. A pass over the documents writes blocks: token numbers of whole documents and the block's own list of words with their forms. The lists, not the
tokens, are shuffled by word; a shard adds up a word's counts and sends them to each block that holds it. Counts of words grow with the
corpus; they are never sent to the driver or broadcast. The tables of contexts are of fixed size (8 of 2**22 cells, a byte each) and are broadcast.

Defined results: null text counts as empty: its tokens are one end. A null id counts as an empty id. Rows that repeat an id
give a row each. Without training documents base_score and score come from empty counts. bits_per_byte is null for
empty texts. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, materialize, shuffle_partitions, table

FORMS, SHORT, TAIL, BLOCK = 2048, 4, 3, 500_000
END = FORMS - 1
CELLS, CHUNK = 1 << 22, 1 << 16
SHARES = (0.0, 0.02, 0.08, 0.2, 0.45)
#: One of so many training documents, and words, fits the weights instead of filling tables of contexts.
FOLD = 8
#: Counts of the shrinkage to the log-odds without context; steps of the quantised log-odds; first and longest stretch between refinements; their rate.
SHRINK, QUANT, FIRST, LONGEST, RATE = 2.0, 16.0, 64, 8192, 0.002
#: Tokens whose bits are held at once.
SLICE = 1 << 15
CONTEXTS, INPUTS = 4, 6
_UPPER = np.triu_indices(INPUTS)
#: Bits of a path up to which the odds of one token, e**20 a bit at most, can be multiplied.
DEEPEST = 34
LN10 = float(np.log(10.0))


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


# Blocks: whole documents as token numbers

_BLOCK = "block bigint, n_words int, n_ids int, words binary, shapes binary, trained binary, ids binary, doc_id array<bigint>, role array<int>, size array<int>, n_bytes array<bigint>"
HELD, TABLES, WEIGHTS = 0, 1, 2


class _Block:
    def __init__(self, number: int):
        self.number, self.known = number, {}
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc: int | None, role: int, text: str | None) -> None:
        data = (text or "").encode()
        words, known = data.translate(LOWER).split(), self.known
        self.ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        self.docs.append((doc, role, len(words), len(data)))
        self.size += len(words) + 1

    def row(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        doc, role, size, n_bytes = (list(x) for x in zip(*self.docs, strict=True))
        learned = np.repeat(np.array(role) != HELD, size)
        trained = np.bincount(ids[learned], minlength=len(self.known)).astype(np.int32)
        cols = [self.number, len(self.known), len(ids), b" ".join(self.known), _pack(forms(list(self.known)).astype(np.int16)), _pack(trained), _pack(ids), doc, role, size, n_bytes]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block(TaskContext.get().partitionId() << 32)
    for b in batches:
        for doc, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            block.add(doc, role, text.as_py())
            if block.size >= BLOCK:
                yield block.row()
                block = _Block(block.number + 1)
    if block.docs:
        yield block.row()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(name)[k].as_py() for name in b.schema.names}


def _split(words: bytes, n: int) -> list[bytes]:
    return words.split(b" ") if n else []


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        names, counts = _split(r["words"], r["n_words"]), _unpack(r["trained"], r["n_words"], np.int32)
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array(np.full(len(part), r["block"])), pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.array(counts[k : k + len(part)])],
                names=["word", "block", "at", "n"],
            )


# Contexts


def form(word: bytes) -> int:
    if len(word) <= SHORT:
        return crc32(word) % (FORMS // 2)
    return FORMS // 2 + crc32(word[-TAIL:]) % (FORMS // 2 - 1)


def forms(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(form, words), np.int64, len(words))


def _hashed(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def form_contexts(leaf: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows of the four contexts of each token of documents that lie end to end (sizes: with their ends), and its place in its document."""
    place = np.arange(len(leaf)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    back = []
    for k in (1, 2, 3):
        before = np.full(len(leaf), END, np.int64)
        before[k:] = leaf[:-k]
        before[place < k] = END
        back.append(before)
    return [*back, _hashed(back[0] * FORMS + back[1], 11)], place


def byte_contexts(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Bytes of the words and their closing spaces end to end, the rows of the four contexts, the place in the word, and the sizes."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows, context = [], np.zeros(len(flat), np.int64)
    for k in (1, 2, 3, 4):
        before = np.zeros(len(flat), np.int64)
        before[k:] = flat[:-k] + 1
        before[place < k] = 0
        context = context * 257 + before
        rows.append(_hashed(context * 4 + k - 1, 14))
    return flat, rows, place, sizes


def _in_fold(word: bytes) -> bool:
    return crc32(word, 1) % FOLD == 0


def _pieces(words: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of words of at most so many bytes, longer words on their own."""
    part, size = [], 0
    for w in words:
        if part and size + len(w) > most:
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w) + 1
    if part:
        yield part


# Trees and tables


class Tree:
    """A binary code over leaves: for each leaf the nodes and bits of its path, and for each node the leaves on both sides."""

    def __init__(self, weights: np.ndarray, huffman: bool = True):
        k = len(weights)
        left, right = [0] * (k - 1), [0] * (k - 1)
        if huffman:
            heap = [(float(w), i) for i, w in enumerate(weights)]
            heapq.heapify(heap)
            for node in range(k - 1):
                (a, left[node]), (b, right[node]) = heapq.heappop(heap), heapq.heappop(heap)
                heapq.heappush(heap, (a + b, k + node))
        else:  # a complete tree in the order of the leaves
            layer, node = list(range(k)), 0
            while len(layer) > 1:
                new = []
                for a, b in zip(layer[::2], layer[1::2], strict=True):
                    left[node], right[node] = a, b
                    new.append(k + node)
                    node += 1
                layer = new
        self.order, self.spans = np.zeros(k, np.int64), np.zeros((k - 1, 3), np.int64)
        paths: list = [None] * k
        stack, at = [(2 * k - 2, (), ())], 0
        first: dict[int, int] = {}
        while stack:
            x, nodes, bits = stack.pop()
            if x < k:
                self.order[at], paths[x] = x, (nodes, bits)
                at += 1
                continue
            first[x - k] = at
            stack.append((right[x - k], (*nodes, x - k), (*bits, 1)))
            stack.append((left[x - k], (*nodes, x - k), (*bits, 0)))
        size = [1] * k + [0] * (k - 1)
        for node in range(k - 1):
            size[k + node] = size[left[node]] + size[right[node]]
        for node, a in first.items():
            self.spans[node] = a, a + size[left[node]], a + size[k + node]
        self.depth = np.array([len(n) for n, _ in paths], np.int64)
        self.start = np.cumsum(self.depth) - self.depth
        self.nodes = np.array([x for n, _ in paths for x in n], np.int32)
        self.bits = np.array([x for _, b in paths for x in b], np.int8)
        self.level = np.array([j for n, _ in paths for j in range(len(n))], np.int32)

    def counts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of counts by leaf: the counts of 0 and 1 at each node."""
        sums = np.zeros((len(rows), len(self.order) + 1))
        np.cumsum(rows[:, self.order], 1, out=sums[:, 1:])
        a, m, b = (sums[:, self.spans[:, j]] for j in range(3))
        return m - a, b - m

    def plain(self, weights: np.ndarray) -> np.ndarray:
        """Log-odds of 1 at each node without context."""
        n0, n1 = self.counts(weights[None, :])
        return np.log((n1[0] + 0.05) / (n0[0] + 0.05)).astype(np.float32)

    def table(self, rows: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Log-odds of rows of counts beyond those without context, in steps of 1 / QUANT; a row has a place for each leaf."""
        n0, n1 = self.counts(rows)
        p = 1 / (1 + np.exp(-plain.astype(float)))
        x = np.log((n1 + SHRINK * p) / (n0 + SHRINK * (1 - p))) - plain
        out = np.zeros(rows.shape, np.int8)
        out[:, :-1] = np.clip(np.rint(x * QUANT), -127, 127)
        return out


class Mixer:
    """The bits of a tree's paths, predicted from rows of tables by gated weights."""

    GATES = 36

    def __init__(self, tree: Tree, plain: np.ndarray, tables: np.ndarray, weights: np.ndarray | None = None):
        self.tree, self.plain, self.tables = tree, plain, tables
        if weights is None:
            weights = np.tile(np.array([1.0, 0.5, 0.3, 0.2, 0.2, 0.0]), (self.GATES, 1))
        self.weights = weights.astype(np.float32)

    def __getstate__(self) -> dict:
        """Broadcasts lie on the disks of the driver and of every executor: the tables, mostly empty cells, are pressed in them."""
        return self.__dict__ | {"tables": (self.tables.shape, _pack(self.tables))}

    def __setstate__(self, state: dict) -> None:
        shape, data = state["tables"]
        self.__dict__.update(state, tables=_unpack(data, int(np.prod(shape)), np.int8).reshape(shape))

    def weighed(self, weights: np.ndarray) -> Mixer:
        return Mixer(self.tree, self.plain, self.tables, weights)

    def bits(self, leaf: np.ndarray, rows: list[np.ndarray], place: np.ndarray) -> tuple:
        """(first bit of each token, token of each bit, sign, gate, inputs)."""
        t, k = self.tree, len(self.tree.order)
        n = t.depth[leaf]
        first = np.cumsum(n) - n
        at = np.repeat(t.start[leaf] - first, n)
        at += np.arange(len(at))
        node = t.nodes[at]
        token = np.repeat(np.arange(len(leaf)), n)
        gate = np.minimum(t.level[at], 11) * 3 + np.repeat(np.minimum(place, 2), n)
        x = [self.plain[node]]
        for j in range(CONTEXTS):
            spot = np.repeat(rows[j] * k, n)
            spot += node
            x.append(self.tables[j].take(spot) * np.float32(1 / QUANT))
        return first, token, t.bits[at].astype(np.float32) * 2 - 1, gate, x

    @staticmethod
    def mix(x: list[np.ndarray], w: np.ndarray, cell: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The odds against each bit. w: inputs x cells."""
        z = w[INPUTS - 1].take(cell)
        for j, v in enumerate(x):
            z += w[j].take(cell) * v
        np.clip(z, -20, 20, out=z)
        z *= -sign
        return np.exp(z, out=z)

    def paths(self, odds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """ln of the probability of each token from the odds against its bits: a logarithm a token, as long as no product can overflow."""
        if self.tree.depth.max() > DEEPEST:
            return -np.add.reduceat(np.log1p(odds.astype(float)), first)
        return -np.log(np.multiply.reduceat(np.add(odds, 1.0, dtype=float), first))

    def sums(self, leaf: np.ndarray, rows: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """Sums of a Newton step for the weights of each gate: gradient and curvature."""
        out = np.zeros((self.GATES, INPUTS + INPUTS * (INPUTS + 1) // 2))
        for a in range(0, len(leaf), SLICE):
            own = slice(a, a + SLICE)
            first, token, sign, gate, x = self.bits(leaf[own], [r[own] for r in rows], place[own])
            if not len(sign):
                continue
            odds = self.mix(x, np.ascontiguousarray(self.weights.T), gate, sign)
            p = odds / (1 + odds)
            order = np.argsort(gate.astype(np.uint8), kind="stable")
            cuts = np.searchsorted(gate[order], np.arange(self.GATES + 1))
            miss, curve = (sign * p)[order].astype(float), (p * (1 - p))[order].astype(float)
            x = np.stack([*(v[order] for v in x), np.ones(len(sign), np.float32)]).astype(float)
            for g in np.flatnonzero(np.diff(cuts)):
                b, e = cuts[g], cuts[g + 1]
                out[g, :INPUTS] += x[:, b:e] @ miss[b:e]
                out[g, INPUTS:] += ((x[:, b:e] * curve[b:e]) @ x[:, b:e].T)[_UPPER]
        return out

    def step(self, sums: np.ndarray) -> np.ndarray:
        """The weights after a Newton step, to six digits; a gate with little evidence stays close to where it was."""
        new = self.weights.astype(float).copy()
        for g in range(self.GATES):
            h, at = np.zeros((INPUTS, INPUTS)), INPUTS
            for i in range(INPUTS):
                for j in range(i, INPUTS):
                    h[i, j] = h[j, i] = sums[g, at]
                    at += 1
            move = np.linalg.solve(h + 5.0 * np.eye(INPUTS), sums[g, :INPUTS])
            new[g] += move * min(1.0, 1.0 / max(np.abs(move).max(), 1e-9))
        return np.round(new, 6)

    def spell(self, leaf: np.ndarray, rows: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """ln of the probability of each token by the fitted weights."""
        out, w = np.zeros(len(leaf)), np.ascontiguousarray(self.weights.T)
        for a in range(0, len(leaf), SLICE):
            own = slice(a, a + SLICE)
            first, _, sign, gate, x = self.bits(leaf[own], [r[own] for r in rows], place[own])
            out[own] = self.paths(self.mix(x, w, gate, sign), first)
        return out

    def online(self, leaf: np.ndarray, rows: list[np.ndarray], place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """ln of the probability of each token; every document refines its own weights as it goes."""
        out, starts = np.zeros(len(leaf)), np.cumsum(sizes) - sizes
        alive, done, length = np.arange(len(sizes)), 0, FIRST
        w = {}  # weights of the documents that go on, inputs x gates
        base = np.ascontiguousarray(self.weights.T)
        while len(alive):
            many = np.minimum(sizes[alive] - done, length)
            cuts = np.searchsorted(np.cumsum(many), np.arange(SLICE, int(many.sum()) + SLICE, SLICE), "right")
            for docs in np.split(np.arange(len(alive)), np.unique(cuts[cuts < len(alive)])):
                if not len(docs):
                    continue
                own, n = alive[docs], many[docs]
                at = np.repeat(starts[own] + done - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                which = np.repeat(np.arange(len(own)), n)
                first, token, sign, gate, x = self.bits(leaf[at], [r[at] for r in rows], place[at])
                held = np.concatenate([w[int(d)] if int(d) in w else base for d in own], 1)
                cell = gate + which[token] * self.GATES
                odds = self.mix(x, held, cell, sign)
                out[at] = self.paths(odds, first)
                more = sizes[own] > done + n
                if more.any():
                    pick = np.flatnonzero(more[which][token])
                    cell, miss = cell[pick], odds[pick]
                    miss = sign[pick] * (miss / (1 + miss))
                    total = np.bincount(cell, minlength=held.shape[1])
                    pace = RATE / np.maximum(1.0, total / 256.0)
                    for j in range(INPUTS):
                        pull = miss if j == INPUTS - 1 else miss * x[j][pick]
                        held[j] += pace * np.bincount(cell, pull, held.shape[1])
                    for k in np.flatnonzero(more):
                        w[int(own[k])] = held[:, k * self.GATES : (k + 1) * self.GATES].copy()
                for d in own[~more]:
                    w.pop(int(d), None)
            done += length
            alive = alive[sizes[alive] > done]
            length = min(2 * length, LONGEST)
        return out


# Shards: all entries of some words

_PART = "kind int, key bigint, n int, a binary, b binary"
COUNTS, TOTALS, LETTERS, NAMES = 0, 1, 2, 3


def _part(kind: int, key: int, n: int, a: bytes, b: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([key], pa.int64()), pa.array([n], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=[x.split()[0] for x in _PART.split(", ")])


def _cells(kind: int, number: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The filled cells of a table, by chunk."""
    filled = np.flatnonzero(counts)
    for own in np.split(filled, np.searchsorted(filled, np.arange(CHUNK, CELLS, CHUNK))):
        if len(own):
            yield _part(kind, number * CELLS + int(own[0]) // CHUNK * CHUNK, len(own), _pack((own % CHUNK).astype(np.uint16)), _pack(counts[own].astype(np.int64)))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    del got
    coded = t.column("word").combine_chunks().dictionary_encode()
    code, n = coded.indices.to_numpy(), t.column("n").to_numpy()
    counts = np.bincount(code, n, len(coded.dictionary)).astype(np.int64)
    block, at = t.column("block").to_numpy(), t.column("at").to_numpy()
    order = np.argsort(block, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        yield _part(COUNTS, int(block[own[0]]), len(own), _pack(at[own]), _pack(counts[code[own]]))
    del t, block, at, order, code, n
    names = [w for w, c in zip(coded.dictionary.to_pylist(), counts, strict=True) if c]
    counts = counts[counts > 0]
    shape = forms(names)
    totals = [np.bincount(shape, counts, FORMS), np.bincount(shape[counts == 1], minlength=FORMS)]
    letters, tables = np.zeros(256), np.zeros((CONTEXTS, CELLS), np.int32)
    for part in _pieces([w for w in names if not _in_fold(w)]):
        flat, rows, *_ = byte_contexts(part)
        letters += np.bincount(flat, minlength=256)
        for j, r in enumerate(rows):
            tables[j] += np.bincount(r * 256 + flat, minlength=CELLS).astype(np.int32)
    yield _part(TOTALS, len(names), int(counts.sum() > 0), _pack(np.concatenate([*totals, letters]).astype(np.int64)))
    for j in range(CONTEXTS):
        yield from _cells(LETTERS, j, tables[j])
    fold = [w for w in names if _in_fold(w)]
    if fold:
        yield _part(NAMES, 0, len(fold), b" ".join(fold))


def _shapes(r: dict) -> np.ndarray:
    """Forms of a block's words, as its row holds them."""
    return _unpack(r["shapes"], r["n_words"], np.int16).astype(np.int64)


def _stream(r: dict, which: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forms of the tokens of a block's documents (of one role), the numbers of their words (-1: the end), and the documents' sizes."""
    shape = np.append(_shapes(r), END)
    ids, sizes = _unpack(r["ids"], r["n_ids"], np.int32), np.array(r["size"], np.int64)
    tokens = np.full(len(ids) + len(sizes), -1, np.int64)
    spot = np.ones(len(tokens), bool)
    spot[np.cumsum(sizes + 1) - 1] = False
    tokens[spot] = ids
    if which is not None:
        mine = np.array(r["role"]) == which
        tokens, sizes = tokens[np.repeat(mine, sizes + 1)], sizes[mine]
    return shape[tokens], tokens, sizes + 1


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = np.zeros((CONTEXTS, CELLS), np.int32)
    for r in _rows(batches):
        leaf, _, sizes = _stream(r, TABLES)
        if len(leaf):
            for j, row in enumerate(form_contexts(leaf, sizes)[0]):
                tables[j] += np.bincount(row * FORMS + leaf, minlength=CELLS).astype(np.int32)
    for j in range(CONTEXTS):
        yield from _cells(COUNTS, j, tables[j])


def _added(cells: DataFrame, tree: Tree, plain: np.ndarray) -> np.ndarray:
    """The quantised tables (contexts x cells) from partial counts of their cells; chunks are added up apart and are all the driver gets."""
    spark = cells.sparkSession
    sent = spark.sparkContext.broadcast((tree, plain))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tree, plain), sums = sent.value, {}
        for r in _rows(batches):
            own = sums.setdefault(r["key"], np.zeros(CHUNK, np.int64))
            own[_unpack(r["a"], r["n"], np.uint16)] += _unpack(r["b"], r["n"], np.int64)
        for key, own in sums.items():
            made = tree.table(own.reshape(-1, len(tree.order)).astype(float), plain)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([_pack(made)], pa.binary())], names=["key", "made"])

    out = np.zeros(CONTEXTS * CELLS, np.int8)
    for r in cells.select("key", "n", "a", "b").repartition(shuffle_partitions(spark), "key").mapInArrow(add, "key bigint, made binary").toLocalIterator():
        out[r.key : r.key + CHUNK] = _unpack(r.made, CHUNK, np.int8)
    return out.reshape(CONTEXTS, CELLS)


def _fit(mixer: Mixer, rows: DataFrame, read, rounds: int = 2) -> Mixer:
    """Newton steps over all rows; ``read`` gives (leaf, contexts, place) of a row. Sums are added up before the driver sees them. The tables are sent once."""
    sent = rows.sparkSession.sparkContext.broadcast(mixer)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], weights=mixer.weights) -> Iterator[pa.RecordBatch]:
            total, own = np.zeros((Mixer.GATES, INPUTS + INPUTS * (INPUTS + 1) // 2)), sent.value.weighed(weights)
            for r in _rows(batches):
                for leaf, contexts, place in read(r):
                    total += own.sums(leaf, contexts, place)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

        sums = np.zeros((Mixer.GATES, INPUTS + INPUTS * (INPUTS + 1) // 2)).ravel()
        for r in rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
            sums[r["cell"]] = r["value"]
        mixer = mixer.weighed(mixer.step(sums.reshape(Mixer.GATES, -1)))
    sent.destroy()
    return mixer


def _read_forms(r: dict) -> Iterator[tuple]:
    leaf, _, sizes = _stream(r, WEIGHTS)
    if len(leaf):
        yield (leaf, *form_contexts(leaf, sizes))


def _read_names(r: dict) -> Iterator[tuple]:
    for part in _pieces(_split(r["a"], r["n"])):
        flat, rows, place, _ = byte_contexts(part)
        yield flat, rows, place


class Model:
    """What a text is scored by: the mixers of forms and letters, and for each form the training tokens and the words seen once."""

    def __init__(self, words: Mixer, letters: Mixer, totals: np.ndarray, once: np.ndarray):
        self.words, self.letters, self.totals, self.escape = words, letters, totals, once + 0.5

    def inside(self, names: list[bytes], counts: np.ndarray, shape: np.ndarray | None = None) -> np.ndarray:
        """ln of the probability of each word among those of its form (shape, if that is known)."""
        shape = forms(names) if shape is None else shape
        whole = self.totals[shape] + self.escape[shape]
        out = np.log(np.maximum(counts, 1) / whole)
        new = np.flatnonzero(counts == 0)
        out[new] = np.log(self.escape[shape[new]] / whole[new])
        at = 0
        for part in _pieces([names[k] for k in new]):
            flat, rows, place, sizes = byte_contexts(part)
            out[new[at : at + len(part)]] += np.add.reduceat(self.letters.spell(flat, rows, place), np.cumsum(sizes) - sizes)
            at += len(part)
        return out

    def tokens(self, leaf: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """ln of the probability of each token of documents that lie end to end; inside: that of each word in its form."""
        rows, place = form_contexts(leaf, sizes)
        return self.words.online(leaf, rows, place, sizes) + np.append(inside, 0.0)[tokens]


def refine(tokens: np.ndarray, sizes: np.ndarray, ln: np.ndarray) -> np.ndarray:
    """log10 probability of each document: the mixture over SHARES of the document's own words so far (its end stays as it was)."""
    out = np.zeros((len(SHARES), len(sizes)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    out += np.bincount(doc[tokens < 0], ln[tokens < 0], len(sizes))
    word = np.flatnonzero(tokens >= 0)
    if len(word):
        key = doc[word] * (int(tokens.max()) + 1) + tokens[word]
        order = np.argsort(key, kind="stable")
        first = np.ones(len(word), bool)
        first[1:] = key[order][1:] != key[order][:-1]
        at = np.arange(len(word))
        before = np.empty(len(word))
        before[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        place = word - starts[doc[word]]
        own, p = before / np.maximum(place, 1), np.exp(ln[word])
        begun = place > 0
        for k, share in enumerate(SHARES):
            mixed = np.where(begun, (1 - share) * p + share * own, p)
            out[k] += np.bincount(doc[word], np.log(np.maximum(mixed, 1e-300)), len(sizes)) + np.where(sizes > 1, np.log(1 - share), 0.0)
    best = out.max(0)
    return (best + np.log(np.exp(out - best).mean(0))) / LN10


_RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def learn(docs: DataFrame) -> tuple[DataFrame, DataFrame, Model, int, int, int]:
    """Blocks, counts of their words, the model, and the training documents, tokens and distinct tokens of ``docs`` (doc_id, held_out, text)."""
    spark = docs.sparkSession
    role = F.when(F.col("held_out"), HELD).when(F.pmod(F.xxhash64("text"), F.lit(FOLD)) == 0, WEIGHTS).otherwise(TABLES)
    blocks = materialize(docs.select(F.col("doc_id").cast("bigint"), role.alias("role"), F.col("text").cast("string").alias("text")).mapInArrow(_blocks, _BLOCK), "op2-blocks")
    entries = blocks.select("block", "n_words", "words", "trained").mapInArrow(_entries, "word binary, block bigint, at int, n int")
    parts = materialize(entries.repartition(shuffle_partitions(spark), "word").mapInArrow(_shards, _PART), "op2-words")
    ends = int(blocks.agg(F.sum(F.size(F.filter("role", lambda x: x != HELD)))).first()[0] or 0)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * FORMS + 257, np.int64)
        for r in _rows(batches):
            sums[:-1] += _unpack(r["a"], 2 * FORMS + 256, np.int64)
            sums[-1] += r["key"]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["cell", "value"])

    sums = np.zeros(2 * FORMS + 257, np.int64)
    for r in parts.where(F.col("kind") == TOTALS).select("key", "a").mapInArrow(total, "cell int, value bigint").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        sums[r["cell"]] = r["value"]
    counts, once, letters, known = sums[:FORMS].copy(), sums[FORMS : 2 * FORMS], sums[2 * FORMS : -1], int(sums[-1])
    tokens = int(counts.sum())
    counts[END] = ends

    weights = counts + 0.5
    tree = Tree(weights)
    plain = tree.plain(weights)
    cells = blocks.select("n_words", "n_ids", "shapes", "ids", "role", "size").mapInArrow(_count_forms, _PART)
    words = Mixer(tree, plain, _added(cells, tree, plain))
    own = F.exists("role", lambda x: x == WEIGHTS)
    words = _fit(words, blocks.where(own).select("n_words", "n_ids", "shapes", "ids", "role", "size"), _read_forms)
    tree = Tree(np.ones(256), huffman=False)
    plain = tree.plain(letters + 0.5)
    spelling = Mixer(tree, plain, _added(parts.where(F.col("kind") == LETTERS), tree, plain))
    spelling = _fit(spelling, parts.where(F.col("kind") == NAMES).select("n", "a"), _read_names)
    counts[END] = 0
    return blocks, parts, Model(words, spelling, counts, once), ends, tokens + ends, known + (ends > 0)


def score(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, held_out, text) scored by a model of those that aren't held out."""
    blocks, parts, model, ends, total, kinds = learn(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    found = parts.where(F.col("kind") == COUNTS).groupBy(F.col("key").alias("block")).agg(F.collect_list(F.struct("n", "a", "b")).alias("parts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.log10(total + 0.1 * (kinds + 1))
        for r in _rows(batches):
            counts = np.zeros(r["n_words"], np.int64)
            for part in r["parts"] or []:
                counts[_unpack(part["a"], part["n"], np.int32)] = _unpack(part["b"], part["n"], np.int64)
            r["parts"] = None
            leaf, tokens, sizes = _stream(r, None)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            each = np.append(np.log10(counts + 0.1), np.log10(ends + 0.1)) - floor
            base = np.bincount(doc, each[tokens], len(sizes))
            seen = np.bincount(doc, np.append(counts > 0, ends > 0)[tokens], len(sizes)).astype(np.int64)
            inside = sent.value.inside(_split(r["words"], r["n_words"]), counts, _shapes(r))
            made = refine(tokens, sizes, sent.value.tokens(leaf, tokens, sizes, inside))
            n_bytes = np.array(r["n_bytes"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_id"], pa.int64()), pa.array(np.array(r["role"]) == HELD), pa.array(sizes), pa.array(seen), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(made), pa.array(-made * np.log2(10) / np.maximum(n_bytes, 1), mask=n_bytes == 0)],
                names=[x.split()[0] for x in _RESULT.split(", ")],
            )

    return blocks.drop("trained").join(found, "block", "left").mapInArrow(finish, _RESULT)


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", crc_mod("doc_id", 10) == 0).select("doc_id", "held_out", "text"))
