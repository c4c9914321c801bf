"""Lexical retrieval packing: windows filled by a seed document's BM25 neighbours.

1. Documents are tokenized where they are read; their ids (with the end id) are
   written once, with two bytes an id where the vocabulary allows it.
2. Document frequencies of all ids are counted: one row per id of the vocabulary,
   whatever the corpus, so they fit the driver and a broadcast.
3. Documents are dealt out by range of their ``TOPICS`` heaviest terms (tf-idf), so
   that documents on one subject lie together; equal terms go on by doc_id, so a
   hot subject is split like any other range.
4. A task cuts its range into shards of ``SHARD_DOCS`` documents and builds the
   inverted index of each: term -> documents with their BM25 weight (global
   document frequencies and mean length).  The first unused document is the seed;
   all unused documents of the shard that share a term with it are ranked by
   score, and fill the window in that order.  One that doesn't fit is cut: its rest
   opens the next window and is the next seed.  Used documents leave the index.

Every window is filled to the last id, as the open one goes on into the next
shard.  The last ids of a task become sequences whose lengths are powers of two
(the binary digits of their number), which take no padding.

Scale: one pass over the texts, one over the ids for the frequencies, one shuffle
of the ids.  A task's memory is one shard (``SHARD_DOCS`` documents or ``SHARD_IDS``
ids, or one longer document) whatever the size of its range.  Nothing depends on
how often a task runs: ranges, orders and seeds are functions of the rows.

Defined cases: a null or empty text is the end id alone; rows of null id come
first in their range and keep it; rows of one id are packed each; equal rows are
interchangeable; ties of score go by order of the shard; documents longer than a
window fill windows of their own and seed the one they end in; an empty table
gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .rans_output import RUN_BYTES, WordTokenizer
from .segment_bpe import ragged
from .store import keep, ship

WINDOW = 4096
END_ID = 2
#: Documents and ids of one shard of the index.
SHARD_DOCS = 1024
SHARD_IDS = 4 << 20
#: Ids whose rows and terms are sorted at once, few enough for a core's cache; one longer document by itself.
SORTED_IDS = 1 << 16
#: Heaviest terms that order the documents.
TOPICS = 3
#: Ids of one range at most, and at least while cores are idle.
RANGE_IDS = 64 << 20
RANGE_LEAST = 1 << 20
#: BM25's term saturation and length norm.
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
KEYS = [f"topic{i + 1}" for i in range(TOPICS)]


# --- terms ------------------------------------------------------------------------------------------------------------
def _kind(wide: bool):
    return np.dtype("<u4") if wide else np.dtype("<u2")


def _ids(column: pa.Array, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and the bounds of each row's."""
    kind = _kind(wide)
    _, offsets, data = column.buffers()
    step = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(offsets, step)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]].tobytes() if data is not None else b""
    return np.frombuffer(flat, kind), (bounds - bounds[0]) // kind.itemsize


def _terms(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct ids of each row, by row and term; ``SORTED_IDS`` are sorted at once."""
    kind, bits = (np.uint32, 16) if ids.dtype.itemsize == 2 else (np.uint64, 32)
    rows, terms, counts, first, n = [], [], [], 0, len(bounds) - 1
    while first < n:
        last = min(n, first + (1 << 16), max(first + 1, int(np.searchsorted(bounds, bounds[first] + SORTED_IDS, "right")) - 1))
        key = np.repeat(np.arange(last - first, dtype=kind) << kind(bits), np.diff(bounds[first:last + 1])) | ids[bounds[first]:bounds[last]]
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        own = key[at]
        rows.append((own >> kind(bits)).astype(np.int64) + first)
        terms.append((own & kind((1 << bits) - 1)).astype(np.int64))
        counts.append(np.diff(np.append(at, len(key))))
        first = last
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, terms, counts))


def _tokenize(batches, path: str, end_id: int, wide: bool):
    """(doc_id, n, ids)"""
    tokenizer = WordTokenizer.shared(path)
    for batch in batches:
        for run in W.runs(batch.column("text"), run_bytes=RUN_BYTES):
            ids, bounds = tokenizer.encode(run)
            ids = np.insert(ids, bounds[1:], end_id).astype(_kind(wide))
            bounds = bounds + np.arange(run.n + 1)
            offsets = pa.py_buffer((bounds * ids.itemsize).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(run.first, run.n), pa.array(np.diff(bounds)),
                                              pa.Array.from_buffers(pa.binary(), run.n, [None, offsets, pa.py_buffer(ids)])], names=["doc_id", "n", "ids"])


def _frequencies(batches, wide: bool):
    """(term, n): in how many of the batch's documents a term occurs."""
    for batch in batches:
        _, term, _ = _terms(*_ids(batch.column("ids"), wide))
        n = np.bincount(term)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["term", "n"])


def _topics(batches, wide: bool, idf):
    """The rows with the numbers of their heaviest terms, -1 where there are no more."""
    for batch in batches:
        ids, bounds = _ids(batch.column("ids"), wide)
        row, term, count = _terms(ids, bounds)
        weight = idf.value[term] * count / (count + K1)
        opens = np.append(True, row[1:] != row[:-1])[:len(row)]
        first, number = np.flatnonzero(opens), np.cumsum(opens) - 1
        tops = []
        for _ in range(TOPICS):  # a row's heaviest term left, the smallest of equal ones
            top = np.full(len(batch), -1, np.int32)
            most = np.maximum.reduceat(weight, first) if len(first) else weight
            at = np.flatnonzero((weight == most[number]) & (weight > -np.inf))
            at = at[np.append(True, row[at[1:]] != row[at[:-1]])[:len(at)]]
            top[row[at]] = term[at]
            weight[at] = -np.inf
            tops.append(pa.array(top))
        yield pa.RecordBatch.from_arrays([*batch.columns, *tops], names=[*batch.schema.names, *KEYS])


# --- the index of a shard -------------------------------------------------------------------------------------------
class Shard:
    """BM25 postings of some documents; used documents are left out of answers, and of the postings from time to time."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, idf: np.ndarray, mean: float):
        row, term, count = _terms(ids, bounds)
        self.n = len(bounds) - 1
        self.unused = np.ones(self.n, bool)
        self.left = self.posted = self.n
        self.terms, self.term_bounds = term, np.searchsorted(row, np.arange(self.n + 1))
        length = np.diff(bounds)[row]
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))
        order = np.argsort(term.astype(ids.dtype), kind="stable")  # two bytes are sorted by radix
        self.rows, self.weights = row[order].astype(np.int32), weight[order]
        self._starts(term[order])

    def _starts(self, sorted_terms: np.ndarray):
        self.posting_terms = sorted_terms
        self.vocabulary, first = np.unique(sorted_terms, return_index=True)
        self.first = np.append(first, len(sorted_terms))

    def use(self, doc: int):
        self.unused[doc] = False
        self.left -= 1
        if self.left * 2 < self.posted:
            held = self.unused[self.rows]
            self.rows, self.weights, self.posted = self.rows[held], self.weights[held], self.left
            self._starts(self.posting_terms[held])

    def neighbours(self, doc: int) -> np.ndarray:
        """Unused documents that share a term with ``doc``, best first."""
        if not self.left or not len(self.vocabulary):
            return np.empty(0, np.int64)
        own = self.terms[self.term_bounds[doc]:self.term_bounds[doc + 1]]
        at = np.searchsorted(self.vocabulary, own)
        at = at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == own]
        hit = ragged(self.first[at], self.first[at + 1] - self.first[at])
        scores = np.bincount(self.rows[hit], self.weights[hit], minlength=self.n)
        found = np.flatnonzero(self.unused & (scores > 0))
        return found[np.argsort(-scores[found], kind="stable")]


class Packer:
    """Cuts documents into the pieces of a task's sequences; ``base`` is the first sequence's number."""

    def __init__(self, window: int, base: int, with_ids: bool):
        self.window, self.sequence, self.filled, self.with_ids = window, base, 0, with_ids
        self.pieces: list[tuple] = []
        self.open: list[tuple] = []

    @property
    def space(self) -> int:
        return self.window - self.filled

    def add(self, doc_id, ids: np.ndarray) -> None:
        """Put a document into the open window and as many further ones as it needs."""
        start = 0
        while start < len(ids):
            length = min(self.space, len(ids) - start)
            self.open.append((doc_id, start, ids[start:start + length], len(ids), self.filled))
            start, self.filled = start + length, self.filled + length
            if not self.space:
                self._close()

    def _close(self):
        for doc_id, start, ids, total, offset in self.open:
            self._piece(doc_id, start, ids, total, self.sequence, offset)
        self.open, self.filled, self.sequence = [], 0, self.sequence + 1

    def _piece(self, doc_id, start, ids, total, sequence, offset):
        own = ids.astype("<u4")
        self.pieces.append((doc_id, start, len(ids), zlib.crc32(own.tobytes()), total, sequence, offset, own if self.with_ids else None))

    def end(self):
        """The open window as sequences whose lengths are powers of two."""
        sizes = [1 << i for i in reversed(range(self.filled.bit_length())) if self.filled >> i & 1]
        rest, offset = sizes.pop(0) if sizes else 0, 0
        for doc_id, start, ids, total, _ in self.open:
            while len(ids):
                length = min(rest, len(ids))
                self._piece(doc_id, start, ids[:length], total, self.sequence, offset)
                start, ids, offset, rest = start + length, ids[length:], offset + length, rest - length
                if not rest:
                    rest, offset, self.sequence = sizes.pop(0) if sizes else 0, 0, self.sequence + 1
        self.open, self.filled = [], 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.pieces)) if self.pieces else [()] * 8
        self.pieces = []
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if self.with_ids:
            arrays, names = [*arrays, pa.array(columns[7], pa.list_(pa.int64()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names)


def fill(packer: Packer, doc_ids: list, ids: np.ndarray, bounds: np.ndarray, idf: np.ndarray, mean: float) -> None:
    """Pack the documents of one shard: seeds in order, each followed by its unused neighbours, best first."""
    shard, following = Shard(ids, bounds, idf, mean), 0

    def put(doc):
        shard.use(doc)
        packer.add(doc_ids[doc], ids[bounds[doc]:bounds[doc + 1]])

    while shard.left:
        while not shard.unused[following]:
            following += 1
        seed = following
        put(seed)
        while packer.filled:  # the seed ends in an open window
            last = seed
            for doc in shard.neighbours(seed).tolist():
                whole = bounds[doc + 1] - bounds[doc] <= packer.space
                put(doc)
                if not whole:
                    last = doc  # its rest is the next seed
                if not whole or not packer.filled:
                    break
            if last == seed:  # no neighbour left: the next seed goes on in the open window
                break
            seed = last


def _pack(batches, wide: bool, idf, mean: float, window: int, shard_docs: int, with_ids: bool):
    packer = Packer(window, TaskContext.get().partitionId() << 40, with_ids)
    doc_ids, parts, lengths, size = [], [], [], 0

    def flush():
        nonlocal doc_ids, parts, lengths, size
        fill(packer, doc_ids, np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(lengths))), idf.value, mean)
        doc_ids, parts, lengths, size = [], [], [], 0
        return packer.take()

    for batch in batches:
        ids, bounds = _ids(batch.column("ids"), wide)
        names, first = batch.column("doc_id").to_pylist(), 0
        while first < len(batch):
            last = min(len(batch), first + shard_docs - len(doc_ids), max(first + 1, int(np.searchsorted(bounds, bounds[first] + SHARD_IDS - size, "right")) - 1))
            doc_ids += names[first:last]
            parts.append(ids[bounds[first]:bounds[last]])
            lengths.append(np.diff(bounds[first:last + 1]))
            size += len(parts[-1])
            first = last
            if len(doc_ids) >= shard_docs or size >= SHARD_IDS:
                yield flush()
    if doc_ids:
        yield flush()
    packer.end()
    yield packer.take()


# --- plan ---------------------------------------------------------------------------------------------------------------
def pack(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", end_id: int = END_ID, window: int = WINDOW,
         shard_docs: int = SHARD_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, an array, if asked for)."""
    spark = docs.sparkSession
    ship(spark)
    size = WordTokenizer.shared(tokenizer_path).size
    wide = max(size, end_id + 1) > 1 << 16
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = keep(own.mapInArrow(lambda it: _tokenize(it, tokenizer_path, end_id, wide), "doc_id long, n long, ids binary"), "zstd")
    totals = tokens.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids")).first()
    mean = max(1.0, totals["ids"] / max(1, totals["docs"]))
    found = tokens.select("ids").mapInArrow(lambda it: _frequencies(it, wide), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(max(size, end_id + 1), np.float64)
    frequency[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    weights = np.log(1 + (totals["docs"] - frequency + 0.5) / (frequency + 0.5))
    weights[end_id] = 0.0  # every document ends in it
    idf = spark.sparkContext.broadcast(weights)
    ranges = max(1, totals["ids"] // RANGE_IDS, min(totals["ids"] // RANGE_LEAST, 3 * spark.sparkContext.defaultParallelism))
    ordered = tokens.mapInArrow(lambda it: _topics(it, wide, idf), "doc_id long, n long, ids binary, " + ", ".join(f"{k} int" for k in KEYS))
    dealt = ordered.repartitionByRange(ranges, *KEYS, "doc_id").sortWithinPartitions(*KEYS, "doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(lambda it: _pack(it, wide, idf, mean, window, shard_docs, with_ids),
                                                    PIECES + (", ids array<long>" if with_ids else ""))
