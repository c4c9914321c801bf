"""Substring dedup by prefix-partitioned suffix trees over words.

A repeat is a window of 13 words that starts in two documents or more.

1. Equal texts are one (two 64-bit hashes): the smallest doc_id stands for all,
   the later copies lose every word if they hold a window, without any tree.
2. Sparse suffixes: each window names its least 7-word prefix (by hash) as its
   anchor, the same for equal windows.  Windows whose anchor only one document
   holds have no internal node above them and drop out.
3. Partition: a suffix belongs to the group of its first 7 words; a group above
   the row bound is split by 10 words, then by 13.  A sample of the documents tells
   which prefixes are above it (at most 2**20 of each length); it decides the layout
   only, never the result.
4. Subtrees: each group's suffixes are sorted by their words, then doc_id (Spark's
   sort, which spills).  The common prefix with the suffix before gives the tree's
   internal nodes in one pass; a node at depth 13 starts with its least
   document, whose words stay, and all later documents lose theirs.  The state is
   one suffix, whatever the size of a group.
5. A path of 13 words that is still above the bound is one node: its least
   document is a partial aggregate, broadcast to the texts (bounded as above).

Trees end at depth 13, as nothing deeper decides a removal: ``removed_spans`` are the
unions of a document's windows below such nodes.  A span may be covered by repeats of
several documents; longer repeats are not listed one by one.

Scale: a document sends each of its paths once, however often it repeats it; the words
of a path past the prefix travel as 32-bit hashes and are compared in the tree, so that
no single hash decides.  Texts are shuffled once, to meet their shared prefixes; starts
of repeats come back to them by a broadcast of checked size, or by a shuffle beyond it.

Defined cases: null texts and texts of fewer than 13 words have no window; only
strictly smaller doc_ids remove words, so rows of one id never cut each other
and rows with a null id neither cut nor are cut; repeated rows get the same
result; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import BROADCAST_BYTES, keep, ship, small

WINDOW = 13
PREFIX = 7
#: One document in so many is in the sample that lays out the groups.
HEAVY_SAMPLE = 64
#: A group is split beyond this share of the sampled documents, or this many rows, but not below so many sampled rows.
HEAVY_SHARE = 0.005
GROUP_ROWS = 200_000
HEAVY_LEAST = 16
#: At most so many prefixes of one length are split.
HEAVY_PREFIXES = 1 << 20
SPANS = "array<struct<start:int,end:int>>"
ROW = ["doc_id", "text_key"]


def _lengths(window: int, prefix: int) -> tuple[int, int, int]:
    return prefix, (prefix + window) // 2, window


def _room(run: W.Run) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word, and the words from there to the row's end."""
    rows = run.rows
    return rows, run.bounds[rows + 1] - np.arange(len(rows))


def _anchors(head: np.ndarray, start: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """The least prefix hash inside the window at each start."""
    return sliding_window_view(head, window - prefix + 1).min(axis=1)[start] if len(start) else head[start]


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Index of the first row of each distinct combination."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order[new]


def _take(batch: pa.RecordBatch, run: W.Run, row: np.ndarray) -> list[pa.Array]:
    at = pa.array(row + run.first)
    return [batch.column(c).take(at) for c in ROW]


def _sampled(batches, window, prefix):
    """(length, head, n): prefixes of three lengths and the documents of a run that hold each."""
    for batch in batches:
        for run in W.runs(batch.column("text")):
            rows, room = _room(run)
            heads = W.heads(run.hashes(), _lengths(window, prefix))
            for length, head in heads.items():
                at = np.flatnonzero(room >= length)
                found, n = np.unique(head[at][_firsts(rows[at], head[at])], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), length, np.int32)), pa.array(found.view(np.int64)), pa.array(n)],
                                                 names=["length", "head", "n"])


def heavy_prefixes(known: DataFrame, window: int, prefix: int) -> dict[int, np.ndarray]:
    """By length, the prefixes whose suffixes are too many for one group."""
    sample = known.where(F.pmod(F.xxhash64(*ROW), F.lit(HEAVY_SAMPLE)) == 0)
    rows = keep(sample.mapInArrow(lambda it: _sampled(it, window, prefix), "length int, head long, n long").groupBy("length", "head").agg(F.sum("n").alias("n")))
    most = rows.groupBy("length").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    limit = max(HEAVY_LEAST, min(HEAVY_SHARE * sample.count(), GROUP_ROWS / HEAVY_SAMPLE), most / HEAVY_PREFIXES)
    found = rows.where(F.col("n") > limit).toPandas()
    return {n: np.sort(found["head"][found["length"] == n].to_numpy(np.int64).view(np.uint64)) for n in _lengths(window, prefix)}


def _least(batches, window, heavy):
    """(path, check, low): the least document of each heavy path in a run, and a second hash of the path."""
    paths = heavy.value[window]
    for batch in batches:
        docs = batch.column("doc_id").to_numpy()
        for run in W.runs(batch.column("text")):
            rows, room = _room(run)
            at = np.flatnonzero(room >= window)
            path = W.heads(run.hashes(), (window,))[window]
            at = at[np.isin(path[at], paths)]
            if not len(at):
                continue
            check = W.heads(run.hashes(salt=1), (window,))[window]
            low = docs[run.first + rows[at]]
            first = _firsts(path[at], check[at], low)
            first = first[_firsts(path[at][first], check[at][first])]  # the rows are in order of low within a path
            yield pa.RecordBatch.from_arrays([pa.array(path[at][first].view(np.int64)), pa.array(check[at][first].view(np.int64)), pa.array(low[first])],
                                             names=["path", "check", "low"])


def settled_paths(known: DataFrame, window: int, heavy) -> tuple[np.ndarray, np.ndarray]:
    """Heavy paths, sorted, and the least document of each; a path whose hash two texts share is left to the trees."""
    if not len(heavy.value[window]):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = known.mapInArrow(lambda it: _least(it, window, heavy), "path long, check long, low long")
    paths = rows.groupBy("path").agg(F.min("low").alias("low"), F.min("check").alias("c"), F.max("check").alias("d")).where("c = d").toPandas()
    path = paths["path"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(path)
    return path[order], paths["low"].to_numpy(np.int64)[order]


def _prefixes(batches, window, prefix, heavy):
    """(doc_id, text_key, prefix): the distinct anchors of each document, without the heavy ones."""
    for batch in batches:
        for run in W.runs(batch.column("text")):
            rows, room = _room(run)
            start = np.flatnonzero(room >= window)
            least, row = _anchors(W.heads(run.hashes(), (prefix,))[prefix], start, window, prefix), rows[start]
            light = _firsts(row, least)
            light = light[~np.isin(least[light], heavy.value[prefix])]
            yield pa.RecordBatch.from_arrays([*_take(batch, run, row[light]), pa.array(least[light].view(np.int64))], names=[*ROW, "prefix"])


def _of_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of a value and the row that it belongs to."""
    return W.mix(values + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column (null: empty) and the row of each."""
    counts = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), counts)


def _suffixes(batches, window, prefix, heavy, settled):
    """(key, rest, doc_id, text_key, start): per document the first suffix of each path that others may share; key: its group."""
    short, middle, _ = _lengths(window, prefix)
    for batch in batches:
        shared = batch.column("shared")
        for run in W.runs(batch.column("text")):
            rows, room = _room(run)
            start = np.flatnonzero(room >= window)
            if not len(start):
                continue
            hashes = run.hashes()
            heads = W.heads(hashes, _lengths(window, prefix))
            least, row = _anchors(heads[short], start, window, prefix), rows[start]
            known, owner = _lists(shared.slice(run.first, run.n))
            hit = np.isin(_of_row(least, row), _of_row(known.astype(np.int64).view(np.uint64), owner)) | np.isin(least, heavy.value[short])
            hit &= ~np.isin(heads[window][start], settled.value[0])
            start, row = start[hit], row[hit]
            first = _firsts(row, heads[window][start])
            start, row = start[first], row[first]
            key, second = heads[short][start], heads[middle][start]
            split = np.isin(key, heavy.value[short])
            key = np.where(split, np.where(np.isin(second, heavy.value[middle]), heads[window][start], second), key)
            rest = np.ascontiguousarray(hashes.astype(np.uint32)[start[:, None] + np.arange(prefix, window)])
            rest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * (window - prefix)), len(start), [None, pa.py_buffer(rest)])
            yield pa.RecordBatch.from_arrays([
                pa.array(key.view(np.int64)), rest.cast(pa.binary()), *_take(batch, run, row),
                pa.array((start - run.bounds[row]).astype(np.int32))], names=["key", "rest", *ROW, "start"])


def _subtrees(batches, width):
    """Suffixes in tree order -> those below a node of full depth that an earlier document opens."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        key, doc = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
        column = batch.column("rest")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
        rest = np.frombuffer(data, np.uint8)[at:at + 4 * width * len(batch)].copy().view(np.uint32).reshape(-1, width)
        # words past the prefix that a suffix has in common with the one before it in its group; -1: another group
        common = np.full(len(key), -1)
        common[1:] = np.where(key[1:] == key[:-1], np.logical_and.accumulate(rest[1:] == rest[:-1], axis=1).sum(axis=1), -1)
        goes_on = last is not None and last[0] == key[0] and (last[1] == rest[0]).all()
        opens = common < width
        opens[0] = True
        low = doc[opens]
        if goes_on:
            low[0] = last[2]
        low = low[np.cumsum(opens) - 1]
        last = key[-1], rest[-1], low[-1]
        at = pa.array(np.flatnonzero(doc > low))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in [*ROW, "start"]], names=[*ROW, "start"])


def _cut(batches, window, settled):
    """Texts without the words of their repeats."""
    paths, lows = settled.value
    for batch in batches:
        docs, low = (pc.fill_null(batch.column(c), -2**63 if c == "doc_id" else 2**63 - 1).to_numpy() for c in ("doc_id", "low"))
        for run in W.runs(batch.column("text")):
            own, copied = docs[run.first:run.first + run.n], low[run.first:run.first + run.n]
            rows, room = _room(run)
            start = np.flatnonzero(room >= window)
            path, row = W.heads(run.hashes(), (window,))[window], rows[start]
            found, owner = _lists(batch.column("starts").slice(run.first, run.n))
            hit = np.isin(_of_row(path[start], row), _of_row(path[run.bounds[owner] + found.astype(np.int64)], owner))
            if len(paths):
                place = np.minimum(np.searchsorted(paths, path[start]), len(paths) - 1)
                hit |= (paths[place] == path[start]) & (lows[place] < own[row])
            hit |= own[row] > copied[row]
            edge = np.zeros(len(rows) + 1, np.int64)
            np.add.at(edge, start[hit], 1)
            np.add.at(edge, start[hit] + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            before = np.zeros(len(gone), bool)
            before[1:] = gone[:-1] & (rows[1:] == rows[:-1])
            after = np.zeros(len(gone), bool)
            after[:-1] = gone[1:] & (rows[1:] == rows[:-1])
            opens, closes = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
            base = run.bounds[rows[opens]]
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[opens], np.arange(run.n + 1)).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array((opens - base).astype(np.int32)), pa.array((closes - base).astype(np.int32))], names=["start", "end"]))
            lost, data, texts, shas = W.per_row(gone, run.bounds), run.data.tobytes(), [], []
            for i in range(run.n):
                parts = data[run.offsets[i]:run.offsets[i + 1]].split()
                kept = b" ".join(compress(parts, ~gone[run.bounds[i]:run.bounds[i + 1]]) if lost[i] else parts)
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if lost[i] else None)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(run.first, run.n), pa.array(np.diff(run.bounds)), pa.array(lost), pa.array(shas, pa.string()),
                pa.array(texts, pa.string()), spans], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed_spans"])


def with_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) and two hashes of the text; low: the least doc_id of a text that several rows hold."""
    own = docs.withColumns({"text_key": F.xxhash64("text"), "text_check": F.xxhash64(F.lit(7), "text")})
    key = ["text_key", "text_check"]
    lows = keep(own.where("doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"))
    return own.join(small(lows, 96), key, "left")


def shared_starts(known: DataFrame, window: int, prefix: int, heavy, settled) -> DataFrame:
    """(doc_id, text_key, starts): the first start of each path of a document that an earlier document holds too."""
    anchors = known.mapInArrow(lambda it: _prefixes(it, window, prefix, heavy), "doc_id long, text_key long, prefix long")
    by = Window.partitionBy("prefix")
    anchors = anchors.withColumns({"low": F.min("doc_id").over(by), "high": F.max("doc_id").over(by)}).where("low < high")
    shared = keep(anchors.groupBy(*ROW).agg(F.collect_list("prefix").alias("shared")))
    texts = known.join(shared, ROW, "left").select(*ROW, "text", "shared")
    suffixes = texts.mapInArrow(lambda it: _suffixes(it, window, prefix, heavy, settled), "key long, rest binary, doc_id long, text_key long, start int")
    ordered = suffixes.repartition("key").sortWithinPartitions("key", "rest", "doc_id")
    later = ordered.mapInArrow(lambda it: _subtrees(it, window - prefix), "doc_id long, text_key long, start int")
    return later.groupBy(*ROW).agg(F.collect_list("start").alias("starts"))


def substring_dedup(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """Per input row: doc_id, n_words, n_removed, kept_sha256, the kept text (null if nothing was removed) and the removed word spans."""
    spark = docs.sparkSession
    ship(spark)
    own = with_copies(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    known = own.where("doc_id is not null and text is not null and (low is null or doc_id = low)").select(*ROW, "text")
    heavy = spark.sparkContext.broadcast(heavy_prefixes(known, window, prefix))
    settled = spark.sparkContext.broadcast(settled_paths(known, window, heavy))
    starts = keep(shared_starts(known, window, prefix, heavy, settled))
    size = starts.agg(F.sum(F.size("starts") * 4 + 64).alias("n")).first()["n"] or 0
    side = F.broadcast(starts) if size <= BROADCAST_BYTES else starts
    return own.join(side, ROW, "left").select("doc_id", "text", "low", "starts").mapInArrow(
        lambda it: _cut(it, window, settled), f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed_spans {SPANS}")
