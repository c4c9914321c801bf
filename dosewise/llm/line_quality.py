"""Quality rules with cross-document line frequency.

Normalised lines (words lower-cased in ASCII, joined by one space) are hashed;
per host, the distinct documents that hold a line are counted; lines above the
host's limit are removed, and documents that this depletes are rejected.

Scale: a document is one row of line hashes; texts are never shuffled.  The
count is a partial aggregate per (host, line), so a line found in a third of all
documents or a host with a third of all rows costs one row per map task.  The
join back is left to AQE, which splits a hot line.

Defined cases: null text has no words and no lines; a null host is a host of its
own; documents of one host with the same text count once (repeated rows
included) and get the same verdict; null ids pass through; an empty table gives
an empty result; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import keep, ship

#: A line is above the limit in more documents of a host than both of these allow.
MIN_DOCS = 20
HOST_SHARE = 0.01
#: A document is depleted with fewer words left, or with more than this share removed.
MIN_WORDS = 10
MAX_REMOVED = 0.5
NO_HOST = "\x01none"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1

PROFILE = ("doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, base_failed boolean, lines array<long>, line_words array<long>")


def _lines(run: W.Run):
    """Start, end and row of the lines that hold a word, with the range of their words."""
    breaks = np.flatnonzero(run.data == 10)
    starts = np.union1d(run.offsets[:-1][np.diff(run.offsets) > 0], breaks + 1)
    starts = starts[starts < len(run.data)]
    if not len(starts):
        return (np.empty(0, np.int64),) * 5
    ends = np.append(starts[1:], len(run.data))
    ends = ends - ((ends > starts) & (run.data[np.maximum(ends, 1) - 1] == 10))
    first, last = np.searchsorted(run.starts, starts), np.searchsorted(run.starts, ends)
    held = last > first
    starts, ends, first, last = starts[held], ends[held], first[held], last[held]
    return starts, ends, np.searchsorted(run.offsets, starts, "right") - 1, first, last


def _profile(run: W.Run) -> dict:
    n, rows = run.n, run.rows
    hashes = run.hashes()
    points = np.zeros(len(run.data) + 1, np.int64)
    np.cumsum((run.data & 0xC0) != 0x80, out=points[1:])
    n_words = np.diff(run.bounds)
    window, at = W.grams(hashes, rows, 5)
    _, inverse, counts = np.unique(W.mix(window + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                                   return_inverse=True, return_counts=True)
    again = at[counts[inverse] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    starts, ends, row, first, last = _lines(run)
    raw = W.span_hashes(W._BYTE[run.data], starts, ends)
    lowered = W.Run(run.first, W._LOWER[run.data], run.offsets, run.starts, run.ends, run.bounds).hashes()
    normal = W.span_hashes(lowered, first, last)
    exact = np.unique(np.stack([row.astype(np.uint64), raw]), axis=1) if len(row) else np.empty((2, 0), np.uint64)
    order = np.lexsort((normal, row))
    row, normal, size = row[order], normal[order], (last - first)[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (normal[1:] != normal[:-1])
    heads = np.flatnonzero(new)
    per_line = W.per_row(size, np.append(heads, len(row)))
    repeated = W.per_row((np.cumsum(cover[:-1]) > 0).astype(np.int64), run.bounds)
    n_lines = np.bincount(row, minlength=n)
    return {
        "n_words": n_words, "word_chars": W.per_row(points[run.ends] - points[run.starts], run.bounds),
        "n_symbols": W.per_row(_SYMBOL[run.data], run.offsets),
        "n_dup_lines": n_lines - np.bincount(exact[0].astype(np.int64), minlength=n), "n_repeat_words": repeated,
        "base_failed": (n_words < 10) | (100 * repeated > 20 * n_words),
        "lines": W.list_array(normal[heads], np.searchsorted(row[heads], np.arange(n + 1))),
        "line_words": W.list_array(per_line, np.searchsorted(row[heads], np.arange(n + 1))),
    }


def _profiles(batches):
    names = [x.strip().split()[0] for x in PROFILE.split(",")]
    for batch in batches:
        for run in W.runs(batch.column("text")):
            got = _profile(run)
            got |= {c: batch.column(c).slice(run.first, run.n) for c in ("doc_id", "host", "text_key")}
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in map(got.get, names)], names=names)


def profiles(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """One row per document: base counts, and its distinct normalised lines with their words."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col), F.lit(NO_HOST)).alias("host"),
                      F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return own.mapInArrow(_profiles, PROFILE)


def frequent_lines(profile: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """(host, line, n_docs) of the lines above their host's limit."""
    once = profile.select("host", "text_key", "lines").dropDuplicates(["host", "text_key"])
    hosts = once.groupBy("host").agg(F.count("*").alias("n_host"))
    counts = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    above = counts.where(F.col("n_docs") > min_docs)
    return above.join(hosts, "host").where(F.col("n_docs") > host_share * F.col("n_host")).select("host", "line", "n_docs")


def line_quality(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", min_docs: int = MIN_DOCS,
                 host_share: float = HOST_SHARE, min_words: int = MIN_WORDS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """Per document: base counts, words and lines removed, the removed lines' hashes, ``base_failed`` and ``kept``."""
    profile = keep(profiles(docs, id_col, text_col, host_col))
    above = keep(frequent_lines(profile, min_docs, host_share))
    lines = profile.dropDuplicates(["host", "text_key"]).select(
        "host", "text_key", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select(
        "host", "text_key", F.col("x.lines").alias("line"), F.col("x.line_words").alias("line_words"))
    gone = lines.join(above, ["host", "line"]).groupBy("host", "text_key").agg(
        F.sum("line_words").alias("n_removed_words"), F.count("*").alias("n_removed_lines"),
        F.sort_array(F.collect_list("line")).alias("removed_lines"))
    out = profile.join(gone, ["host", "text_key"], "left").withColumns({
        "n_removed_words": F.coalesce("n_removed_words", F.lit(0)), "n_removed_lines": F.coalesce("n_removed_lines", F.lit(0)),
        "removed_lines": F.coalesce("removed_lines", F.array().cast("array<long>"))})
    depleted = (F.col("n_removed_words") > 0) & ((F.col("n_words") - F.col("n_removed_words") < min_words)
                                                  | (F.col("n_removed_words") > max_removed * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select(
        "doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_removed_lines", "n_removed_words", "removed_lines", "kept")


def _without(batches):
    for batch in batches:
        texts = []
        for run in W.runs(batch.column("text")):
            starts, ends, row, first, last = _lines(run)
            lowered = W.Run(run.first, W._LOWER[run.data], run.offsets, run.starts, run.ends, run.bounds).hashes()
            normal = W.span_hashes(lowered, first, last).view(np.int64)
            by_row = np.searchsorted(row, np.arange(run.n + 1))
            whole = run.data.tobytes()
            for i in range(run.n):
                gone = set(batch.column("removed_lines")[run.first + i].as_py() or ())
                text, at = whole[run.offsets[i]:run.offsets[i + 1]], int(run.offsets[i])
                for j in reversed(range(by_row[i], by_row[i + 1])):
                    if int(normal[j]) in gone:
                        a, b = int(starts[j]) - at, int(ends[j]) - at
                        text = text[:a] + text[b + (text[b:b + 1] == b"\n"):]
                texts.append(text.decode())
        yield batch.drop_columns(["text", "removed_lines"]).append_column("clean_text", pa.array(texts, pa.string()))


def cleaned(docs: DataFrame, verdicts: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, clean_text) of the kept documents, without the lines above the limit."""
    kept = verdicts.where("kept").select("doc_id", "text_key", "removed_lines").dropDuplicates(["doc_id", "text_key"])
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    same = own.doc_id.eqNullSafe(kept.doc_id) & (own.text_key == kept.text_key)
    return own.join(kept, same).select(own.doc_id, own.text, "removed_lines").mapInArrow(_without, "doc_id long, clean_text string")
