"""Benchmark decontamination by a positional inverted index (DataFrame operations only).

A benchmark item is searched by its windows of 13 words (a shorter item is one
window).  Term counts over all documents name each window's two rarest terms;
the index stores the postings (document, position) of just these terms.  A
posting of the item's j-th word at position p lies on the diagonal p - j, so the
lists of an item are intersected by grouping on (document, item, diagonal), and
the diagonals that hold two terms are compared word by word.  ``near_matches``
groups the same postings by neighbouring diagonals instead; no query asks for it.

Scale: documents are never shuffled as words: the explode meets the benchmark's
terms in a broadcast join if their counted size allows it (shuffle join beyond
it), counts are partial aggregates, and only postings of rare terms are stored.
A passage in a third of all documents costs a few rows per occurrence.

Defined cases: words are lower-cased in A-Z only; null texts have no words;
items without words or id are never found, items of one id are found if one of
them is; windows with a term that no document has are dropped at once; repeated
rows get the same result, rows of one id are judged each on its text, null ids
pass through; empty tables give no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_BYTES, keep, small

WINDOW = 13
RAREST = 2
#: A document with hit words is contaminated if they are one in this many at least.
SHARE = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z; null has none."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, BREAK), ""), F.array().cast("array<string>"))


class PhraseIndex:
    """Postings of the terms that decide the benchmark's windows."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
                 window: int = WINDOW):
        self.window = window
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), words(F.col(text_col)).alias("words"))
        items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("item")).where("size(item) > 0")
        self.items = keep(items.distinct().withColumn("item_key", F.xxhash64("item")).withColumn("len", F.least(F.size("item"), F.lit(window))))
        self.lookups = keep(self._lookups())
        terms = keep(self.lookups.select("term").distinct())
        self.postings = keep(self.docs.select("doc_id", "text_key", F.posexplode("words").alias("pos", "term")).join(small(terms, 64), "term"))

    def term_counts(self) -> DataFrame:
        """Occurrences, in all documents, of the benchmark's terms."""
        terms = keep(self.items.select(F.explode("item").alias("term")).distinct())
        return self.docs.select(F.explode("words").alias("term")).join(small(terms, 64), "term").groupBy("term").agg(F.count("*").alias("n"))

    def _lookups(self) -> DataFrame:
        """(item_id, item_key, offset, term): for each window that can occur, its rarest terms; once per item."""
        places = self.items.select("item_id", "item_key", "len", F.size("item").alias("size"), F.posexplode("item").alias("offset", "term"))
        counted = places.join(small(keep(self.term_counts()), 64), "term")
        # word `offset` belongs to the windows that start at offset - len + 1 .. offset
        inside = counted.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - F.col("len") + 1),
                                                                  F.least(F.col("offset"), F.col("size") - F.col("len")))))
        rare = inside.groupBy("item_id", "item_key", "start").agg(F.first("len").alias("len"), F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("t"))
        rare = rare.where(F.size("t") == F.col("len")).select("item_id", "item_key", F.explode(F.slice("t", 1, RAREST)).alias("t"))
        return rare.select("item_id", "item_key", "t.offset", "t.term").distinct()

    def _aligned(self) -> DataFrame:
        rows = self.postings.join(small(self.lookups, 96), "term")
        return rows.select("doc_id", "text_key", "item_id", "item_key", "offset", "pos", (F.col("pos") - F.col("offset")).alias("diagonal"))

    def candidates(self) -> DataFrame:
        """(doc_id, text_key, item_id, item_key, diagonal) on which the rarest terms of a window meet."""
        met = self._aligned().groupBy("doc_id", "text_key", "item_id", "item_key", "diagonal").agg(F.count_distinct("offset").alias("n"))
        size = small(self.items.select("item_id", "item_key", "len"), 32)
        return met.join(size, ["item_id", "item_key"]).where(F.col("n") >= F.least(F.lit(RAREST), F.col("len"))).drop("n", "len")

    def matches(self) -> DataFrame:
        """Per input row doc_id, n_words and found: array of (item_id, spans) with the word spans of exact occurrences."""
        found = self.candidates().join(small(self.items, 600), ["item_id", "item_key"])
        found = keep(found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("item_id", "diagonal", "item", "len")).alias("tries")))
        size = found.agg(F.sum(F.aggregate("tries", F.lit(64).cast("long"), lambda s, x: s + 32 + 16 * F.size(x["item"]))).alias("n")).first()["n"] or 0
        side = (F.broadcast(found) if size <= BROADCAST_BYTES else found).withColumnsRenamed({"doc_id": "id", "text_key": "key"})
        rows = self.docs.join(side, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")

        def starts(c):
            """Places of the item on this diagonal whose window agrees."""
            return F.filter(F.sequence(F.lit(0), F.size(c["item"]) - c["len"]), lambda i: (c["diagonal"] + i >= 0) & (
                F.slice("words", F.greatest(F.lit(1), c["diagonal"] + i + 1), c["len"]) == F.slice(c["item"], i + 1, c["len"])))

        tried = F.transform("tries", lambda c: F.struct(c["item_id"].alias("item_id"), F.transform(starts(c), lambda i: F.struct(
            (c["diagonal"] + i).alias("start"), (c["diagonal"] + i + c["len"]).alias("end"))).alias("spans")))
        return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(tried, lambda c: F.size(c["spans"]) > 0).alias("found"))

    def near_matches(self, slop: int = 8, share: float = 0.8) -> DataFrame:
        """(doc_id, text_key, item_id, start, n): items of which a window has ``share`` of its stored terms within ``slop`` of their
        distance in the document; the first such place and the most terms met."""
        size = small(self.items.select("item_id", "item_key", "len", F.size("item").alias("size")), 40)
        held = self.lookups.join(size, ["item_id", "item_key"]).select("item_id", "item_key", "offset", F.explode(F.sequence(
            F.greatest(F.lit(0), F.col("offset") - F.col("len") + 1), F.least(F.col("offset"), F.col("size") - F.col("len")))).alias("window")).distinct()
        whole = held.groupBy("item_id", "item_key", "window").agg(F.count("*").alias("whole"))
        held = keep(held.join(whole, ["item_id", "item_key", "window"]))
        rows = self._aligned()
        # two half-overlapping rows of buckets, so that any two diagonals within slop share one
        rows = rows.withColumn("bucket", F.explode(F.array(F.floor(F.col("diagonal") / (2 * slop)) * 2, F.floor((F.col("diagonal") + slop) / (2 * slop)) * 2 + 1)))
        # a window has at most 2 x slop postings of each of its words in a bucket
        met = rows.join(small(held, 64), ["item_id", "item_key", "offset"]).groupBy("doc_id", "text_key", "item_id", "item_key", "bucket", "window").agg(
            F.first("whole").alias("whole"), F.collect_set(F.struct("diagonal", "offset", "pos")).alias("terms"))

        def tight(d):
            """The terms whose diagonals are d to d + slop."""
            return F.filter("terms", lambda x: (x["diagonal"] >= d["diagonal"]) & (x["diagonal"] <= d["diagonal"] + slop))

        met = met.where(F.size("terms") >= share * F.col("whole"))
        places = met.withColumn("places", F.transform("terms", lambda d: F.struct(
            F.array_min(F.transform(tight(d), lambda x: x["pos"])).alias("start"), F.size(F.array_distinct(F.transform(tight(d), lambda x: x["offset"]))).alias("n"))))
        found = places.select("doc_id", "text_key", "item_id", "whole", F.explode("places").alias("x")).select("doc_id", "text_key", "item_id", "whole", "x.*")
        return found.where(F.col("n") >= share * F.col("whole")).groupBy("doc_id", "text_key", "item_id").agg(F.min("start").alias("start"), F.max("n").alias("n"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
                  window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per input row: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated."""
    index = PhraseIndex(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    found = index.matches()
    covered = F.flatten(F.transform("found", lambda c: F.flatten(F.transform(c["spans"], lambda s: F.sequence(s["start"], s["end"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda c: c["item_id"].cast("string"))))
    out = found.withColumns({"n_hit": F.coalesce(F.size(F.array_distinct(F.when(F.col("found").isNotNull(), covered))), F.lit(0)).cast("long"),
                             "item_ids": F.coalesce(ids, F.array().cast("array<string>"))})
    out = out.withColumns({"n_hit": F.greatest(F.col("n_hit"), F.lit(0)), "n_items": F.size("item_ids").cast("long")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).drop("found")
