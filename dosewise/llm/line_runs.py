"""Line dedup by prefix doubling over line-ID sequences (DataFrame operations only).

A document is the sequence of the ids (hashes) of its lines that hold a word.
Prefix doubling names the suffixes of all documents by their first h lines:
the name for 2h lines is made of the names at a position and h lines later, and
suffixes whose name is unique are discarded after each round, as no longer
prefix of theirs can repeat.  Doubling ends at depth ``min_lines``: of the suffixes
with one name the first (by id, then line) is the copy that stays, and the lines
below every later one are deleted.  No suffix order, LCP or maximal interval is
built.  ``longest_run`` is the most adjacent lines deleted in a document, which
may be copies from several documents.  With ``min_words``
the later copies of windows of one or two lines that hold so many words are
deleted as well; their names are those of the first rounds.

Scale: lines travel as hashes; counts are partial aggregates, joins are
equi-joins on (document, line) or on the name, which AQE can split for a line
that a third of all documents hold.  The deletions come back to the texts by a
broadcast of checked size, or by a shuffle beyond it.

Defined cases: null texts have no lines; lines without a word are kept and
belong to no run; a null id orders after all ids, rows of one id are ordered by
their text's hash; repeated rows (same id and text) are one document, so they
don't delete each other and get the same result; an empty table gives an empty
result; all input columns stay, the text column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_BYTES, keep

MIN_LINES = 3
WORD = r"[^\x20\x09-\x0D]"
SPACES = r"[\x20\x09-\x0D]+"
#: Working columns; no input column may have one of these names.
KEY = ["__run_id", "__run_none", "__run_text"]


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias(KEY[0]), F.col(id_col).isNull().alias(KEY[1]), F.xxhash64(F.col(text_col)).alias(KEY[2])]


def _again(names: DataFrame) -> DataFrame:
    """The suffixes whose name occurs twice or more."""
    names = keep(names)
    twice = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    return keep(names.join(twice, "name"))


def _joined(names: DataFrame, shift: int, extra: list[str]) -> DataFrame:
    """Names of twofold prefixes: a suffix's own name and that of the suffix ``shift`` lines later."""
    later = names.select(*KEY, (F.col("pos") - shift).alias("pos"), F.col("name").alias("next"), *[F.col(c).alias(f"next_{c}") for c in extra])
    return names.join(later, [*KEY, "pos"]).select(*KEY, "pos", F.xxhash64("name", "next").alias("name"), *[(F.col(c) + F.col(f"next_{c}")).alias(c) for c in extra])


def suffix_names(docs: DataFrame, depth: int, id_col="doc_id", text_col="text", min_words: int | None = None) -> dict[int, DataFrame]:
    """(document key, pos, name) by lines: suffixes whose first ``depth`` lines occur twice or more, by prefix doubling; with
    ``min_words`` also those whose first line or first two do and hold so many words."""
    held = F.filter(F.split(text_col, "\n"), lambda x: x.rlike(WORD))
    extra = [] if min_words is None else ["words"]
    count = {"words": lambda x: F.size(F.filter(F.split(x, SPACES), lambda w: w != ""))}
    line = F.transform(held, lambda x: F.struct(F.xxhash64(x).alias("name"), *[count[c](x).alias(c) for c in extra]))
    lines = docs.where(F.col(text_col).isNotNull()).select(*_key(docs, id_col, text_col), F.posexplode(line).alias("pos", "line")).select(
        *KEY, "pos", "line.name", *[f"line.{c}" for c in extra])
    names, h, found = _again(lines), 1, {}
    while h < depth:
        if extra and h <= 2:
            found[h] = names.where(F.col("words") >= min_words).drop("words")
        step = min(h, depth - h)
        names, h = _again(_joined(names, step, extra)), h + step
    return found | {depth: names.drop("words")}


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col="doc_id", text_col="text", min_words: int | None = None) -> DataFrame:
    """(document key, __run_gone): positions, among the lines with a word, of the later copies of repeated runs."""
    place = F.struct(KEY[1], KEY[0], KEY[2], "pos")
    gone = None
    for n, names in suffix_names(docs, min_lines, id_col, text_col, min_words).items():
        first = names.groupBy("name").agg(F.min(place).alias("first"))
        later = names.join(first, "name").where(place > F.col("first")).select(*KEY, F.sequence(F.col("pos"), F.col("pos") + (n - 1)).alias("at"))
        gone = later if gone is None else gone.union(later)
    return gone.groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("__run_gone"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, id_col="doc_id", text_col="text", min_words: int | None = None) -> DataFrame:
    """The input columns, the text without later copies of runs of ``min_lines`` lines or more (and of shorter ones with a window
    of one or two lines and ``min_words`` words), and n_lines, n_removed and longest_run."""
    gone = keep(repeated_lines(docs, min_lines, id_col, text_col, min_words))
    size = gone.agg(F.sum(F.size("__run_gone") * 4 + 64).alias("n")).first()["n"] or 0
    side = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    out = docs.withColumns({n: c for n, c in zip(KEY, _key(docs, id_col, text_col))}).join(side, KEY, "left")
    out = out.withColumn("__run_lines", F.split(text_col, "\n"))
    # places of the lines with a word, then of those that stay
    places = F.filter(F.sequence(F.lit(0), F.size("__run_lines") - 1), lambda i: F.get("__run_lines", i).rlike(WORD))
    out = out.withColumn("__run_held", F.when(F.col("__run_lines").isNotNull(), places))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__run_lines") - 1), F.transform("__run_gone", lambda g: F.get("__run_held", g)))
    text = F.when(F.col("__run_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__run_lines", i)), "\n"))
    # a deleted line continues its run if the line before is deleted too
    run = F.aggregate("__run_gone", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")), lambda s, g: F.struct(
        g.alias("last"), F.when(g == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1)).alias("run"),
        F.greatest(s["best"], F.when(g == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1))).alias("best")), lambda s: s["best"])
    counts = {"n_lines": F.coalesce(F.size("__run_held"), F.lit(0)), "n_removed": F.coalesce(F.when(F.col("__run_gone").isNotNull(), F.size("__run_gone")), F.lit(0)),
              "longest_run": F.coalesce(F.when(F.col("__run_gone").isNotNull(), run), F.lit(0))}
    counts["n_lines"] = F.when(F.col("__run_held").isNull(), F.lit(0)).otherwise(F.size("__run_held"))
    return out.withColumns({text_col: text, **{k: v.cast("long") for k, v in counts.items()}}).drop(*KEY, "__run_gone", "__run_lines", "__run_held")
