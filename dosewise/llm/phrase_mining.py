"""Collocations by best-first growth of phrases, with bounds from prefix counts.

A phrase of ``a`` occurrences that is cut after its first k words into parts of
``l`` and ``r`` occurrences scores floor(1000 a n / (l r)), the least over all
cuts.  As r >= a, no phrase that starts with a word of f occurrences scores more
than floor(1000 n / f): the count of a prefix bounds all that grows out of it.

1. Words are counted per language (one shuffle of pre-counted words).  Words below
   ``least`` end phrases; the texts are written once more as sequences of the
   64-bit keys of the others, 0 where a piece or a stretch of frequent words ends.
2. The frontier are the first words not yet grown, best bound (rarest word)
   first, taken in bands of ``BANDS`` times ``least`` occurrences.  A band grows
   word by word: a pass over the sequences counts the phrases whose prefix was
   frequent, with the least and greatest neighbour on each side.
3. A phrase whose neighbour is the same word at all its occurrences lies in a
   longer phrase of equal count and is dropped; no other phrase can be.  The parts
   behind a cut that start with a word not grown are counted in one more pass.
4. The language is settled when no word left has a bound that reaches its
   ``top``-th surviving score, ties included; else the next band is grown.

Exactness: a word's key is a hash; words of equal key are looked for among all
counted words, and another hash function is taken if there are any, so phrases
(tuples of keys) are exact.  Which words and prefixes are frequent reaches the
tasks as a bitmap of fixed size (``BITS``), whatever the corpus: a wrong yes only
costs a row that the exact counts drop.  Products are decimals of 38 digits
(1000 a n below 10^38).

Scale: every count is a partial aggregate before its one shuffle, so a frequent
phrase or a hot language is a row per task; no group is collected; the ranking
keeps ``top`` rows a task and language before its shuffle.  To the driver come
the bitmaps, one number of languages and row counts.

Defined cases: null texts have no words, a null language is ``und``; repeated rows
count each time; ties go by a, then by the phrase's bytes; documents of any length
are cut into words where they are read; an empty table gives no rows; other input
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import keep, ship

LEAST = 100
TOP = 2000
LONGEST = 5
UNKNOWN = "und"
#: First words of up to so many times the least count are grown before more frequent ones; the last band is all others.
BANDS = (16,)
#: Bits of a bitmap that tells tasks what is frequent.
BITS = 1 << 24
#: Keys that a task works on at once.
STEP = 1 << 17

_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32, *b".,;:!?"]] = True
_ENDS = _GAPS.copy()
_ENDS[[9, 32]] = False
_ROW = np.uint64(0xD6E8FEB86659FD93)


# --- in the tasks ----------------------------------------------------------------------------------------------------
def _keys(run: W.Run, languages: np.ndarray, salt: int) -> np.ndarray:
    """Key of each word within its language, never 0."""
    keys = W.mix(run.hashes(salt) + languages[run.rows].view(np.uint64) * _ROW)
    return np.where(keys == 0, np.uint64(1), keys)


def _count_words(batches, salt: int):
    """(lang, word, h, n): the words of a run of texts with their counts."""
    for batch in batches:
        languages = batch.column("language").to_numpy()
        for run in W.runs(batch.column("text"), lower=True, gaps=_GAPS):
            keys, first, n = np.unique(_keys(run, languages[run.first:run.first + run.n], salt), return_index=True, return_counts=True)
            row = pa.array(run.rows[first] + run.first)
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(row), run.texts(first), pa.array(keys.view(np.int64)), pa.array(n)],
                                             names=["lang", "word", "h", "n"])


def _encode(batches, salt: int, frequent):
    """(seq): per text the keys of its frequent words, stretches of two and more, each ended by 0."""
    for batch in batches:
        languages = batch.column("language").to_numpy()
        for run in W.runs(batch.column("text"), lower=True, gaps=_GAPS):
            keys, rows = _keys(run, languages[run.first:run.first + run.n], salt), run.rows
            held = _holds(frequent.value, keys)
            ends = np.zeros(len(run.data) + 1, np.int64)
            np.cumsum(_ENDS[run.data], out=ends[1:])
            linked = (rows[1:] == rows[:-1]) & (ends[run.starts[1:]] == ends[run.ends[:-1]]) & held[1:] & held[:-1]
            before, after = np.append(False, linked), np.append(linked, False)
            at = np.flatnonzero(before | after)
            last = ~after[at]
            seq = np.insert(keys[at], np.flatnonzero(last) + 1, np.uint64(0))
            row = np.insert(rows[at], np.flatnonzero(last) + 1, rows[at][last])
            counts = np.bincount(row, minlength=run.n)
            yield pa.RecordBatch.from_arrays([W.list_array(seq, np.append(0, np.cumsum(counts[counts > 0])))], names=["seq"])


def _gram(parts) -> np.ndarray:
    """Hash of the phrases whose words are the columns ``parts``."""
    out = parts[0] * W._GRAM[0]
    for j, part in enumerate(parts[1:], 1):
        out = out + part * W._GRAM[j]
    return W.mix(out)


def _holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes % np.uint64(8 * len(bitmap))
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _flat(batches):
    """The sequences of a batch one after the other, about ``STEP`` keys at a time, with 0 before and behind."""
    for batch in batches:
        column = batch.column("seq")
        values, bounds = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + STEP, "right")) - 1)
            own = values[bounds[first]:bounds[last]]
            x = np.zeros(len(own) + LONGEST + 2, np.uint64)
            x[1:len(own) + 1] = own.view(np.uint64)
            yield x
            first = last


def _grow(batches, size: int, prefixes):
    """Occurrences of phrases of ``size`` words whose first ``size`` - 1 are in ``prefixes``: words, neighbours on both sides."""
    for x in _flat(batches):
        at = np.flatnonzero(x != 0)
        for j in range(1, size):
            at = at[x[at + j] != 0]
        at = at[_holds(prefixes.value, _gram([x[at + j] for j in range(size - 1)]) if size > 2 else x[at])]
        yield pa.RecordBatch.from_arrays([pa.array(x[at + j].view(np.int64)) for j in (*range(size), -1, size)],
                                         names=[*(f"h{j + 1}" for j in range(size)), "before", "after"])


def _look_up(batches, wanted, sizes):
    """Occurrences of the wanted phrases."""
    for x in _flat(batches):
        at, columns = np.flatnonzero(x != 0), []
        for size in range(2, max(sizes) + 1):
            at = at[x[at + size - 1] != 0]
            hit = at[_holds(wanted.value, _gram([x[at + j] for j in range(size)]))]
            columns.append([x[hit + j] if j < size else np.zeros(len(hit), np.uint64) for j in range(LONGEST)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*columns)], names=_names())


def _slots(batches, size: int, bits: int):
    """The bytes of the bitmap that the rows' phrases set."""
    for batch in batches:
        parts = [batch.column(f"h{j + 1}").to_numpy().view(np.uint64) for j in range(size)]
        if size == 0:  # phrases of mixed length, 0 behind their end
            wide = [batch.column(n).to_numpy().view(np.uint64) for n in _names()]
            length = sum((c != 0).astype(np.int64) for c in wide)
            hashes = np.zeros(len(batch), np.uint64)
            for n in range(2, LONGEST + 1):
                hit = length == n
                hashes[hit] = _gram([c[hit] for c in wide[:n]])
        else:
            hashes = parts[0] if size == 1 else _gram(parts)
        slot = hashes % np.uint64(bits)
        yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(3)).astype(np.int64)), pa.array(1 << (slot & np.uint64(7)).astype(np.int64))],
                                         names=["slot", "bits"])


# --- plan ---------------------------------------------------------------------------------------------------------------
def _names() -> list[str]:
    return [f"h{j + 1}" for j in range(LONGEST)]


def _bitmap(rows: DataFrame, size: int):
    """Broadcast bitmap of the phrases in ``rows`` (``size`` words each; 0: mixed); at most BITS / 8 rows reach the driver."""
    bits = BITS
    got = rows.mapInArrow(lambda it: _slots(it, size, bits), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(bits >> 3, np.uint8)
    bitmap[got["slot"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bitmap)


def _wide(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumns({n: F.lit(0).cast("long") for n in _names()[size:]})


def _count(own: DataFrame) -> tuple[DataFrame, int]:
    """All words with their counts and keys, of a hash function under which no two words meet."""
    salt = 0
    while True:
        found = own.mapInArrow(lambda it, s=salt: _count_words(it, s), "lang string, word string, h long, n long")
        counted = keep(found.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")))
        if counted.groupBy("h").count().where("count > 1").isEmpty():
            return counted, salt
        salt += 1


def _phrases(sequences: DataFrame, first: DataFrame, least: int) -> DataFrame:
    """(h1..h5, a, dropped): the frequent phrases that start with a word of ``first``."""
    grown, prefixes = [], _bitmap(first.select("h1"), 1)
    for size in range(2, LONGEST + 1):
        names = _names()[:size]
        found = sequences.mapInArrow(lambda it, s=size, p=prefixes: _grow(it, s, p), ", ".join(f"{n} long" for n in [*names, "before", "after"]))
        level = keep(found.groupBy(*names).agg(F.count("*").alias("a"), *(g(c).alias(f"{k}_{c}") for c in ("before", "after") for k, g in (("lo", F.min), ("hi", F.max))))
                     .where(F.col("a") >= least))
        same = " or ".join(f"(lo_{c} = hi_{c} and lo_{c} <> 0)" for c in ("before", "after"))
        grown.append(_wide(level, size).select(*_names(), "a", F.expr(same if size < LONGEST else "false").alias("dropped")))
        if size < LONGEST:
            if level.isEmpty():
                break
            prefixes = _bitmap(level.select(*names), size)
    out = grown[0]
    for level in grown[1:]:
        out = out.unionByName(level)
    return out


def _cuts(phrases: DataFrame) -> DataFrame:
    """One row per phrase and cut: the words of the part before (l1..) and behind (r1..)."""
    size = sum((F.col(n) != 0).cast("int") for n in _names())
    word = F.array(*_names(), *(F.lit(0).cast("long") for _ in _names()))
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumn("word", word)
    return cut.select(*_names(), "a", "k", *(F.when(F.col("k") > j, F.col(n)).otherwise(0).alias(f"l{j + 1}") for j, n in enumerate(_names())),
                      *(F.element_at("word", F.col("k") + j + 1).alias(f"r{j + 1}") for j in range(LONGEST)))


def _scored(sequences: DataFrame, phrases: DataFrame, known: DataFrame, frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, h1..h5, a, l, r, n, score) of the phrases not dropped; ``known`` are counts of phrases (words included)."""
    cuts = keep(_cuts(phrases.where("not dropped")))
    behind = cuts.where("r2 <> 0").select(*(F.col(f"r{j + 1}").alias(n) for j, n in enumerate(_names()))).distinct()
    missing = keep(behind.join(known, _names(), "left_anti"))
    if not missing.isEmpty():
        wanted = _bitmap(missing, 0)
        found = sequences.mapInArrow(lambda it: _look_up(it, wanted, (2, LONGEST - 1)), ", ".join(f"{n} long" for n in _names()))
        counts = found.groupBy(*_names()).agg(F.count("*").alias("a"))
        known = known.unionByName(keep(counts.join(missing, _names(), "left_semi")))
    for side in "lr":
        part = known.select(*(F.col(n).alias(f"{side}{j + 1}") for j, n in enumerate(_names())), F.col("a").alias(side))
        cuts = cuts.join(part, [f"{side}{j + 1}" for j in range(LONGEST)])
    cuts = cuts.join(frequent.select("h1", "lang"), "h1").join(totals, "lang")
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(a as {wide}) * cast(n as {wide}) * 1000) div (cast(l as {wide}) * cast(r as {wide}))")
    best = cuts.withColumn("score", score).groupBy("lang", *_names(), "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return keep(best.select("lang", *_names(), "a", "cut.l", "cut.r", "n", "cut.score"))


def _settled(scored: DataFrame, top: int) -> DataFrame:
    """(lang, floor): the ``top``-th score of each language that has so many."""
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc()))).where(F.col("place") <= top)
    return ranked.where(F.col("place") == top).select("lang", F.col("score").alias("floor"))


def _texts(scored: DataFrame, frequent: DataFrame) -> DataFrame:
    """``scored`` with the phrase's words."""
    rows = scored.withColumn("i", F.monotonically_increasing_id())
    spelled = (rows.select("i", F.posexplode(F.array(*_names())).alias("at", "h1")).where("h1 <> 0").join(frequent.select("h1", "word"), "h1")
               .groupBy("i").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words")))
    return rows.join(spelled, "i").withColumn("phrase", F.concat_ws(" ", F.col("words.word")))


def collocations(docs: DataFrame, text_col="text", lang_col="lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of 2 to 5 words."""
    spark = docs.sparkSession
    ship(spark)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    own = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("language"), F.col(text_col).alias("text"))
    counted, salt = _count(own)
    totals = keep(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = keep(counted.where(F.col("n") >= least).select(F.col("h").alias("h1"), "lang", "word", F.col("n").alias("f")))
    held = _bitmap(frequent.select("h1"), 1)
    sequences = keep(own.mapInArrow(lambda it: _encode(it, salt, held), "seq array<long>"))
    known = _wide(frequent.select("h1", F.col("f").alias("a")), 1).select(*_names(), "a")
    scored, floors, done = None, None, 0
    bounds = frequent.join(totals, "lang").withColumn("bound", F.expr("(cast(n as decimal(19,0)) * 1000) div f"))
    for limit in [b * least for b in BANDS] + [None]:
        band = bounds.where(F.col("f") > done) if limit is None else bounds.where((F.col("f") > done) & (F.col("f") <= limit))
        if floors is not None:  # a language with a settled list has no first word left whose bound reaches it
            band = band.join(floors, "lang", "left").where("floor is null or bound >= floor")
        first = keep(band.select("h1"))
        done = limit
        if first.isEmpty():
            continue
        phrases = keep(_phrases(sequences, first, least).join(first, "h1", "left_semi"))
        known = known.unionByName(phrases.select(*_names(), "a"))
        own_scores = _scored(sequences, phrases, known, frequent, totals)
        scored = own_scores if scored is None else scored.unionByName(own_scores)
        floors = keep(_settled(scored, top))
    if scored is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    reach = scored.join(floors, "lang", "left").where("floor is null or score >= floor").drop("floor")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = _texts(keep(reach), frequent).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
