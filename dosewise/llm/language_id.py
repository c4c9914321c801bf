"""Language ID by a bit-sliced Bloom filter over language bitmasks.

Each language's frequent character trigrams (share of its trigrams in the
training texts at least ``MIN_SHARE``) are its set.  One filter holds all sets:
a slot is a bitmask with one bit per language (a column of masks, 8 MB, for every
64 languages), a trigram sets its languages' bits in ``HASHES`` slots, and the AND
of these slots returns all languages that contain it.  A text's popcount per language, corrected for that language's false
positives, decides.

Scale: trigrams are counted over all training texts, pre-aggregated per task and
partially before the shuffle.  A set has 1/MIN_SHARE trigrams at most, so the
filter's size is bounded whatever the corpus; texts are never shuffled.

Defined cases: a null text or one without a letter is ``und`` with score 0; with
no training rows every text is ``und``; if no trigram is known, the language with
most training trigrams is named with score 0; ties go to the language that sorts
first; rows with a null id or language don't train; held_out is false for a null
id; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import letters
from .store import keep, ship
from .words import _GRAM, mix
from .worker import tidy

GRAM = 3
MIN_SHARE = 2e-5
SLOTS = 1 << 20
HASHES = 4
#: Bytes of an Arrow batch of training texts.
BATCH_BYTES = 4 << 20
HELD_OUT = 2  # of 4, by crc32 of the id
UNKNOWN = "und"


def remainder(id_col: str):
    """crc32(id as text) mod 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def _slots(gram: np.ndarray) -> list[np.ndarray]:
    return [(mix(gram ^ _GRAM[50 + j]) & np.uint64(SLOTS - 1)).astype(np.int64) for j in range(HASHES)]


def _count(batches):
    """Trigram counts per language of all texts of a task."""
    found: dict[str, list] = {}

    def merge(parts):
        grams, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        uniq, inverse = np.unique(grams, return_inverse=True)
        return uniq, np.bincount(inverse, counts, len(uniq)).astype(np.int64)

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, folded, row, n in letters.runs(x.as_py() for x in batch.column("text")):
            gram, own = letters.grams(folded, row, GRAM)
            lang = langs[first:first + n]
            for name in set(lang.tolist()):
                parts = found.setdefault(name, [])
                parts.append(np.unique(gram[(lang == name)[own]], return_counts=True))
                if len(parts) > 64:
                    parts[:] = [merge(parts)]
    for name, parts in found.items():
        gram, count = merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(count)],
                                         names=["lang", "gram", "n"])


class Filter:
    """The bit-sliced filter: languages, slot masks and each language's false-positive rate."""

    def __init__(self, langs: list[str], gram: np.ndarray, bit: np.ndarray, sizes: list[int]):
        self.langs = langs
        self.prior = int(np.argmax(sizes)) if langs else 0
        self.masks = np.zeros((-(-len(langs) // 64), SLOTS), np.uint64)
        for slot in _slots(gram):
            np.bitwise_or.at(self.masks, (bit // 64, slot), np.uint64(1) << (bit % 64).astype(np.uint64))
        fill = [np.count_nonzero(self.masks[j // 64] >> np.uint64(j % 64) & np.uint64(1)) / SLOTS for j in range(len(langs))]
        self.false = np.array(fill) ** HASHES

    def counts(self, gram: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected number of trigrams per text and language, and all trigrams per text."""
        slots = _slots(gram)
        total = np.bincount(row, minlength=n)
        hits = np.empty((n, len(self.langs)))
        for c, masks in enumerate(self.masks):
            mask = masks[slots[0]]
            for slot in slots[1:]:
                mask &= masks[slot]
            for j in range(min(64, len(self.langs) - 64 * c)):
                hits[:, 64 * c + j] = np.bincount(row, (mask >> np.uint64(j) & np.uint64(1)).astype(float), n)
        return np.maximum(0, (hits - total[:, None] * self.false) / (1 - self.false)), total

    def decide(self, texts: Iterable) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for _, folded, row, n in letters.runs(texts):
            gram, own = letters.grams(folded, row, GRAM)
            total = np.bincount(own, minlength=n)
            if not self.langs:
                names += [UNKNOWN] * n
                scores.append(np.zeros(n))
                continue
            counts, total = self.counts(gram, own, n)
            best = np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), self.prior)
            names += [self.langs[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist())]
            scores.append(np.where(total > 0, np.minimum(1, counts.max(axis=1) / np.maximum(1, total)), 0.0))
        return names, np.concatenate(scores) if scores else np.empty(0)


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", min_share: float = MIN_SHARE) -> Filter:
    """Learn the languages' sets from the documents that aren't held out."""
    ship(docs.sparkSession)
    train = docs.where(F.col(id_col).isNotNull() & (remainder(id_col) != HELD_OUT) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    train = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = keep(train.mapInArrow(lambda it: tidy(_count(it)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), batch_bytes=BATCH_BYTES)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    # at most 1 / min_share rows per language
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(totals[lang]))]) if langs else None
    rows = counts.where(F.col("n") >= min_share * share[F.col("lang")]).select("lang", "gram").toPandas() if langs else None
    gram = rows["gram"].to_numpy(np.int64).view(np.uint64) if langs else np.empty(0, np.uint64)
    bit = rows["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy(np.int64) if langs else np.empty(0, np.int64)
    return Filter(langs, gram, bit, [totals[x] for x in langs])


def predict(docs: DataFrame, model: Filter, id_col="doc_id", text_col="text") -> DataFrame:
    """All input columns with held_out, lang_pred and score added (replaced where they exist)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("held_out", "lang_pred", "score").withColumn("held_out", F.coalesce(remainder(id_col) == HELD_OUT, F.lit(False)))
    schema = StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        for batch in batches:
            names, scores = shared.value.decide(x.as_py() for x in batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(lambda it: tidy(run(it)), schema)


def language_id(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    return predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
