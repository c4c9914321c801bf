"""Token-ID output as range asymmetric numeral system (rANS) files.

Documents are dealt out by id range and sorted, so partition p holds the ids
after those of partition p - 1.  Each task tokenizes its documents, appends the
end id and packs the ids in segments of about ``SEGMENT_IDS``: one static
frequency table, shared by all blocks of the segment, and independent blocks
of ``BLOCK_IDS`` ids whose id i is coded by lane i mod ``lanes``.  The block
directory is the checkpoint list: first id, word offset, lane states and CRC-32,
so any block decodes on its own.  A segment is one row of a Parquet table.

Segment bytes (little-endian): magic ``RNS1``; u32 documents, symbols, blocks;
per document i64 id, u8 id known, u32 ids; per symbol u32 symbol, u32 frequency
(sum 2**20); per block u32 ids, u32 lanes, u32 words, u32 CRC-32 of its ids as
u32; then per block its lane states as u64 and its words as u32; at the end the
CRC-32 of all bytes before it.

Scale: one shuffle of the texts (by range); a task's memory is one segment (its
ids and files once, everything else by block), or one document if that is longer.  The start of a partition is the sum of the
totals before it, a list as long as the number of partitions.

Defined cases: a null or empty text is the end id alone; null ids come last and
stay null; rows of one id are ordered by their text; an empty table gives no
files and no rows; other input columns are ignored; a damaged segment raises.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .segment_bpe import Generation, ragged
from .store import folder, ship

SEGMENT_IDS = 4 << 20
BLOCK_IDS = 1 << 20
MAX_LANES = 2048
#: Frequencies of a table sum to 2**SCALE; lane states stay in [2**31, 2**63).
SCALE = 20
LOW = np.uint64(1 << 31)
MAGIC = b"RNS1"
END_ID = 1
#: Words of a generation of a worker's memory (about 40 bytes each), and lower-case letter strings and marks kept beside it.
MEMORY_WORDS = 1_000_000
MEMORY_CORES = 500_000
#: Bytes of text tokenized at once; one longer text is a run of its own.
RUN_BYTES = 1 << 18
#: Slots (a power of two) of the table of words met last, which most words of a text are found in.
RECENT_BITS = 19

SEGMENTS = "part int, start long, n_ids long, payload binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


# --- coding -----------------------------------------------------------------------------------------------------------
def table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in use and their frequencies, scaled to a sum of 2**SCALE with at least 1 each."""
    if (most := int(ids.max(initial=0))) < 1 << 22:
        counts = np.zeros(most + 1, np.int64)
        for first in range(0, len(ids), BLOCK_IDS):
            counts += np.bincount(ids[first:first + BLOCK_IDS], minlength=most + 1)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << SCALE
    if len(symbols) > total // 2:
        raise ValueError("too many different ids for the table's scale")
    freq = np.maximum(1, counts * total // max(1, counts.sum()))
    while (over := int(freq.sum()) - total) != 0:
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        else:
            most = order[:max(1, len(order) // 4)]
            cut = np.minimum(freq[most] - 1, -(-over * freq[most] // freq[most].sum()))
            cut = np.where(np.cumsum(cut) <= over, cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
            freq[most] -= cut
    return symbols, freq


def encode_block(index: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane states and words of the symbols ``index`` (positions in the table)."""
    state = np.full(lanes, LOW, np.uint64)
    words = []
    f_all, c_all = freq[index], start[index]
    top = f_all << np.uint64(31 - SCALE + 32)
    for first in range((len(index) - 1) // lanes * lanes, -1, -lanes):
        f, c, most = f_all[first:first + lanes], c_all[first:first + lanes], top[first:first + lanes]
        x = state[:len(f)]
        full = x >= most
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:len(f)] = (q << np.uint64(SCALE)) + (x - q * f) + c
    words.reverse()
    return state, np.concatenate(words) if words else np.empty(0, np.uint32)


def decode_block(n: int, state: np.ndarray, words: np.ndarray, freq: np.ndarray, start: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Table positions of the n coded symbols."""
    lanes, at = len(state), 0
    state = state.copy()
    out = np.empty(n, np.int32)
    mask = np.uint64((1 << SCALE) - 1)
    words = words.astype(np.uint64)
    for first in range(0, n, lanes):
        x = state[:min(lanes, n - first)]
        slot = x & mask
        symbol = slots[slot]
        out[first:first + len(x)] = symbol
        x = freq[symbol] * (x >> np.uint64(SCALE)) + slot - start[symbol]
        need = np.flatnonzero(x < LOW)
        x[need] = (x[need] << np.uint64(32)) | words[at:at + len(need)]
        at += len(need)
        state[:len(x)] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("rANS block does not end in its first state")
    return out


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of one segment."""
    symbols, freq = table(ids)
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    if symbols[-1:].max(initial=0) < 1 << 22:
        place = np.zeros(int(symbols[-1:].max(initial=0)) + 1, np.int32)
        place[symbols] = np.arange(len(symbols))
    else:
        place = None
    wide = freq.astype(np.uint64)
    heads, bodies = [], []
    for first in range(0, len(ids), BLOCK_IDS):
        own = ids[first:first + BLOCK_IDS]
        lanes = int(min(MAX_LANES, max(1, len(own) // 256)))
        state, words = encode_block(np.searchsorted(symbols, own) if place is None else place[own], wide, start, lanes)
        heads.append(struct.pack("<4I", len(own), lanes, len(words), zlib.crc32(own.astype("<u4"))))
        bodies += [state.astype("<u8").tobytes(), words.astype("<u4").tobytes()]
    docs = b"".join((np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
                     np.array([d is not None for d in doc_ids], "u1").tobytes(), lengths.astype("<u4").tobytes()))
    out = [MAGIC, struct.pack("<3I", len(doc_ids), len(symbols), len(heads)), docs,
           symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), *heads, *bodies]
    crc = 0
    for part in out:
        crc = zlib.crc32(part, crc)
    return b"".join([*out, struct.pack("<I", crc)])


def unpack(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids of a segment; raises on any damage."""
    if payload[:4] != MAGIC or zlib.crc32(memoryview(payload)[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("not a whole rANS segment")
    n_docs, n_symbols, n_blocks = struct.unpack_from("<3I", payload, 4)
    at = 16

    def take(kind, n):
        nonlocal at
        got = np.frombuffer(payload, kind, n, at)
        at += got.nbytes
        return got

    doc_ids, known, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs).astype(np.int64)
    symbols, freq = take("<u4", n_symbols), take("<u4", n_symbols).astype(np.uint64)
    heads = take("<u4", 4 * n_blocks).reshape(-1, 4)
    start = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(n_symbols, dtype=np.int32), freq.astype(np.int64))
    out, done = np.empty(int(heads[:, 0].sum()), np.uint32), 0
    for n, lanes, n_words, crc in heads.tolist():
        state, words = take("<u8", lanes), take("<u4", n_words)
        ids = symbols[decode_block(n, state, words, freq, start, slots)]
        if zlib.crc32(ids.astype("<u4", copy=False)) != crc:
            raise ValueError("rANS block checksum differs")
        out[done:done + n] = ids
        done += n
    return [int(d) if k else None for d, k in zip(doc_ids, known)], lengths, out


# --- tokenizing -------------------------------------------------------------------------------------------------------
#: Words whose normal form and pieces are plain: Latin letters, with one full stop or comma at most.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


#: What ``core_ids`` and the split at white space take for granted of a tokenizer file.
ASSUMED = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of these spans (UTF-8) with Latin letters in lower case, their bounds, which spans are plain as by ``_PLAIN``, and
    which of all end in a mark after something."""
    lengths = ends - starts
    own, bounds = data[ragged(starts, lengths)], np.append(0, np.cumsum(lengths))
    folded = own | np.uint8(32)
    ascii_ = (folded >= 97) & (folded <= 122)
    # the letters from À to ÿ are 0xC3 and a second byte
    second = np.append(False, own[:-1] == 0xC3)[:len(own)] & (own >= 0x80) & (own <= 0xBF) & (own != 0x97) & (own != 0xB7)
    letter = ascii_ | second
    letter[:-1] |= (own[:-1] == 0xC3) & second[1:]
    own[(ascii_ & (own < 97)) | (second & (own <= 0x9E))] += np.uint8(32)
    last = own[bounds[1:] - 1]
    mark = ((last == ord(".")) | (last == ord(","))) & (lengths > 1)
    return own, bounds, W.per_row(letter, bounds) == lengths - mark, mark


class WordTokenizer:
    """Ids of white-space separated words by the tokenizers library, through a memory keyed by the word's hash.

    A tokenizer as in ``ASSUMED`` never joins characters across white space, so a text's
    ids are those of its words in order; any other file's texts are encoded whole.
    The memory has two generations of at most ``MEMORY_WORDS`` words: a full one becomes
    the old one, whose words move over as they are met again.
    """

    _shared: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        # the tasks of an executor are its threads; a pool of threads in each worker only takes more memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.size = max(self.whole.get_vocab(with_added_tokens=True).values()) + 1
        said = {k: json.loads(part.__getstate__()) if (part := getattr(self.whole, k)) else None for k in ASSUMED}
        added = self.whole.get_added_tokens_decoder().values()
        # added tokens are found in the raw text: one that takes in white space reaches over words
        self.by_word = said == ASSUMED and type(self.model).__name__ == "BPE" and not self.model.dropout and not any(
            t.lstrip or t.rstrip or t.single_word or t.normalized or set(t.content) & set(" \t\n\x0b\x0c\r") or _PLAIN(t.content)
            for t in added)
        self.letters = dict(enumerate(byte_letters()))
        self.old = Generation()
        self._begin()
        self.cores = Generation()

    def _begin(self):
        self.now = Generation()
        self.recent, self.recent_codes = np.zeros(1 << RECENT_BITS, np.uint64), np.full(1 << RECENT_BITS, -1, np.int32)

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def core_ids(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans of lower-case letters or of one mark, and how many each has."""
        if len(self.cores.keys) > MEMORY_CORES:
            self.cores = Generation()
        keys, first, inverse = np.unique(W.span_hashes(W._BYTE[low], starts, ends), return_index=True, return_inverse=True)
        codes = self.cores.find(keys)
        new = np.flatnonzero(codes < 0)
        if len(new):
            text, tokenize = low.tobytes().decode("latin-1").translate(self.letters), self.model.tokenize
            got = [[t.id for t in tokenize(text[a:b])] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            codes[new] = self.cores.add(keys[new], np.array([i for ids in got for i in ids], np.int32), np.array([len(ids) for ids in got], np.int64))
        return self.cores.read(codes[inverse])

    def tokenize(self, run: W.Run, data: bytes, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of these numbers, and how many each has."""
        low, bounds, plain, mark = spell(run.data, run.starts[index], run.ends[index])
        own, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        # a plain word is its letters, and a mark after some of them
        marked, cut = mark[own], bounds[own + 1] - mark[own]
        first = np.arange(len(own)) + np.cumsum(marked) - marked
        starts, ends = np.empty((2, len(own) + int(marked.sum())), np.int64)
        starts[first], ends[first] = bounds[own], cut
        starts[first[marked] + 1], ends[first[marked] + 1] = cut[marked], cut[marked] + 1
        ids, n = self.core_ids(low, starts, ends)
        texts = [data[a:b].decode() for a, b in zip(run.starts[index[odd]].tolist(), run.ends[index[odd]].tolist())]
        got = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.empty(len(index), np.int64)
        lengths[own], lengths[odd] = np.add.reduceat(n, first) if len(own) else 0, [len(x) for x in got]
        order = np.append(own, odd)
        place = np.empty(len(index), np.int64)
        place[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.append(ids, np.array([i for x in got for i in x], np.int32))[ragged(place, lengths)], lengths

    def learn(self, run: W.Run, data: bytes, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Codes of the words at these places of the run, which are added if they are new."""
        keys, first, inverse = np.unique(hashes[at], return_index=True, return_inverse=True)
        first = at[first]
        known = self.now.find(keys)
        lost = np.flatnonzero(known < 0)
        before = self.old.find(keys[lost])
        moved, new = lost[before >= 0], lost[before < 0]
        if len(moved):
            known[moved] = self.now.add(keys[moved], *self.old.read(before[before >= 0]))
        if len(new):
            known[new] = self.now.add(keys[new], *self.tokenize(run, data, first[new]))
        return known[inverse]

    def encode(self, run: W.Run) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run's rows, and the bounds of each row's."""
        data = run.data.tobytes()
        if not self.by_word:
            texts = [data[a:b].decode() for a, b in zip(run.offsets[:-1].tolist(), run.offsets[1:].tolist())]
            got = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.int64), np.append(0, np.cumsum([len(x) for x in got])).astype(np.int64)
        if len(self.now.keys) > MEMORY_WORDS:
            self.old = self.now
            self._begin()
        hashes = run.hashes()
        slot = (hashes >> np.uint64(64 - RECENT_BITS)).astype(np.int64)
        codes = np.where(self.recent[slot] == hashes, self.recent_codes[slot], -1)
        at = np.flatnonzero(codes < 0)
        if len(at):
            codes[at] = self.learn(run, data, hashes, at)
            # the word that comes last in a slot keeps it, with its own code
            self.recent[slot[at]] = hashes[at]
            kept = at[self.recent[slot[at]] == hashes[at]]
            self.recent_codes[slot[kept]] = codes[kept]
        ids, lengths = self.now.read(codes)
        return ids, np.append(0, np.cumsum(lengths))[run.bounds]


# --- files ------------------------------------------------------------------------------------------------------------
def _write(batches, path: str, end_id: int):
    tokenizer, part = WordTokenizer.shared(path), TaskContext.get().partitionId()
    kind = np.uint16 if max(tokenizer.size, end_id + 1) <= 1 << 16 else np.uint32
    docs, lengths, parts, size, start = [], [], [], 0, 0

    def flush():
        nonlocal docs, lengths, parts, size, start
        ids, parts = np.concatenate(parts), []
        payload = pack(docs, np.concatenate(lengths), ids)
        row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start]), pa.array([size]), pa.array([payload], pa.binary())],
                                         names=["part", "start", "n_ids", "payload"])
        docs, lengths, start, size = [], [], start + size, 0
        return row

    for batch in batches:
        for run in W.runs(batch.column("text"), run_bytes=RUN_BYTES):
            ids, bounds = tokenizer.encode(run)
            ids = np.insert(ids.astype(kind), bounds[1:], end_id)
            docs += batch.column("doc_id").slice(run.first, run.n).to_pylist()
            lengths.append(np.diff(bounds) + 1)
            parts.append(ids)
            size += len(ids)
            if size >= SEGMENT_IDS:
                yield flush()
    if docs:
        yield flush()


def write(docs: DataFrame, out: str, tokenizer_path: str, id_col="doc_id", text_col="text", end_id: int = END_ID) -> None:
    """Tokenize all texts and write their ids in ascending id order as segments under ``out``."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    by = F.col("doc_id").asc_nulls_last()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own.repartitionByRange(parts, by).sortWithinPartitions(by, "text")
    rows.mapInArrow(lambda it: _write(it, tokenizer_path, end_id), SEGMENTS).write.option("compression", "uncompressed").parquet(out)


def _read(batches, base: dict[int, int]):
    for batch in batches:
        for row in batch.to_pylist():
            docs, lengths, ids = unpack(row["payload"])
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array(ends - lengths + row["start"] + base[row["part"]]), pa.array(lengths),
                pa.array([zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids_crc32, decoded block by block."""
    ship(spark)
    segments = spark.read.schema(SEGMENTS).parquet(out)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per partition written
    base, total = {}, 0
    for row in totals:
        base[row["part"]] = total
        total += row["n"]
    return segments.mapInArrow(lambda it: _read(it, base), DOCUMENTS)


def write_and_read(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Write the files into the shared folder and return what they hold."""
    out = folder(docs.sparkSession)
    write(docs, out, tokenizer_path, id_col, text_col)
    return read(docs.sparkSession, out)
