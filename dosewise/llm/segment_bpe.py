"""Byte-level BPE encoding and decoding with segment trees of pair ranks.

A piece of text (one match of the split pattern) is a row of byte positions.  A
segment tree over the positions stores in each node the leftmost minimum rank
of the pairs below it; the root names the next merge.  A merge joins the
position with its next live neighbour and updates the tree at three points (the
merged position, its left neighbour, the dead one), each in log(width) steps.
Many pieces of like width are worked on together, one tree per row of a matrix,
so each numpy step advances all of them by one merge.

Scale: documents are encoded where they are read; no shuffle.  Each distinct
piece is merged once per worker while it stays in a bounded memory
(``MEMORY_PIECES``; full memories are emptied, which costs time, never results).

Defined cases: a null or empty text has no ids (digests of empty bytes); very
long pieces get a tree of their own width; repeated rows and null ids pass
through; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .worker import tidy

#: Distinct pieces that a worker remembers at once.
MEMORY_PIECES = 400_000
#: Matrix cells of one batch of trees.
TREE_CELLS = 1 << 19
#: Rows of a text batch are encoded together up to so many characters.
CHUNK_CHARS = 500_000
NONE = np.int64(1) << 40


class Ranks:
    """A rank file as tables: token bytes, single bytes, and all mergeable pairs of ids."""

    _loaded: dict[str, Ranks] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ids.values()) + 1
        tokens = [b""] * self.size
        for token, rank in self.ids.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.append(0, np.cumsum(self.lengths))[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ids.items():
            for i in range(1, len(token)):
                a, b = self.ids.get(token[:i]), self.ids.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    @classmethod
    def load(cls, path: str) -> Ranks:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of ids a and b; NONE where they don't merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and the bounds of each piece's."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        known = np.array([self.ids.get(p, -1) for p in pieces], np.int64)
        whole, todo = np.flatnonzero(known >= 0), np.flatnonzero(known < 0)
        owners, found, counts = [whole], [known[whole]], [np.ones(len(whole), np.int64)]
        width = 4
        while len(todo):
            fits = todo[lengths[todo] <= width]
            todo = todo[lengths[todo] > width]
            step = max(1, TREE_CELLS // width)
            for j in range(0, len(fits), step):
                own = fits[j:j + step]
                ids, n = self._trees([pieces[i] for i in own], lengths[own], width)
                owners.append(own)
                found.append(ids)
                counts.append(n)
            width *= 2
        order, n, ids = np.concatenate(owners), np.concatenate(counts), np.concatenate(found)
        size, start = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        size[order], start[order] = n, np.cumsum(n) - n
        return ids[ragged(start, size)], np.append(0, np.cumsum(size))

    def _trees(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(pieces)
        live = np.arange(width) < lengths[:, None]
        ids = np.zeros((rows, width), np.int64)
        ids[live] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 1), (rows, 1))
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        # node 1 is the root, leaves start at `width`; a value holds rank and position, so the least is the leftmost minimum
        tree = np.full((rows, 2 * width), NONE * width, np.int64)
        rank = self.pair(ids[:, :-1], ids[:, 1:])
        rank[~live[:, 1:]] = NONE
        tree[:, width:2 * width - 1] = rank * width + np.arange(width - 1)
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        at = np.flatnonzero(tree[:, 1] < NONE * width)

        def update(r, pos, value):
            node = width + pos
            tree[r, node] = value
            while width > 1 and node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        def pair_at(r, pos):
            """Tree value of the pair that starts at pos, if it has a right neighbour."""
            nxt = after[r, pos]
            inside = nxt < lengths[r]
            value = self.pair(ids[r, pos], ids[r, np.where(inside, nxt, 0)])
            return np.where(inside & (value < NONE), value * width + pos, NONE * width)

        while len(at):
            top = tree[at, 1]
            pos = top % width
            dead = after[at, pos]
            ids[at, pos] = top // width
            live[at, dead] = False
            follow = after[at, dead]
            after[at, pos] = follow
            some = follow < width
            before[at[some], follow[some]] = pos[some]
            update(at, dead, NONE * width)
            update(at, pos, pair_at(at, pos))
            left = before[at, pos]
            has = left >= 0
            if has.any():
                update(at[has], left[has], pair_at(at[has], left[has]))
            at = at[tree[at, 1] < NONE * width]
        return ids[live], live.sum(axis=1)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges start..start + length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def _put(array: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """The array with ``more`` after its first n values; a full one is copied to one of twice the size."""
    if n + len(more) > len(array):
        old, array = array, np.empty(max(2 * len(array), n + len(more)), array.dtype)
        array[:n] = old[:n]
    array[n:n + len(more)] = more
    return array


class Generation:
    """Keys (sorted) with their id sequences, read and added to in bulk."""

    def __init__(self):
        self.keys = np.empty(0, np.uint64)
        self.codes = np.empty(0, np.int32)
        self.n_ids = 0
        self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int32)
        self.ids = np.empty(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Code of each key, -1 if unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.codes[at], -1)

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Codes of new keys (sorted) and their concatenated ids."""
        n = len(self.keys)
        codes = np.arange(n, n + len(keys), dtype=np.int32)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.codes = np.insert(self.keys, at, keys), np.insert(self.codes, at, codes)
        if self.n_ids + len(ids) > np.iinfo(self.starts.dtype).max:
            self.starts = self.starts.astype(np.int64)
        self.starts = _put(self.starts, n, self.n_ids + np.cumsum(lengths) - lengths)
        self.lengths, self.ids = _put(self.lengths, n, lengths), _put(self.ids, self.n_ids, ids)
        self.n_ids += len(ids)
        return codes

    def read(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[codes].astype(np.int64)
        return self.ids[ragged(self.starts[codes].astype(np.int64), lengths)], lengths


def _hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, keys), np.int64, len(keys)).view(np.uint64)


class Memory(Generation):
    """Strings, told apart by Python's own 64-bit hash, with their id sequences; the strings themselves are not kept."""

    def new(self, texts: list[str]) -> list[str]:
        distinct = list(dict.fromkeys(texts))
        return [distinct[i] for i in np.flatnonzero(self.find(_hashes(distinct)) < 0).tolist()]

    def learn(self, texts: list[str], ids: np.ndarray, bounds: np.ndarray):
        """Add new strings with all their ids and the bounds of each one's."""
        keys = _hashes(texts)
        order, lengths = np.argsort(keys), np.diff(bounds)
        self.add(keys[order], ids[ragged(bounds[:-1][order], lengths[order])], lengths[order])

    def get(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, and the bounds of each one's."""
        ids, lengths = self.read(self.find(_hashes(texts)))
        return ids, np.append(0, np.cumsum(lengths))


#: A space before more white space or the end: there the pattern looks across it.
_JOINED = re.compile(r" (?=\s|\Z)")


class Encoder:
    """Encodes texts through a bounded memory of merged pieces.

    With the default pattern a space between two words always opens a piece, so
    a text is cut at its spaces and each distinct word (with its space) is split
    by the pattern once; texts with joined white space are split as a whole.
    """

    _shared: dict[tuple, Encoder] = {}

    def __init__(self, path: str, pattern: str, memory: int = MEMORY_PIECES):
        self.ranks, self.find, self.memory = Ranks.load(path), regex.compile(pattern).findall, memory
        self.by_space = pattern == public_tokenizers.PATTERN
        self.pieces, self.words = Memory(), Memory()

    @classmethod
    def shared(cls, path: str, pattern: str) -> Encoder:
        """The worker's own encoder, whose memory serves all of its tasks."""
        if (path, pattern) not in cls._shared:
            cls._shared[path, pattern] = cls(path, pattern)
        return cls._shared[path, pattern]

    def words_of(self, text: str) -> list[str]:
        """Keys of the text's words: the word itself after a space, else a space and the text as it stands."""
        if not self.by_space or _JOINED.search(text):
            return [" " + p for p in self.find(text)]
        words = text.split(" ")
        words[0] = " " + words[0]
        return words

    def learn(self, keys: list[str]):
        found = [self.find(k[1:] if k[:1] == " " else " " + k) for k in keys]
        flat = [p for pieces in found for p in pieces]
        new = self.pieces.new(flat)
        if new:
            self.pieces.learn(new, *self.ranks.merge([p.encode() for p in new]))
        ids, bounds = self.pieces.get(flat)
        self.words.learn(keys, ids, bounds[np.append(0, np.cumsum([len(p) for p in found])).astype(np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the bounds of each text's."""
        words = [self.words_of(t) for t in texts]
        flat = [w for own in words for w in own]
        if len(self.words.codes) > self.memory or len(self.pieces.codes) > self.memory:
            self.pieces, self.words = Memory(), Memory()
        new = self.words.new(flat)
        if new:
            self.learn(new)
        ids, bounds = self.words.get(flat)
        return ids, bounds[np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)]


SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _chunks(column):
    """Runs of rows (first, texts) of about CHUNK_CHARS characters."""
    first, texts, size = 0, [], 0
    for text in column:  # one Python text at a time: a batch as a list is as large as all its texts
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK_CHARS:
            yield first, texts
            first, texts, size = first + len(texts), [], 0
    if texts:
        yield first, texts


def _encode(batches, path: str, pattern: str, digests: bool):
    encoder = Encoder.shared(path, pattern)
    for batch in batches:
        for first, texts in _chunks(batch.column("text")):
            ids, bounds = encoder.encode(texts)
            own = batch.column("doc_id").slice(first, len(texts))
            decoded = [encoder.ranks.decode(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            if digests:
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([
                    own, pa.array(np.diff(bounds)),
                    pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([
                    own, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.array([x.decode("utf-8", "replace") for x in decoded], pa.string())], names=["doc_id", "ids", "decoded"])


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col="doc_id", text_col="text") -> DataFrame:
    """Per input row: doc_id, its ids, and the text decoded from them."""
    return _own(docs, id_col, text_col).mapInArrow(lambda it: tidy(_encode(it, ranks_path, pattern, False)), SCHEMA)


def digests(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col="doc_id", text_col="text") -> DataFrame:
    """Per input row: doc_id, n_tokens and the SHA-256 of the ids (little-endian 32 bit) and of the decoded bytes."""
    return _own(docs, id_col, text_col).mapInArrow(lambda it: tidy(_encode(it, ranks_path, pattern, True)), DIGESTS)
