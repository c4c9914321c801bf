"""Periodic runs of words, by longest common extensions in two suffix trees.

A run is a stretch of words with smallest period q and at least ``exponent`` periods
(and ``least`` words) that no neighbouring word extends.

1. Zones.  A run of L words has the ``gram`` words that start q words after its
   start already at its start (L - q >= gram, by its exponent), so a run lies
   between stretches of repeated grams, at most (m + gram - 1) / (exponent - 1)
   words before a stretch of m.  Words outside such zones are in no run; zones that
   overlap are one.
2. Trees.  The zones' words, each zone ended by a symbol of its own, make one string;
   Ukkonen's algorithm builds its suffix tree and that of the zones reversed.  A
   walk over the tree gives its Euler tour, whose least depth between two
   leaves, read from a table of block minima in constant time, is the length
   of the longest common extension (LCE) of two suffixes.
3. Roots.  The leaves' order is that of the suffixes; the longest Lyndon word that
   starts at i ends where the next smaller suffix starts.  Every run has such a
   word as its root, in the order of symbols or in the reversed one.  Both give
   candidates (i, j), extended to the right by LCE(i, j), to the left by the LCE of
   the reversed tree, and kept if long enough.  Equal results are one run.

Scale: texts are worked on where they are read; no shuffle, nothing broadcast.
Trees hold ``TREE_WORDS`` words, or one zone if that is longer.

Defined cases: a null text, or one without words, has no runs and collapses to the empty
text; documents shorter than ``least`` have no runs; a text of any length is one row; repeated
rows and null ids pass through, each with its own result; an empty table gives an
empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .segment_bpe import ragged
from .store import ship

LEAST = 24
EXPONENT = 3
#: Words of the zones that share a tree.
TREE_WORDS = 1 << 15
BLOCK = 16


# --- suffix tree ----------------------------------------------------------------------------------------------------
def ukkonen(text: list[int], symbols: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Suffix tree of a text whose last symbol occurs once: edge labels text[start:end] by node, and children by node * symbols + symbol."""
    n = len(text)
    start, end, link, child = [0], [0], [0], {}
    node = at = length = pending = 0
    for i, symbol in enumerate(text):
        pending += 1
        fresh = 0
        while pending:
            if not length:
                at = i
            key = node * symbols + text[at]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                first = start[below]
                size = end[below] - first
                if length >= size:
                    at += size
                    length -= size
                    node = below
                    continue
                if text[first + length] == symbol:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                inner = len(start)
                child[key] = inner
                start += (first, i)
                end += (first + length, n)
                link += (0, 0)
                child[inner * symbols + symbol] = inner + 1
                start[below] = first + length
                child[inner * symbols + text[first + length]] = below
                if fresh:
                    link[fresh] = inner
                fresh = inner
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - pending + 1
    return start, end, child


class Minima:
    """Least value between two places of an array in constant time: minima of blocks in a sparse table, running minima inside blocks."""

    def __init__(self, values: np.ndarray):
        blocks = np.full((len(values) // BLOCK + 1, BLOCK), np.iinfo(np.int32).max, np.int32)
        self.flat = blocks.reshape(-1)
        self.flat[:len(values)] = values
        self.before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        levels = [blocks.min(axis=1)]
        while (step := 1 << len(levels) - 1) * 2 <= len(levels[0]):
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        self.levels = np.zeros((len(levels), len(levels[0])), np.int32)
        for k, level in enumerate(levels):
            self.levels[k, :len(level)] = level

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.behind[low], self.before[high])
        far = np.flatnonzero(last - first > 1)
        if len(far):
            a, b = first[far] + 1, last[far]
            k = np.frexp((b - a).astype(np.float64))[1] - 1
            out[far] = np.minimum(out[far], np.minimum(self.levels[k, a], self.levels[k, b - (1 << k)]))
        near = np.flatnonzero(first == last)
        if len(near):
            at = low[near]
            least = self.flat[at]
            for _ in range(BLOCK - 1):
                at = np.minimum(at + 1, high[near])
                least = np.minimum(least, self.flat[at])
            out[near] = least
        return out


class SuffixTree:
    """Order of the suffixes, and their longest common extensions, of a text whose first ``ends`` symbols each occur once."""

    def __init__(self, text: np.ndarray, symbols: int, ends: int):
        self.n, self.symbols, self.ends = len(text), symbols, ends
        start, end, child = ukkonen(text.tolist(), symbols)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self.below = np.fromiter(child.values(), np.int64, len(child))
        self.above, self.symbol = keys // symbols, keys % symbols
        self.lengths = (np.array(end) - np.array(start)).tolist()
        self._tour()

    def _children(self, reverse: bool):
        """Children of all nodes, last first, and their bounds by node."""
        order = np.where(self.symbol < self.ends, self.symbol, self.symbols - 1 + self.ends - self.symbol) if reverse else self.symbol
        by = np.lexsort((-order, self.above))
        return self.below[by].tolist(), np.searchsorted(self.above[by], np.arange(len(self.lengths) + 1)).tolist()

    def _tour(self):
        below, bounds = self._children(False)
        depth, met, tour, leaves = [0] * len(self.lengths), [0] * len(self.lengths), [], []
        stack = [0]
        while stack:
            node = stack.pop()
            if node < 0:  # back from a child
                tour.append(depth[~node])
                continue
            met[node] = len(tour)
            here = depth[node]
            tour.append(here)
            a, b = bounds[node], bounds[node + 1]
            if a == b:
                leaves.append(node)
            for inner in below[a:b]:
                depth[inner] = here + self.lengths[inner]
                stack += (~node, inner)
        self.minima = Minima(np.array(tour, np.int32))
        self.depth = depth
        leaves = np.array(leaves)
        suffix = self.n - np.array(depth)[leaves]
        self.place = np.zeros(self.n, np.int64)
        self.place[suffix] = np.array(met)[leaves]
        self.rank = np.zeros(self.n, np.int64)
        self.rank[suffix] = np.arange(self.n)

    def reversed_rank(self) -> np.ndarray:
        """Ranks of the suffixes when all symbols but the ends are ordered the other way round."""
        below, bounds = self._children(True)
        rank, stack, n = np.zeros(self.n, np.int64), [0], self.n
        suffixes = []
        while stack:
            node = stack.pop()
            a, b = bounds[node], bounds[node + 1]
            if a == b:
                suffixes.append(n - self.depth[node])
            else:
                stack += below[a:b]
        rank[suffixes] = np.arange(n)
        return rank

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b (a differs from b)."""
        x, y = self.place[a], self.place[b]
        return self.minima.between(np.minimum(x, y), np.maximum(x, y)).astype(np.int64)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """Start of the next smaller suffix: the end of the longest Lyndon word at each place."""
    values, out, stack = rank.tolist(), [0] * len(rank), []
    for i in range(len(values) - 1, -1, -1):
        own = values[i]
        while stack and values[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1] if stack else len(values)
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(zones: list[list], least: int, exponent: int) -> list[np.ndarray]:
    """Per zone (a list of words) its runs as rows (start, length, period), by start and period."""
    codes = {}
    for zone in zones:
        for word in zone:
            codes.setdefault(word, len(zones) + len(codes))
    sizes = np.array([len(z) for z in zones])
    first = np.cumsum(sizes + 1) - sizes - 1  # a zone's words, then its end
    symbols = len(zones) + len(codes)
    text = np.fromiter((c for k, zone in enumerate(zones) for c in (*map(codes.get, zone), k)), np.int64, int((sizes + 1).sum()))
    zone = np.repeat(np.arange(len(zones)), sizes + 1)
    inside = np.arange(len(text)) - first[zone] < sizes[zone]
    mirror = np.where(inside, 2 * first[zone] + sizes[zone] - 1 - np.arange(len(text)), np.arange(len(text)))
    left = SuffixTree(text[mirror], symbols, len(zones))
    right = SuffixTree(text, symbols, len(zones))
    found = []
    for rank in (right.rank, right.reversed_rank()):
        j = next_smaller(rank)
        i = np.flatnonzero(inside & (exponent * (j - np.arange(len(text))) <= sizes[zone]))
        i = i[inside[j[i]]]
        j = j[i]
        after = right.extension(i, j)
        before = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > first[zone[i]])
        before[inner] = left.extension(mirror[i[inner] - 1], mirror[j[inner] - 1])
        period, length = j - i, j + after - (i - before)
        held = length >= np.maximum(least, exponent * period)
        found.append(np.stack([zone[i], i - before - first[zone[i]], period, length], axis=1)[held])
    rows = np.unique(np.concatenate(found), axis=0)
    cut = np.searchsorted(rows[:, 0], np.arange(len(zones) + 1))
    return [rows[a:b][:, [1, 3, 2]] for a, b in zip(cut[:-1], cut[1:])]


# --- texts --------------------------------------------------------------------------------------------------------------
def planted(run: W.Run, marks: np.ndarray) -> np.ndarray:
    """Place of each word when rows whose mark ends in 0 go on periodically: i becomes a + (i - a) % p from word a on (marks below 0: unchanged)."""
    n = np.diff(run.bounds)
    g = marks // 10
    a = g % np.maximum(n, 1)
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(len(run.starts))
    at = ragged((run.bounds[:-1] + a)[(marks % 10 == 0) & (marks >= 0) & (n > 0)], (n - a)[(marks % 10 == 0) & (marks >= 0) & (n > 0)])
    row = run.rows[at]
    begin = run.bounds[row] + a[row]
    place[at] = begin + (at - begin) % p[row]
    return place


def zones(hashes: np.ndarray, rows: np.ndarray, bounds: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (word numbers of the run of texts) of the zones that hold all runs."""
    gram = least - least // exponent
    keys, at = W.grams(hashes, rows, gram)
    keys = W.mix(keys + rows[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    at = at[again]
    if not len(at):
        return at, at
    opens = np.append(True, (np.diff(at) > 1) | (rows[at[1:]] != rows[at[:-1]]))
    first = at[opens]
    last = at[np.append(opens[1:], True)]
    m = last - first + 1
    low = np.maximum(first - (m + gram - 1) // (exponent - 1), bounds[rows[first]])
    high = np.minimum(last + gram, bounds[rows[first] + 1])
    # a zone may reach back over earlier ones, so join from the right
    low = np.minimum.accumulate(low[::-1])[::-1]
    high = np.maximum.accumulate(high)
    opens = np.append(True, low[1:] >= high[:-1])
    return low[opens], high[np.append(opens[1:], True)]


def _find(batches, least: int, exponent: int, with_text: bool):
    for batch in batches:
        marks = batch.column("mark").to_numpy(zero_copy_only=False)
        for run in W.runs(batch.column("text")):
            data, own = run.data.tobytes(), marks[run.first:run.first + run.n]
            place = planted(run, own)
            rows = run.rows
            low, high = zones(run.hashes()[place], rows, run.bounds, least, exponent)
            found: list[list] = [[] for _ in range(run.n)]
            waiting, size = [], 0

            def settle():
                for (a, _), got in zip(waiting, runs_of([w for _, w in waiting], least, exponent)):
                    row = int(rows[a])
                    found[row] += [(a - int(run.bounds[row]) + s, n, p) for s, n, p in got.tolist()]

            for a, b in zip(low.tolist(), high.tolist()):
                at = place[a:b]
                waiting.append((a, [data[x:y] for x, y in zip(run.starts[at].tolist(), run.ends[at].tolist())]))
                size += b - a
                if size >= TREE_WORDS:
                    settle()
                    waiting, size = [], 0
            if waiting:
                settle()
            out = []
            for i in range(run.n):
                words, runs = data[run.offsets[i]:run.offsets[i + 1]].split(), found[i]
                if own[i] >= 0 and own[i] % 10 == 0:
                    words = [words[k] for k in (place[run.bounds[i]:run.bounds[i + 1]] - run.bounds[i]).tolist()]
                best = (None,) * 4
                if runs:
                    runs.sort(key=lambda r: (r[0], r[2]))
                    s, n, p = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
                    best = s, n, p, 1000 * n // p
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s, n, p in runs:
                        gone[s + p] += 1
                        gone[s + n] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                text = b" ".join(words)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                out.append((len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(),
                            *((runs, text.decode()) if with_text else ())))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.string()] * 2)]
            names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if with_text:
                kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
                columns += [pa.array([[dict(zip(("start", "length", "period"), r)) for r in o[7]] for o in out], kind), pa.array([o[8] for o in out], pa.string())]
                names += ["runs", "collapsed_text"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(run.first, run.n), *columns], names=["doc_id", *names])


def periodic_runs(docs: DataFrame, id_col="doc_id", text_col="text", least: int = LEAST, exponent: int = EXPONENT, plant: bool = False,
                  with_text: bool = False) -> DataFrame:
    """Per input row: doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli), and digests of all
    runs and of the words that no run repeats; ``with_text``: also the runs and the collapsed text.  ``plant`` first makes the
    texts of a tenth of the ids periodic from some word on, as ``planted`` says."""
    ship(docs.sparkSession)
    mark = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")).cast("long"), F.lit(-1)) if plant else F.lit(-1)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), mark.cast("long").alias("mark"))
    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed_text string" if with_text else ""
    return own.mapInArrow(lambda it: _find(it, least, exponent, with_text), "doc_id long, n_runs long, start long, length long, period long, "
                          "exponent_milli long, runs_sha256 string, collapsed_sha256 string" + more)
