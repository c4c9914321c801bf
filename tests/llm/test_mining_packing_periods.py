"""Phrase mining, retrieval packing and periodic runs against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import edge_rows, prose, table, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dosewise.llm import periodic_runs, phrase_mining
from dosewise.llm import retrieval_packing as R

WORDS = public_tokenizers.path("word_bpe_49k.json")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- phrase mining
def brute_phrases(rows, least, top):
    counts = defaultdict(Counter)
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(r[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                counts[r[2] or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in counts.items():
        n = sum(v for k, v in count.items() if len(k) == 1)
        f = {k: v for k, v in count.items() if v >= least}
        dead = {k[i:j] for k, v in f.items() for i in range(len(k)) for j in range(i + 2, len(k) + 1) if j - i < len(k) and v >= f[k[i:j]]}
        best = []
        for k, a in f.items():
            if len(k) > 1 and k not in dead:
                score, cut = min((1000 * a * n // (f[k[:i]] * f[k[i:]]), i) for i in range(1, len(k)))
                best.append((-score, -a, " ".join(k).encode(), f[k[:cut]], f[k[cut:]]))
        out += [(lang, i + 1, b[2].decode(), -b[1], b[3], b[4], n, -b[0]) for i, b in enumerate(sorted(best)[:top])]
    return sorted(out)


def phrase_rows(seed):
    rnd = random.Random(seed)
    fixed = [prose(rnd, n, 10**6) for n in (2, 3, 4, 5, 6, 9)]
    rows = [(*r, "en", "s0")[:4] if len(r) == 2 else r for r in edge_rows()]
    for i in range(60):
        parts = [rnd.choice([prose(rnd, rnd.randrange(1, 8), 12), rnd.choice(fixed), "É d'un MOT", "tab\tbed,next;x"]) for _ in range(30)]
        rows.append((1000 + i, rnd.choice([" ", ". ", ",", "\n", "\x0b"]).join(parts), rnd.choice(["en", "fr", None, "und"]), "s1"))
    return rows


@pytest.mark.parametrize("least,top,bands", [(5, 40, (2, 4)), (6, 3, (1, 2, 4))])
def test_phrases_match_brute_force(spark, monkeypatch, least, top, bands):
    monkeypatch.setattr(phrase_mining, "BANDS", bands)
    rows = phrase_rows(least)
    got = phrase_mining.collocations(table(spark, rows), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, top)


def test_phrases_of_small_bitmaps_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "BITS", 64)  # nearly every bit is set: false members have to fall to the counts
    rows = phrase_rows(9)
    assert sorted(map(tuple, phrase_mining.collocations(table(spark, rows), least=4, top=50).collect())) == brute_phrases(rows, 4, 50)
    assert phrase_mining.collocations(table(spark, rows).limit(0)).count() == 0
    assert phrase_mining.collocations(table(spark, [(1, None), (2, "")])).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    known = spark.createDataFrame([(3 * 10**12, 7 * 10**13, 2 * 10**13, 5 * 10**12)], "a long, n long, l long, r long")
    wide = "decimal(19,0)"
    got = known.select(F.expr(f"(cast(a as {wide}) * cast(n as {wide}) * 1000) div (cast(l as {wide}) * cast(r as {wide}))").alias("s")).first()
    assert got.s == 1000 * 3 * 10**12 * 7 * 10**13 // (2 * 10**13 * 5 * 10**12)


# --- retrieval packing
def checked_sequences(rows, got, window, end_id=2):
    """Sequences of the pieces, after a look at every rule of their form."""
    library = Tokenizer.from_file(WORDS)
    texts = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, end_id])) for r in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        assert len(p.ids) == p.length > 0 and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for doc, own in pieces.items():
        wanted = Counter()
        for (d, ids), n in texts.items():
            if d == doc:
                for start in {p.start for p in own}:
                    for p in own:
                        if p.start == start and p.doc_tokens == len(ids) and tuple(p.ids) == ids[start:start + p.length]:
                            wanted[ids] += p.length
        assert sum(p.length for p in own) == sum(len(ids) * n for (d, ids), n in texts.items() if d == doc)
        if sum(n for (d, _), n in texts.items() if d == doc) == 1:
            ids, = [ids for d, ids in texts if d == doc]
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids) and tuple(p.ids) == ids[at:at + p.length]
                at += p.length
            assert at == len(ids)
    assert {d for d, _ in texts} == set(pieces)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at == window or (at < window and at & (at - 1) == 0)
    return sequences


@pytest.mark.parametrize("wide", [False, True])
def test_terms_and_heaviest_terms_in_small_pieces(monkeypatch, wide):
    monkeypatch.setattr(R, "SORTED_IDS", 50)
    rnd = random.Random(4)
    docs = [[rnd.randrange(12) for _ in range(rnd.choice([0, 1, 2, 9, 40, 130]))] for _ in range(80)]
    ids = np.array([i for d in docs for i in d], R._kind(wide))
    row, term, count = R._terms(ids, np.append(0, np.cumsum([len(d) for d in docs])))
    assert list(zip(row.tolist(), term.tolist(), count.tolist())) == [(r, t, n) for r, d in enumerate(docs) for t, n in sorted(Counter(d).items())]
    idf = np.array([0.0, 1, 1, 1, 2, 2, 0.5, 0.5, 3, 1, 1, 0])  # equal weights: the smaller term
    want = [([*sorted(n, key=lambda t: (-idf[t] * n[t] / (n[t] + R.K1), t)), -1, -1, -1][:R.TOPICS]) for n in map(Counter, docs)]
    batch = pa.RecordBatch.from_arrays([pa.array([np.array(d, R._kind(wide)).tobytes() for d in docs], pa.binary())], names=["ids"])
    (got,) = R._topics([batch], wide, SimpleNamespace(value=idf))
    assert [list(x) for x in zip(*[got.column(k).to_pylist() for k in R.KEYS])] == want
    (none,) = R._topics([batch.slice(0, 0)], wide, SimpleNamespace(value=idf))
    assert none.num_rows == 0 and len(R._terms(ids[:0], np.zeros(1, np.int64))[0]) == 0


@pytest.mark.parametrize("window,shard", [(64, 7), (4096, 1024)])
def test_packing_covers_every_id_once(spark, window, shard):
    rows = edge_rows() + [(100 + i, t) for i, t in enumerate(["a <|endoftext|> b", "<|startoftext|>", "don't. Stop! \u00e9\u0301 \u4e2d\u6587 x1y22"])]
    got = R.pack(table(spark, rows).repartition(3), WORDS, window=window, shard_docs=shard, with_ids=True).collect()
    sequences = checked_sequences(rows, got, window)
    assert sum(sum(p.length for p in own) < window for own in sequences.values()) <= 13  # powers of two at the end of the only range
    assert R.pack(table(spark, rows).limit(0), WORDS).count() == 0
    assert R.pack(table(spark, rows), WORDS).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_packing_in_several_ranges_is_the_same_on_each_run(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE_LEAST", 500)
    rnd = random.Random(6)
    rows = [(i, prose(rnd, rnd.randrange(1, 300), 60)) for i in range(60)]
    one, two = (sorted(map(tuple, R.pack(table(spark, rows).repartition(n), WORDS, window=256).collect())) for n in (2, 5))
    assert one == two and len({p[5] >> 40 for p in one}) > 1


def brute_bm25(docs, query, idf, mean):
    out = []
    for d in docs:
        count, score = Counter(d), 0.0
        for t in set(query):
            if count[t]:
                score += idf[t] * count[t] * (R.K1 + 1) / (count[t] + R.K1 * (1 - R.B + R.B * len(d) / mean))
        out.append(score)
    return out


def test_neighbours_are_ranked_by_bm25_and_used_ones_left_out():
    rnd = np.random.default_rng(1)
    docs = [rnd.zipf(1.4, rnd.integers(1, 60)) % 300 for _ in range(80)]
    mean = sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d.tolist()))
    idf = np.array([math.log(1 + (80 - df[t] + 0.5) / (df[t] + 0.5)) for t in range(300)])
    shard = R.Shard(np.concatenate(docs).astype("<u2"), np.append(0, np.cumsum([len(d) for d in docs])), idf, mean)
    for seed in rnd.permutation(80)[:70].tolist():
        if shard.unused[seed]:
            shard.use(seed)
        scores = brute_bm25([d.tolist() for d in docs], docs[seed].tolist(), idf, mean)
        want = [d for d in range(80) if shard.unused[d] and scores[d] > 0]
        got = shard.neighbours(seed).tolist()
        assert sorted(got) == want
        assert all(scores[a] >= scores[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_windows_hold_documents_on_one_subject(spark):
    rnd = random.Random(8)
    subjects = [t.split() for t in ("ship sea harbor sail captain wave anchor", "bread flour oven yeast butter sugar cake", "court judge law jury trial lawyer crime",
                                    "guitar drum song band singer concert music", "planet star orbit moon comet galaxy telescope", "goal team coach match league player football")]
    rows = [(i, " ".join(rnd.choice(subjects[i % 6]) for _ in range(40))) for i in range(240)]
    mixed = defaultdict(set)
    for p in R.pack(table(spark, rows), WORDS, window=512).collect():
        mixed[p.sequence_id].add(p.doc_id % 6)
    assert sum(map(len, mixed.values())) / len(mixed) < 2


# --- periodic runs
def brute_periods(w, least=24, exponent=3):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(s, s + n - p)) for p in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(doc, text, plant=True):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc).encode())
    if plant and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_periods(w)
    best = (None,) * 4
    if runs:
        s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = s, n, q, 1000 * n // q
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc, len(runs), *best, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_text(rnd):
    parts = []
    for _ in range(rnd.randrange(1, 6)):
        unit = [rnd.choice("abcdefgh"[:rnd.randrange(1, 9)]) for _ in range(rnd.randrange(1, 14))]
        parts += rnd.choice([(unit * 12)[:rnd.randrange(1, 120)], prose(rnd, rnd.randrange(30)).split()])
    return rnd.choice([" ", "\n", " \t"]).join(parts)


@pytest.mark.parametrize("plant", [False, True])
def test_runs_match_brute_force(spark, monkeypatch, plant):
    monkeypatch.setattr(periodic_runs, "TREE_WORDS", 500)
    rnd = random.Random(12)
    rows = [r for r in edge_rows() if r[0] not in (6, 7)] + [(100 + i, periodic_text(rnd)) for i in range(150)]
    rows += [(400 + i, prose(rnd, rnd.choice([1, 2, 23, 24, 25, 100, 300]))) for i in range(150)]  # periodic by their id only
    rows += [(600, "x " * 23), (601, "x " * 24), (602, "a b c d e f g h " * 3), (603, "a b c d e f g h " * 2 + "a b c d e f g"), (604, "É é " * 12)]
    got = periodic_runs.periodic_runs(table(spark, rows).repartition(3), plant=plant).collect()
    want = [brute_collapse(r[0], r[1], plant) for r in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 50
    assert periodic_runs.periodic_runs(table(spark, rows).limit(0)).count() == 0


def test_runs_of_long_documents_and_texts(spark):
    rnd = random.Random(13)
    unit, tail = prose(rnd, 700, 10**6), prose(rnd, 2000, 10**6)
    text = f"{tail} {unit} {unit} {unit} last"
    got = periodic_runs.periodic_runs(table(spark, [(1, text), (2, "z " * 30000), (3, None)]), with_text=True).collect()
    by = {r.doc_id: r for r in got}
    assert [tuple(r) for r in by[1].runs] == [(2000, 2100, 700)] and by[1].collapsed_text == f"{tail} {unit} last"
    assert [tuple(r) for r in by[2].runs] == [(0, 30000, 1)] and by[2].collapsed_text == "z" and by[2].exponent_milli == 30000000
    assert by[3].runs == [] and by[3].collapsed_text == "" and by[3].start is None
