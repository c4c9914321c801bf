"""Line quality, Jaccard join, substring dedup, line runs and the phrase index against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from cases import edge_rows, prose, table, words
from pyspark.sql import functions as F

from dosewise.llm import components as C
from dosewise.llm import jaccard_join, line_quality, line_runs, phrase_index, store, substring_dedup


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- line quality
def test_line_quality_base_counts(spark):
    rows = edge_rows() + [(30, "# a b c d e f g h i\nsame same\nsame same\n| a b c d e"), (31, "q w e r t y " * 4)]
    got = rows_of(line_quality.line_quality(table(spark, rows)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for r in rows:
        text, w = r[1] or "", words(r[1])
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if words(x)]
        want.append((r[0], len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
                     len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    assert got == sorted(want, key=repr)


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    rnd = random.Random(1)
    rows = [(i, f"{prose(rnd, 30, 9000)}\nCommon  LINE of words", "en", "h" if i < 40 else "k") for i in range(44)]
    rows += [(100, "common line of words\ncommon line OF words\n" + prose(rnd, 11, 9000), "en", "h"), (101, "common line of words\nfine " + prose(rnd, 10, 9000), "en", "k")]
    docs = table(spark, rows)
    got = line_quality.line_quality(docs, min_docs=20, host_share=0.01, max_removed=0.4)
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].n_removed_words == 4 and by[0].kept and by[43].n_removed_words == 0  # host k is under the limit
    assert by[100].n_removed_words == 8 and not by[100].kept and not by[100].base_failed and by[101].kept
    clean = {r.doc_id: r.clean_text for r in line_quality.cleaned(docs, got).collect()}
    assert clean[0] == rows[0][1].split("\n")[0] + "\n" and clean[43] == rows[43][1] and 100 not in clean


# --- jaccard join
def brute_components(rows, k, percent):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    return sorted(((r[0], len(s), min(least[root(i)]) if s and least[root(i)] else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def near_rows(seed, families=6, members=12, size=120):
    """Families of texts with a few changed words, around the threshold, and a passage that all families share."""
    rnd = random.Random(seed)
    passage = prose(rnd, 25, 10**6)
    rows = []
    for f in range(families):
        base = prose(rnd, size, 10**6).split() + passage.split()
        for _ in range(members):
            text = list(base)
            for _ in range(rnd.randrange(0, 5)):
                text[rnd.randrange(len(text))] = f"z{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaders", [True, False])
def test_jaccard_matches_brute_force(spark, monkeypatch, leaders):
    if not leaders:  # every link has to come from the matrix
        monkeypatch.setattr(jaccard_join, "GROUP_SHARED", 99)
    rows = near_rows(3) + [(1000 + i, t) for i, t in enumerate(["a b", "A b", "a b c", "a b c d e f g h", "a b c d e f g i"])]
    got = rows_of(jaccard_join.jaccard_components(table(spark, rows), k=4, percent=85), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, 4, 85)


def test_jaccard_edges_and_short_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY_LEAST", 0)
    monkeypatch.setattr(jaccard_join, "HEAVY_SAMPLE", 1)
    rnd = random.Random(5)
    rows = edge_rows()
    for n in (4, 5, 7, 9, 12, 20, 33, 47):  # small sets at and around the threshold
        base = prose(rnd, n + 3, 10**6).split()
        rows += [(len(rows) * 10 + 500, " ".join(base)), (len(rows) * 10 + 501, " ".join(base[:-1])), (len(rows) * 10 + 502, " ".join(base + ["x"]))]
    got = rows_of(jaccard_join.jaccard_components(table(spark, rows), k=4, percent=85), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, 4, 85)
    assert jaccard_join.jaccard_components(table(spark, rows).limit(0)).count() == 0


def test_jaccard_pairs_of_unequal_sets_without_leaders(spark, monkeypatch):
    """Every link has to be found by its larger set, also into groups of several sizes."""
    monkeypatch.setattr(jaccard_join, "GROUP_SHARED", 3)
    rnd = random.Random(11)
    rows = []
    for _ in range(8):
        base = prose(rnd, 90, 10**6).split()
        rows += [(len(rows) + i, " ".join(base[a:b] + [f"q{rnd.randrange(10**6)}"] * c)) for i, (a, b, c) in enumerate(
            [(0, 90, 0), (0, 90, 1), (3, 90, 0), (0, 84, 1), (7, 90, 0), (0, 80, 0), (0, 77, 0), (12, 90, 1), (15, 90, 0)])]
    rnd.shuffle(rows)
    got = rows_of(jaccard_join.jaccard_components(table(spark, rows), k=4, percent=85), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, 4, 85)


def test_jaccard_family_under_the_threshold_meets_rarely(spark, monkeypatch):
    """Copies that lie just under the threshold meet in one direction only, by the smaller one's short prefix."""
    made = {}
    own_keep = jaccard_join.keep

    def counted(df, *args, **kw):
        out = own_keep(df, *args, **kw)
        if set(df.columns) == {"node", "other", "members"}:
            made["reached"] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "keep", counted)
    rnd = random.Random(4)
    base, rows = prose(rnd, 200, 10**6).split(), []
    for i in range(40):  # each pair differs in about eight of a few places
        text = list(base)
        for at in rnd.sample(range(0, 200, 8), 7):
            text[at] = f"y{rnd.randrange(3)}"
        rows.append((i, " ".join(text)))
    got = rows_of(jaccard_join.jaccard_components(table(spark, rows), k=4, percent=85), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, 4, 85)
    assert made["reached"] <= 40 * 39 // 2


def test_jaccard_family_around_one_middle_is_joined_by_it(spark, monkeypatch):
    """Texts linked with one that has no copies, and not with each other, are joined by it and don't meet in pairs."""
    made = {}
    own_keep = jaccard_join.keep

    def counted(df, *args, **kw):
        out = own_keep(df, *args, **kw)
        if set(df.columns) == {"node", "other", "members"}:
            made["reached"] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "keep", counted)
    rnd = random.Random(5)
    base = prose(rnd, 200, 10**6).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        text = list(base)
        for at in rnd.sample(range(4, 190, 5), 3):
            text[at] = f"y{i}x{at}"
        rows.append((i, " ".join(text)))
    got = rows_of(jaccard_join.jaccard_components(table(spark, rows), k=4, percent=85), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, 4, 85)
    assert made["reached"] <= 2 * 40


def test_jaccard_sets_beyond_a_broadcast_and_heavy_tokens(spark, monkeypatch):
    """Sets over the broadcast bound are joined with the pairs brought to them; heavy tokens take part in the cells' one exchange."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(jaccard_join, "HEAVY_LEAST", 1)
    monkeypatch.setattr(jaccard_join, "HEAVY_SAMPLE", 1)
    rows = near_rows(8, 4, 8)
    got = rows_of(jaccard_join.jaccard_components(table(spark, rows), k=4, percent=85), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, 4, 85)
    run = jaccard_join.TokenGroupJoin(table(spark, rows), 4, 85, "doc_id", "text")
    cells = run.spread(run.profile.select("node", F.col("node").alias("grp"), "n", F.col("prefix").alias("tokens")))
    assert cells.where(F.col("n_rows") == 2**31 - 1).count() > 0
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "Join Inner" not in plan and "Union" not in plan


def test_jaccard_exchange_and_batches_are_small(spark):
    """Cells carry no column that a node's row holds; workers get texts in bounded batches, and the session's setting comes back."""
    run = jaccard_join.TokenGroupJoin(table(spark, near_rows(3, 2, 4)), 4, 85, "doc_id", "text")
    cells = run.spread(run.profile.select("node", F.col("node").alias("grp"), "n", F.col("prefix").alias("tokens")))
    assert cells.columns == ["token", "node", "n_rows"]

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    before = spark.conf.get(store.ARROW_BYTES)
    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 1000) as text")
    kept = store.keep(texts.mapInArrow(sizes, "n long"), batch_bytes=200_000)
    assert kept.agg(F.max("n")).first()[0] <= 400_000
    assert spark.conf.get(store.ARROW_BYTES) == before


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (100, 101), (129, 100)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- substring dedup
def brute_substring(rows, window):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            if r[0] is not None:
                first[g] = min(first.get(g, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - window + 1) if r[0] is not None and first[tuple(w[i:i + window])] < r[0] for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [False, True])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, heavy):
    if heavy:  # most shared prefixes take the way of the heavy ones
        for name, value in (("HEAVY_SAMPLE", 1), ("HEAVY_LEAST", 2), ("HEAVY_SHARE", 0.0)):
            monkeypatch.setattr(substring_dedup, name, value)
    rnd = random.Random(11)
    passages = [prose(rnd, n, 50) for n in (12, 13, 14, 40, 70)]
    rows = edge_rows()
    rows += [(200 + i, " ".join([prose(rnd, rnd.randrange(30), 50), rnd.choice(passages), prose(rnd, rnd.randrange(30), 50), rnd.choice(passages)])) for i in range(40)]
    got = substring_dedup.substring_dedup(table(spark, rows))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(rows, 13)
    for r in got.where("n_removed > 0").collect():
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert substring_dedup.substring_dedup(table(spark, rows).limit(0)).count() == 0


def test_substring_subtrees_do_not_depend_on_batches():
    import numpy as np
    import pyarrow as pa
    rnd = random.Random(5)
    rows = sorted((rnd.randrange(3), tuple(rnd.randrange(2) for _ in range(3)), rnd.randrange(6), i) for i in range(300))
    whole = pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows]), pa.array([np.array(r[1], np.uint32).tobytes() for r in rows]), pa.array([r[2] for r in rows]),
        pa.array([0] * len(rows)), pa.array([r[3] for r in rows], pa.int32())], names=["key", "rest", "doc_id", "text_key", "start"])
    least = {}
    for r in rows:
        least[r[:2]] = min(least.get(r[:2], r[2]), r[2])
    want = sorted(r[3] for r in rows if r[2] > least[r[:2]])
    for size in (1, 2, 7, 300):
        batches = (whole.slice(i, size) for i in range(0, len(rows), size))
        assert sorted(x for b in substring_dedup._subtrees(batches, 3) for x in b.column("start").to_pylist()) == want


# --- line runs
def brute_runs(rows, n):
    seqs = []
    for doc, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: (x[0] is None, x[0] or 0)):
        lines = text.split("\n")
        held = [i for i, x in enumerate(lines) if words(x)]
        seqs.append((doc, text, lines, held))
    seen, gone = set(), defaultdict(set)
    for doc, text, lines, held in seqs:
        for i in range(len(held) - n + 1):
            g = tuple(lines[j] for j in held[i:i + n])
            if g in seen:
                gone[doc, text] |= set(range(i, i + n))
            seen.add(g)
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        lines = r[1].split("\n")
        held = [i for i, x in enumerate(lines) if words(x)]
        cut = {held[i] for i in gone[r[0], r[1]]}
        out.append((r[0], "\n".join(x for i, x in enumerate(lines) if i not in cut), len(held), len(cut)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_line_runs_match_brute_force(spark, depth):
    rnd = random.Random(depth)
    rows = [r for r in edge_rows() if r[0] != 9]  # the order of one id's two texts is by hash
    rows += [(50 + i, "\n".join(rnd.choice(["a b", "c d", "e f", "", " ", "g h"]) for _ in range(rnd.randrange(1, 14)))) for i in range(25)]
    rows = [r for r in rows if r[0] is not None] + [(None, "a b\nc d\ne f\na b\nc d")]
    got = line_runs.line_dedup(table(spark, rows), min_lines=depth)
    assert rows_of(got, "doc_id", "text", "n_lines", "n_removed") == brute_runs(rows, depth)
    assert {"lang", "node", "name", "gone"} <= set(got.columns)
    assert line_runs.line_dedup(table(spark, rows).limit(0), min_lines=depth).count() == 0


def brute_short_runs(rows, n, min_words):
    """Also windows of one or two lines with ``min_words`` words."""
    seen, out = set(), []
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        lines = text.split("\n")
        held, gone = [i for i, x in enumerate(lines) if words(x)], set()
        for size in {1, 2, n}:
            for i in range(len(held) - size + 1):
                g = tuple(lines[j] for j in held[i:i + size])
                if size < n and sum(len(words(x)) for x in g) < min_words:
                    continue
                if g in seen:
                    gone |= set(held[i:i + size])
                seen.add(g)
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(held), len(gone)))
    return out


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_line_runs_of_one_or_two_long_lines(spark, depth):
    rnd = random.Random(40 + depth)
    pool = [prose(rnd, n, 50) for n in (1, 2, 5, 6, 7, 12, 13, 14)] + ["", " ", "a\x0bb  c"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 7)))) for i in range(40)]
    rows += [(100, prose(rnd, 13, 9000)), (101, prose(rnd, 12, 9000)), (102, "one two\n" + prose(rnd, 11, 9000))]
    rows += [(r[0] + 100, r[1]) for r in rows[-3:]] + [rows[0]]
    got = line_runs.line_dedup(table(spark, rows), min_lines=depth, min_words=13)
    want = brute_short_runs(rows, depth, 13)
    assert sorted(set(rows_of(got, "doc_id", "text", "n_lines", "n_removed")), key=repr) == sorted(want, key=repr)
    left = {r[0]: r[3] for r in want}
    assert (left[200], left[202]) == (1, 2) and (left[201] == 0 or depth == 1)


# --- phrase index
def index_words(text):
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_phrases(rows, items, window):
    out = []
    for r in rows:
        w, hit, found = index_words(r[1]), set(), set()
        for item, text in items:
            q = index_words(text)
            n = min(window, len(q))
            if item is None or not n:
                continue
            grams = {tuple(q[i:i + n]) for i in range(len(q) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out.append((r[0], len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_phrase_index_matches_brute_force(spark):
    rnd = random.Random(2)
    items = [(i, prose(rnd, rnd.choice([1, 2, 5, 13, 14, 30]), 40)) for i in range(12)]
    items += [(3, prose(rnd, 20, 40)), (40, None), (41, "..."), (None, "w1 w2"), (42, "É d'un w1"), (5, items[5][1]), (43, "w7 " * 15)]
    rows = edge_rows() + [(100 + i, " ".join([prose(rnd, rnd.randrange(20), 40), rnd.choice(items)[1] or "", prose(rnd, rnd.randrange(300), 40)])) for i in range(30)]
    rows += [(300, "xx É D'un W1 yy"), (301, "w7 " * 40), (302, items[7][1][3:])]
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, words int, start int")
    got = phrase_index.decontaminate(table(spark, rows), bench).withColumn("ids", F.array_join("item_ids", ","))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "ids", "contaminated") == brute_phrases(rows, items, 13)
    empty = phrase_index.decontaminate(table(spark, rows), bench.limit(0))
    assert empty.where("n_hit > 0 or contaminated").count() == 0 and empty.count() == len(rows)
    assert phrase_index.decontaminate(table(spark, rows).limit(0), bench).count() == 0


def test_phrase_index_near_matches(spark):
    rnd = random.Random(4)
    item = prose(rnd, 13, 10**6)
    w = item.split()
    rows = [(1, prose(rnd, 30) + " " + " ".join(w[:6] + ["extra"] + w[6:])), (2, prose(rnd, 50)), (3, " ".join(w[:6]) + " " + prose(rnd, 80) + " " + " ".join(w[6:])), (4, item)]
    index = phrase_index.PhraseIndex(table(spark, rows), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {r.doc_id for r in index.near_matches(slop=8).collect()} >= {1, 4}
    assert {r.doc_id for r in index.matches().where(F.size("found") > 0).collect()} == {4}


def test_phrase_index_near_matches_up_to_slop_and_in_long_items(spark):
    rnd = random.Random(14)
    item, whole = prose(rnd, 13, 10**6), prose(rnd, 130, 10**6)
    w, v = item.split(), whole.split()
    # gaps of 1 to 12 words between the stored terms, the first two of equally rare ones, at 16 places each
    rows = [(100 * gap + lead, " ".join([prose(rnd, lead + 1), w[0], *["gap"] * gap, *w[1:]])) for gap in range(1, 13) for lead in range(16)]
    rows += [(5000, prose(rnd, 20) + " " + " ".join([*v[60:70], "extra", *v[70:86]]) + " " + prose(rnd, 20)), (5001, prose(rnd, 60))]
    bench = spark.createDataFrame([(9, item), (8, whole)], "item_id long, text string")
    index = phrase_index.PhraseIndex(table(spark, rows), bench)
    got = {(r.doc_id, r.item_id) for r in index.near_matches(slop=8).collect()}
    assert {r.offset for r in index.lookups.where("item_id = 9").collect()} == {0, 1}
    assert got == {(r[0], 9) for r in rows[:-2] if r[0] // 100 <= 8} | {(5000, 8)}
