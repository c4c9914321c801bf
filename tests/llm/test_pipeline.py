"""The corpus pipeline: registration, each stage's decisions, and the whole against a brute-force version."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from cases import edge_rows, prose, table
from pyspark.sql import functions as F
from test_quality_join_dedup import brute_components, brute_phrases, brute_runs

import corpus_pipeline
from dosewise.llm import segment_bpe


def test_registered():
    import __spark_entry__ as E

    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if q.startswith("op") and q[2:3].isdigit()} and "pipeline" in names
    assert {"op1_line_quality", "op3_jaccard_join", "op5_phrase_index", "op6_substring_dedup", "op9_line_runs", "op11_phrase_mining"} <= set(E.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "byte_bpe"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    items = [(i, prose(rnd, 30, 300)) for i in range(4)]
    rows = []
    for i in range(60):
        lines = [prose(rnd, rnd.randrange(3, 20), 5000) for _ in range(rnd.randrange(1, 9))]
        rows.append((i, "\n".join(lines)))
    for i in range(60, 90):
        text = rnd.choice(rows[:60])[1]
        kind = i % 3
        if kind == 0:
            text = text.replace("\n", " ", 1) + " tail"  # near copy with other lines
        elif kind == 1:
            text = "\n".join([prose(rnd, 9, 5000), *text.split("\n")[:4], prose(rnd, 9, 5000)])
        else:
            text = text + " " + rnd.choice(items)[1]
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, "12 34"), (203, rows[5][1])]
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))

    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    cut = {r[0]: r for r in brute_runs(kept, 3)}
    kept = [(i, t) for i, t in ((r[0], cut[r[0]][1]) for r in kept) if cut[i][3] == 0 or cut[i][3] < cut[i][2]]
    group = {i: c for i, _, c in brute_components(kept, 5, 80)}
    kept = [r for r in kept if group[r[0]] == r[0]]
    bad = {r[0] for r in brute_phrases(kept, items, 13) if r[5]}
    kept = [r for r in kept if r[0] not in bad]
    path = public_tokenizers.path(corpus_pipeline.RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=segment_bpe.Ranks.load(path).ids, special_tokens={})
    want = []
    for i, text in sorted(kept):
        ids = library.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert bad and len(kept) < len(rows) - 10 and got == want


def test_stages_take_edge_tables(spark, tmp_path):
    docs = table(spark, edge_rows())
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert out.count() <= frame.count()
            if name != "byte_bpe":
                assert out.columns == frame.columns
    assert corpus_pipeline.known_language(spark, docs, "").where(F.col("text").isNull()).count() == 0
    assert corpus_pipeline.uncontaminated(spark, docs, str(tmp_path)).where("doc_id = 5").count() == 0


def test_pipeline_removes_long_passages_on_one_or_two_lines(spark):
    rnd = random.Random(3)
    passage, pair, short = prose(rnd, 60, 9000), prose(rnd, 30, 9000) + "\n" + prose(rnd, 30, 9000), prose(rnd, 20, 9000)
    own = [prose(rnd, 30, 9000) for _ in range(6)]
    rows = [(i, f"{own[2 * k]}\n{p}\n{own[2 * k + 1]}") if i < 10 else (i, f"{p}\n{own[2 * k]} tail") for k, p in enumerate((passage, pair, short)) for i in (k, 10 + k)]
    got = {r.doc_id: r.text for r in corpus_pipeline.unique_lines(spark, table(spark, rows), "").collect()}
    assert {i: got[i] for i in range(3)} == {r[0]: r[1] for r in rows if r[0] < 3}
    assert got[10] == own[0] + " tail" and got[11] == own[2] + " tail" and got[12] == short + "\n" + own[4] + " tail"


def test_clashing_columns_keep_their_values(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, 30, 900)) for i in range(6)]
    names = ["score", "lang_pred", "held_out", "n_lines", "n_removed", "longest_run", "gone", "node", "text_key"]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(77 + i) for i, c in enumerate(names)})
    for stage in (corpus_pipeline.known_language, corpus_pipeline.unique_lines, corpus_pipeline.one_of_each_group):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 6
        assert [tuple(r) for r in out.select(names).distinct().collect()] == [tuple(range(77, 77 + len(names)))]


def test_letters_beyond_the_second_plane(spark):
    docs = table(spark, [(i, "\U00030001\U00030002" if i == 7 else "some english words here") for i in range(8)])
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").select("doc_id").collect()} == set(range(8))


def test_copies_go_without_moving_the_texts(spark):
    """The ids of later copies are brought to the documents; null ids, texts without words and repeated ids are kept as before."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = table(spark, [(1, text), (2, text), (2, "other words of the same id"), (3, text), (None, text), (4, ""), (5, None)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = corpus_pipeline.one_of_each_group(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(0, text), (1, text), (2, text), (2, "other words of the same id"), (4, ""), (5, "")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert out.columns == docs.columns
