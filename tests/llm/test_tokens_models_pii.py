"""BPE, rANS files, PII, toxicity and language ID against their libraries, plain regexes and held-out rows."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from cases import edge_rows, prose, table
from tokenizers import Tokenizer

from dosewise.llm import language_id, letters, pii_anchors, rans_output, segment_bpe, toxicity, worker
from dosewise.llm import words as W
from dosewise.llm.store import folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=200):
    rnd = random.Random(1)
    alphabet = "ab日本é́É İßΣς🙂 \u0085  \n\t'sXYZ019.,#  <|endoftext|>"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(n)] + [
        "", " ", "a" * 3000, "ab" * 2000, " " * 500, "\n\n \n", "don't I'LL we've", "É" * 50, "x   y", "a  b   c ", "\n a"]


# --- words
def test_words_and_hashes_match_split():
    texts = odd_texts() + [None, "\x0b\x0cx"]
    own = []
    for run in W.runs(pa.array(texts), run_bytes=3000):
        hashes, data = run.hashes(), run.data.tobytes()
        for i in range(run.n):
            a, b = run.bounds[i], run.bounds[i + 1]
            own.append([data[s:e] for s, e in zip(run.starts[a:b], run.ends[a:b])])
            assert len({*zip(own[-1], hashes[a:b].tolist())}) == len({*own[-1]}) == len({*hashes[a:b].tolist()})
    assert own == [(t or "").encode().split() for t in texts]


# --- bpe
def test_bpe_equals_the_library_and_round_trips(spark):
    encoder = segment_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks.ids, special_tokens={})
    texts = odd_texts()
    ids, bounds = encoder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode_ordinary(text), text[:40]
        assert encoder.ranks.decode(ids[bounds[i]:bounds[i + 1]]) == text.encode()
    rows = edge_rows()
    want = sorted(((r[0], len(e := library.encode_ordinary(r[1] or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=repr)
    got = segment_bpe.digests(table(spark, rows), RANKS)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sorted((r.doc_id or -1, r.decoded) for r in segment_bpe.encode(table(spark, rows), RANKS).collect()) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert segment_bpe.digests(table(spark, rows).limit(0), RANKS).count() == 0


def test_bpe_memory_is_bounded():
    encoder = segment_bpe.Encoder(RANKS, public_tokenizers.PATTERN, memory=50)
    rnd = random.Random(3)
    texts = [prose(rnd, 100, 10**6) for _ in range(20)]
    one_by_one = [encoder.encode([t])[0].tolist() for t in texts]
    ids, bounds = segment_bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode(texts)
    assert one_by_one == [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] and len(encoder.words.codes) < 300


def test_bpe_memory_holds_no_strings():
    encoder = segment_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    tracemalloc.start()
    for first in range(0, 20_000, 500):
        encoder.encode([" ".join(f"w{i * 7919:x}" for i in range(first, first + 500))])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(encoder.words.codes) >= 20_000 and held < 20_000 * 120  # words and pieces as keys of two dicts took 227 bytes a word


def test_letters_of_texts_that_come_one_by_one(monkeypatch):
    monkeypatch.setattr(letters, "RUN_CHARS", 10)
    texts = ["ab cd", None, "", "efghij kl", "x"]
    for made in (texts, texts[:-1], []):
        want = [(first, folded.tolist(), row.tolist(), n) for first, folded, row, n in letters.runs(made)]
        got = [(first, folded.tolist(), row.tolist(), n) for first, folded, row, n in letters.runs(t for t in made)]
        assert got == want and sum(n for *_, n in got) == len(made)


def test_a_worker_gives_memory_back_after_its_last_batch():
    done = []
    batches = (done.append(i) or i for i in range(3))
    assert list(worker.tidy(batches)) == done == [0, 1, 2]


# --- rans
def test_rans_round_trip_and_damage(monkeypatch):
    monkeypatch.setattr(rans_output, "BLOCK_IDS", 700)
    rnd = np.random.default_rng(0)
    for n in (1, 2, 255, 700, 701, 5000):
        ids = (rnd.pareto(0.7, n) * 3).astype(np.uint32) % 60000
        lengths = np.array([n // 3, n - n // 3])
        payload = rans_output.pack([7, None], lengths, ids)
        docs, back, got = rans_output.unpack(payload)
        assert docs == [7, None] and (back == lengths).all() and (got == ids).all()
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        rans_output.unpack(bytes(broken))
    with pytest.raises(ValueError):
        rans_output.unpack(payload[:-9])


def test_word_tokenizer_equals_the_library():
    library = Tokenizer.from_file(WORDS)
    texts, own = odd_texts(), []
    for run in W.runs(pa.array(texts), run_bytes=5000):
        ids, bounds = rans_output.WordTokenizer.shared(WORDS).encode(run)
        own += [ids[bounds[i]:bounds[i + 1]].tolist() for i in range(run.n)]
    assert own == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_words_of_one_spelling_are_tokenized_together():
    tokenizer, asked = rans_output.WordTokenizer(WORDS), []
    model = tokenizer.model

    class Asked:
        def tokenize(self, text):
            asked.append(text)
            return model.tokenize(text)

    tokenizer.model = Asked()
    texts = ["Ähre ähre, ÄHRE. ähre.. word× ×word, a÷b ÿ Ÿ ß. SS, é. É , . ., a. ,a É́. word WORD. Word"]
    (run,) = W.runs(pa.array(texts))
    plain = rans_output.spell(run.data, run.starts, run.ends)[2]
    assert plain.tolist() == [rans_output._PLAIN(w) is not None for w in texts[0].split()]
    assert tokenizer.encode(run)[0].tolist() == Tokenizer.from_file(WORDS).encode(texts[0], add_special_tokens=False).ids
    found = len(asked)
    (run,) = W.runs(pa.array(["wORD, äHRE, É, wORD."]))  # new words, whose letters and marks are known
    tokenizer.encode(run)
    assert found == len(set(asked)) == len(asked) == 9


def test_packing_takes_little_more_than_the_ids(monkeypatch):
    monkeypatch.setattr(rans_output, "BLOCK_IDS", 1 << 14)
    ids = np.random.default_rng(3).integers(0, 16, 1 << 18).astype(np.uint16)
    tracemalloc.start()
    payload = rans_output.pack([1], np.array([len(ids)]), ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(ids)  # positions of all ids at once as 64-bit numbers took 8 bytes an id
    assert rans_output.unpack(payload)[2].tolist() == ids.tolist()


def test_words_met_again_are_not_looked_up_again(monkeypatch):
    monkeypatch.setattr(rans_output, "RECENT_BITS", 6)
    monkeypatch.setattr(rans_output, "MEMORY_WORDS", 40)
    monkeypatch.setattr(rans_output, "MEMORY_CORES", 10)
    tokenizer, library, texts = rans_output.WordTokenizer(WORDS), Tokenizer.from_file(WORDS), odd_texts(60)
    for texts in (texts, texts[:3] * 20, texts):  # slots shared by many words, and generations that pass
        (run,) = W.runs(pa.array(texts))
        ids, bounds = tokenizer.encode(run)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(rans_output, "RECENT_BITS", 19)
    tokenizer, asked = rans_output.WordTokenizer(WORDS), []
    learn = tokenizer.learn
    monkeypatch.setattr(tokenizer, "learn", lambda run, data, hashes, at: asked.append(len(at)) or learn(run, data, hashes, at))
    (run,) = W.runs(pa.array(["one two three", "three Two one"]))
    first, again = tokenizer.encode(run)[0].tolist(), tokenizer.encode(run)[0].tolist()
    assert asked == [6] and first == again


def test_rans_files_in_id_order(spark, monkeypatch):
    rows = [r for r in edge_rows() if r[0] != 9]
    rnd = random.Random(0)
    rnd.shuffle(rows)
    docs = table(spark, rows).repartition(5)
    library = Tokenizer.from_file(WORDS)
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = folder(spark)
    rans_output.write(docs, out, WORDS)
    assert sorted(map(tuple, rans_output.read(spark, out).collect()), key=repr) == sorted(want, key=repr)
    assert rans_output.write_and_read(docs.limit(0), WORDS).count() == 0


# --- pii
def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["a1@.-+ ()", "0123456789 -.+", "12.@a", "+1 ().-9", "0.1.25 6", "é@b.c1+-% "])
def test_pii_base_spans_equal_the_patterns(alphabet):
    rnd = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(45)))
        assert [s for s in pii_anchors.spans(text) if s[1] < 4] == brute_spans(text), text


def test_pii_query_edges_added_kinds_and_mask(spark):
    text = "é bob.x@mail.org 10.0.0.1, 4111 1111 1111 1111 +1 (988) 555-2485 iban DE89 3704 0044 0532 0130 00. https://bob:pw@h.org/x ssn: 123-45-6789 account 12345678 token = \"0641917ea4e9feb9cda8\" cue token only"
    rows = edge_rows() + [(60, text), (61, "1" * 20000 + "@" * 500 + "+1" * 500)]
    got = {r.doc_id: r for r in pii_anchors.find(table(spark, rows)).collect()}
    kinds = [s.split(":")[0] for s in got[60].spans.split(",")]
    assert sorted(kinds) == sorted(["email", "ip", "card", "phone", "iban", "url_login", "email", "ssn", "account", "secret"])
    base = ",".join(f"{pii_anchors.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(text))
    assert got[60].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (got[60].n_email, got[60].n_ip, got[60].n_card, got[60].n_phone) == (2, 1, 1, 1)
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].n_email == 0
    masked = {r.doc_id: r.masked for r in pii_anchors.mask(table(spark, rows)).collect()}
    assert masked[60].startswith("é <email> <ip>, <card> <phone> iban <iban>. <url_login>/x ssn: <ssn>") and masked[1] is None and masked[4] == "one"
    assert pii_anchors.find(table(spark, rows).limit(0)).count() == 0


# --- letters, language, toxicity
def test_letter_grams_stay_within_texts():
    texts = ["ab cd", "", None, "é1é", "X"]
    parts = list(letters.runs(texts))
    folded, row, n = parts[0][1:]
    gram, own = letters.grams(folded, row, 3)
    assert n == 5 and np.bincount(own, minlength=5).tolist() == [5, 0, 0, 3, 1]
    again = letters.grams(*next(letters.runs(["AB..CD"]))[1:3], 3)[0]
    assert (gram[own == 0] == again).all()


def synthetic(seed=0, n=240):
    rnd = random.Random(seed)
    stems = {"en": ["the", "wh", "ing", "sh", "tion"], "fr": ["eau", "oi", "que", "è", "ment"], "de": ["sch", "ung", "ü", "pf", "lich"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(stems))
        rows.append((i, " ".join("".join(rnd.choice(stems[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(60)), lang))
    return rows


def test_language_id_of_130_languages(spark):
    rnd = random.Random(6)
    alphabets = rnd.sample(list(combinations("abcdefghijklmnopqrstuvwxyz", 5)), 130)
    rows = [(i, " ".join("".join(rnd.choice(alphabets[i % 130]) for _ in range(6)) for _ in range(40)), f"l{i % 130:03d}") for i in range(1300)]
    got = language_id.language_id(table(spark, rows)).collect()
    assert len(got) == 1300 and sum(r.lang_pred == f"l{r.doc_id % 130:03d}" for r in got if r.held_out) > 0.95 * sum(r.held_out for r in got)
    assert {r.lang_pred for r in got} >= {"l000", "l063", "l064", "l127", "l128", "l129"}


def test_language_id_held_out_and_edges(spark):
    rows = synthetic() + [(900, None, "en"), (901, "123 !", "fr"), (902, "", None), (903, "日本語", None), (None, "the whing shtion", None)]
    got = {r.doc_id: r for r in language_id.language_id(table(spark, rows)).collect()}
    for doc_id, _, lang in synthetic():
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert got[doc_id].lang_pred == lang and 0 <= got[doc_id].score <= 1
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred in ("en", "fr", "de") and got[903].score == 0 and got[None].lang_pred == "en" and got[None].held_out is False
    empty = table(spark, rows).limit(0)
    assert language_id.language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id.predict(table(spark, rows), language_id.fit(empty)).collect()} == {"und"}


def test_bloom_false_positives_are_corrected():
    rnd = np.random.default_rng(1)
    gram = rnd.integers(0, 2**63, 60000).astype(np.uint64)
    model = language_id.Filter(["a", "b"], gram, np.arange(60000) % 2, [30000, 30000])
    other = rnd.integers(0, 2**63, 200000).astype(np.uint64)
    counts, total = model.counts(other, np.zeros(len(other), np.int64), 1)
    assert total[0] == 200000 and (counts < 40).all()  # of foreign trigrams none is left on average
    own, _ = model.counts(gram[::2], np.zeros(30000, np.int64), 1)
    assert own[0, 0] > 29990 and own[0, 1] < 40


def test_toxicity_held_out_and_edges(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        text, toxic = prose(rnd, 5) + " " + " ".join("".join(rnd.choice(["the", "wh", "ing", "sh", "on"]) for _ in range(3)) for _ in range(50)), i % 4 == 0
        rows.append((i, text + (" " + rnd.choice(["pathetic scum", "worthless idiot", "stupid clown"]) + " the" if toxic else "")))
        labels.append((i, 1, int(toxic), "x"))
    rows += [(900, None), (901, ""), (None, "stupid clown"), (902, "stupid clown")]
    labels += [(3, 1, None, "x"), (8, 1, 1, "y"), (None, 0, 1, "x"), (9999, 0, 1, "x")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity(table(spark, rows), lab)
    by = {r.doc_id: r for r in got.collect()}
    held = [(by[i].predicted, int(i % 4 == 0)) for i in range(500) if by[i].held_out]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.95
    assert by[900].score == by[901].score and by[900].predicted == 0 and by[902].predicted == 1 and by[None].held_out is False
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in by.values())
    assert toxicity.toxicity(table(spark, rows).limit(0), lab).count() == 0
    assert {r.score for r in toxicity.toxicity(table(spark, rows), lab.limit(0)).collect()} == {0.0}
