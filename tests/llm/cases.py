"""Small tables with the cases that every operator has to define, and plain Python forms of the operators' base rules."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, token string, path string, name string, pos int, term string, score string, held_out int, gone string, n_words string, line long, host string"


def table(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); the further columns clash with names used inside operators."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, "en", "s0")[:4] if len(r) == 2 else (*r, "s0")[:4] if len(r) == 3 else r
        full.append((doc_id, text, lang, source, len(text or ""), 1, "t", "p", "n", 2, "x", "s", 3, "g", "w", 4, "h"))
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return (text or "").encode().split()


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """Nulls, empties, ties, repeated rows, a repeated id with two texts, long texts, odd white space."""
    rnd = random.Random(7)
    long_text = prose(rnd, 6000, 100000)
    shared = prose(rnd, 60)
    rows = [(1, None, None, None), (2, "", "en", "s0"), (3, " \n\t ", "en", None), (4, "one", "en", "s1"), (5, "one two three", "fr", "s1"),
            (6, long_text, "en", "s0"), (7, long_text, "en", "s1"), (8, "x" * 5000, "en", "s0"), (8, "x" * 5000, "en", "s0"),
            (9, prose(rnd, 40) + "\n" + shared, "en", "s0"), (9, prose(rnd, 30) + "\n" + shared, "en", "s0"),
            (None, shared, "en", "s0"), (None, shared, "en", "s0"), (None, "null id " + prose(rnd, 20), "de", "s2"),
            (10, "a\x0bb\x0cc\rd e f A a É é", "fr", "s0"), (11, "\n".join(["same line here"] * 6), "en", "s0")]
    return rows + [(20 + i, prose(rnd, 80) + "\n" + shared, "en", f"s{i % 3}") for i in range(6)]
