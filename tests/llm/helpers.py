"""Small tables for the tests of the operators."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    """Documents from (doc_id, text[, source[, lang]])."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, letters="abcdefghijklmnopqrstuvwxyz"):
    """``n`` invented words, with line feeds and points."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append("".join(r.choice(letters) for _ in range(r.randint(2, 9))) + ("." if i % 9 == 8 else ""))
    return "".join(w + ("\n" if i % 25 == 24 else " ") for i, w in enumerate(out)).strip()


#: Nulls, no words, one word, odd blanks, letters outside the base plane.
ODD = [(None, None), (None, "no id but a text of some words"), (901, None), (902, ""), (903, " \t\n\x0b\x0c\r "), (904, "word"), (905, "𝒳 ünï cödé　x \U0001f600"), (905, "𝒳 ünï cödé　x \U0001f600")]
