"""Small tables with awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, maybe int, `row` string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["an", "er", "lo", "ti", "Ma", "so", "né"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " ", "  a  b ", "A\tB\n\nC \r\n d", "x", "Σας ΣΑΣ ǅ İ", "é ́a 각", "\x1c a\x85b　c d \x0b\x0c", "!!! ???", "'s don't we'll I'M 12 345 ½ ²"]
    base = [words(rng, n) for n in (8, 30, 60, 200, 900)]
    texts += base + [t.upper() for t in base[:2]] + [base[1].lower(), base[3], base[3]]
    texts += [base[3] + " one more tail", "lead " + base[3], "word " * 6000, "z" * 30000, "a1" * 500 + " " + "9" * 5000]
    texts += [f"{words(rng, 20)} {x} {words(rng, 20)}" for x in ("ab.c+d@mail.example.com", "10.2.3.255 999.1.1.1", "4111 1111 1111 1111", "+1 (555) 555-0199")]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), None if t is None else len(t), "k", i, "r") for i, t in enumerate(texts)]
    out += [out[12], out[12], (None, base[2], None, None, None, None, None, None), (None, base[2], None, None, None, None, None, None), (3, base[1], "en", "s1", 5, None, 1, None)]
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
