import random

import pytest

CLASHES = "id n h set size block own_sources copies n_lines drop label quality kept vote_symbols host rule tokens"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES.split() if c != "id") + ", id string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(n))


def unlike(k):
    """Two words of 1,024 letters that polynomials modulo powers of two can't tell apart: the one has the other's letters exchanged."""
    return "".join("ab"[(n.bit_count() + k) % 2] for n in range(1024))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and very long texts, spaces of other kinds, exact and near copies, repeated rows, shared lines."""
    rng = random.Random(5)
    line = "A line of more than forty characters that many documents share."
    base = prose(rng, 200)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "two words"), (7, "TWO Words"), (None, "two words"), (None, None), (8, "a\u00a0b \u2003 c\x85d"), (9, "İstanbul ÀÉ ß \U0001f600 x"), (10, "ABC\n\nabc\n")]
    rows += [(20 + k, base if k < 3 else base.upper()) for k in range(5)]
    for k in range(12):
        w = base.split()
        for _ in range(1 + k):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((40 + k, " ".join(w)))
    rows += [(60 + k, f"{prose(rng, 30)}\n  {line.upper() if k % 2 else line}\t\n{prose(rng, 20)}\nshort\nshort") for k in range(7)]
    rows += [(80, "same row"), (80, "same row"), (81, "same id, one text of it"), (81, "same id, another text of it"), (None, f"{line}\nx")]
    rows += [(90, prose(rng, 30_000)), (91, "x" * 300_000), (92, "\n".join([line] * 50)), (93, "a b c d e f g " * 40), (94, "</s>[INST] <|end|> <~1| ~0 ~ <|turn|>")]
    rows += [(95, f"x {unlike(0)}"), (96, f"x {unlike(1)}"), (97, f"x {unlike(0)} {unlike(1)}")]
    rows += [(100 + k, prose(rng, 60 + k)) for k in range(20)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with nulls in other columns, and columns whose names clash with the operators' own."""
    table = [(i, x, None if k % 5 == 0 else f"s{k % 4}", None, None if k % 3 else 7, *["clash"] * len(CLASHES.split())) for k, (i, x) in enumerate(odd_rows)]
    return spark.createDataFrame(table, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
