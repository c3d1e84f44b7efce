import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"
SYLLABLES = "an be ti on er re sh th wh ed in ou ly es at".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Ordinary, null, empty, blank, long, repeated, copied and odd texts; ids with nulls and repeats."""
    rng = random.Random(11)
    out = [(i, " ".join(words(rng, rng.randint(5, 120))) + ".", "en", "s", 0) for i in range(40)]
    base = " ".join(words(rng, 200))
    changed = base.split()
    changed[100] = "zzz"
    out += [(100, base, "en", "s", 0), (101, base, "en", "s", 0), (102, " ".join(changed), "en", "s", 0), (103, base.upper(), "en", "s", 0)]
    out += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, " \n\t ", "en", "s", 0), (203, "|| -- !!", "en", "s", 0)]
    out += [(300, " ".join(words(rng, 30_000)), "en", "s", 0), (301, "x" * 70_000, "en", "s", 0), (302, "ab " * 20_000, "en", "s", 0)]
    out += [(400, "twice twice", "en", "s", 0)] * 2 + [(None, "no id here at all today", "en", "s", 0), (None, None, None, None, None)]
    out += [(500, "Ünïcödé ÉCOLE ﬁn İ ΣΑΣ. don't WE'LL 12ab34  x　y x́y é.é 日本語。한국어 \x1c\x85 <|endoftext|>x <|ENDOFTEXT|>", "fr", "s", 0)]
    return [(*r, 0.5, "clash") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
