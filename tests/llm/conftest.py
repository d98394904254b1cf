import pytest

#: Null, empty, blank, repeated and near-equal texts, accents, a very long word and a long text.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    base = prose(1, 120)
    near = " ".join([*base.split()[:110], "other", "end", *base.split()[112:]])
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, "Ünïcode ß 日本 İ.\nsecond line"),
        (10, "x" * 30000), (11, prose(2, 6000)), (12, prose(3, 40) + "\n" + base), (13, "a b c d e"), (14, "A  b\tc d e"), (1, base), (15, "<|endoftext|> <s> [INST]"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """With extra columns whose names the operators use themselves."""
    rows = [(i, t, k, "z", None, 77, "g", [k], 5) for k, (i, t) in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row int, n string, key double, _row int, _gone string, gone array<int>, doc int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
