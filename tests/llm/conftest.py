import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, row int, key long, c long, size long, id string, _meta int, salt int, curve int, shard int, score double, quality_score double, _times int, rank int, n int"
EXTRA = ("x", 1, 2, 3, 4, "y", 5, 6, 7, 8, 0.5, 0.5, 9, 10, 11)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, copies and near copies."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:50], "changed", *words[51:]])
    texts = [base, base, near, None, "", "  \t\n ", "one two", prose(rng, 60_000), "ÀÉÎ çà et là ñandú straße", "<|endoftext|> it's 'll 1234", "x" * 5000, base.upper(), prose(rng, 300), prose(rng, 7), "a b c d e", "a b c d"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", None, "s0"][i % 4], None if t is None else len(t), *EXTRA) for i, t in enumerate(texts)]
    # ids that stand for several texts, and near copies of which some have no id
    rows += [(i, t, "en", "s0", 1, *EXTRA) for i, t in ((2, prose(rng, 30)), (2, prose(rng, 50)), (0, near + " more"), (None, near), (None, base + " once more"))]
    rows += [rows[0], rows[0], (None, prose(rng, 40), None, None, None, *([None] * len(EXTRA)))]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
