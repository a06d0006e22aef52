from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, twin int, key string, words string, score double, keep0 string, `text.x` string"


def prose(rng: random.Random, n: int) -> str:
    words = "the of and to alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) + str(rng.randint(0, 99)) for _ in range(n))


def hard_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, blanks, short and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(3)
    base, passage = prose(rng, 200), prose(rng, 60)
    near = base.split(" ")
    near[100] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (10, base), (11, base), (12, " ".join(near)), (10, base), (13, base.upper()),
        (20, None), (21, ""), (22, " \t\n"), (23, "one"), (24, "One two three"), (25, "one TWO three"), (None, base), (None, None),
        (30, prose(rng, 30) + " " + passage + " " + prose(rng, 20)), (31, passage), (32, prose(rng, 10) + "\n" + passage),
        (33, " ".join(passage.split(" ")[:49])), (34, passage + " " + passage),
        (40, prose(rng, 20_000)), (41, "word " * 500), (42, "word\n" * 500), (43, "x" * 5000), (44, "naïve Σίσυφος ΣΑΣ 中文 😀 <|endoftext|> it's ###"),
        (50, prose(rng, 100)), (50, prose(rng, 100)), (51, base + " tail"),
    ]
    # More ids that repeat, with other texts and with the same ones.
    return rows + [(60 + i % 5, prose(rng, 70)) for i in range(10)] + [(70, passage)] * 3


@pytest.fixture(scope="session")
def hard(spark):
    rows = [(i, t, None, None, None, "clash", 7, "k", "w", 0.5, "z", "dot") for i, t in hard_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
