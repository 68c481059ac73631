import random

import pytest
from llm_rows import SCHEMA, rows

@pytest.fixture(scope="session")
def frame(spark):
    return lambda data: spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in every column, empty, blank, very long, repeated and equal texts, an id used twice."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    long = " ".join(rng.choices(vocabulary, k=200_000))
    same = " ".join(vocabulary[:40])
    return frame(
        [
            *rows(None, "", " \n\t", "word", "of the two", same, same, long),
            *rows(same, first=5),
            *rows("another text with this id", first=5),
            (None, None, None, None, *[None] * 12),
            (None, same + " more", None, "s", *[None] * 12),
        ]
    )


@pytest.fixture(scope="session")
def n_odd():
    return 12
