import random

import pytest

WORDS = (
    "amber basin cedar delta ember fjord grove harbor island jetty kelp lagoon meadow north"
    " orchard prairie quarry river summit tundra upland valley willow yonder zephyr"
).split()


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def prose(rng):
    def make(count: int) -> str:
        return " ".join(f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(count))

    return make


@pytest.fixture
def documents(spark):
    """A table of documents from ids and texts, with columns that clash with working names."""

    def make(rows):
        rows = [(i, text, "en", "s", 1, 9, "t") for i, text in rows]
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long,"
            " score long, places string"
        )
        return spark.createDataFrame(rows, schema)

    return make
