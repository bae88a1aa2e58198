import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = "ka lo mi tu re sa ne po vi da".split()


def documents(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text) or more columns as documents."""
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def words(n, seed, vocabulary=None):
    """n seeded words, of many or of a given few."""
    rng = random.Random(seed)
    if vocabulary:
        return [rng.choice(vocabulary) for _ in range(n)]
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 5))) for _ in range(n)]


@pytest.fixture(scope="session")
def given():
    return "/root/testdata/sf0.001"
