import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def texts():
    """Identifiers and texts with copies, near copies, blanks, nulls, repeated rows and one long text."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 120))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 120):  # near copies of a few
        w = base[i % 7].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(120, base[3].replace(" ", "\n\t ")), (121, base[3].upper()), (122, None), (123, ""), (124, " \n\v\f\r"), (125, "one two"), (126, "One  TWO"), (127, "été né"), (128, "ÉTÉ né")]
    rows += [(129, " ".join(rng.choices(words, k=30_000))), (130, base[5]), (130, base[5]), (None, base[6]), (131, "a b c d e f"), (132, "漢字 ひらがな")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, ["en", "de", None][(i or 0) % 3], ["a", "b", None, "Z"][(i or 0) % 4], len(t or "") or None) for i, t in texts], SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
