import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["ta", "re", "mo", "lin", "sha", "do", "ver", "ki", "on", "bel"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def corpus() -> list[tuple]:
    """Plain, near-equal and equal texts, junk, a shared passage, and odd rows."""
    texts = [" ".join(prose(i, 60 + 7 * i)) + "." for i in range(24)]
    near = texts[5].split(" ")
    near[10] = "changed"
    passage = " ".join(prose(99, 60))
    texts += [" ".join(near), texts[6], texts[6], " ".join(prose(201, 70)) + " " + passage + " " + " ".join(prose(202, 30)), passage + " " + " ".join(prose(203, 80))]
    texts += [" ".join(w + "###" for w in prose(300 + i, 80)) for i in range(6)]
    texts += ["again " * 400, "one line here\n" * 30, "", "x", "two words", "é ü 😀 " * 40, "y" * 20000]
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None), (None, " ".join(prose(777, 90)), "en", "src0", 1), (3, texts[3], "en", "src3", len(texts[3])), (3, texts[3], "en", "src3", len(texts[3]))]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    marks = [(r[0], int("###" not in (r[1] or "") and len((r[1] or "").split()) > 5), 0) for r in corpus() if r[0] is not None]
    return spark.createDataFrame([*marks, (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
