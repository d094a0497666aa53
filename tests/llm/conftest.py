import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept_id string, sha string, row string, sig string, n string, key string, blocks string, p_toxic string, component_id string"


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, repeated rows, copies, near copies, shared passages; extra columns with clashing names."""
    base, passage, long = prose(1, 300), prose(2, 60), prose(3, 30_000, 40_000)
    near = base.split()
    near[150] = "changed"
    texts = [(1, base), (2, base), (3, base), (3, base), (4, " ".join(near)), (5, None), (6, ""), (7, "  \n "), (8, None), (None, passage), (None, None)]
    texts += [(9, prose(4, 40) + " " + passage + " " + prose(5, 40)), (10, passage + " " + prose(6, 70)), (11, "Ünï " * 30), (12, "one"), (13, "One"), (14, "two words")]
    texts += [(15, long), (16, long + " end"), (17, "same id"), (17, base + " same id"), (18, "x" * 49), (19, "x" * 50), (20, "x" * 200)]
    texts += [(100 + i, " ".join(w if j != 7 * i % 300 else f"edit{i}" for j, w in enumerate(base.split()))) for i in range(90)]
    texts += [(300 + i, prose(7, 30)) for i in range(40)]
    return [(i, t, None if k % 9 == 0 else "en", None, None, "a", "b", "c", "d", "e", "f", "g", "h", "i") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
