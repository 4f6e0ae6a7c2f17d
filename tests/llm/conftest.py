import os

import pytest

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def medium():
    if not os.path.isdir(MEDIUM):
        pytest.skip("no test tables")
    return MEDIUM


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Rows with nulls, empty and blank texts, ties, repeats, a long text and names that clash with the operators' own."""
    prose = "the quick brown fox jumps over the lazy dog while seven wise owls watch from their old oak tree."
    rows = [
        (1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \t\n "), (None, prose + " Then it rains."), (None, None),
        (6, "one"), (7, " ".join(f"word{i}" for i in range(60_000))), (8, "É\u0000ü 😀 \n" * 3), (-9, "x " * 200),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, fp long, part int, shard string, low int, component int, n_words int"
    return spark.createDataFrame(
        [(i, t, None if i == 3 else "en", None if i == 4 else "s", None if t is None else len(t), 0, 0, "x", 1, 2, 3) for i, t in rows], names)
