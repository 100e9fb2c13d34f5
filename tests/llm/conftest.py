import hashlib
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, spans string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, columns with names that operators use."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the very angry bear in the wood "
    texts = [None, "", " \n", "one", base, base, base + "twice", base * 40, "Ünï çode ﷺ 東京 " * 30, "123 ... !!!", "A" * 5000, "x y " * 3000]
    rows = [(k, t, "en" if k % 2 else None, None, None, 0.5, "fp", "s") for k, t in enumerate(texts)]
    rows += [rows[4], (None, base, None, "s", 1, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def sample(spark):
    """Real rows of the smallest table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
