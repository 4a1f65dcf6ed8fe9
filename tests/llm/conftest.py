import pytest

pytest.importorskip("cellprobe.llm")

from odd_rows import ODD, ODD_DDL  # noqa: E402
from public_tokenizers import path  # noqa: E402


@pytest.fixture(scope="session")
def vocabulary():
    return path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_DDL).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD_DDL)
