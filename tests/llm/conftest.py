import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from corpus_rows import SHAPE, odd_rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SHAPE)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
