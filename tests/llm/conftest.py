import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return corpus.frame(spark, [])
