import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import make_documents, near_copies  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    # with a repeated row, a repeated id and ids that are null
    found = near_copies()
    return [*found, found[4], (found[5][0], "another text with that id"), (None, "text without an id"), (None, None)]


@pytest.fixture(scope="session")
def documents(spark, rows):
    return make_documents(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make_documents(spark, [])
