import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shelfsift.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """(product_id, description) frame from a list of texts, ids from 0."""

    def build(rows, **columns):
        frame = [(i, text) for i, text in enumerate(rows)]
        return spark.createDataFrame(frame, "product_id bigint, description string")

    return build


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return SMALL
