from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tests")):
    if path not in sys.path:
        sys.path.insert(0, path)

from ronda.schemas import SCHEMAS  # noqa: E402
from ronda.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def make(spark):
    """make("grants", dict(...), ...): a logical table of literal rows."""

    def build(table: str, *rows: dict):
        schema = SCHEMAS[table]
        unknown = {key for row in rows for key in row} - set(schema.names)
        assert not unknown, unknown
        return spark.createDataFrame([tuple(row.get(n) for n in schema.names) for row in rows], schema)

    return build
