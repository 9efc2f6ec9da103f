import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from toolsentry.schemas import FILES, TOOLS  # noqa: E402
from toolsentry.session import local_session  # noqa: E402
from toolsentry.sources.files import as_files  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    def make(contents, target="t"):
        rows = [(target, path, content) for path, content in contents.items()]
        return as_files(spark.createDataFrame(rows, "target string, path string, content string"))

    return make


@pytest.fixture(scope="session")
def make_tools(spark):
    def make(descriptions, schemas=None, target="t"):
        schemas = schemas or {}
        rows = [(target, tool, text, schemas.get(tool, "{}"), None) for tool, text in descriptions.items()]
        return spark.createDataFrame(rows, TOOLS)

    return make


__all__ = ["FILES", "make_files", "make_tools", "spark"]
