from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests", shuffle=4)


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture()
def tiny_tasks(spark, request):
    """Force the split paths: a key of the test data is cut into a handful of blocks."""
    from tidemark.operators.series import ROWS_PER_TASK

    spark.conf.set(ROWS_PER_TASK, request.param if hasattr(request, "param") else "40")
    yield
    spark.conf.unset(ROWS_PER_TASK)
