from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for folder in (ROOT, os.path.join(ROOT, "tools"), os.path.join(ROOT, "tests")):
    sys.path.insert(0, folder)

from check import oracle, session  # noqa: E402

from openchair.plans.staging import drop_staged  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session(int(os.environ.get("TEST_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    drop_staged(spark)
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def sql(sf_dir):
    return oracle(sf_dir)
