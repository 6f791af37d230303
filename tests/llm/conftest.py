import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
