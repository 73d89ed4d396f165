from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from weftline.session import session, ship

    spark = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("OFF")
    yield ship(spark)
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
