"""One session for all tests, and generated identities."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def unit(v):
    return v / np.linalg.norm(v)


@pytest.fixture(scope="session")
def identities():
    """40 vectors of 512 numbers: three identities of 12, then four strangers (-1)."""
    rng = np.random.default_rng(42)
    rows, truth = [], []
    for k in range(3):
        base = unit(rng.normal(size=512))
        for _ in range(12):
            rows.append(unit(base + rng.normal(0, 0.02, 512)))
            truth.append(k)
    for _ in range(4):
        rows.append(unit(rng.normal(size=512)))
        truth.append(-1)
    return np.array(rows, np.float32), np.array(truth)
