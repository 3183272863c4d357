from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lupafiscal import session  # noqa: E402

QUIET = {
    "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "3",
    "spark.default.parallelism": "3",
    "spark.driver.memory": "6g",
}


@pytest.fixture(scope="session")
def spark():
    spark = session.build("local[8]", "lupafiscal-tests", **QUIET)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def settings(spark):
    """Set Spark settings for one test."""
    changed = {}

    def change(values: dict[str, str]) -> None:
        for key, value in values.items():
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
