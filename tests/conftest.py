from __future__ import annotations

import os
import time

import pytest

from hourtally import build_session

os.environ["TZ"] = "UTC"  # Row timestamps come back in local time
time.tzset()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "hourtally-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
