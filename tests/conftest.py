from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from papyrus.session import get_spark

    folder = tmp_path_factory.mktemp("spark")
    conf = {"spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.default.parallelism": "4"}
    session = get_spark("tests", "local[4]", 4, **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
