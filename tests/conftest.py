import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fieldloom.session import local_session

    work = tmp_path_factory.mktemp("spark")
    session = local_session(4, "tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.warehouse.dir": str(work / "warehouse"),
        "spark.checkpoint.dir": f"file://{work}/shared",
    })
    yield session
    session.stop()
