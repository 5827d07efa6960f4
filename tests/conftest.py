import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ["TZ"] = "UTC"

TESTDATA = Path(os.environ.get("CLAIMLOOM_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from claimloom.session import get_spark

    session = get_spark(
        "tests",
        "local[4]",
        {
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(), "spark.sql.streaming.stopTimeout": "60s",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest test tables; tests over them are left out where they are missing."""
    if not (TESTDATA / "sf0.001").exists():
        pytest.skip("no test tables")
    return str(TESTDATA / "sf0.001")
