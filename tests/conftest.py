import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]").appName("statframe-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    import statframe

    statframe.ship(s)
    yield s
    s.stop()


@pytest.fixture
def tight():
    """Force the split plans (range partitions, brackets, blocks) on small data."""
    from statframe.operators import core

    old = vars(core.LIMITS).copy()
    core.LIMITS.small_rows = core.LIMITS.map_rows = 20
    core.LIMITS.broadcast_rows = 8
    core.LIMITS.collect_rows = 8
    core.LIMITS.sample_rows = 40
    core.LIMITS.block_rows = 30
    core.LIMITS.groups = 2
    yield core.LIMITS
    for k, v in old.items():
        setattr(core.LIMITS, k, v)
