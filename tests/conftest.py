import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    from scangrid.session import build_session
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cloud(spark):
    """Build a points table from (x, y, z, pred[, truth[, frame]]) rows."""
    def build(rows, conf=1.0):
        full = [(0, int(r[5]) if len(r) > 5 else 0, i, float(r[0]), float(r[1]), float(r[2]),
                 int(r[3]), int(r[4]) if len(r) > 4 else int(r[3]), float(conf))
                for i, r in enumerate(rows)]
        return spark.createDataFrame(
            full, "sequence long, frame_id long, point_id long, x double, y double, z double, "
                  "pred int, truth int, conf double")
    return build
