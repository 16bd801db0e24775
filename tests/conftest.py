import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sceneframe.session import build_session

    session = build_session("local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Every ordered computation takes its sliced way while this is in use."""
    spark.conf.set("sceneframe.skew.taskBytes", "0")
    yield
    spark.conf.unset("sceneframe.skew.taskBytes")
