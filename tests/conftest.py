import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from scoutmill.session import discard_kept, local_session

    session = local_session(8, shuffle_partitions=4, memory="8g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    discard_kept(session)


@pytest.fixture
def many_tasks(spark):
    """Keep small shuffles in several tasks, so that slice edges are met."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
