import pytest

from lanecast.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "lanecast-tests",
        master="local[8]",
        shuffle_partitions=8,
        **{
            "spark.driver.memory": "2g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.maxMetadataStringLength": "4000",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
