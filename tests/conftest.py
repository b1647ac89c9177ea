import pytest

from weir.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("weir-tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
