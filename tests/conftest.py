import os

import pytest

os.environ.setdefault("PYSPARK_PYTHON", "python")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from archivolt.session import local_session

    folder = tmp_path_factory.mktemp("spark")
    session = local_session(4, 4, "4g", **{"spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.checkpoint.dir": str(folder / "checkpoints")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
