import pytest

from gridsquall.session import build


@pytest.fixture(scope="session")
def spark():
    s = build("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
