import pytest

from lexloom.session import session


@pytest.fixture(scope="session")
def spark():
    own = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()
