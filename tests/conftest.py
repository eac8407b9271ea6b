import pytest

from barwright.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session("local[4]", partitions=4, memory="4g", name="tests")
    yield spark
    spark.stop()
