import pytest

from stagepath.staging import Staging


@pytest.fixture(scope="session")
def staging_factory(spark):
    return lambda: Staging(spark)
