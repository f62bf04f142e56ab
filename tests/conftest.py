import pytest

from gridprobe.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("gridprobe-tests")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
