import pytest

from clinmill.runtime import local_session, shared_dir


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="4", partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    shared_dir(s)
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def clean(request):
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()
