import tempfile

import pytest

from tokenloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="tokenloom-test-")
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=f"{folder}/checkpoints", spark__sql__warehouse__dir=f"{folder}/warehouse",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
