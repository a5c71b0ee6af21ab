import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import local_session

    os.environ["SHUFFLE_PARTITIONS"] = "4"
    with tempfile.TemporaryDirectory() as folder:
        session = local_session(4, "3g", spark__checkpoint__dir=folder, spark__sql__warehouse__dir=f"{folder}/warehouse", spark__default__parallelism="4")
        yield session
        session.stop()
