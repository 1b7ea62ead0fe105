import os

import pytest

from cortigraph.session import local_session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return local_session("4", partitions=4, memory="4g")
