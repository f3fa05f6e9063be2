import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from packetlog.session import local_session
    warehouse = tempfile.mkdtemp(prefix="packetlog-wh-")
    s = local_session("4", 4, app="packetlog-tests",
                      extra={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="packetlog-test-")
