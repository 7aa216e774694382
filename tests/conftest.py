import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from feedyard.session import local_session
    ckpt = tempfile.mkdtemp(prefix="feedyard-test-ckpt-")
    s = local_session("4", app="feedyard-tests", extra={"spark.sql.shuffle.partitions": "4",
                                                          "spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="feedyard-test-")


def write_file(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    data = text if isinstance(text, bytes) else text.encode(encoding)
    with open(path, "wb") as f:
        f.write(data)
    return path
