import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)
sys.path.insert(0, ROOT)
# Python workers start from the JVM's environment: let them import the
# package and classes defined in test modules (fake model clients).
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, HERE] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])


@pytest.fixture(scope="session")
def spark():
    from quillrank.session import local_session
    s = local_session("*", shuffle_partitions=8, app="quillrank-tests")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"
