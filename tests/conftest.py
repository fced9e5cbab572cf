import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import importable, local_session

    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    importable(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
