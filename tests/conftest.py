import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from marginalia.session import local_session

    session = local_session(4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test data here")
    return str(DATA)
