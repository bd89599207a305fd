import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])  # the Python workers import the package too


@pytest.fixture(scope="session")
def spark():
    from lexweave.session import local_session

    session = local_session(4, 4, **{"spark.sql.warehouse.dir": "/tmp/lexweave-test-warehouse", "spark.checkpoint.dir": "/tmp/lexweave-test-shared"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("the driver's tables are not here")
    return str(folder)
