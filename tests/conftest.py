import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sparkfeat.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="sparkfeat-tests-")
    session = local_session(8, memory="4g", **{
        "spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    yield session
    session.stop()
