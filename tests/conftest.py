import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from valuwatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, partitions=2)
    # tiny inputs: compiling stages costs more than it saves
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    return session
