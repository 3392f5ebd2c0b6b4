import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessella.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session("tests", shuffle_partitions=4, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
