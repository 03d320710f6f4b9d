import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestone.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def listens(spark, tmp_path_factory):
    """24 users with 6 rows each in 2 sorted files."""
    from lodestone.sources import layouts

    path = str(tmp_path_factory.mktemp("data") / "listens")
    layouts.write_layout(layouts.sample_listens(spark), path, "sorted", files=2)
    return path
