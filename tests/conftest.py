import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from veriframe.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = session(4, "tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.default.parallelism": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.driver.memory": "6g",
    })
    yield found
    found.stop()
