import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tellerlens.params import RunParams  # noqa: E402
from tellerlens.session import build_session  # noqa: E402
from tellerlens.sources.bank import Bank  # noqa: E402
from tellerlens.sources.schemas import SCHEMAS  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false",
           "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def params():
    return RunParams(as_of=datetime(2024, 4, 15, 9, 30))


def table(spark, name, rows):
    """A banking table from dicts; columns not given are NULL."""
    fields = SCHEMAS[name].fieldNames()
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], SCHEMAS[name])


def bank_of(spark, **tables):
    frames = {n: table(spark, n, rows) for n, rows in tables.items()}
    for name in SCHEMAS:
        if name not in frames and name != "aaml_sir_details":
            frames[name] = table(spark, name, [])
    return Bank.from_frames(spark, frames)
