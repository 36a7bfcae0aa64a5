import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (str(ROOT), str(ROOT / "tests")):
    if folder not in sys.path:
        sys.path.insert(0, folder)

from helpers import SMALL  # noqa: E402

from sitegrain.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__sql__maxMetadataStringLength="20000",
        spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from workload.inputs import Inputs

    return Inputs(spark, SMALL)
