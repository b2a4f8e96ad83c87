from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from pricewren.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__driver__host="127.0.0.1")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
