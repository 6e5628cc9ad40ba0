"""One local session for all tests."""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = Path(os.environ.get("FOLIATE_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from foliate.session import session

    at = tempfile.mkdtemp(prefix="foliate-tests-")
    s = session(
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=f"file://{at}/shared",
        spark__sql__warehouse__dir=f"{at}/warehouse",
        spark__local__dir=f"{at}/local",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny() -> str:
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def small() -> str:
    return str(DATA / "sf0.01")
