import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from joinwright.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("local[8]", "tests", spark__sql__shuffle__partitions="8", spark__checkpoint__dir=f"file://{shared}", spark__driver__memory="6g", spark__driver__host="127.0.0.1", spark__sql__warehouse__dir=str(shared / "warehouse"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
