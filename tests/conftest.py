import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from defectloom.session import session

    s = session("local[4]", 4, spark__ui__enabled="false", spark__driver__memory="3g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
