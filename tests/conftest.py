import os
import sys
from pathlib import Path

import pytest

HOME = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, HOME)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, os.environ.get("PYTHONPATH")]))  # for the Python workers


@pytest.fixture(scope="session")
def spark():
    from tessera.session import session

    spark = session("local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    spark.sparkContext.setLogLevel("ERROR")
    return spark
