import shutil
import tempfile

import pytest

from paperloom.session import session


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="paperloom-tests-")  # one machine, so a local folder is shared
    s = session("tests", "local[4]", spark__checkpoint__dir=folder, spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(folder, ignore_errors=True)
