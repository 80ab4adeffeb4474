import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from terraloom.operators import ordering  # noqa: E402
from terraloom.session import build_session, clear_materialized  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__ui__enabled="false",
                            spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_materialized(session)
    session.stop()


@pytest.fixture(params=["plain", "bucketed"])
def path(request, monkeypatch):
    """Run a test with the plain plans and with the plans for inputs that do not fit one task."""
    if request.param == "bucketed":
        monkeypatch.setattr(ordering, "ONE_TASK_BYTES", -1)
        monkeypatch.setattr(ordering, "PLAIN_WINDOW_ROWS", -1)
    return request.param
