import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strataloom.session import get_session, ship


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", 4, **{"spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
