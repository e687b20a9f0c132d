import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    from tallyforge.session import local_session
    session = local_session("tests", shuffle=4)
    yield session
    session.stop()


@pytest.fixture
def tight(spark):
    """Limits so low that every size-aware helper takes its distributed form."""
    keys = {"tallyforge.smallBytes": "0", "tallyforge.broadcastBytes": "0", "tallyforge.hotRows": "3"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)
