import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plaudit.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(8, "tests", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(params=["broadcast", "shuffle"])
def join_mode(request, monkeypatch):
    """Runs a test with both ways of joining group values back."""
    from plaudit.operators import scale

    if request.param == "shuffle":
        monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(scale, "HOT_GROUPS", 2)
    return request.param
