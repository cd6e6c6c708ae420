import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from hourweave.session import local_session

    session = local_session("tests", 8, 8)
    yield session
    session.stop()


@pytest.fixture
def small_blocks(monkeypatch):
    """Cut series into 4-day blocks, so that ordinary test data crosses many of them."""
    from hourweave.operators import blocks, grid

    monkeypatch.setattr(blocks, "BLOCK_HOURS", 96)
    monkeypatch.setattr(blocks, "_BLOCK_SECONDS", 96 * 3600)
    monkeypatch.setattr(grid, "BLOCK_HOURS", 96)
