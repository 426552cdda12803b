from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from atom_tables import atom_rows  # noqa: E402
from atomframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mixed(spark):
    """ALA 1 and SER 2 in chain A; a zinc and a water in chain B."""
    return atom_rows(spark, [
        ("A", 1, "ALA", "N", "N", 0, 0, 0),
        ("A", 1, "ALA", "CA", "C", 1.5, 0, 0),
        ("A", 1, "ALA", "C", "C", 3, 0, 0),
        ("A", 1, "ALA", "O", "O", 3, 1.2, 0),
        ("A", 1, "ALA", "CB", "C", 1.5, 1.5, 0, {"b": 80.0}),
        ("A", 2, "SER", "CA", "C", 6, 0, 0),
        ("A", 2, "SER", "OG", "O", 6, 1.5, 0),
        ("B", 3, "ZN", "ZN", "ZN", 7, 2.5, 0, {"hetero": True}),
        ("B", 4, "HOH", "O", "O", 20, 0, 0, {"hetero": True}),
    ]).cache()
