from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import local_session

    return local_session(8, name="cohortlens-tests")


def pytest_generate_tests(metafunc):
    if "bound_query" in metafunc.fixturenames:
        from cohortlens.bindings import QUERIES

        metafunc.parametrize("bound_query", sorted(QUERIES))
