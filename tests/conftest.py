import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from newsweave.session import build_session
    s = build_session("*", shuffle_partitions=8, app="newsweave-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect ``cols`` (or all) as a list of tuples, sorted."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)
