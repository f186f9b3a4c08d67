import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pickwright.session import build_session

    scratch = tmp_path_factory.mktemp("scratch")
    s = build_session("tests", master="local[8]", partitions=4, scratch=scratch.as_uri())
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def rows():
    """Collect a DataFrame as sorted tuples of the given columns."""

    def collect(df, *cols, digits=6):
        def clean(v):
            return round(v, digits) if isinstance(v, float) else v

        return sorted((tuple(clean(r[c]) for c in (cols or df.columns)) for r in df.collect()), key=str)

    return collect
