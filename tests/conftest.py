import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from binflow.session import local_session  # noqa: E402

T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "binflow-tests", 4)
    yield session
    session.stop()


def hour(h: float) -> datetime:
    return T0 + timedelta(hours=h)


def nulls_first(row):
    return [(v is not None, v) if not isinstance(v, (dict, list)) else (True, str(v)) for v in row]


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=nulls_first)
