import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickloom.session import local_session  # noqa: E402

DAY0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus="4")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Daily bars of one or more symbols from lists of closes (None = no bar that day)."""

    def make(**closes):
        rows = [
            (s, DAY0 + dt.timedelta(days=i), c, c * 1.01, c * 0.99, c, 100.0 + i)
            for s, cs in closes.items()
            for i, c in enumerate(cs)
            if c is not None
        ]
        return spark.createDataFrame(rows, "symbol string, day date, open double, high double, low double, close double, volume double")

    return make


def by_day(df, column, symbol=None):
    rows = df.where(f"symbol = '{symbol}'") if symbol else df
    return [r[column] for r in rows.orderBy("day").collect()]
