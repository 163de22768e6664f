import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chronoplane.keys import Keys  # noqa: E402
from chronoplane.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "8g", "tests")


@pytest.fixture()
def keys():
    return Keys("player_id", "game_date", "game_id", season="season")


def day(n: int, start: str = "2024-01-01") -> dt.date:
    return dt.date.fromisoformat(start) + dt.timedelta(days=n)


@pytest.fixture()
def sequential(spark):
    """One entity, a row every second day, values 10, 20, ... 100."""
    minutes = [25, 30, 35, 40, 35, 30, 25, 30, 35, 40]
    rows = [(1, 100 + i, day(2 * i), "2023-24", float(10 * (i + 1)), float(minutes[i])) for i in range(10)]
    return spark.createDataFrame(
        rows, "player_id long, game_id long, game_date date, season string, pra double, minutes double"
    )


@pytest.fixture()
def several(spark):
    """Three entities of five rows; value 20 + 5 id + 2 i."""
    rows = [
        (p, 100 * p + i, day(2 * i), "2023-24", float(20 + 5 * p + 2 * i), 30.0) for p in (1, 2, 3) for i in range(5)
    ]
    return spark.createDataFrame(
        rows, "player_id long, game_id long, game_date date, season string, pra double, minutes double"
    )


@pytest.fixture()
def not_played(spark):
    """Fifteen rows, not played at 2, 3, 7 and 13."""
    rows = [
        (1, i, day(2 * i), "2023-24", 0.0 if i in (2, 3, 7, 13) else 20.0, 0.0 if i in (2, 3, 7, 13) else 30.0)
        for i in range(15)
    ]
    return spark.createDataFrame(
        rows, "player_id long, game_id long, game_date date, season string, pra double, minutes double"
    )


def column(df, name, order="game_id"):
    return [r[name] for r in df.orderBy(order).collect()]
