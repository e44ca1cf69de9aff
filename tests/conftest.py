import datetime as dt
from decimal import Decimal as D
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ridelens.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

SCHEMAS = {
    "app_downloads": "app_download_key BIGINT, platform STRING, download_ts TIMESTAMP_NTZ",
    "signups": "user_id BIGINT, session_id BIGINT, age_range STRING",
    "ride_requests": ("ride_id BIGINT, user_id BIGINT, request_ts TIMESTAMP_NTZ, "
                      "accept_ts TIMESTAMP_NTZ, pickup_ts TIMESTAMP_NTZ, "
                      "dropoff_ts TIMESTAMP_NTZ, cancel_ts TIMESTAMP_NTZ"),
    "transactions": "ride_id BIGINT, purchase_amount_usd DECIMAL(12,2), charge_status STRING",
    "reviews": "ride_id BIGINT, user_id BIGINT, rating INT, review STRING",
}


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", app_name="ridelens-tests",
                          conf={"spark.sql.shuffle.partitions": "8",
                                "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ridelens-test-ckpt-"))
    yield session


def ts(*parts):
    return dt.datetime(*parts)


@pytest.fixture
def make_tables(spark):
    """Build the five funnel tables from lists of row tuples (missing = empty)."""
    def build(**rows):
        return {name: spark.createDataFrame(rows.get(name, []), schema)
                for name, schema in SCHEMAS.items()}
    return build


@pytest.fixture
def small_world(make_tables):
    """A hand-made world of 4 users, 6 rides, covering the traps."""
    T = ts
    return make_tables(
        app_downloads=[(1, "ios", T(2021, 1, 1, 8)), (2, "android", T(2021, 1, 1, 8)),
                       (3, "web", T(2021, 2, 3, 17)), (4, "ios", T(2021, 2, 3, 17)),
                       (5, "web", T(2021, 3, 1, 9))],
        signups=[(10, 1, "Not specified"), (20, 2, None), (30, 3, "35-44"), (40, 4, "25-34")],
        ride_requests=[
            # completed, two transactions (fan-out)
            (100, 10, T(2022, 5, 1, 8, 0), T(2022, 5, 1, 8, 7), T(2022, 5, 1, 8, 20),
             T(2022, 5, 1, 9, 35), None),
            # completed (75 min drive -> minute field 15)
            (101, 20, T(2022, 5, 1, 8, 10), T(2022, 5, 1, 8, 12), T(2022, 5, 1, 8, 30),
             T(2022, 5, 1, 9, 45), None),
            # cancelled 5.5 minutes *before* acceptance was recorded
            (102, 30, T(2022, 5, 1, 9, 0), T(2022, 5, 1, 9, 10), None, None,
             T(2022, 5, 1, 9, 4, 30)),
            # accepted, neither picked up nor cancelled
            (103, 30, T(2022, 6, 2, 16, 0), T(2022, 6, 2, 16, 3), None, None, None),
            # never accepted, cancelled after 24h5m
            (104, 40, T(2022, 6, 2, 16, 0), None, None, None, T(2022, 6, 3, 16, 5)),
            # rider without signup
            (105, 99, T(2022, 6, 2, 17, 0), T(2022, 6, 2, 17, 1), T(2022, 6, 2, 17, 9),
             T(2022, 6, 2, 17, 40), None),
        ],
        transactions=[(100, D("10.50"), "Approved"), (100, D("4.25"), "Approved"),
                      (101, D("7.00"), "Declined"), (105, D("3.00"), "Approved"),
                      (999, D("1.00"), "Approved")],
        reviews=[(100, 10, 5, "Drivers were courteous, on time"),
                 (100, 10, 3, "fine"),
                 (105, 99, 1, "rude"),
                 (777, 40, 4, "app is easy")],
    )


def canon(rows):
    """Rows as an order-free, NULL-safe comparable list."""
    return sorted((tuple(r) for r in rows), key=repr)
