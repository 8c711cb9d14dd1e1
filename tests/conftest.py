import sys
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tenurekit.config import Calendar, apply_runtime_defaults  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tenurekit-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(shared))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield apply_runtime_defaults(session)
    session.stop()


@pytest.fixture(scope="session")
def cal():
    return Calendar()


def moment(text):
    """'2026-03-01' or '2026-03-01 10:00' as a datetime; None stays None."""
    return datetime.fromisoformat(text) if text else None


def on(text):
    return date.fromisoformat(text) if text else None


TERM_SCHEMA = """subscription_id string, subscription_term_id string, term_number int, term_started_at timestamp,
    cancel_requested_at timestamp, term_ended_at timestamp, is_failed_payment_canceled boolean"""


@pytest.fixture(scope="session")
def make_terms(spark):
    """Term rows from (case, start, cancel, end[, failed-payment flag[, term number]])."""

    def make(*rows):
        filled = []
        for row in rows:
            case, start, cancel, end, *rest = row
            flag = rest[0] if rest else False
            number = rest[1] if len(rest) > 1 else 1
            sub, _, term = case.partition("/")
            filled.append((sub, term or f"{sub}-t", number, moment(start), moment(cancel), moment(end), flag))
        return spark.createDataFrame(filled, TERM_SCHEMA)

    return make


@pytest.fixture(scope="session")
def make_subs(spark):
    def make(*ids, paid=True, activated=True):
        return spark.createDataFrame(
            [(i, paid, activated) for i in ids], "subscription_id string, is_paid boolean, is_activated boolean"
        )

    return make
