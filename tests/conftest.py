import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyscope.schemas import TRANSACTIONS  # noqa: E402
from tallyscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4)


@pytest.fixture
def make_txns(spark):
    """Builds a transactions table from (customer, date, amount, type, merchant, series) rows."""

    def make(rows):
        full = [
            (
                str(i), customer, dt.date.fromisoformat(date), Decimal(str(amount)),
                merchant or "other", kind, merchant, series,
            )
            for i, (customer, date, amount, kind, merchant, series) in enumerate(rows)
        ]
        return spark.createDataFrame(full, TRANSACTIONS)

    return make


@pytest.fixture(scope="session")
def features_of():
    """All features of one customer as a dict."""
    from tallyscope.operators import store

    def features(txns, customer="c1", **options):
        wide = store.features_wide(txns, store.feature_groups(**options))
        return wide.where(wide.customer_id == customer).first().asDict()

    return features
