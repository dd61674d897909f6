import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from storelens.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    yield s


def make_lines(spark, rows):
    """Canonical base rows from dicts (missing fields get defaults)."""
    from storelens.schema import BASE_COLUMNS, ORDER_LINE_SCHEMA
    defaults = dict(order_id="O1", order_date=dt.date(2024, 1, 15), ship_date=dt.date(2024, 1, 18),
                    ship_mode="Standard", customer_id="C1", customer_name="Ann", segment="Consumer",
                    state="Ohio", region="East", category="Office", sub_category="Paper",
                    sales=Decimal("100"), quantity=1, discount=Decimal("0"), profit=Decimal("10"))
    out = []
    for i, r in enumerate(rows):
        d = dict(defaults, row_id=f"r{i:05d}")
        d.update(r)
        for k in ("sales", "discount", "profit"):
            if d[k] is not None and not isinstance(d[k], Decimal):
                d[k] = Decimal(str(d[k]))
        out.append(tuple(d[c] for c in BASE_COLUMNS))
    return spark.createDataFrame(out, ORDER_LINE_SCHEMA)


@pytest.fixture
def lines(spark):
    return lambda rows: make_lines(spark, rows)
