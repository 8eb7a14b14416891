"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def net_price(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    return F.col(price) * (1 - F.col(discount))


def json_long(column: str, field: str) -> Column:
    """A whole-number field of a JSON text; null where it is missing."""
    return F.get_json_object(column, f"$.{field}").cast("long")
