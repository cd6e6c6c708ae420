"""Trailing means and lags on the gridded series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourweave import model
from hourweave.operators.blocks import in_time, own_rows, with_halo


def add_rolling_lags(
    df: DataFrame, value: str = "pm25", rolls: tuple = model.ROLLS, lags: tuple = model.LAGS
) -> DataFrame:
    """Means skip nulls and need one value; rows are hours because the grid has no holes."""
    order = in_time()
    out = with_halo(df, before=max(max(rolls) - 1, max(lags))).withColumns(
        {f"{value}_roll{n}": F.avg(value).over(order.rowsBetween(1 - n, 0)) for n in rolls}
        | {f"{value}_lag{n}": F.lag(value, n).over(order) for n in lags}
    )
    return own_rows(out)
