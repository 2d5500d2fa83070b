"""Time series whose column names differ by source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions import times


def infer_series(
    table: DataFrame, keep: Sequence[str] = (), date_column: str | None = None, value_column: str | None = None
) -> DataFrame:
    """Rows as (day, value): the first known date and value column, numbers cleaned of commas and percent signs."""
    day = date_column or next((c for c in fixed.SERIES_DATE_COLUMNS if c in table.columns), None)
    value = value_column or next((c for c in fixed.SERIES_VALUE_COLUMNS if c in table.columns), None)
    if value is None:
        raise ValueError("cannot infer the value column; name it")
    number = F.regexp_replace(F.col(value).cast("string"), "[,%]", "").try_cast("double")
    moment = times.flexible_date(F.col(day)) if day else F.lit(None).cast("date")
    return table.select(*keep, moment.alias("day"), number.alias("value"))
