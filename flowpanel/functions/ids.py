"""Meter identifiers. They are text; leading zeros are significant."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_WIDTH = 10


def id_prefix(series_id, width: int = ID_WIDTH) -> Column:
    """The join key of a series: the first `width` characters of its full column name."""
    return F.substring(series_id, 1, width)


def id_pad(meter_id, width: int = ID_WIDTH) -> Column:
    """Left-pad with zeros. Longer ids stay whole, which `lpad` alone would cut."""
    text = F.col(meter_id).cast("string") if isinstance(meter_id, str) else meter_id.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def id_strip_zeros(meter_id) -> Column:
    text = F.col(meter_id) if isinstance(meter_id, str) else meter_id
    return F.regexp_replace(text.cast("string"), "^0+", "")


def id_from_path(path) -> Column:
    """The digits after `meter_` in a file name; NULL when there are none."""
    found = F.regexp_extract(path, "meter_([0-9]+)", 1)
    return F.when(found != "", found)
