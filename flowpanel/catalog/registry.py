"""Query registry: each query stands next to the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowpanel.catalog.inputs import Inputs, with_inputs

# The operators as they are, for timing, and with rounded output, for comparison.
PLAIN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6, view: Callable[[DataFrame], DataFrame] | None = None):
    """Register a query; `view` turns nested results into flat rows for the comparison."""
    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = fn(Inputs(spark, sf_dir))
            return rounded(view(result) if view else result, digits)

        PLAIN[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_inputs(sql)
        return fn

    return register


def _nudge(digits: int) -> float:
    """Means often end in an exact half. A shift far below the last digit rounds it up in both
    engines, whatever the last bits of the sum."""
    return 10.0 ** -(digits + 3)


# Below this size the product with a power of ten is known to about a hundred-thousandth.
_EXACT = 1e11


def round_half_up(value, digits: int):
    """`F.round` of a double, without a decimal number per value.

    Away from an exact half the nearest whole number of last digits is certain, and its quotient by a power of ten is
    the double nearest to the decimal, as `F.round` gives it. Halves, large values, NaN and infinities go to `F.round`.
    """
    scale = F.lit(10.0**digits)
    shifted = value * scale
    near = F.rint(shifted)
    certain = (F.abs(shifted) < F.lit(_EXACT)) & (F.abs(shifted - near) < F.lit(0.499))
    # Adding zero turns a negative zero into zero.
    return F.when(certain, near / scale + F.lit(0.0)).otherwise(F.round(value, digits))


# Columns whose rounding fits beside other steps in one method of generated code.
_INLINE = 3


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns, so that the last bits of a sum do not decide equality."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not doubles:
        return df
    nudge = F.lit(_nudge(digits))
    columns = {c: round_half_up(F.col(f"`{c}`") + nudge, digits) for c in doubles}
    if len(doubles) > _INLINE:
        # A lambda keeps the projection out of whole-stage code, where many columns become one method, too long for the
        # JVM to compile. By itself a projection is generated in short methods.
        own = F.get(F.transform(F.array(F.col(f"`{doubles[0]}`")), lambda v: v), 0)
        columns[doubles[0]] = F.round(own + nudge, digits)
    return df.withColumns(columns)


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """DuckDB text of the same rounding; a negative zero becomes zero as it does in Spark."""
    value = f"round({expression} + {_nudge(digits)!r}, {digits})"
    return f"CASE WHEN {value} = 0 THEN 0e0 ELSE {value} END AS {name or expression}"


def rs(*columns: str, digits: int = 6) -> str:
    return ", ".join(r(c, digits=digits) for c in columns)
