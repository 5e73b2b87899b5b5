"""Fixed-length windows of a feature table, and their tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpanel.functions import hurdle
from flowpanel.functions.calendar import elapsed_seconds
from flowpanel.plans.ordered import CHECK, RN, keep_ids, number_rows, resolve_hot
from flowpanel.schemas import C_IN, C_OUT, CALENDAR, STEP_MINUTES, STEPS_PER_DAY, USAGE_LAGS
from flowpanel.session import materialize

BLOCK = "_block"


def project_window_cols(features: DataFrame, keys: tuple[str, ...] = ("series_id", "date_time", "usage")) -> DataFrame:
    """Keys, target and the 12 + 10 condition columns, in tensor order."""
    return features.select(*keys, *C_IN, *C_OUT)


def _blocks(
    rows: DataFrame, key: str, time: str, matrices: dict[str, list[str]], size: int, require: str | None = None,
) -> DataFrame:
    """Rows (key, _block, _times, and each matrix as an array of rows): the rows of a series in blocks of `size`, each row once.

    Times and each matrix are lists of their own, so that Spark drops those nobody asks for before they are gathered and sorted.
    """
    block = F.floor((F.col(RN) - 1) / size).alias(BLOCK)
    values = dict.fromkeys(c for own in matrices.values() for c in own)
    lists = {"_times": [time], **matrices}
    ordered = [F.sort_array(F.collect_list(F.struct(RN, *dict.fromkeys(own)))).alias(name) for name, own in lists.items()]
    if require:
        ordered.append(F.bool_and(F.coalesce(require, F.lit(False))).alias(require))
        values[require] = None
    return rows.select(key, time, RN, *values, block).groupBy(key, BLOCK).agg(*ordered)


def _cut(
    rows: DataFrame, key: str, time: str, matrices: dict[str, list[str]], size: int, step_minutes: int, require: str | None = None,
) -> DataFrame:
    """Windows that do not overlap: the full blocks without a gap, and all of whose rows meet `require`."""
    times = F.col("_times").getField(time)
    full = _blocks(rows, key, time, matrices, size, require).where(F.size("_times") == size)
    full = full.where(require) if require else full
    full = full.withColumns({"window_idx": F.col(BLOCK), "window_start": F.get(times, 0), "_end": F.get(times, size - 1)})
    span = elapsed_seconds(full, "window_start", F.col("window_start"), F.col("_end"))
    whole = full.where(span == (size - 1) * step_minutes * 60)
    return whole.select(key, "window_idx", "window_start", *_by_feature(matrices))


def _by_feature(matrices: dict[str, list[str]]) -> list[Column]:
    """Each matrix from its array of rows, feature by feature; x of one feature is a plain array."""
    def turned(name: str, own: list[str]) -> Column:
        feature = [F.col(name).getField(c) for c in own]
        return feature[0] if name == "x" and len(own) == 1 else F.array(*feature)

    return [turned(name, own).alias(name) for name, own in matrices.items()]


def _slide(
    rows: DataFrame, key: str, time: str, matrices: dict[str, list[str]], size: int, stride: int, step_minutes: int, long_series: bool,
) -> DataFrame:
    """Windows at any stride as slices of a block and the one after it.

    Ordinary series meet their next block in the partition they are in already; the blocks of long
    series meet in a join, so that no task holds a series.
    """
    blocks = _blocks(rows, key, time, matrices, size)
    later = {name: f"_next_{name}" for name in ("_times", *matrices)}
    if long_series:
        blocks = materialize(blocks, "window-blocks")
        after = blocks.select(key, (F.col(BLOCK) - 1).alias(BLOCK), *[F.col(name).alias(after) for name, after in later.items()])
        blocks = blocks.join(after, [key, BLOCK], "left")
    else:
        next_block = Window.partitionBy(key).orderBy(BLOCK)
        blocks = blocks.withColumns({after: F.lead(name).over(next_block) for name, after in later.items()})
    both = [F.when(F.col(after).isNull(), F.col(name)).otherwise(F.concat(name, after)).alias(name) for name, after in later.items()]
    lists = blocks.select(key, BLOCK, *both)
    lists = lists.select(key, BLOCK, F.col("_times").getField(time).alias("_times"), *_by_feature(matrices))
    # Windows start inside the block, at positions of the series that the stride hits. Those with a gap are left out
    # here, where a start is one number, not behind the explode, where it is a row with all lists.
    first = F.pmod(-F.col(BLOCK) * size, F.lit(stride))
    last = F.least(F.size("_times") - size, F.lit(size - 1))
    starts = F.when(first <= last, F.sequence(first, last.cast("bigint"), F.lit(stride).cast("bigint")))

    def whole(at: Column) -> Column:
        start, end = F.get("_times", at.cast("int")), F.get("_times", at.cast("int") + size - 1)
        return elapsed_seconds(rows, time, start, end) == (size - 1) * step_minutes * 60

    at = lists.withColumn("_at", F.explode(F.filter(starts, whole)))
    place = F.col("_at").cast("int")

    def cut(name: str, own: list[str]) -> Column:
        """The window's part of a row, or of every row of a matrix, each by an expression of its own: inside a lambda a slice
        is interpreted and boxes the whole row first."""
        if name == "x" and len(own) == 1:
            return F.slice(name, place + 1, F.lit(size)).alias(name)
        return F.array(*[F.slice(F.get(name, k), place + 1, F.lit(size)) for k in range(len(own))]).alias(name)

    # A lambda keeps this projection out of whole-stage code, where all slices become one method, too long for the
    # JVM to compile. By itself a projection is generated in short methods.
    index = F.transform(F.array(F.floor((F.col(BLOCK) * size + F.col("_at")) / stride)), lambda k: k)
    return at.select(
        key, F.get(index, 0).alias("window_idx"), F.get("_times", place).alias("window_start"),
        *[cut(name, own) for name, own in matrices.items()])


def day_windows(
    features: DataFrame, key: str = "series_id", time: str = "date_time", x: str | list[str] = "usage",
    c_in: list[str] | None = None, c_out: list[str] | None = None, size: int = STEPS_PER_DAY,
    stride: int | None = None, step_minutes: int = STEP_MINUTES, hot: DataFrame | str | None = CHECK, require: str | None = None,
) -> DataFrame:
    """Gap-free windows of `size` rows, counted from the first row of each series.

    Windows do not realign after a gap: one missing hour shifts all later ones. A window is kept
    when it is full and its first and last rows are (size - 1) steps apart. Matrices are
    feature-major. Row numbers and grouping share one shuffle. Rows are grouped once, into blocks of
    `size`; with the default stride the blocks are the windows, with another one a window is a slice
    of two neighbouring blocks, so no row is moved or sorted once per window that holds it. `require` names a boolean
    column: windows with a row where it does not hold are left out, while the rows keep their places.
    """
    x = [x] if isinstance(x, str) else list(x)
    c_in = C_IN if c_in is None else c_in
    c_out = C_OUT if c_out is None else c_out
    matrices = {name: own for name, own in (("x", x), ("c_in", c_in), ("c_out", c_out)) if own}
    step = stride or size
    hot = resolve_hot(features, hot, key)

    def windows(rows: DataFrame, long_series: bool) -> DataFrame:
        if step == size:
            return _cut(rows, key, time, matrices, size, step_minutes, require)
        if not require:
            return _slide(rows, key, time, matrices, size, step, step_minutes, long_series)
        cut = _slide(rows, key, time, {**matrices, require: [require]}, size, step, step_minutes, long_series)
        return cut.where(F.forall(F.get(require, 0), lambda v: F.coalesce(v, F.lit(False)))).drop(require)

    def number(rows: DataFrame) -> DataFrame:
        return rows.withColumn(RN, F.row_number().over(Window.partitionBy(key).orderBy(time)).cast("bigint"))

    if hot is None:
        return windows(number(features), False)
    features = materialize(features, "window-input")
    cold = windows(number(keep_ids(features, hot, [key], "left_anti")), False)
    split = windows(number_rows(keep_ids(features, hot, [key]), key, time), True)
    return cold.unionByName(split)


def sliding_windows(features: DataFrame, stride: int = 1, **kwargs) -> DataFrame:
    return day_windows(features, stride=stride, **kwargs)


def finite_windows(windows: DataFrame) -> DataFrame:
    """Drop windows with a NULL, NaN or infinite element."""
    parts = [
        hurdle.is_finite(F.flatten(c) if "array<array" in windows.schema[c].dataType.simpleString() else F.col(c))
        for c in ("x", "c_in", "c_out") if c in windows.columns
    ]
    keep = parts[0]
    for part in parts[1:]:
        keep = keep & part
    return windows.where(keep)


def encode_windows(windows: DataFrame, stats: dict[str, float], masked: bool = True, flag_scaled: bool = False) -> DataFrame:
    """Raw windows to training tensors `x[2,n]`, `c_in[12,n]`, `c_out[10,n]`."""
    return windows.select(
        "series_id", "window_idx", "window_start",
        hurdle.encode_window(F.col("x"), stats).alias("x"),
        hurdle.scale_indoor(F.col("c_in"), stats, masked).alias("c_in"),
        hurdle.scale_outdoor(F.col("c_out"), stats, flag_scaled).alias("c_out"),
    )


def encode_rows(features: DataFrame, stats: dict[str, float], masked: bool = True) -> DataFrame:
    """The same encoding on feature rows, before they are cut: plain columns stay in generated code."""
    mean, std = stats["log_mean"], stats["log_std"]
    usage = F.col("usage")
    return features.select(
        "series_id", "date_time",
        hurdle.occurrence(usage).alias("mask"),
        hurdle.magnitude(usage, mean, std).alias("z"),
        *CALENDAR,
        *[hurdle.magnitude(F.col(c), mean, std, masked).alias(c) for c in USAGE_LAGS],
        *[hurdle.scale_weather(F.col(c), c, stats).alias(c) for c in C_OUT],
    )


def training_tensors(features: DataFrame, stats: dict[str, float], hot: DataFrame | str | None = CHECK) -> DataFrame:
    """Feature rows to finite training tensors in one shuffle.

    The rows are encoded and checked before they are cut: a window is finite when all its rows are, as in
    `finite_windows` of `encode_windows`, but no element of a window passes through a lambda.
    """
    rows = encode_rows(features, stats)
    # Times zero a finite number is zero; NULL, NaN and infinities are not.
    zeros = [F.col(c) * F.lit(0.0) for c in ("mask", "z", *C_IN, *C_OUT)]
    rows = rows.withColumn("_finite", sum(zeros[1:], zeros[0]) == F.lit(0.0))
    return day_windows(rows, x=["mask", "z"], hot=hot, require="_finite")


def as_float32(tensors: DataFrame) -> DataFrame:
    """Cast the tensors to float for the sink."""
    kinds = {c: tensors.schema[c].dataType.simpleString().replace("double", "float") for c in ("x", "c_in", "c_out")}
    return tensors.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def window_condition_means(windows: DataFrame) -> DataFrame:
    """The mean of each condition row over the steps: all a model with pooled conditions sees."""
    def row_mean(row: Column) -> Column:
        return F.aggregate(row, F.lit(0.0), lambda a, v: a + v) / F.size(row)

    return windows.select(
        "series_id", "window_idx",
        F.transform("c_in", row_mean).alias("c_in_mean"),
        F.transform("c_out", row_mean).alias("c_out_mean"),
    )


def explode_windows(windows: DataFrame, value: str = "x", name: str = "usage", keep: tuple[str, ...] = ()) -> DataFrame:
    return windows.select("series_id", "window_idx", *keep, F.posexplode(value).alias("interval", name))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def first_batches(windows: DataFrame, batches: int, batch_size: int = 32) -> DataFrame:
    return windows.orderBy("series_id", "window_idx").limit(batches * batch_size)
