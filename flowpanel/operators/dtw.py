"""Dynamic time warping: pair distances, barycenter archetypes, alignments, monthly runs."""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpanel.functions import kernels
from flowpanel.functions.hashing import hash_key, text_key, text_pick
from flowpanel.operators.compare import REAL, SYNTHETIC
from flowpanel.operators.sampling import sample_homes
from flowpanel.plans.ordered import keep_ids
from flowpanel.session import discard, materialize, spread

# Fixed values of the evaluation.
BAND = 8
N_PAIRS = 1000
N_SAMPLE = 100
HOMES_PER_MONTH = 500
COMPARISONS = {
    "Real-vs-Real": (REAL, REAL),
    "Synthetic-vs-Synthetic": (SYNTHETIC, SYNTHETIC),
    "Real-vs-Synthetic": (REAL, SYNTHETIC),
}


def to_sequences(
    df: DataFrame, keys: tuple[str, ...] = ("source", "home_id"), time: str = "time", value: str = "usage"
) -> DataFrame:
    """One time-ordered array per key. Use a key with a day or month so that arrays stay bounded."""
    return df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v")))).getField("v").alias("seq")
    )


# Steps of a long history that lie in one row.
HISTORY_STEPS = 4096


def to_histories(
    df: DataFrame, keys: tuple[str, ...] = ("source", "home_id"), time: str = "time", value: str = "usage", steps: int = HISTORY_STEPS,
) -> DataFrame:
    """Whole histories in blocks: `keys, block, seq`, at most `steps` values in a row, in time order.

    A day's values are one array and days are placed by the counts before them, so no task sorts a history, and whole
    days move, not rows; repeated times count by value.
    """
    whole = df.select(*keys, F.col(time).alias("_t"), F.col(value).alias("_v")).withColumn("_day", F.to_date("_t"))
    days = whole.groupBy(*keys, "_day").agg(F.sort_array(F.collect_list(F.struct("_t", "_v"))).getField("_v").alias("_vs"))
    before = Window.partitionBy(*keys).orderBy(F.col("_day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = days.withColumn("_from", F.coalesce(F.sum(F.size("_vs")).over(before), F.lit(0)))
    placed = placed.withColumn("_to", F.col("_from") + F.size("_vs"))
    blocks = F.sequence(F.floor(F.col("_from") / steps), F.floor((F.col("_to") - 1) / steps))
    parts = placed.withColumn("block", F.explode(blocks))
    first = F.greatest(F.col("_from"), F.col("block") * steps)
    last = F.least(F.col("_to"), (F.col("block") + 1) * steps)
    part = F.slice("_vs", (first - F.col("_from") + 1).cast("int"), (last - first).cast("int"))
    joined = F.sort_array(F.collect_list(F.struct(first.alias("_at"), part.alias("_part"))))
    return parts.groupBy(*keys, "block").agg(F.flatten(joined.getField("_part")).alias("seq"))


def history_distances(
    pairs: DataFrame, histories: DataFrame, keys: tuple[str, ...] = ("source", "home_id"), pair_id: str = "pair_id", band: int = BAND,
) -> DataFrame:
    """`pair_id, distance` of pairs of whole histories, put together only where a pair is warped.

    `pairs` has the pair and the keys of both ends, suffixed _a and _b. The blocks of a pair arrive one after the
    other; the pairs of an Arrow batch are warped together, and one pair alone is the most that is kept beside them.
    The band keeps the warping linear in their length.
    """
    distances = kernels.dtw_distances
    ends = []
    for side in "ab":
        own = pairs.select(pair_id, *[F.col(f"{k}_{side}").alias(k) for k in keys])
        ends.append(own.join(histories, list(keys)).select(
            pair_id, F.lit(side).alias("side"), "block", F.col("seq").cast("array<double>").alias("seq")))

    def warp(batches):
        import numpy as np
        import pyarrow as pa

        def whole(rows, codes, first):
            parts = [([], []) for _ in first]
            side, seq = rows["side"].to_pylist(), rows["seq"].combine_chunks()
            offsets, values = seq.offsets.to_numpy(), seq.values.to_numpy(zero_copy_only=False)
            for k, code in enumerate(codes):
                parts[code][side[k] == "b"].append(values[offsets[k] : offsets[k + 1]])
            a, b = ([np.concatenate([np.empty(0), *own[k]]) for own in parts] for k in (0, 1))
            ids = rows[pair_id].combine_chunks().take(pa.array(first))
            return pa.RecordBatch.from_arrays([ids, pa.array(distances(a, b, band), from_pandas=True)], [pair_id, "distance"])

        held = None  # the pair that the next batch may go on with
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not len(rows):
                continue
            # Pairs are numbered in the order in which they come.
            codes = rows[pair_id].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.unique(codes, return_index=True)[1]
            last = int(first[-1])
            if last:
                yield whole(rows.slice(0, last), codes[:last], first[:-1])
            held = rows.slice(last)
        if held is not None and len(held):
            yield whole(held, np.zeros(len(held), dtype=int), np.zeros(1, dtype=int))

    kind = pairs.schema[pair_id].dataType.simpleString()
    blocks = spread(ends[0].unionByName(ends[1]), pair_id).sortWithinPartitions(pair_id, "side", "block")
    return blocks.mapInArrow(warp, f"{pair_id} {kind}, distance double")


def dtw_distance(left, right, band: int | None = BAND) -> Column:
    """Warping distance of two array columns; NULL where no path stays inside the band."""
    distances = kernels.dtw_distances

    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(distances(a.tolist(), b.tolist(), band))

    raw = udf(left, right)
    return F.when(~F.isnan(raw), raw)


def sample_sequences(
    traces: DataFrame, groups: tuple[str, ...] = (), keys: tuple[str, ...] = ("home_id",),
    n_sample: int = N_SAMPLE, seed: int = 42, time: str = "time", value: str = "usage",
) -> DataFrame:
    """Up to `n_sample` sequences per group and source, numbered by `_k`.

    Keys are drawn first, so only the rows of the drawn sequences are collected into arrays.
    """
    whole = [*groups, "source", *keys]
    order = Window.partitionBy(*groups, "source").orderBy(text_key(seed, *whole), *keys)
    drawn = (
        traces.select(*whole).distinct()
        .withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n_sample)
    )
    # At most n_sample keys per group and source.
    rows = traces.join(F.broadcast(drawn), whole)
    return to_sequences(rows, (*whole, "_k"), time, value)


def sample_pairs(
    sampled: DataFrame, groups: tuple[str, ...] = (), keys: tuple[str, ...] = ("home_id",),
    n_pairs: int = N_PAIRS, seed: int = 42,
) -> DataFrame:
    """`n_pairs` random pairs per comparison, with replacement, of sampled sequences.

    Both sides draw from as many sequences as the smaller source has. Self-pairs occur, as they
    do when both ends are drawn independently.
    """
    spark = sampled.sparkSession
    chosen = materialize(sampled, "dtw-sample")
    per_source = chosen.groupBy(*groups, "source").agg(F.count(F.lit(1)).alias("_n"))
    sizes = per_source.groupBy(*groups).agg(F.min("_n").alias("_n"), F.count(F.lit(1)).alias("_sources"))
    kinds = spark.createDataFrame([(k, a, b) for k, (a, b) in COMPARISONS.items()], "comparison string, _a string, _b string")
    draws = (
        sizes.where(F.col("_sources") == 2)
        .select(*groups, "_n", F.explode(F.array(*[F.lit(k) for k in COMPARISONS])).alias("comparison"))
        .join(F.broadcast(kinds), "comparison")  # three rows
        .withColumn("pair_id", F.explode(F.sequence(F.lit(1), F.lit(n_pairs))))
    )

    def rank(side: str) -> Column:
        return (text_pick(seed, F.col("_n"), *groups, "comparison", "pair_id", F.lit(side)) + 1).cast("int")

    draws = draws.withColumns({"_ka": rank("a"), "_kb": rank("b")})

    def end(side: str) -> DataFrame:
        return chosen.select(
            *groups, F.col("source").alias(f"_{side}"), F.col("_k").alias(f"_k{side}"),
            F.concat_ws("/", *keys).alias(f"id_{side}"), F.col("seq").alias(f"seq_{side}"),
        )

    return (
        draws.join(end("a"), [*groups, "_a", "_ka"]).join(end("b"), [*groups, "_b", "_kb"])
        .select(*groups, "comparison", "pair_id", "id_a", "id_b", "seq_a", "seq_b")
    )


def dtw_pairs(pairs: DataFrame, band: int | None = BAND) -> DataFrame:
    """Distance of every pair; the pairs are spread evenly, whatever their groups."""
    rest = [c for c in pairs.columns if c not in ("seq_a", "seq_b")]
    even = spread(pairs, "comparison", "pair_id")
    return even.select(*rest, dtw_distance("seq_a", "seq_b", band).alias("distance"))


def dtw_summary(distances: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    return distances.groupBy(*groups, "comparison").agg(
        F.avg("distance").alias("mean_distance"), F.var_samp("distance").alias("var_distance")
    )


def dba_archetype(
    sequences: DataFrame, keys: tuple[str, ...] = ("source",), seq_id: str = "home_id", iterations: int = 20,
    tolerance: float = 1e-3, band: int | None = None, seed: int = 42,
) -> DataFrame:
    """Warping barycenter per key: `keys, step, value, rounds`.

    Sequences stay where they are, equal ones as one with a weight. The centroids are a table: in
    each round those that still move are joined to their sequences, one sum and count per step comes
    back from every block of sequences, and the new centroids are written. Blocks are formed once, dealt
    to all tasks and added in their order: ties of the paths hang on the last bits of a sum. A key is done when no step moved by
    `tolerance`; `rounds` says how many rounds it took. The first centroid is the sequence with the
    smallest seeded hash.
    """
    typed = sequences.select(*keys, seq_id, F.col("seq").cast("array<double>").alias("seq"))
    start = typed.groupBy(*keys).agg(F.min_by("seq", F.struct(hash_key(seed, *keys, seq_id), F.col(seq_id))).alias("centroid"))
    start = start.where(F.size("centroid") > 0)
    equal = typed.groupBy(*keys, "seq").agg(F.count(F.lit(1)).alias("weight"))
    grouped = materialize(equal, "dba-grouped")
    current = materialize(start.withColumns({"rounds": F.lit(0).cast("bigint"), "done": F.lit(iterations <= 0)}), "dba-centroids")
    key_schema = ", ".join(f"{k} {grouped.schema[k].dataType.simpleString()}" for k in keys)
    sums_of, size_of = kernels.barycenter_sums, kernels.block_size
    names, block = list(keys), ["_part", "_batch", "_block"]

    def number(batches):
        for k, batch in enumerate(batches):
            batch["_m"] = [0 if s is None else len(s) for s in batch["seq"]]
            numbers, first = pd.Series(-1, index=batch.index), 0
            for key, rows in batch.groupby([*names, "_m"], sort=False, observed=True, dropna=False):
                if key[-1]:
                    own = [first + i // size_of(rows["_n"].iloc[0], key[-1], band, keep_steps=True) for i in range(len(rows))]
                    numbers.loc[rows.index] = own
                    first = own[-1] + 1
            numbered = batch.assign(_part=TaskContext.get().partitionId(), _batch=k, _block=numbers, _at=range(len(batch)))
            yield numbered.loc[numbers >= 0, [*names, "seq", "weight", *block, "_at"]]

    lengths = current.select(*keys, F.size("centroid").alias("_n"))
    numbered = grouped.join(lengths, names).mapInPandas(
        number, f"{key_schema}, seq array<double>, weight bigint, _part int, _batch int, _block int, _at int")
    kept = materialize(spread(numbered, *block).sortWithinPartitions(*block, "_at"), "dba-sequences")
    discard(grouped)

    def sums_by_block(rows):
        for key, own in rows.groupby([*names, *block], sort=False, observed=True, dropna=False):
            total, count = sums_of(own["seq"].tolist(), own["centroid"].iloc[0], band, own["weight"].to_numpy())
            out = {k: [key[i]] * len(total) for i, k in enumerate([*names, *block])}
            yield pd.DataFrame({**out, "step": range(len(total)), "total": total, "n": count})

    def partial(batches):
        held = None  # the block that the next batch may go on with
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(rows):
                last = (rows[block] == rows[block].iloc[-1]).all(axis=1)
                yield from sums_by_block(rows[~last])
                held = rows[last]
        if held is not None:
            yield from sums_by_block(held)

    for _ in range(iterations):
        moving = current.where(~F.col("done"))
        if moving.isEmpty():
            break
        rows = kept.join(moving.select(*keys, "centroid"), names)
        sums = rows.mapInPandas(partial, f"{key_schema}, _part int, _batch int, _block int, step int, total double, n bigint")
        ordered = F.sort_array(F.collect_list(F.struct(*block, "total")))
        total = F.aggregate(ordered, F.lit(0.0), lambda a, own: a + own["total"])
        means = sums.groupBy(*keys, "step").agg(total.alias("total"), F.sum("n").alias("n"))
        steps = moving.select(*keys, F.posexplode("centroid").alias("step", "old")).join(means, [*names, "step"], "left")
        value = F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.col("old"))
        moved = steps.select(*keys, "step", value.alias("value"), F.abs(value - F.col("old")).alias("by")).groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct("step", "value"))).getField("value").alias("centroid"), F.max("by").alias("by"))
        after = moving.select(*keys, "rounds").join(moved, names).select(
            *keys, "centroid", (F.col("rounds") + 1).alias("rounds"), (F.col("by") < tolerance).alias("done"))
        following = materialize(current.where("done").unionByName(after), "dba-centroids")
        discard(current)
        current = following
    return current.select(*keys, F.posexplode("centroid").alias("step", "value"), "rounds")


def _archetype_pairs(archetypes: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    seqs = archetypes.groupBy(*groups, "source").agg(
        F.sort_array(F.collect_list(F.struct("step", "value"))).getField("value").alias("seq")
    )

    def side(source: str, name: str) -> DataFrame:
        return seqs.where(F.col("source") == source).select(*groups, F.lit(0).alias("_one"), F.col("seq").alias(name))

    # One archetype per source and group, joined on the group.
    return side(REAL, "real").join(side(SYNTHETIC, "synthetic"), [*groups, "_one"]).drop("_one")


def dtw_alignment_path(archetypes: DataFrame, groups: tuple[str, ...] = (), band: int | None = BAND) -> DataFrame:
    """The warping path between the two archetypes: `pos, index1, index2, distance` (1-based)."""
    paths = kernels.dtw_paths

    @F.pandas_udf("distance double, path array<struct<index1:int,index2:int>>")
    def align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for x, y in zip(a, b):
            cost, cells = paths(np.asarray([x], dtype=float), np.asarray([y], dtype=float), band)
            out.append({
                "distance": float(cost[0]),
                "path": [{"index1": int(i[0]) + 1, "index2": int(j[0]) + 1} for i, j, _ in reversed(cells)],
            })
        return pd.DataFrame(out, columns=["distance", "path"])

    aligned = _archetype_pairs(archetypes, groups).withColumn("_a", align("real", "synthetic"))
    return aligned.select(
        *groups, F.col("_a.distance").alias("distance"), F.posexplode("_a.path").alias("pos", "_c")
    ).select(*groups, "distance", (F.col("pos") + 1).alias("pos"), "_c.index1", "_c.index2")


def mapping_segments(path: DataFrame, archetypes: DataFrame, groups: tuple[str, ...] = (), offset: float = 1.5) -> DataFrame:
    """Path cells as line segments; the synthetic curve is shifted by `offset` times the real peak."""
    def curve(source: str, index: str, value: str) -> DataFrame:
        rows = archetypes.where(F.col("source") == source)
        return rows.select(*groups, (F.col("step") + 1).alias(index), F.col("value").alias(value))

    real, synthetic = curve(REAL, "index1", "y_start"), curve(SYNTHETIC, "index2", "_y")
    peak = real.groupBy(*groups, F.lit(0).alias("_one")).agg((F.max("y_start") * offset).alias("_shift"))
    return (
        path.withColumn("_one", F.lit(0))
        .join(real, [*groups, "index1"]).join(synthetic, [*groups, "index2"]).join(peak, [*groups, "_one"])
        .select(*groups, "pos", F.col("index1").alias("x_start"), F.col("index2").alias("x_end"),
                "y_start", (F.col("_y") + F.col("_shift")).alias("y_end"))
    )


def thin_rows(path: DataFrame, groups: tuple[str, ...] = (), order: str = "pos", every: int = 2) -> DataFrame:
    """Every second row of a path in its order."""
    w = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(order)
    return path.withColumn("_k", F.row_number().over(w)).where(F.col("_k") % every == 0).drop("_k")


def _month_homes(traces: DataFrame, homes: int, seed: int, time: str) -> DataFrame:
    """The traces of at most `homes` drawn homes per month and source."""
    monthly = traces if "month" in traces.columns else traces.withColumn("month", F.month(time))
    chosen = F.broadcast(sample_homes(monthly, homes, seed, ("month", "source")))
    return keep_ids(monthly, chosen, ["month", "source", "home_id"])


def monthly_dtw(
    traces: DataFrame, homes: int = HOMES_PER_MONTH, n_pairs: int = N_PAIRS, band: int = BAND, seed: int = 42,
    time: str = "time",
) -> DataFrame:
    """The pair distances of every month at once: the month is a grouping key, not a loop."""
    kept = _month_homes(traces, homes, seed, time)
    pairs = sample_pairs(sample_sequences(kept, ("month",), seed=seed, time=time), ("month",), n_pairs=n_pairs, seed=seed)
    return dtw_summary(dtw_pairs(pairs, band), ("month",))


def monthly_archetypes(
    traces: DataFrame, homes: int = HOMES_PER_MONTH, iterations: int = 20, band: int | None = None, seed: int = 42,
    time: str = "time", parts: tuple[str, ...] = (),
) -> DataFrame:
    """The archetype of every month and source: `month, source, step, value, rounds`.

    A sequence is a home's month, or with `parts`, columns that cut the month, one part of it.
    `dtw_alignment_path` and `mapping_segments` with groups=("month",) align the two of a month.
    """
    kept = _month_homes(traces, homes, seed, time)
    sequences = to_sequences(kept, ("month", "source", "home_id", *parts), time)
    sequences = sequences.withColumn("_id", F.concat_ws("/", "home_id", *[F.col(p).cast("string") for p in parts]))
    return dba_archetype(sequences, ("month", "source"), "_id", iterations, band=band, seed=seed)
