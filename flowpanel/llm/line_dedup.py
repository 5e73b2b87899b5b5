"""Fuzzy line dedup by MinHash.

Equal lines are joined first. Every different line gets a signature: one permutation of its
character shingles, cut into bins, the least hash of each bin (empty bins borrow from the next one).
Bands of the signature bring similar lines together, candidates are verified by the exact Jaccard
similarity of their shingle sets, and distributed union-find over the verified links makes
components, of which one line is kept: the first by document id and line number.

The lines of a band bucket are never paired with each other. They are compared with one leader; two
lines near it can be similar only if they share many of their differences to it, so they are looked up
by their rarest differences. A line close to the leader is answered then, as all lines similar to it
are near the leader too. Those that are not choose a new leader, for some rounds; lines that are far
from all leaders so far are looked up by their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpanel.llm.common import components, cut, mix64, once, release, shuffle_partitions, text_chunks

WIDTH = 8
THRESHOLD = (80, 100)
BANDS, ROWS = 12, 4  # a pair at similarity 0.8 shares a band with probability 0.998, at 0.9 with 0.999997
KEPT_LINES = 200_000
# Leaders that the lines of a bucket are compared with, one after another.
ROUNDS = 3
HASH_SEED = 42  # that of Spark's xxhash64
BLANK = r"^[\x20\x09-\x0D]*$"


def shingle_hashes(lines: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(line index, hash) of all character shingles; a line shorter than `width` is one shingle."""
    lengths = np.array([len(x) for x in lines], dtype=np.int64)
    pad = "\0" * (width - 1)
    codes = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    starts = np.cumsum(lengths + width - 1) - (lengths + width - 1)
    n = np.maximum(lengths - width + 1, 1)
    owner = np.repeat(np.arange(len(lines)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    with np.errstate(over="ignore"):
        rolled = _rolled(codes, width)
        return owner, mix64(rolled[at] + np.repeat(np.minimum(lengths, width).astype(np.uint64), n))


def _rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hash of every window of `width` codes, put together from windows of half the size."""
    out, done, power, size = None, 0, np.uint64(0x9E3779B97F4A7C15), 1
    part = codes  # hashes of windows of `size`, whose factor is `power`
    while True:
        if width & size:
            if out is None:
                out, done = part, size
            else:
                n = len(codes) - done - size + 1
                out, done = out[:n] * power + part[done : done + n], done + size
        if size * 2 > width:
            return out[: len(codes) - width + 1]
        n = len(codes) - 2 * size + 1
        part = part[:n] * power + part[size : size + n]
        power, size = power * power, size * 2


def band_keys(lines: list[str], bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> np.ndarray:
    """One row of `bands` 64-bit keys per line."""
    bins = bands * rows
    owner, h = shingle_hashes(lines, width)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full(len(lines) * bins, empty, dtype=np.uint64)
    # The high half picks the bin, as a share of all bins; inside a bin what is left of it and the low half decide.
    bin_of = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    np.minimum.at(table, owner * bins + bin_of.view(np.int64), h)
    table = table.reshape(-1, bins)
    # An empty bin borrows the value of the next one that is not empty, changed by the distance.
    at = np.arange(2 * bins)
    place = np.where(np.hstack([table, table]) != empty, at, 2 * bins)
    ahead = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :bins]
    away = (ahead - at[:bins]).astype(np.uint64)
    with np.errstate(over="ignore"):
        value = np.take_along_axis(table, ahead % bins, axis=1)
        table = np.where(away > 0, mix64(value + away), value)
        keys = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(lines), 1))
        for r in range(rows):
            keys = mix64(keys * np.uint64(0xD6E8FEB86659FD93) + table[:, r::rows])
    return keys


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, line_no, h) of the lines that are not blank."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t")).where("doc_id is not null")
    rows = rows.select("doc_id", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    return rows.where(~F.col("line").rlike(BLANK)).select("doc_id", "line_no", F.xxhash64("line").alias("h"))


def _bands(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, width: int) -> DataFrame:
    """Rows (key, h): the bands of every line, lines of one task mostly once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, own in text_chunks(batches, "k", "t"):
            fresh: dict[int, bytes] = {}
            for t in own:
                for line in t.split(b"\n"):
                    if line and not line.isspace():
                        h = xxhash.xxh64_intdigest(line, HASH_SEED)
                        if h not in seen:
                            fresh[h] = line
            if not fresh:
                continue
            if len(seen) > KEPT_LINES:
                seen.clear()
            seen.update(fresh)
            keys = band_keys([x.decode() for x in fresh.values()], bands, rows, width)
            ids = np.fromiter(fresh, dtype=np.uint64, count=len(fresh)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, bands))], names=["key", "h"])

    rows_in = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    return rows_in.mapInArrow(run, "key bigint, h bigint")


def _buckets(bands: DataFrame) -> DataFrame:
    """The different rows (key, h) of buckets with two or more lines.

    Rows are sorted by bucket and streamed, so a large bucket is never held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None  # the last row, whose follower is not known yet
        before: int | None = None  # the bucket of the row before it
        for b in batches:
            key, h = (b.column(i).to_numpy() for i in range(2))
            if held is not None:
                key, h = np.append(held[0], key), np.append(held[1], h)
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            key, h = key[new], h[new]
            same = key[1:] == key[:-1]
            first = before is not None and len(key) > 0 and key[0] == before
            keep = np.append(first, same)[:-1] | same  # of all rows but the last
            if len(key) > 1:
                before = int(key[-2])
            if len(key):
                held = (key[-1], h[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(h[:-1][keep])], names=["key", "h"])
        if held is not None and before == held[0]:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], names=["key", "h"])

    n = shuffle_partitions(bands.sparkSession)
    return bands.repartition(n, "key").sortWithinPartitions("key", "h").mapInArrow(run, "key bigint, h bigint")


def compared(s: np.ndarray, t: np.ndarray) -> tuple[int, np.ndarray | None]:
    """(size of the intersection, what sets two sorted sets apart: see `near`)."""
    both = np.intersect1d(s, t, assume_unique=True)
    if not near(len(s), len(t), len(both)):
        return len(both), None
    added, missing = np.setdiff1d(s, both, assume_unique=True), np.setdiff1d(t, both, assume_unique=True)
    return len(both), np.concatenate([added | np.uint64(1), missing & ~np.uint64(1)]).view(np.int64)


def near(n, m, common):
    """A similarity of at least 1/3. Whatever is similar to a line well above that is near the same leader."""
    return 4 * common >= n + m


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (h, line) for the lines `wanted` (h, doc_id, line_no)."""
    places = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h")).alias("at"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t")).join(places, "doc_id")
    rows = rows.select("at", once(F.split("t", "\n")).alias("lines"))
    found = rows.select("lines", F.explode("at").alias("x")).select(F.col("x.h").alias("h"), F.get("lines", F.col("x.line_no")).alias("line"))
    return found.where(F.xxhash64("line") == F.col("h")).dropDuplicates(["h"])


def _overlaps(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) with their exact similarity as common / (n + m - common), and what sets them apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                sets = []
                for side in ("la", "lb"):
                    lines = part.column(side).to_pylist()
                    different = list(dict.fromkeys(lines))
                    owner, h = shingle_hashes(different, width)
                    ends = np.searchsorted(owner, np.arange(len(different) + 1))
                    own = {x: np.unique(h[ends[i] : ends[i + 1]]) for i, x in enumerate(different)}
                    sets.append([own[x] for x in lines])
                n, m = ([len(s) for s in side] for side in sets)
                common, diff = zip(*(compared(x, y) for x, y in zip(*sets, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(common, pa.int64()),
                     pa.array(diff, pa.list_(pa.int64()))], names=["a", "b", "n", "m", "common", "diff"])

    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("la")), "a")
    both = both.join(texts.select(F.col("h").alias("b"), F.col("line").alias("lb")), "b").select("a", "b", "la", "lb")
    return both.mapInArrow(run, "a bigint, b bigint, n bigint, m bigint, common bigint, diff array<bigint>")


def _by_differences(first: DataFrame, roots: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of lines near one leader, in different components, that may be similar.

    With the differences to the leader known, the overlap of two lines is what the leader keeps in
    both plus the differences they share. So many of these are needed that one of them is early in
    both lists, which are ordered from rare to frequent among the lines of the leader: what sets the
    leader itself apart is shared by all of them and stands last. Differences of one line only link
    nothing and just take their places.
    """
    lines = first.where("diff is not null").select(F.col("a").alias("id"), F.col("b").alias("lid"), "n", F.col("m").alias("ln"), "common", "diff")
    lines = lines.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = lines.groupBy("lid").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("lid")
    lines = cut(lines.join(mixed, "lid", "left_semi"), "near-lines")
    tokens = lines.select("id", "lid", F.explode("diff").alias("token"))
    counts = tokens.groupBy("lid", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = tokens.join(counts, ["lid", "token"]).groupBy("id", "lid").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("ts"))
    facts = lines.select("id", "lid", "n", "ln", "common", "root", F.size("diff").alias("size"))
    rows = facts.join(shared, ["id", "lid"]).select("*", (F.col("size") - F.size("ts")).alias("alone"), F.posexplode("ts").alias("i", "t"))
    rows = rows.withColumn("pos", F.col("alone") + F.col("i"))
    # A pair needs as many shared differences as both lack together and what the leader's size adds;
    # one of the two lacks something, the other at least the negative of what the size adds.
    share = threshold[0] / (threshold[0] + threshold[1])
    lacks, adds = share * (F.col("n") + F.col("ln")) - F.col("common"), F.col("ln") * (1 - 2 * share)
    early = F.col("pos") + F.when(lacks > 0, lacks).otherwise(lacks + adds) <= F.col("size") + 1e-6
    rows = cut(rows.where(early).select("id", "lid", "n", "ln", "common", "root", "size", "pos", F.col("t.token").alias("token")), "line-differences")
    release(lines)
    x, y = rows.alias("x"), rows.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * share - 1e-9) - F.col("x.common") - F.col("y.common") + F.col("x.ln")
    early = (F.col("x.pos") + need <= F.col("x.size")) & (F.col("y.pos") + need <= F.col("y.size"))
    same = (F.col("x.lid") == F.col("y.lid")) & (F.col("x.token") == F.col("y.token"))
    pairs = x.join(y, same & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & early)
    found = cut(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "line-pairs")
    release(rows)
    return found


def _by_shingles(entries: DataFrame, roots: DataFrame, texts: DataFrame, threshold: tuple[int, int], width: int) -> DataFrame:
    """Pairs (a, b) of the lines of one bucket, rows (key, h), in different components, that share an early shingle.

    Shingles are ordered from rare to frequent among these lines; similar lines share one of their
    first ones, at places that leave enough room for the rest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                owner, h = shingle_hashes(part.column(1).to_pylist(), width)
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
                sets = [np.unique(h[ends[i] : ends[i + 1]]) for i in range(part.num_rows)]
                sizes = [len(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.concatenate(sets).view(np.int64)),
                     pa.array(np.repeat(sizes, sizes).astype(np.int64))], names=["id", "token", "n"])

    num, den = threshold
    lines = texts.join(entries.select("h").distinct(), "h", "left_semi").select("h", "line")
    tokens = cut(lines.mapInArrow(run, "id bigint, token bigint, n bigint"), "far-shingles")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = tokens.join(counts, "token").groupBy("id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "token"))).alias("ts"))
    rows = shared.select("id", "n", (F.col("n") - F.size("ts")).alias("alone"), F.posexplode("ts").alias("i", "t"))
    rows = rows.select("id", "n", (F.col("alone") + F.col("i")).alias("pos"), F.col("t.token").alias("token"))
    rows = rows.where(F.col("pos") + F.ceil(F.col("n") * num / den - 1e-9) <= F.col("n"))
    rows = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = cut(rows.join(entries.withColumnRenamed("h", "id"), "id"), "far-lines")
    release(tokens)
    x, y = rows.alias("x"), rows.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * num / (num + den) - 1e-9)
    early = (F.col("x.pos") + need <= F.col("x.n")) & (F.col("y.pos") + need <= F.col("y.n"))
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.token") == F.col("y.token"))
    pairs = x.join(y, meet & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & early)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(lines, components): rows (doc_id, line_no, h), and (node, root) of lines linked with another."""
    num, den = threshold
    lines = cut(_lines(docs, id_col, text_col), "lines")
    # Buckets of one line link nothing. One exchange finds the others.
    entries = cut(_buckets(_bands(docs, id_col, text_col, bands, rows, width)), "line-buckets")
    first_place = lines.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("p")).select("h", "p.doc_id", "p.line_no")
    wanted = first_place.join(entries.select("h").distinct(), "h", "left_semi")
    texts = cut(_texts(docs, wanted, id_col, text_col), "line-texts")
    share = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    similar = F.col("common") * den >= (F.col("n") + F.col("m") - F.col("common")) * num
    close = share >= 1 / 3 + 1 - num / den + 1e-9
    firsts: list[DataFrame] = []
    linked = roots = None
    for r in range(ROUNDS):
        # The leader is the line that shares most bands with others: edits show as bands of one's own.
        shared = entries.groupBy("h").agg(F.count(F.lit(1)).alias("shared"))
        leaders = entries.join(shared, "h").groupBy("key").agg(F.min(F.struct((-F.col("shared")).alias("s"), "h")).alias("l")).select("key", F.col("l.h").alias("leader"))
        led = cut(entries.join(leaders, "key").where("h <> leader"), "led-buckets")
        release(entries)
        stars = led.select(F.col("h").alias("a"), F.col("leader").alias("b")).distinct()
        for known in firsts:
            stars = stars.join(known.select("a", "b"), ["a", "b"], "left_anti")
        firsts.append(cut(_overlaps(stars, texts, width), "line-stars"))
        first = reduce(DataFrame.unionByName, firsts)
        if linked is None:  # the roots only spare work, those of the first leaders do
            linked = components(first.where(similar), "line-stars")
            roots = linked.select(F.col("node").alias("id"), "root")
        answered = first.select(F.col("a").alias("h"), F.col("b").alias("leader"), F.col("diff").isNotNull().alias("near"), close.alias("close"))
        left = led.join(answered, ["h", "leader"]).where("not close").join(roots.withColumnRenamed("id", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
        open_ = left.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("near").alias("all_near")).where("r0 <> r1 and not all_near")
        entries = cut(left.join(open_.select("key"), "key", "left_semi").select("key", "h"), "line-open")
        release(led)
        if entries.isEmpty():
            break
    pairs = _by_differences(first, roots, threshold)
    pairs = cut(pairs.unionByName(_by_shingles(entries, roots, texts, threshold, width)).distinct(), "line-pairs")
    second = _overlaps(pairs, texts, width).where(similar).select("a", "b")
    later = reduce(DataFrame.unionByName, [x.where(similar).select("a", "b") for x in firsts[1:]], second)
    found = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(later), "line-links")
    release(entries, texts, *firsts, pairs, linked)
    return lines, found


def removed_lines(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, removed): the numbers, from 0, of the lines that are not the first of their component."""
    lines, linked = line_components(docs, **options)
    reps = lines.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    reps = reps.join(linked, reps.h == linked.node, "left").select("h", "first", "n", F.coalesce("root", "h").alias("cid"))
    kept = reps.groupBy("cid").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1").select("cid", "keep")
    repeated = reps.join(kept, "cid").select("h", "keep")
    place = F.struct("doc_id", "line_no")
    gone = lines.join(repeated, "h").where(place != F.col("keep"))
    return gone.groupBy("doc_id").agg(F.collect_list("line_no").alias("removed"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with repeated and near-repeated lines gone from `text_col`, and n_lines, n_removed.

    Lines end at \\n. Blank lines (space and \\x09-\\x0D only) always stay; a line shorter than a
    shingle is one shingle. A null text stays null. Rows without an id stay as they are and count
    for nothing; rows that repeat an id share its line numbers, so what is removed in one is removed
    in all of them. Other columns pass through; the names n_lines, n_removed and _removed are taken.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "_removed")]
    key = "_id"
    while key in columns:
        key += "_"
    gone = removed_lines(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(key), F.col("removed").alias("_removed"))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns]).join(gone, F.col(f"`{id_col}`").cast("bigint") == F.col(key), "left")
    rows = rows.withColumn("_removed", F.array_distinct("_removed"))
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("_removed", i)), "\n")
    text = F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(kept)
    n_lines = (F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit("\n")) + 1).cast("bigint")
    n_removed = F.coalesce(F.size("_removed"), F.lit(0)).cast("bigint")
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))
