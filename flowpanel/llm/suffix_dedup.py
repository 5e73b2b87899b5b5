"""Removal of repeated byte strings by distributed suffix arrays.

A byte goes when a string of `length` bytes that covers it also starts somewhere else. Places that
can match are brought together by minimizers: of all K-byte strings inside a window of `length`
bytes the one of least hash is its anchor, so equal windows have equal anchors at equal offsets.
Around every anchor lies a segment that holds all windows it stands for. Equal segments are
joined by hash before anything else (their windows repeat as they are), anchors that occur once are
dropped, and the different segments of the remaining anchors go, block by block, through a suffix
array built by two-stage sorting; neighbours with a common prefix of `length` bytes are the repeats.
An anchor with very many different segments is split into groups of windows by what these have in
common, and the windows of groups that meet others are counted.

Rows are numbered and stored once; texts are shuffled as zstd bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowpanel.llm.common import CHUNK_BYTES, cut, mix64, release, shuffle_partitions, text_chunks
from flowpanel.llm.rolling import Hashes, slide
from flowpanel.llm.suffix_array import repeated

LENGTH = 200
K = 40
# Texts are treated in pieces of this many bytes, with margins that make the result the same.
PIECE = 4 << 20
# Characters of segments that share one suffix array.
BLOCK = 4 << 20
# Different segments of one anchor that go to one task; beyond, its windows are counted.
MAX_SEGMENTS = 8_000
# Windows that a split anchor's row stands for.
GROUP = 16

def _pieces(keys: list, texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int, int, int]], bytes]]:
    """Buffers with their parts (key, start in the text, first and last + 1 anchor place in the part)."""
    parts, data, size = [], [], 0
    for key, t in zip(keys, texts, strict=True):
        if len(t) < length:
            continue
        for a in range(0, len(t), PIECE):
            lo, hi = max(0, a - length), min(len(t), a + PIECE + length)
            if parts and size + hi - lo > CHUNK_BYTES:
                yield parts, b"".join(data)
                parts, data, size = [], [], 0
            parts.append((key, lo, size, size + hi - lo, size + a - lo, size + min(len(t), a + PIECE) - lo))
            data.append(t[lo:hi])
            size += hi - lo
    if parts:
        yield parts, b"".join(data)


def _anchors(data: np.ndarray, parts: np.ndarray, hashes: Hashes, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(place, part, first window, last window) of the anchors of all windows that lie inside a part.

    A window belongs to the first of its K-byte strings that have the least hash. Equal windows have
    the same one, so a segment need hold only the windows that belong to its anchor.
    """
    n, w = len(data), length - k + 1
    v = hashes.windows(k)
    least = slide(np.minimum, v, w)  # least hash of the window that starts here
    whole = np.zeros(len(least), dtype=np.int8)
    for start, end in parts[:, 2:4].tolist():
        if end - start >= length:
            whole[start : end - length + 1] = 1
    least[whole == 0] = 0
    most = slide(np.maximum, np.concatenate([np.zeros(w - 1, dtype=np.uint64), least, np.zeros(w - 1, dtype=np.uint64)]), w)
    places = np.flatnonzero(most[: len(v)] == v)
    # Runs of windows with one least hash; a run has its value's anchors in it.
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(starts[1:], len(least)) - 1
    values, rank = np.unique(np.concatenate([v[places], least[starts]]), return_inverse=True)
    anchor_rank, run_rank = rank[: len(places)], rank[len(places) :]
    runs = np.argsort(run_rank * n + starts, kind="stable")
    run = runs[np.searchsorted((run_rank * n + starts)[runs], anchor_rank * n + places, "right") - 1]
    by = np.lexsort((places, anchor_rank))
    before = np.full(len(places), -1, dtype=np.int64)  # the last place with the same value
    again = anchor_rank[by][1:] == anchor_rank[by][:-1]
    before[by[1:][again]] = places[by[:-1][again]]
    first = np.maximum(np.maximum(starts[run], places - (w - 1)), before + 1)
    last = np.minimum(ends[run], places)
    part = np.searchsorted(parts[:, 2], places, "right") - 1
    inside = (places >= parts[part, 4]) & (places < parts[part, 5]) & (first <= last)
    return places[inside], part[inside], first[inside], last[inside]


FOUND = "akey bigint, skey bigint, lkey int, rkey int, uid bigint, start bigint, len int, off int, n int"


def _segments(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Rows of segments (one for equal ones of a buffer, n counts them up to 2), and rows without
    `skey` for stretches [start, start + len) that repeat within the buffer."""
    reach = length - k
    half = reach // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part_of = b.slice(first, 256)
                keys = part_of.column("uid").to_pylist()
                own = [unpack.decompress(z) for z in part_of.column("z").to_pylist()]
                for parts, buffer in _pieces(keys, own, length):
                    yield one(parts, buffer)

    def one(parts, buffer) -> pa.RecordBatch:
        data = np.frombuffer(buffer, dtype=np.uint8)
        parts = np.array(parts, dtype=np.int64)
        hashes = Hashes(data)
        place, part, s, last = _anchors(data, parts, hashes, length, k)
        uid, shift, e = parts[part, 0], parts[part, 1] - parts[part, 2], last + length
        akey = hashes.of(place, place + k)
        with np.errstate(over="ignore"):
            skey = mix64(hashes.of(s, e) + (place - s).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
            alone = mix64(uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place + shift).astype(np.uint64))
        has_left, has_right = place - s >= half, e - place - k >= half
        lkey = np.where(has_left, hashes.of(np.where(has_left, place - half, place), place + k), alone)
        rkey = np.where(has_right, hashes.of(place, np.where(has_right, place + k + half, place + k)), alone)
        _, index, inverse, counts = np.unique(skey, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[inverse] > 1)
        stretch = _joined(uid[again], (s + shift)[again], (e + shift)[again])
        none = np.zeros(len(stretch[0]), dtype=bool)

        def col(values, other, kind, absent=False):
            mask = np.concatenate([np.zeros(len(index), dtype=bool), ~none if absent else none])
            return pa.array(np.concatenate([values, other]).astype(kind), mask=mask)

        zero = np.zeros(len(stretch[0]), dtype=np.int64)
        return pa.RecordBatch.from_arrays([
            col(akey[index].view(np.int64), mix64(stretch[0].astype(np.uint64)).view(np.int64), np.int64),
            col(skey[index].view(np.int64), zero, np.int64, absent=True),
            col((lkey[index] >> np.uint64(33)).astype(np.int64), zero, np.int32),
            col((rkey[index] >> np.uint64(33)).astype(np.int64), zero, np.int32),
            col(uid[index], stretch[0], np.int64), col((s + shift)[index], stretch[1], np.int64),
            col((e - s)[index], stretch[2] - stretch[1], np.int32), col((place - s)[index], zero, np.int32), col(np.minimum(counts, 2), zero + 1, np.int32),
        ], names=[c.split()[0] for c in FOUND.split(", ")])

    return texts.select("uid", "z").mapInArrow(run, FOUND)


def _joined(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of one owner as one."""
    if not len(owner):
        return owner, start, end
    by = np.lexsort((start, owner))
    owner, start, end = owner[by], start[by], end[by]
    base = owner - owner.min()
    room = int(end.max()) + 2
    if int(base.max()) < (1 << 62) // room:
        rank = base
    else:
        rank = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))
    reach = np.maximum.accumulate(end + rank * room)
    new = np.concatenate([[True], (start + rank * room)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(owner)]]) - 1
    return owner[first], start[first], reach[last] - rank[last] * room


def _extract(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Rows (akey, uid, start, seg, windows): the wanted segments' bytes.

    A segment of a split anchor gives a row for every GROUP of its windows instead: `akey` is the
    hash of what these windows have in common, `windows` are the hashes of the windows.
    """
    places = wanted.groupBy("uid").agg(F.collect_list(F.struct("akey", "start", "len", "off", "split")).alias("at"))
    names = ["akey", "uid", "start", "seg", "windows"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())], strict=True)))

    def signed(b: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(b)
        return h - (1 << 64) if h >> 63 else h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows: list[tuple] = []
            for uid, z, at in zip(b.column("uid").to_pylist(), b.column("z"), b.column("at"), strict=True):
                t = unpack.decompress(z.as_py())
                own = at.values
                for akey, start, size, off, split in zip(*(own.field(c).to_pylist() for c in ("akey", "start", "len", "off", "split")), strict=True):
                    if not split:
                        rows.append((akey, uid, start, t[start : start + size], None))
                        continue
                    # Groups count from the anchor, so they are the same in every segment of it.
                    place, end = start + off, start + size - length + 1
                    for far in range(place - off // GROUP * GROUP, place + 1, GROUP):
                        first, stop = max(start, far - GROUP + 1), min(end, far + 1)
                        if first < stop:
                            common = signed(t[far : far - GROUP + 1 + length])
                            rows.append((common, uid, first, None, [signed(t[j : j + length]) for j in range(first, stop)]))
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out = "akey bigint, uid bigint, start bigint, seg binary, windows array<bigint>"
    return texts.select("uid", "z").join(places, "uid").mapInArrow(run, out)


def _sorted_repeats(segments: DataFrame, length: int) -> DataFrame:
    """Rows (uid, start, len) of the stretches that suffix arrays over blocks of anchors find."""
    dealt = segments.select("akey", "uid", "start", "seg").repartition(shuffle_partitions(segments.sparkSession), "akey").sortWithinPartitions("akey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                # A block ends between two anchors only.
                if size > BLOCK and row[0] != held[-1][0]:
                    yield from block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from block(held)

    def block(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, uid, start, seg = zip(*rows, strict=True)
        uid, start = np.array(uid, dtype=np.int64), np.array(start, dtype=np.int64)
        text, pos = repeated(list(seg), uid, start, length)
        if len(text):
            owner, s, e = _joined(uid[text], start[text] + pos, start[text] + pos + length)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(s), pa.array(e - s, pa.int64())], names=["uid", "start", "len"])

    return dealt.mapInArrow(run, "uid bigint, start bigint, len bigint")


def stored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (uid, id, z): every row of `docs` with a number of its own and its text as zstd bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for keys, own in text_chunks(batches, "k", "t"):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([pack.compress(t) for t in own], pa.binary())], names=["id", "z"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).cast("string").alias("t"))
    return cut(rows.mapInArrow(run, "id bigint, z binary").select(F.monotonically_increasing_id().alias("uid"), "id", "z"), "stored-texts")


def repeats(texts: DataFrame, length: int = LENGTH, k: int = K, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """Rows (uid, start, len): stretches of bytes to remove; they may overlap."""
    found = _segments(texts, length, k)
    total = F.sum("n").over(Window.partitionBy("akey"))
    shared = cut(found.withColumn("total", total).where("skey is null or total > 1").drop("total"), "anchors")
    inside = shared.where("skey is null").select("uid", "start", F.col("len").cast("bigint").alias("len"))
    keyed = shared.where("skey is not null")
    kinds = cut(keyed.groupBy("akey", "skey").agg(
        F.sum("n").alias("n"), F.min(F.struct("uid", "start", "len", "off")).alias("rep"), F.first("lkey").alias("lkey"), F.first("rkey").alias("rkey")), "segments")
    # Equal segments: each window of them starts in every copy.
    several = kinds.where("n > 1").select("akey", "skey")
    copies = keyed.join(several, ["akey", "skey"], "left_semi").where(F.col("len") >= length).select("uid", "start", F.col("len").cast("bigint").alias("len"))
    # Different segments of one anchor: one side must agree up to half the reach for a window to fit.
    of_anchor = Window.partitionBy("akey")
    compared = (
        kinds.withColumn("d", F.count(F.lit(1)).over(of_anchor)).where("d > 1")
        .withColumn("nl", F.count(F.lit(1)).over(Window.partitionBy("akey", "lkey")))
        .withColumn("nr", F.count(F.lit(1)).over(Window.partitionBy("akey", "rkey"))).where("nl > 1 or nr > 1")
        .select("akey", "rep.*", (F.col("d") > max_segments).alias("split")).where(F.col("len") >= length)
    )
    cutouts = cut(_extract(texts, compared, length), "segment-texts")
    sorted_out = _sorted_repeats(cutouts.where("seg is not null"), length)
    groups = cutouts.where("seg is null")
    shared_groups = groups.groupBy("akey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("akey")
    windows = groups.join(shared_groups, "akey", "left_semi").select("akey", "uid", "start", F.posexplode("windows").alias("i", "window"))
    often = windows.groupBy("akey", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("akey", "window")
    counted = windows.join(often, ["akey", "window"], "left_semi").select("uid", (F.col("start") + F.col("i")).alias("start"), F.lit(length).cast("bigint").alias("len"))
    out = cut(inside.unionByName(copies).unionByName(sorted_out).unionByName(counted), "repeats")
    release(shared, kinds, cutouts)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digests: bool = False,
          k: int = K, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans and the bytes that are left, or their sha256.

    Strings are judged on the input, overlaps count, and no match crosses rows. A null text is
    empty; ids may repeat or be null, as rows are told apart by a number of their own; other columns
    are ignored. What is left may not be UTF-8, as bytes are cut.
    """
    texts = stored(docs, id_col, text_col)
    gone = repeats(texts, length, k, max_segments).groupBy("uid").agg(F.collect_list(F.struct("start", "len")).alias("at"))
    last = "kept_sha256 string" if digests else "kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                rows = []
                for key, z, at in zip(part.column("id").to_pylist(), part.column("z"), part.column("at"), strict=True):
                    t = unpack.decompress(z.as_py())
                    kept, removed, spans = t, 0, 0
                    if at.is_valid:
                        s = at.values.field("start").to_numpy()
                        e = s + at.values.field("len").to_numpy()
                        _, s, e = _joined(np.zeros(len(s), dtype=np.int64), s, e)
                        ends = [0, *e.tolist()]
                        kept = b"".join([t[x:y] for x, y in zip(ends, [*s.tolist(), len(t)], strict=True)])
                        removed, spans = int((e - s).sum()), len(s)
                    rows.append((key, len(t), removed, spans, hashlib.sha256(kept).hexdigest() if digests else kept))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string() if digests else pa.binary())],
                    names=[id_col, "n_bytes", "n_removed", "n_spans", last.split()[0]])

    out = texts.join(gone, "uid", "left").select("id", "z", "at")
    return out.mapInArrow(run, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last}")
