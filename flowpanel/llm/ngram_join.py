"""N-gram Jaccard join with set-relation skipping.

Texts are sets of word shingles; sets with a Jaccard similarity of at least the threshold are
linked. Equal sets are joined by digest first, so a set of many copies is treated once. The others
are indexed by their prefixes: shingles are ordered from rare to frequent (by counts of hash buckets
over all documents), and two similar sets share a shingle of their prefixes. Index lists are blocked
by size, and positions decide which entries can be the first common shingle of similar sets.

Work is skipped through relations of sets. First every member of a list is compared with the list's
leader only, the member whose shingles are shared most; members similar to it are in its component.
The answers of the others are derived from what the comparison gave. Two sets near one leader can be
similar only if they share many of their differences to it, so only those are looked up, which are
few even in a large group of near copies. For members far from the leader the distances decide: sets
at distances d(x, L) and d(y, L) are at least |d(x, L) - d(y, L)| apart. What stays open is computed.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowpanel.llm.common import components, cut, mix64, packed, release, text_chunks

WIDTH = 5
THRESHOLD = (80, 100)  # intersection * 100 >= union * 80
# Buckets of the frequency counts that order the shingles: a fixed size, whatever the corpus.
BUCKETS = 1 << 20
CHUNKS = 32
# Bits of the map that tells which texts may be asked for: 2 MB, whatever the corpus.
MARKS = 1 << 24
# Sets kept by a verifying task.
KEPT_SETS = 64


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words than `width` give one shingle, none gives none."""
    words = text.lower().split()  # bytes: A-Z only, space and \x09-\x0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - width + 1
    out = h[: max(n, 1)].copy()
    with np.errstate(over="ignore"):
        for i in range(1, min(width, len(h))):
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(out)])
        if n < 1:
            out = mix64(out + np.uint64(len(h)))
    out.sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    return out[keep]


def _read_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, n, digest), and per task rows (chunk, counts) of shingles per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                            ("chunk", pa.int32()), ("counts", pa.binary())])
        total = np.zeros(BUCKETS, dtype=np.uint32)
        for keys, own in text_chunks(batches, "k", "t"):
            sets = [shingles(t, width) for t in own]
            whole = np.concatenate(sets)
            total += np.bincount((whole >> np.uint64(44)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            none = [None] * len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=schema)
        if total.any():
            parts = [zstandard.compress(p.tobytes(), 1) for p in np.split(total, CHUNKS)]
            none = [None] * CHUNKS
            yield pa.RecordBatch.from_arrays(
                [pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()),
                 pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, digest binary, chunk int, counts binary")


def _frequencies(rows: DataFrame) -> np.ndarray:
    """Sum of all tasks' counts: BUCKETS numbers. Sums are formed in two levels of tasks."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(counts), dtype=np.uint32)
                sums[chunk] = np.minimum(sums[chunk].astype(np.uint64) + part, 0xFFFFFFFF).astype(np.uint32) if chunk in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([zstandard.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())],
                names=["chunk", "counts"])

    parts = rows.where("chunk is not null").select("chunk", "counts")
    halves = parts.repartition(CHUNKS * 4, "chunk", F.xxhash64("counts") % 8).mapInArrow(add, "chunk int, counts binary")
    found = halves.repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").collect()  # BUCKETS * 4 bytes at most
    total = np.zeros((CHUNKS, BUCKETS // CHUNKS), dtype=np.uint32)
    for r in found:
        total[r["chunk"]] = np.frombuffer(zstandard.decompress(r["counts"]), dtype=np.uint32)
    return total.reshape(-1)


def _postings(texts: DataFrame, counts: np.ndarray, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Rows (h, id, n, pos): the prefix of every set of more than no shingle."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            hs, ids, ns, pos = [], [], [], []
            for i, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(unpack.decompress(z), width)
                n = len(s)
                if not n:
                    continue
                order = np.lexsort((s, freq[(s >> np.uint64(44)).astype(np.int64)]))
                k = n - -(-n * num // den) + 1
                hs.append(s[order[:k]])
                ids.append(np.full(k, i, dtype=np.int64))
                ns.append(np.full(k, n, dtype=np.int32))
                pos.append(np.arange(k, dtype=np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(pos))],
                    names=["h", "id", "n", "pos"])

    return texts.mapInArrow(run, "h bigint, id bigint, n int, pos int")


def _needed(n, m, threshold: tuple[int, int]):
    """The least overlap of two similar sets of these sizes."""
    num, den = threshold
    return F.ceil((n + m) * num / (num + den) - 1e-9)


def _first_common(x: str, y: str, threshold: tuple[int, int]):
    """The shared shingle can be the first common one of two similar sets: enough places follow it."""
    num, den = threshold
    n, m = F.col(f"{x}.n").cast("bigint"), F.col(f"{y}.n").cast("bigint")
    need = _needed(n, m, threshold)
    fits = (F.col(f"{x}.pos") + need <= n) & (F.col(f"{y}.pos") + need <= m)
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & fits


def compared(s: np.ndarray, t: np.ndarray) -> tuple[int, np.ndarray | None]:
    """(size of the intersection, what sets two sorted sets apart), see `_overlaps`."""
    both = np.intersect1d(s, t, assume_unique=True)
    if 2 * len(both) < max(len(s), len(t)):
        return len(both), None
    added, missing = np.setdiff1d(s, both, assume_unique=True), np.setdiff1d(t, both, assume_unique=True)
    return len(both), np.concatenate([added | np.uint64(1), missing & ~np.uint64(1)]).view(np.int64)


def _marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of MARKS bits, of fixed size whatever the ids, with the bit of every id set."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARKS, dtype=bool)
        for b in batches:
            bits[_mark(b.column(0))] = True
        if bits.any():
            parts = [zstandard.compress(p.tobytes(), 1) for p in np.split(np.packbits(bits), CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(bits), dtype=np.uint8)
                whole[chunk] = whole[chunk] | part if chunk in whole else part
        if whole:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(whole), pa.int32()), pa.array([zstandard.compress(v.tobytes(), 1) for v in whole.values()], pa.binary())], names=["chunk", "bits"])

    parts = ids.select("id").mapInArrow(mark, "chunk int, bits binary")
    halves = parts.repartition(CHUNKS * 4, "chunk", F.xxhash64("bits") % 8).mapInArrow(join, "chunk int, bits binary")
    out = np.zeros((CHUNKS, MARKS // 8 // CHUNKS), dtype=np.uint8)
    for r in halves.repartition(CHUNKS, "chunk").mapInArrow(join, "chunk int, bits binary").collect():  # MARKS / 8 bytes at most
        out[r["chunk"]] = np.frombuffer(zstandard.decompress(r["bits"]), dtype=np.uint8)
    return out.reshape(-1)


def _mark(ids: pa.Array) -> np.ndarray:
    return (mix64(ids.to_numpy().view(np.uint64)) % np.uint64(MARKS)).astype(np.int64)


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of `texts` with one of the `ids`. Most others are left out where they lie, by a bitmap of the ids.

    With so many ids that the bitmap is full, the join alone decides.
    """
    marks = ids.sparkSession.sparkContext.broadcast(_marked(ids))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for b in batches:
            at = _mark(b.column(0))
            yield b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

    return texts.select("id", "z").mapInArrow(likely, "id bigint, z binary").join(ids, "id", "left_semi")


def _pair_texts(pairs: DataFrame, texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The texts of the sets in `pairs`, so that joins with the pairs move no others; `known` has some already."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    if known is not None:
        ids = ids.join(known.select("id"), "id", "left_anti")
    ids = cut(ids, "pair-ids")
    if known is not None and ids.isEmpty():
        release(ids)
        return known
    own = _texts_of(ids, texts)
    out = cut(own if known is None else own.unionByName(known), "pair-texts")
    release(ids, known)
    return out


def _overlaps(pairs: DataFrame, texts: DataFrame, width: int, name: str) -> DataFrame:
    """Pairs (a, b) with n, m and the exact size of their intersection, computed from the texts.

    For pairs that share at least half of the larger set `diff` has what sets them apart: the
    shingles of a that b lacks (lowest bit 1), then those of b that a lacks, each by hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def known(z: bytes) -> np.ndarray:
            if z in kept:
                kept.move_to_end(z)
            else:
                kept[z] = shingles(unpack.decompress(z), width)
                if len(kept) > KEPT_SETS:
                    kept.popitem(last=False)
            return kept[z]

        for b in batches:
            za, zb = b.column("za"), b.column("zb")
            sizes, diffs = [], []
            for r in range(b.num_rows):
                s, t = known(za[r].as_py()), known(zb[r].as_py())
                common, diff = compared(s, t)
                sizes.append((len(s), len(t), common))
                diffs.append(diff)
            n, m, c = (np.array(v, dtype=np.int64) for v in zip(*sizes, strict=True)) if sizes else (np.empty(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays(
                [b.column("a"), b.column("b"), pa.array(n), pa.array(m), pa.array(c), pa.array(diffs, pa.list_(pa.int64()))],
                names=["a", "b", "n", "m", "common", "diff"])

    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", "za", "zb")
    return cut(both.mapInArrow(run, "a bigint, b bigint, n bigint, m bigint, common bigint, diff array<bigint>"), name)


def _similar(threshold: tuple[int, int]):
    num, den = threshold
    return (F.col("common") > 0) & (F.col("common") * den >= (F.col("n") + F.col("m") - F.col("common")) * num)


def of_one_leader(first: DataFrame, roots: DataFrame, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of sets near one leader, in different components, that may be similar; the table behind them.

    With the differences to the leader known, the overlap of two sets is what the leader keeps in
    both plus the differences they share; so many shared differences are needed that one of them is
    among the first of both lists of differences.
    """
    near = first.where("diff is not null").select(F.col("a").alias("id"), F.col("b").alias("lid"), "n", F.col("m").alias("ln"), "common", "diff")
    near = near.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = near.groupBy("lid").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("lid")
    near = near.join(mixed, "lid", "left_semi").select("id", "lid", "n", "ln", "common", "root", F.size("diff").alias("size"), F.posexplode("diff").alias("pos", "token"))
    # What a set lacks to be similar to the leader. A pair needs as many shared differences as both lack
    # together and what the leader's size adds; one of the two lacks something, the other at least
    # the negative of what the size adds. So late differences cannot be the first shared one.
    share = threshold[0] / (threshold[0] + threshold[1])
    lacks, adds = share * (F.col("n") + F.col("ln")) - F.col("common"), F.col("ln") * (1 - 2 * share)
    near = cut(near.where(F.col("pos") + F.when(lacks > 0, lacks).otherwise(lacks + adds) <= F.col("size") + 1e-6), "differences")
    x, y = near.alias("x"), near.alias("y")
    need = _needed(F.col("x.n"), F.col("y.n"), threshold) - F.col("x.common") - F.col("y.common") + F.col("x.ln")
    early = (F.col("x.pos") + need <= F.col("x.size")) & (F.col("y.pos") + need <= F.col("y.size"))
    same = (F.col("x.lid") == F.col("y.lid")) & (F.col("x.token") == F.col("y.token"))
    pairs = x.join(y, same & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & early)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), near


def _of_one_list(entries: DataFrame, first: DataFrame, roots: DataFrame, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of one list, in different components, that no answer for the leader decides; the table behind them."""
    to_leader = first.select(
        F.col("a").alias("id"), F.col("b").alias("lid"), (F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("share"),
        F.col("diff").isNotNull().alias("near"))
    members = (
        entries.select("h", "id", "n", "pos", "lid").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        .join(to_leader, ["id", "lid"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    )
    # Pairs with the leader are answered, pairs of near members are found by their differences.
    members = members.where("id <> lid")
    mixed = members.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("near").alias("all_near"))
    members = members.join(mixed.where("r0 <> r1 and not all_near").select("h"), "h", "left_semi")
    # Blocks by size: a partner lies in the same block or the next one, as blocks grow by the inverse threshold.
    block = F.floor(F.log("n") / float(np.log(threshold[1] / threshold[0]))).cast("int")
    members = cut(members.withColumn("block", block), "mixed-lists")
    left = members.withColumn("meet", F.explode(F.array(F.col("block"), F.col("block") + 1))).alias("x")
    right = members.withColumn("meet", F.col("block")).alias("y")
    other = (F.col("x.h") == F.col("y.h")) & (F.col("x.meet") == F.col("y.meet")) & (F.col("x.root") != F.col("y.root"))
    once_each = (F.col("x.block") != F.col("y.block")) | (F.col("x.id") < F.col("y.id"))
    limit = 1 - threshold[0] / threshold[1] + 1e-9
    # A leader that a member was not compared with tells nothing.
    open_ = F.coalesce(F.abs(F.col("x.share") - F.col("y.share")) <= limit, F.lit(True)) & ~(F.col("x.near") & F.col("y.near"))
    pairs = left.join(right, other & once_each & open_ & _first_common("x", "y", threshold))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")), members


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
         threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): set size and the least id reachable by links.

    Words are cut at space and \\x09-\\x0D, A-Z count as a-z. A null or wordless text has an empty
    set, which is linked with nothing. Repeated ids keep their rows; they are one node, linked with
    all that any of their texts is linked with. Rows without an id stay, with no component. Other
    columns are ignored. Links are exact up to equal 64-bit hashes of different shingles.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).cast("string").alias("t"))
    read = cut(_read_sets(rows, width), "sets")
    sets = read.where("chunk is null").select("doc_id", "n", "digest")
    found = sets.where("doc_id is not null and n > 0")
    # Equal sets: one stands for all. The class carries its least id and one text that has the set.
    classes = cut(found.groupBy("digest").agg(F.min("doc_id").alias("id")), "set-classes")
    distinct_ids = found.join(classes, "digest").select("doc_id", "digest", "id")
    same = distinct_ids.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    counts = _frequencies(read)
    standing = classes.select("id").distinct()
    texts = cut(packed(rows, "k", "t").join(standing, "id", "left_semi"), "set-texts")
    posted = _postings(texts, counts, width, threshold)
    # Lists of one entry link nothing.
    of_list = Window.partitionBy("h")
    kept = posted.withColumn("lo", F.min("id").over(of_list)).withColumn("hi", F.max("id").over(of_list)).where("lo <> hi")
    kept = cut(kept.drop("lo", "hi"), "lists")
    # The leader of a list is the member whose prefix is shared most: edits show as shingles of one's own.
    prefix = F.col("n") - F.ceil(F.col("n") * threshold[0] / threshold[1] - 1e-9) + 1
    shared = kept.groupBy("id").agg((F.count(F.lit(1)) / F.max(prefix)).alias("shared"))
    lead = F.min(F.struct((-F.col("shared")).alias("s"), F.xxhash64("id").alias("p"), "id", "n", "pos")).alias("l")
    leaders = kept.join(shared, "id").groupBy("h").agg(lead).select("h", F.col("l.id").alias("lid"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lpos"))
    entries = cut(kept.join(leaders, "h"), "led-lists")
    release(kept)
    stars = entries.where("id <> lid").select(
        F.struct("id", "n", "pos").alias("x"), F.struct(F.col("lid").alias("id"), F.col("ln").alias("n"), F.col("lpos").alias("pos")).alias("y"))
    stars = cut(stars.where(_first_common("x", "y", threshold)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "star-pairs")
    own = _pair_texts(stars, texts)
    first = _overlaps(stars, own, width, "star-overlaps")
    release(stars)
    linked = components(first.where(_similar(threshold)), "stars")
    roots = linked.select(F.col("node").alias("id"), "root")
    near, mixed = of_one_leader(first, roots, threshold), _of_one_list(entries, first, roots, threshold)
    scratch = [near[1], mixed[1]]
    seconds = cut(near[0].unionByName(mixed[0]).distinct(), "other-pairs")
    release(entries, first, *scratch)
    own = _pair_texts(seconds, texts, own)
    release(texts)
    overlaps = _overlaps(seconds, own, width, "other-overlaps")
    release(seconds, own)
    stars_linked, second = linked, overlaps.where(_similar(threshold)).select("a", "b")
    linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second).unionByName(same), "links")
    release(stars_linked, overlaps, classes)
    out = sets.join(linked, sets.doc_id == linked.node, "left")
    return out.select(sets.doc_id, F.col("n").alias("n_shingles"), F.coalesce("root", sets.doc_id).alias("component_id"))
