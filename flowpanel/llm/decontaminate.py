"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Texts are sets of 5-word shingles; an item of one to four words is one shingle, its whole sequence,
and documents are cut into windows of that width too. An item is contained in a document when at
least `threshold` of its shingles are. Items are partitioned by the size of their sets; the sketch of
an item is its bottom-k MinHash values, k being the number of shingles that may be missing, plus one,
so every document that contains the item has at least one value of the sketch. Documents look up the
hashes of their shingles in the sketches; a document's side of the sketch is as large as its set,
which long documents need, as a short item takes only a tiny share of them. The partition is a
condition on a hit and not part of the key: as a key, every hash of a document would have to be sent
once to each partition that the document is large enough for. Candidates are verified on the shingles
themselves. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowpanel.llm.common import cut, once

WIDTH = 5
THRESHOLD = 0.8
# Sketch values (16 bytes each and their overhead) up to which the index goes to every executor.
BROADCAST_VALUES = 500_000


def words(text: Column) -> Column:
    return once(F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), ""))


def _windows(make, width: int) -> Column:
    """make(words of the shingle) for each window of `width` words of `w`."""
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda i: make(*[F.get("w", i + j) for j in range(width)]))
    return F.when(F.size("w") >= width, windows)


def _document_shingles(rows: DataFrame, make, widths: list[int], name: str) -> DataFrame:
    """`rows` with column `name`: the windows of all `widths`."""
    lists = [_windows(make, k) for k in widths]
    return rows.withColumn(name, once(F.concat(*[F.coalesce(x, F.array().cast("array<string>" if name == "s" else "array<bigint>")) for x in lists])))


def _item_shingles(rows: DataFrame, make, name: str) -> DataFrame:
    """`rows` with column `name`: the windows of five words, or the whole of a shorter sequence."""
    found = _windows(make, WIDTH)
    for k in range(1, WIDTH):
        found = F.when(F.size("w") == k, F.array(make(*[F.get("w", F.lit(j)) for j in range(k)]))).otherwise(found)
    return rows.withColumn(name, once(found))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (partition, item_id, least, h): bottom-k values of each item, and the least size of a container."""
    rows = _item_shingles(items.select("item_id", "w"), F.xxhash64, "hs")
    rows = rows.withColumn("hs", F.sort_array(F.array_distinct("hs")))
    q = F.size("hs")
    rows = rows.withColumn("least", F.ceil(q * threshold - 1e-9).cast("int"))
    bottom = F.slice("hs", F.lit(1), q - F.col("least") + 1)
    return rows.withColumn("partition", F.floor(F.log2("least"))).select("partition", "item_id", "least", F.explode(bottom).alias("h"))


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared, containment) for every contained item.

    Words are cut at space and \\x09-\\x0D and compared in lower case. An item of one to four words is
    contained where these words stand one after another; one without words is never reported. Null
    texts are empty; rows without an id are left out. Repeated rows give one result (that of the
    largest share). Empty tables give no rows. Other columns are ignored. Texts are read whole.
    """
    asked = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), words(F.col(f"`{item_text}`")).alias("w")).where("item_id is not null")
    asked = cut(asked.where(F.size("w") > 0).distinct(), "items")
    widths = sorted(r[0] for r in asked.select(F.least(F.size("w"), F.lit(WIDTH))).distinct().collect()) or [WIDTH]  # five at most
    index = cut(sketches(asked, threshold), "item-sketches")
    small = index.count() <= BROADCAST_VALUES
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("t")).where("doc_id is not null")
    hashed = _document_shingles(rows.select("doc_id", words(F.col("t")).alias("w")), F.xxhash64, widths, "hs")
    probes = hashed.select("doc_id", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    look = index.select("h", "partition", "item_id", "least")
    met = probes.join(F.broadcast(look) if small else look, "h")
    # Partitions that the document is too small for are skipped, then the items within the partition.
    met = met.where((F.col("partition") <= F.floor(F.log2("n"))) & (F.col("n") >= F.col("least")))
    pairs = cut(met.select("doc_id", "item_id").distinct(), "contained-candidates")
    # Verification on the shingles themselves, for candidate documents only.
    own = rows.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("t")).alias("w"))
    spelled = lambda *w: F.concat_ws(" ", *w)
    own = _document_shingles(own, spelled, widths, "s").select("doc_id", F.array_distinct("s").alias("s"))
    wanted = _item_shingles(asked, spelled, "i").select("item_id", F.array_distinct("i").alias("i"))
    both = pairs.join(own, "doc_id").join(wanted, "item_id")
    both = both.select("doc_id", "item_id", F.size("i").cast("bigint").alias("n_item"), F.size(F.array_intersect("i", "s")).cast("bigint").alias("n_shared"))
    sure = both.where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9))
    best = sure.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")
