"""Prefix trie of conversations by whole-sequence collapse.

Turns are digests of role and text from the first scan on, so only narrow rows are shuffled. A turn's
prefix is named by a digest of all turns up to it. Conversations with the same whole digest are
collapsed into one weighted sequence with the list of conversations that end there; sequences whose
digest is a proper prefix of another one are dropped from the leaves by an anti-join; the nodes are
the weighted prefixes of the different sequences, summed by digest.

Prefix digests are built in blocks of BLOCK turns: a chain inside each block, and the blocks' ends
chained the same way one level up. No task holds a conversation, however long it is. Numbers of turns
come from ranges over all rows, not from a window over a conversation.

Digests are SHA-256 cut to 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowpanel.llm.common import cut, release, shuffle_partitions
from flowpanel.llm.ordering import numbered

BLOCK = 64
# Conversation numbers per packed row of an end list.
END_BLOCK = 4096
# Rebuilding: conversations in blocks of SHARED share up to MOST_SHARED - 1 first turns.
SHARED = 5
MOST_SHARED = 9


def root() -> Column:
    """The prefix without turns."""
    return F.lit("").cast("binary")


def digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def turn_digest(role: Column, text: Column) -> Column:
    """One digest of role and text; the length of the role keeps the two apart."""
    return digest(F.length(role).cast("string"), F.lit(":"), role, text)


def _blank(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def ordered_turns(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, sizes): rows (c, pos, x, nb) with positions from 0, and (c, first, n_turns)."""
    role, text = _blank(role_col), _blank(text_col)
    rows = convs.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("c"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        turn_digest(role, text).alias("x"), F.octet_length(text).cast("bigint").alias("nb"),
    ).where("c is not null")
    order = [F.col("c").asc(), F.col("turn").asc_nulls_first(), F.col("x").asc()]
    found = cut(numbered(rows, order, "number", "turn-ranges").drop("turn"), "turns")
    sizes = cut(found.groupBy("c").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n_turns")), "conversations")
    turns = found.join(sizes.select("c", "first"), "c").select("c", (F.col("number") - F.col("first")).alias("pos"), "x", "nb")
    return turns, sizes


def rebuilt(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The turns of rebuilt conversations: the first h turns of conversation c - c % 5, then one's own after the first h."""
    h = (F.crc32(F.col("c").cast("string")) % MOST_SHARED).alias("h")
    whole = sizes.select("c", (F.col("c") - F.col("c") % SHARED).alias("base"), h, "n_turns")
    heads = whole.select(F.col("c").alias("base"), F.col("n_turns").alias("n_base")).where(F.col("base") % SHARED == 0)
    whole = whole.join(heads, "base", "left")
    whole = whole.select("c", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    own = turns.join(whole, "c").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "x", "nb")
    first = turns.where((F.col("pos") < MOST_SHARED) & (F.col("c") % SHARED == 0)).withColumnRenamed("c", "base")
    shared = first.join(whole, "base").where("pos < h").select("c", "pos", "x", "nb")
    return shared.unionByName(own)


def _prefixes(rows: DataFrame, name: str) -> DataFrame:
    """Rows (c, pos, x, nb, p, up, cum): digest of all items up to this one, up to the one before, sum of nb."""
    items = F.sort_array(F.collect_list(F.struct("pos", "x", "nb"))).alias("items")
    blocks = rows.groupBy("c", F.floor(F.col("pos") / BLOCK).alias("b")).agg(items)
    none = F.array().cast("array<struct<pos:bigint,x:binary,nb:bigint,p:binary,up:binary,cum:bigint>>")

    def step(acc: Column, item: Column) -> Column:
        p = F.when(F.size(acc["out"]) == 0, item["x"]).otherwise(digest(acc["p"], item["x"]))
        cum = acc["cum"] + item["nb"]
        one = F.struct(item["pos"].alias("pos"), item["x"].alias("x"), item["nb"].alias("nb"), p.alias("p"), acc["p"].alias("up"), cum.alias("cum"))
        return F.struct(F.concat(acc["out"], F.array(one)).alias("out"), p.alias("p"), cum.alias("cum"))

    start = F.struct(none.alias("out"), root().alias("p"), F.lit(0).cast("bigint").alias("cum"))
    blocks = cut(blocks.select("c", "b", F.aggregate("items", start, step).alias("z")).select("c", "b", "z.*"), f"{name}-blocks")
    many = cut(blocks.where("b > 0").select("c").distinct(), f"{name}-long")
    if many.isEmpty():
        return blocks.select("c", F.explode("out").alias("i")).select("c", "i.*")
    # The ends of a conversation's blocks are items of their own, one level up.
    ends = blocks.join(many, "c", "left_semi").select("c", F.col("b").alias("pos"), F.col("p").alias("x"), F.col("cum").alias("nb"))
    above = cut(_prefixes(ends, f"{name}-up").select("c", F.col("pos").alias("b"), "p", "cum"), f"{name}-above")
    carry = above.select("c", (F.col("b") + 1).alias("b"), F.col("p").alias("carry"), F.col("cum").alias("carried"))
    whole = above.select("c", "b", F.col("p").alias("whole"))
    out = blocks.select("c", "b", F.explode("out").alias("i")).join(carry, ["c", "b"], "left").join(whole, ["c", "b"], "left")
    last = (F.col("i.pos") % BLOCK == BLOCK - 1) & F.col("whole").isNotNull()
    named = lambda p: digest(F.col("carry"), p)
    p = F.when(last, F.col("whole")).when(F.col("carry").isNull(), F.col("i.p")).otherwise(named(F.col("i.p")))
    up = (
        F.when(F.col("carry").isNull(), F.col("i.up")).when(F.col("i.pos") % BLOCK == 0, F.col("carry"))
        .otherwise(named(F.col("i.up")))
    )
    return out.select("c", "i.pos", "i.x", "i.nb", p.alias("p"), up.alias("up"), (F.col("i.cum") + F.coalesce("carried", F.lit(0))).alias("cum"))


@dataclass
class Trie:
    """`nodes`: one row per prefix; `members`: rows (conv_id, p), the node at which a conversation ends."""

    nodes: DataFrame
    members: DataFrame


def trie(turns: DataFrame, ids: DataFrame) -> Trie:
    """The trie of conversations given as rows (c, pos, x, nb) of turns and (c) of all conversations.

    Nodes have p (digest of the prefix), x (digest of the last turn; root: null), conv_id (least
    member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens.
    """
    steps = cut(_prefixes(turns, "prefix"), "prefixes")
    last = F.max(F.struct("pos", "p", "cum")).alias("z")
    ends = steps.groupBy("c").agg(last).select("c", (F.col("z.pos") + 1).alias("length"), "z.p", F.col("z.cum").alias("total"))
    ends = ids.select("c").distinct().join(ends, "c", "left")
    members = cut(ends.select(
        "c", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("p", root()).alias("p"), F.coalesce("total", F.lit(0)).alias("total")), "ends")
    # Collapse: one weighted sequence for all conversations with the same turns.
    whole = members.groupBy("p").agg(F.min("c").alias("seq"), F.count(F.lit(1)).alias("weight"), F.max("length").alias("length"), F.max("total").alias("total"))
    whole = cut(whole, "sequences")
    paths = steps.join(whole.select(F.col("seq").alias("c"), "length"), "c")
    paths = paths.select(F.col("c").alias("seq"), (F.col("pos") + 1).alias("depth"), "length", "x", "nb", "p", "up", "cum")
    top = whole.select("seq", F.lit(0).cast("bigint").alias("depth"), "length", F.lit(None).cast("binary").alias("x"), F.lit(0).cast("bigint").alias("nb"),
                       root().alias("p"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("bigint").alias("cum"))
    paths = cut(paths.unionByName(top), "sequence-prefixes")
    release(steps)
    # Leaves: sequences that are no proper prefix.
    proper = paths.where("depth < length").select("p").distinct()
    leaves = whole.join(proper, "p", "left_anti").select("seq", F.lit(1).alias("leaf"))
    # A node's text counts once in a subtree: for its least sequence, which has it new from some depth on.
    owners = paths.where("depth > 0").groupBy("p").agg(F.min("seq").alias("owner"))
    new = paths.where("depth > 0").join(owners, "p").where("owner = seq").groupBy("seq").agg(F.min("depth").alias("since"), F.sum("nb").alias("fresh"))
    facts = whole.select("seq", "weight", "total").join(leaves, "seq", "left").join(new, "seq", "left")
    facts = cut(facts.fillna({"leaf": 0, "fresh": 0}), "sequence-facts")
    rest = F.col("total") - F.col("cum") + F.col("nb")
    once_each = F.when(F.col("depth") >= F.col("since"), rest).otherwise(F.col("fresh"))
    nodes = paths.join(facts, "seq").groupBy("p").agg(
        F.min("seq").alias("conv_id"), F.max("depth").alias("depth"), F.max("up").alias("up"), F.max("x").alias("x"),
        F.sum("weight").alias("n_convs"), F.sum("leaf").cast("bigint").alias("n_leaves"), F.sum(F.col("weight") * rest - once_each).alias("saved_tokens"),
    )
    nodes = cut(nodes, "nodes")
    release(paths, facts, whole)
    children = nodes.where("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("up", "p")
    parents = nodes.select(F.col("p").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(children, "p", "left").join(parents, "up", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    return Trie(full.select("p", "x", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"),
                members.select(F.col("c").alias("conv_id"), "p"))


def end_digests(members: DataFrame) -> DataFrame:
    """Rows (p, ends_sha256): SHA-256 of each node's end list, ids ascending and joined by commas.

    Lists are packed in blocks of ids before they move; the hash itself can only run in order, over
    a stream of blocks of which one is held at a time.
    """
    n = shuffle_partitions(members.sparkSession)
    texts = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    blocks = members.groupBy("p", F.floor(F.col("conv_id") / END_BLOCK).alias("block")).agg(F.array_join(texts, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            nodes, sums = [], []
            for p, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != node:
                    if node is not None:
                        nodes.append(node)
                        sums.append(state.hexdigest())
                    node, state = p, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sums, pa.string())], names=["p", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["p", "ends_sha256"])

    rows = blocks.repartition(n, "p").sortWithinPartitions("p", "block").select("p", "ids")
    return rows.mapInArrow(run, "p binary, ends_sha256 string")


def conversation_trie(convs: DataFrame, rebuild: bool = True, **columns: str) -> Trie:
    """The trie of all conversations; with `rebuild`, of their rebuilt turns.

    Turns stand in the order of their number, null first, then by the digest of role and text; rows
    that repeat stand as often as they occur. Null roles and texts are empty. Rows without a
    conversation number are left out. % keeps the sign of the dividend, so the block of -7 starts
    at -5. An empty table has no nodes, not even a root. Other columns are ignored, whatever their
    names.
    """
    turns, sizes = ordered_turns(convs, **columns)
    return trie(rebuilt(turns, sizes) if rebuild else turns, sizes)


def with_turns(nodes: DataFrame, convs: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`nodes` with role and text of their last turn (root: null), looked up by digest."""
    role, text = _blank(role_col), _blank(text_col)
    known = convs.select(turn_digest(role, text).alias("x"), role.alias("role"), text.alias("text"))
    known = known.join(nodes.select("x").distinct(), "x", "left_semi").groupBy("x").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(known, "x", "left")


def digests(found: Trie) -> DataFrame:
    """One row per node, with the digest of its end list."""
    none = hashlib.sha256(b"").hexdigest()
    out = found.nodes.join(end_digests(found.members), "p", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
