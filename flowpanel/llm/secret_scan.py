"""Secret scans with multipart credential linking.

Strong patterns are reported as they are. Weak candidates (identifiers, secrets and endpoints that
alone are mostly harmless) are reported only when complementary parts stand in one scope: an
identifier with a secret, or a secret with an endpoint, at most SCOPE characters apart. Parts are
joined by intervals: each part is written to the scope-sized buckets of its text that it can reach,
equal buckets meet in an equi join, and the distance decides. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowpanel.llm.common import cut, once

SCOPE = 200

# Base kinds in order, with pattern and the group that must have a least length.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
# Weak kinds: name, role, pattern.
WEAK = [
    ("weak_id", "id", r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.+-]{3,}"""),
    ("weak_key", "id", r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,24}(?![A-Za-z0-9])"),
    ("weak_secret", "secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}"),
    ("weak_hex", "secret", r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{16,31}(?![A-Za-z0-9])"),
    ("endpoint", "endpoint", r"""(?i:https?|s3|ftp|postgres|mysql|mongodb|redis)://[^\x00-\x20"'<>]+"""),
]
ROLES = {"assign": "secret", "access": "id", "hex": "secret"} | {kind: role for kind, role, _ in WEAK}
ORDER = [kind for kind, *_ in BASE] + [kind for kind, *_ in WEAK]
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


# Matches added up one after another; the sums of such chunks are added up in a second step.
CHUNK = 256


def _running(parts: Column) -> Column:
    """Sums of the parts before each place, and the sum of all at the end."""
    start = F.array(F.lit(0))
    return F.aggregate(parts, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _measured(text: Column, pattern: str, group: int) -> Column:
    """Lengths of what lies between the matches, of the matches, and of their group if one is asked for."""
    lengths = lambda found: F.transform(found, lambda x: F.length(x))
    found = lambda g: lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)))
    lists = [lengths(F.split(text, pattern, -1)).alias("gap"), found(0).alias("len")]
    return F.when(text.rlike(pattern), F.struct(*lists, *([found(group).alias("own")] if group else [])))


def _chunk_sums(kind: str) -> Column:
    """The running sums inside each chunk of matches, as long as the chunk and one more."""
    size = F.col(f"{kind}.len")
    steps = F.zip_with(F.slice(f"{kind}.gap", F.lit(1), F.size(size)), size, lambda g, n: g + n)
    numbers = F.sequence(F.lit(0), F.floor((F.size(size) - 1) / CHUNK).cast("int"))
    return F.when(F.col(kind).isNotNull(), F.transform(F.transform(numbers, lambda c: F.slice(steps, c * CHUNK + 1, F.lit(CHUNK))), _running))


def _spans(kind: str, group: int, least: int) -> Column:
    """The spans of a kind from its lengths, the sums in its chunks and the sums before them."""
    before, sums, gap, size = (F.col(c) for c in (f"{kind}_before", f"{kind}_sums", f"{kind}.gap", f"{kind}.len"))
    own = F.col(f"{kind}.own") if group else size

    def span(n: Column, i: Column) -> Column:
        chunk, place = F.floor(i / CHUNK).cast("int"), i % CHUNK
        start = F.get(before, chunk) + F.get(F.get(sums, chunk), place) + F.get(gap, i)
        one = F.struct(start.alias("start"), F.lit(ORDER.index(kind)).alias("rank"), (start + n).alias("end"), F.lit(kind).alias("kind"))
        return F.when(F.get(own, i) >= least, one)

    return F.coalesce(F.array_compact(F.transform(size, span)).cast(SPAN), F.array().cast(SPAN))


def spans(rows: DataFrame, text: str, kinds: list[tuple]) -> DataFrame:
    """`rows` with a column of spans for every kind (name, pattern, group, least length), without `text`.

    Matches are leftmost and do not overlap; those whose group is too short are dropped after the
    search. What lies between the matches is cut out by the same pattern; the lengths of both add up
    to the positions, in chunks, so that the time is in proportion to the matches of a text.
    """
    keep = [c for c in rows.columns if c != text]
    rows = rows.select(*keep, *[once(_measured(F.col(text), pattern, group)).alias(kind) for kind, pattern, group, _ in kinds])
    rows = rows.select("*", *[once(_chunk_sums(kind)).alias(f"{kind}_sums") for kind, *_ in kinds])
    totals = lambda kind: F.transform(F.col(f"{kind}_sums"), lambda c: F.element_at(c, -1))
    rows = rows.select("*", *[once(_running(totals(kind))).alias(f"{kind}_before") for kind, *_ in kinds])
    return rows.select(*keep, *[_spans(kind, group, least).alias(kind) for kind, _, group, least in kinds])


def _listed(column: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(column), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Pairs (s, o) of spans of one text at most `scope` apart, or overlapping; pairs may repeat.

    Each part is written to the buckets that it can reach, so a long text is spread over many keys.
    """
    width = 2 * max(scope, SCOPE)
    reach = F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / width), F.floor((F.col("end") + scope) / width))
    s = left.withColumn("bucket", F.explode(reach)).alias("s")
    o = right.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))).alias("o")
    near = (F.col("o.start") <= F.col("s.end") + scope) & (F.col("s.start") <= F.col("o.end") + scope)
    return s.join(o, (F.col("s.uid") == F.col("o.uid")) & (F.col("s.bucket") == F.col("o.bucket")) & near)


def linked(scans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows (uid, start, rank, end, kind) of weak parts with a complementary part in their scope.

    `scans` has uid, base and weak spans. Weak parts that overlap a base span are no parts.
    """
    role = F.create_map(*[F.lit(x) for kind in ORDER for x in (kind, ROLES[kind])])
    some = scans.where(F.size("weak") > 0)
    base = some.select("uid", F.explode("base").alias("s")).select("uid", "s.*")
    weak = some.select("uid", F.explode("weak").alias("s")).select("uid", "s.*")
    overlap = (F.col("s.start") < F.col("o.end")) & (F.col("o.start") < F.col("s.end"))
    covered = _near(weak, base, 0).where(overlap).select("s.uid", "s.start", "s.rank").distinct()
    parts = base.unionByName(weak.join(covered, ["uid", "start", "rank"], "left_anti")).withColumn("role", role[F.col("kind")])
    apart = (F.col("o.start") >= F.col("s.end")) | (F.col("s.start") >= F.col("o.end"))
    met = _near(parts.where("role = 'secret'"), parts.where("role <> 'secret'"), scope).where(apart)
    both = F.array(*[F.struct(*[F.col(f"{t}.{c}") for c in ("start", "rank", "end", "kind")]) for t in "so"])
    reported = met.select(F.col("s.uid").alias("uid"), F.explode(both).alias("p")).select("uid", "p.*")
    return reported.where(F.col("rank") >= len(BASE)).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, all spans as text.

    A null text is empty; ids may repeat or be null (rows are told apart by a number of their own);
    an empty table gives no rows; other columns are ignored. Spans of weak parts that overlap a base
    span are not reported. The time for a text is in proportion to its length and matches.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias(id_col), text.alias("t"))
    found = spans(rows, "t", [*BASE, *((kind, pattern, 0, 0) for kind, _, pattern in WEAK)])
    strong, weak = (F.concat(*names).alias(c) for c, names in (("base", ORDER[: len(BASE)]), ("weak", ORDER[len(BASE) :])))
    found = cut(found.select(F.monotonically_increasing_id().alias("uid"), id_col, strong, weak), "secret-spans")
    more = linked(found, scope).groupBy("uid").agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("more"))
    all_rows = found.join(more, "uid", "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    every = F.concat(F.col("base"), F.coalesce(F.col("more"), F.array().cast(SPAN)))
    return all_rows.select(
        id_col, *[count(kind) for kind, *_ in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans")
    )
