"""Quality rules with risk-controlled cutoffs.

Each rule compares one statistic of a document with a cutoff that depends on the document's stratum.
Cutoffs are chosen on labelled holdout rows: a cutoff of a fixed grid counts as safe when the exact
binomial test rejects that the rule would drop more than `max_false` of the stratum's good documents.
A rule's cutoffs are tested from mild to strict until one is not safe, which needs no correction for
the grid; the level is shared by the sequences (strata x rules) and, as by Holm, passed on by those
that are safe to their end. The strictest cutoff such that it and all milder ones are safe is used; a
rule without one rejects nothing in the stratum. With probability 1 - `error` no rule in any stratum
drops more good documents than allowed.
Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpanel.llm.common import once

# Texts up to so many words have positions of 25 bits.
SHORT_WORDS = 1 << 25
SPACE = r"[\x20\x09-\x0D]"

# name: (statistic, True when high values are bad, cutoffs from mild to strict)
RULES = {
    "symbols": ("n_symbols / n_words", True, [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "dup_lines": ("n_dup_lines / n_lines", True, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "repeats": ("n_repeat_words / n_words", True, [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "long_words": ("word_chars / n_words", True, [30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0]),
    "short_words": ("word_chars / n_words", False, [1.5, 2.0, 2.5, 3.0, 3.25, 3.5]),
    "few_words": ("n_words", False, [55.0, 60.0, 70.0, 80.0, 100.0]),
}


def _with_repeat_words(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words, the words of `w` inside a 3-word window that occurs at least twice.

    Windows are hashed; hash and position are packed into one number, so that sorting plain numbers
    brings equal windows together. What the shortened hash joins is separated by the whole hash. The
    position takes 25 bits, in texts of more words 31.
    Each step is a projection of its own and used at least twice by the next, so that Spark
    evaluates it once per document and not once per element.
    """
    n = F.size("w")
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    bits = F.when(n <= SHORT_WORDS, F.lit(25)).otherwise(F.lit(31))
    shifted = lambda how, x, by: F.call_function(how, x, by)
    high = lambda x: shifted("shiftright", x, F.col("bits"))
    pack = lambda h, i: shifted("shiftleft", shifted("shiftrightunsigned", h, F.col("bits") + 1), F.col("bits")).bitwiseOR(i.cast("bigint"))
    low = lambda x: x.bitwiseAND(F.when(F.col("bits") == 25, F.lit((1 << 25) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("bigint"))

    def twins(column: str, key):
        at = F.col(column)
        return F.filter(at, lambda x, i: (key(x) == key(F.get(at, i + 1))) | ((i > 0) & (key(x) == key(F.get(at, i - 1)))))

    keep = [c for c in rows.columns]
    empty = F.array().cast("array<bigint>")
    rows = rows.select(*keep, bits.alias("bits"), F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(empty).alias("h"))
    # The rest of the hash above the bits of the position, and a sign that is never set.
    rows = rows.select(*keep, "bits", "h", F.sort_array(F.transform("h", pack)).alias("packed"))
    rows = rows.select(*keep, "bits", "h", twins("packed", high).alias("near"))
    pairs = F.transform("near", lambda x: (lambda p: F.struct(F.get("h", p).alias("h"), p.alias("p")))(low(x).cast("int")))
    rows = rows.select(*keep, F.when(F.size("near") > 0, F.sort_array(pairs)).alias("pairs"))
    rows = rows.select(*keep, F.sort_array(F.transform(twins("pairs", lambda x: x["h"]), lambda x: x["p"])).alias("at"))
    gaps = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, g: acc + g)
    # Filters on the number stay above it: below, they would repeat its definition for every element.
    return rows.select(*keep, once(F.coalesce(total, F.lit(0).cast("bigint"))).alias("n_repeat_words"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts per document: id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs of characters other than space and \\x09-\\x0D; word_chars are code points. A null
    text has no words. Lines are cut at \\n; those without a word do not count. Every row gives a row:
    repeated and null ids are counted like others; an empty table gives none. Other columns are
    ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), text.alias("t"))
    rows = rows.select(
        "doc_id", "stratum",
        once(F.array_remove(F.split("t", SPACE + "+"), "")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length("t") - F.regexp_count("t", F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id", "stratum", "w", "word_chars", "n_symbols", F.size("w").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    return _with_repeat_words(rows).drop("w")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _value(rule: str) -> Column:
    """The rule's statistic; null when its denominator is zero."""
    over, _, under = RULES[rule][0].partition(" / ")
    value = F.col(over).cast("double")
    return value / F.when(F.col(under) > 0, F.col(under)) if under else value


def _bad(rule: str, cutoff: Column) -> Column:
    value = _value(rule)
    return F.coalesce(value > cutoff if RULES[rule][1] else value < cutoff, F.lit(False))


def binomial_tail(hits: Column, n: Column, p: float) -> Column:
    """P(X <= hits) for X binomial(n, p), summed in logarithms so that large n do not underflow."""
    ratio = F.lit(p / (1 - p))
    zero = F.struct(
        (n * F.log(F.lit(1 - p))).cast("double").alias("term"), (n * F.log(F.lit(1 - p))).cast("double").alias("total")
    )

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * ratio)
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    steps = F.when(hits > 0, F.sequence(F.lit(1).cast("bigint"), hits.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, zero, add, lambda acc: acc["total"]))


def _level(tests: DataFrame, error: float) -> DataFrame:
    """One row (level): the level at which every sequence of cutoffs (stratum, rule) is tested.

    A sequence that is safe to its end, which its largest p-value tells, passes its share of `error`
    on to the others; the sequences are taken in the order of these p-values.
    """
    ends = tests.groupBy("stratum", "rule").agg(F.max("p_value").alias("p")).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    n = F.size("ps")
    unsafe = F.filter(F.transform("ps", lambda p, i: F.when(p * (n - i) > error, i)), lambda i: i.isNotNull())
    done = F.coalesce(F.array_min(unsafe), n)
    return ends.select((F.lit(error) / F.greatest(n - done, F.lit(1))).alias("level"))


def thresholds(stats: DataFrame, labels: DataFrame, max_false: float = 0.01, error: float = 0.05,
               id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Rows (stratum, rule, cutoff, n_good, n_false, p_value) of the certified cutoffs.

    `labels` may have repeated ids (one row per id counts, good if any of them says so) and null
    labels (ignored). All labelled documents that pass the base rules are used. The result has at
    most one row per stratum and rule.
    """
    good = (
        labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(quality_col).alias("q"))
        .where("q = 1 and doc_id is not null").select("doc_id").distinct()
    )
    held = stats.where(~base_failed()).join(good, "doc_id", "left_semi")
    grid = [(r, j, c) for r, (_, _, cuts) in RULES.items() for j, c in enumerate(cuts)]
    false = [F.sum(_bad(r, F.lit(c)).cast("bigint")).alias(f"f{k}") for k, (r, _, c) in enumerate(grid)]
    per = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *false)
    cells = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(j).alias("step"), F.lit(c).alias("cutoff"), F.col(f"f{k}").alias("n_false"))
        for k, (r, j, c) in enumerate(grid)
    ])
    tests = per.select("stratum", "n_good", F.explode(cells).alias("c")).select("stratum", "n_good", "c.*")
    # More hits than expected can never be safe; the long sum is spared.
    p_value = F.when(F.col("n_false") > F.col("n_good") * max_false, F.lit(1.0)).otherwise(
        binomial_tail(F.col("n_false"), F.col("n_good"), max_false)
    )
    tests = tests.withColumn("p_value", p_value)
    tests = tests.crossJoin(F.broadcast(_level(tests, error)))  # one row
    safe = F.col("p_value") <= F.col("level")
    milder = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ranked = tests.withColumn("ok", F.min(safe.cast("int")).over(milder)).where("ok = 1")
    best = ranked.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n_good", "n_false", "p_value"), "step").alias("b"))
    return best.select("stratum", "rule", "b.*")


def apply_rules(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`stats` with base_failed, kept and the name of the rules that rejected a document.

    A stratum without certified cutoffs is judged by the base rules alone. Rows are judged one by
    one: repeated and null ids keep all their rows, an empty table has none.
    """
    by_stratum = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    by_stratum = by_stratum.select(F.col("stratum").alias("_s"), *[F.col(r).alias(f"_{r}") for r in RULES])
    # One row per stratum; Spark chooses the join by its size.
    rows = stats.join(by_stratum, F.col("stratum").eqNullSafe(F.col("_s")), "left").withColumn("base_failed", base_failed())
    names = F.array_compact(F.array(*[F.when(_bad(r, F.col(f"_{r}")), F.lit(r)) for r in RULES]))
    rows = rows.withColumn("rejected_by", F.array_join(names, ","))
    kept = reduce(lambda a, b: a & b, [~F.col("base_failed"), F.col("rejected_by") == ""])
    return rows.withColumn("kept", kept).drop("_s", *[f"_{r}" for r in RULES])
