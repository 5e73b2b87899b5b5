"""License scans: base phrases, and templates found through a positional rare-token index.

The words of the license templates are counted over all documents. Each template is posted under
its words of highest inverse document frequency, enough of them that a text with the least share of
the template has two at their places. All posted words of a file are looked up, postings are
intersected by relative position (file position minus template position), and what is left is
verified against the whole template and its mandatory key phrase. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpanel.llm.common import cut, once

# Base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Label, template words, mandatory key phrase.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", "redistribution and use in source and binary forms"),
]
RARE_PER_TEMPLATE = 5
LEAST_SHARE = 0.7
LEAST_VOTES = 2


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case.

    The Kelvin sign, whose lower case is an ASCII letter, is made another non-ASCII letter first;
    other non-ASCII letters stay outside ASCII whatever their case, so no word gains an ASCII letter.
    """
    lower = F.lower(F.replace(text, F.lit("K"), F.lit("Ω")))
    return once(F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""))


def phrase_starts(words_col: str, phrase: str) -> Column:
    parts = phrase.split()
    n = F.size(words_col)
    same = lambda i: reduce(lambda a, b: a & b, [F.get(words_col, i + j) == p for j, p in enumerate(parts)])
    starts = F.filter(F.sequence(F.lit(0), n - len(parts)), same)
    # Most files lack the words; the scan over positions is for the others.
    there = (n >= len(parts)) & reduce(lambda a, b: a & b, [F.array_contains(words_col, p) for p in parts])
    return F.when(there, starts).otherwise(F.array().cast("array<int>"))


def inverse_frequencies(files: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """IDF of the templates' words over all rows of `files` (column `vocabulary`: its template words).

    The result has one number per template word, whatever the number of files.
    """
    n = files.count()
    counts = dict(files.select(F.explode("vocabulary").alias("word")).groupBy("word").count().collect())
    return {w: math.log((1 + n) / (1 + counts.get(w, 0))) for _, t, _ in templates for w in t.split()}


def postings(spark: SparkSession, idf: dict[str, float], templates=TEMPLATES) -> DataFrame:
    """Rows (word, idf, template, place): each template under its rarest words."""
    rows = []
    for label, text, _ in templates:
        own = text.split()
        # Every changed word takes one vote at most.
        changed = max(m for m in range(len(own)) if (len(own) - m) / len(own) >= LEAST_SHARE)
        rare = sorted(set(own), key=lambda w: (-idf[w], w))[: max(RARE_PER_TEMPLATE, changed + LEAST_VOTES)]
        rows += [(w, idf[w], label, i) for i, w in enumerate(own) if w in rare]
    return spark.createDataFrame(rows, "word string, idf double, template string, place int")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per document: words, base phrases, labels and the best template's share of found words.

    A null text has no words; ids may repeat or be null; other columns are ignored. The share is 0
    without a template.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w"))
    rows = rows.select(
        id_col, F.size("w").cast("bigint").alias("n_words"),
        *[phrase_starts("w", p).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)],
        F.array_intersect("w", F.array(*[F.lit(x) for x in vocabulary])).alias("vocabulary"), "w",
    )
    # A file can hold a template only if it has all words of the key phrase; only those keep their words.
    keyed = reduce(lambda a, b: a | b, [
        reduce(lambda a, b: a & b, [F.array_contains("vocabulary", x) for x in sorted(set(k.split()))]) for _, _, k in templates
    ])
    rows = rows.withColumn("w", F.when(keyed, F.col("w"))).withColumn("uid", F.monotonically_increasing_id())
    files = cut(rows, "license-words")
    index = postings(spark, inverse_frequencies(files, templates), templates)
    rare = [r[0] for r in index.select("word").distinct().collect()]  # no more than the words of the templates
    kept = files.where("w is not null").select("uid", "w")
    hits = kept.select("uid", F.explode(F.filter(
        F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("pos"))), lambda s: s["word"].isin(rare))).alias("h"))
    hits = hits.select("uid", "h.word", "h.pos")
    met = hits.join(index.drop("idf"), "word")
    votes = met.groupBy("uid", "template", (F.col("pos") - F.col("place")).alias("offset")).agg(F.countDistinct("word").alias("votes"))
    table = spark.createDataFrame(
        [(label, text.split(), text.split().index(key.split()[0]) if key in text else 0, key.split()) for label, text, key in templates],
        "template string, tw array<string>, key_at int, kw array<string>",
    )
    tried = votes.where(F.col("votes") >= LEAST_VOTES).join(table, "template").join(kept, "uid")
    at = lambda base, n: F.sequence(F.lit(0), n - 1)
    same = F.size(F.filter(at(0, F.size("tw")), lambda j: (F.col("offset") + j >= 0) & (F.get("w", F.col("offset") + j) == F.get("tw", j))))
    key = F.forall(at(0, F.size("kw")), lambda j: F.coalesce(
        (F.col("offset") + F.col("key_at") + j >= 0) & (F.get("w", F.col("offset") + F.col("key_at") + j) == F.get("kw", j)), F.lit(False)))
    tried = tried.select("uid", "template", (same / F.size("tw")).alias("share"), key.alias("has_key"))
    best = tried.where(F.col("has_key") & (F.col("share") >= LEAST_SHARE)).groupBy("uid").agg(
        F.collect_set("template").alias("templates"), F.max("share").alias("score"))
    found = files.drop("w", "vocabulary").join(best, "uid", "left")
    base = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    n_base = sum((F.size(f"p{i}") for i in range(len(PHRASES))), F.lit(0))
    every = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    listed = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return found.select(
        id_col, "n_words", n_base.cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"), listed(base).alias("base_labels"),
        listed(F.concat(base, F.coalesce("templates", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
