"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams.

The model is trained by Spark on a small labelled table of URLs and scores the URLs that no rule
judges. Its weights have a fixed number of buckets, whatever the number of URLs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
# At most this many labelled URLs are used for fitting.
MAX_LABELLED = 100_000

# Rules as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# Words of the small labelled table. A URL of it is made from each word. They are
# general words of each kind, in the four languages of the corpus, and not taken from its pages.
BLOCKED_WORDS = (
    "casino slots jackpot roulette poker blackjack lottery bets betting gambling bingo wager pills pharmacy "
    "viagra cialis steroids xxx porn adult escort webcam nude warez torrent crack keygen serial payday loans "
    "cash rich crypto doubler forex replica watches clickbait spam offers winner prize giveaway spielautomaten "
    "wetten gewinnspiel apotheke kredit jeux paris pilules loterie apuestas casinos pastillas premio tragaperras"
).split()
ALLOWED_WORDS = (
    "news library university school science weather health travel recipes garden history museum research journal "
    "docs blog forum music art books sport city council archive wiki maps data theatre kitchen engineering river "
    "mountain teacher language student energy railway harbour village station orchestra philosophy chemistry "
    "nachrichten bibliothek schule wetter reisen garten geschichte zeitung rezepte stadt wissenschaft heimat "
    "actualites bibliotheque ecole meteo voyage jardin histoire journal recettes ville sante culture "
    "noticias biblioteca escuela tiempo viajes jardin historia revista recetas ciudad ciencia cultura "
    "index page article about contact help guide notes report section chapter topic people support download"
).split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: (url, label), 1 for block."""
    rows = []
    for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for i, w in enumerate(words):
            end = ("com", "org", "net")[i % 3]
            rows.append((f"https://{w}.example.{end}/{('en', 'de', 'fr', 'es')[i % 4]}/{1000 + 37 * i}", label))
            rows.append((f"http://www.site{i}.{end}/{w}/index.html", label))
    return spark.createDataFrame(rows, "url string, label int")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_verdict(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null without one.

    A rule fits its host and all subdomains, if the path starts with the rule's; the length is that
    of host and path, ties go to the block.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: str, path: str) -> np.ndarray:
    """Buckets of the character n-grams of host and path, of each and of both together, each once."""
    found = set()
    for kind, s in ((b"h", f"^{host}$"), (b"p", f"^{path}$")):
        b = s.encode()
        for n in GRAMS:
            for i in range(len(b) - n + 1):
                found.add(zlib.crc32(kind + b[i : i + n]) % BUCKETS)
                found.add(zlib.crc32(b"b" + b[i : i + n]) % BUCKETS)
    return np.fromiter(found, dtype=np.int64, count=len(found))


@F.udf(VectorUDT())
def _vector(host: str, path: str):
    found = np.sort(grams(host or "", path or ""))
    return Vectors.sparse(BUCKETS, found.tolist(), [1.0] * len(found))


def train(labelled: DataFrame, regularisation: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and intercept; null URLs or labels are left out. One class only gives a constant model."""
    rows = labelled.where("url is not null and label is not null").select("url", "label").orderBy(F.xxhash64("url"), "url").limit(MAX_LABELLED)
    data = rows.select(_vector(host(F.col("url")), path(F.col("url"))).alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(regParam=regularisation, maxIter=100, standardization=False).fit(data)
    return model.coefficients.toArray(), float(model.intercept)


def filter_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
                threshold: float = 0.5) -> DataFrame:
    """One row per page: host, path, the rule that judged it or null, verdict, the model's score.

    A null URL, or one without ://, has empty host and path and is judged by the model. The score is
    the model's probability of block, given for all rows. Other columns are ignored.
    """
    weights, intercept = train(labelled)
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            known: dict[tuple[str, str], float] = {}
            out = []
            for key in zip(hosts, paths, strict=True):
                if key not in known:
                    known[key] = float(1 / (1 + np.exp(-(w[grams(*key)].sum() + intercept))))
                out.append(known[key])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "score"])

    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias(id_col), host(url).alias("host"), path(url).alias("path"))
    rows = rows.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    judged = rows.withColumn("_r", rule_verdict(F.col("host"), F.col("path"), rules))
    model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.select(
        id_col, "host", "path", F.col("_r")["rule"].alias("rule"), F.coalesce(F.col("_r")["verdict"], model).alias("verdict"), "score"
    )
