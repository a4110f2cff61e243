"""URL filters: rules first, then logistic regression on hashed character n-grams.

Host and path are cut from the URL; host rules cover subdomains and path prefixes, the
longest rule wins. A URL that no rule fits is judged by a logistic regression over the
hashed character three-grams of ``host`` and ``path`` (told apart by a prefix), fitted
with MLlib on a small labelled URL table.

Everything is DataFrame expressions and MLlib transformers: no Python on the executors
and no shuffle in the judging pass. The rules are a short parameter list; they become one
array literal that is filtered per row.

The labelled table is small (``url_labels``: some hundred and seventy URLs labelled by hand, none of
them of ``pages``) or another one, of which at most ``MAX_LABELLED`` rows a class are taken, by
hash; it is written and fitted in one partition, in a fixed order, so reruns give the same
coefficients. Accuracy on URLs that it has not seen is measured in the tests.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule and
the model's verdict on the empty host and path; without labelled rows of both classes the
model's verdict is ``allow``; repeated rows are judged alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirador.llm import url_labels
from mirador.llm.common import positive_hash, read_table, written

# (host, path, verdict): fixed by the query contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
# Host parts that mark a URL as bad in the labelled table (the model learns from them).
SEED_WORDS = ["ads", "adult", "casino", "cheap", "free", "porn", "spam", "viagra"]
MAX_LABELLED = 2_000       # rows per class
FEATURES = 1 << 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: Column) -> DataFrame:
    """Add ``host`` and ``path``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = rest.substr(F.length(host) + 1, F.length(rest))
    return pages.withColumn("path", F.regexp_extract(tail, r"^[^?#]*", 0)) \
        .withColumn("host", F.translate(host, UPPER, LOWER))


def rule_of(rules) -> Column:
    """The longest rule that fits ``host`` and ``path`` as a struct, or null."""
    if not rules:
        return F.lit(None).cast("struct<host:string,path:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0], r[1]))
    table = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
                      for h, p, v in ordered])

    def fits(r: Column) -> Column:
        own = (F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))
        return own & F.col("path").startswith(r["path"])

    return F.get(F.filter(table, fits), F.lit(0))


def n_grams(n: int = 3) -> Column:
    """Character n-grams of host and path with borders, marked by where they come from."""
    def of(col: str, mark: str) -> Column:
        s = F.concat(F.lit("^"), F.col(col), F.lit("$"))
        at = F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.concat(F.lit(mark), s.substr(i, F.lit(n))))

    return F.concat(of("host", "h:"), of("path", "p:"))


def fit(labelled: DataFrame, most: int = MAX_LABELLED) -> PipelineModel | None:
    """Fit on (id, host, path, verdict), at most ``most`` rows a class, both classes
    weighing the same; None without both classes."""
    order = [positive_hash(F.col("id"), F.col("host"), F.col("path")), F.col("id")]
    classes = [labelled.filter(F.col("verdict") == v).orderBy(*order).limit(most) for v in ("allow", "block")]
    rows = classes[0].unionByName(classes[1]).select(
        (F.col("verdict") == "block").cast("double").alias("label"), n_grams().alias("grams"), *order)
    rows = written(rows.toDF("label", "grams", "h", "id").coalesce(1).sortWithinPartitions("h", "id"), "url-labels")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    weight = F.lit(sum(n.values()) / 2) / F.when(F.col("label") == 1.0, n[1.0]).otherwise(n[0.0])
    return Pipeline(stages=[
        HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True),
        LogisticRegression(maxIter=30, regParam=0.01, standardization=False, weightCol="weight")
    ]).fit(rows.coalesce(1).withColumn("weight", weight))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row."""
    model = fit(labelled)
    p = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), F.col("url"))
    p = p.withColumn("r", rule_of(rules)).withColumn("grams", n_grams())
    p = model.transform(p) if model else p.withColumn("prediction", F.lit(0.0))
    guess = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return p.select("page_id", "host", "path", F.concat("r.host", "r.path").alias("rule"),
                    F.coalesce("r.verdict", guess).alias("verdict"))


def labelled_by_words(pages: DataFrame, words=SEED_WORDS) -> DataFrame:
    """A labelled URL table from pages themselves: ``block`` where a part of the host is a seed word."""
    p = with_parts(pages.select(F.col("page_id").alias("id"), "url"), F.col("url"))
    parts = F.split("host", r"[.\-]")
    seeds = F.array(*[F.lit(w) for w in words])
    return p.filter("host <> ''").select("id", "host", "path", F.when(F.arrays_overlap(parts, seeds), "block")
                                         .otherwise("allow").alias("verdict"))


def labelled_urls(spark, rows=None) -> DataFrame:
    """The labelled URL table with its parts."""
    table = spark.createDataFrame(rows or url_labels.rows(), "id long, url string, verdict string")
    return with_parts(table, F.col("url")).select("id", "host", "path", "verdict")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Judge every url of ``pages`` with a model trained on the labelled URLs."""
    return judge(read_table(spark, sf_dir, "pages"), labelled_urls(spark))
