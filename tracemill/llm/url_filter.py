"""URL verdicts: host and path rules first, then logistic regression on hashed character n-grams.

Rules are "host/path" strings with a verdict. A rule fits its host and every subdomain if the url's
path starts with the rule's path; of several that fit, the longest decides. What no rule decides
goes to a model trained on a small table of labelled urls: n-grams of host and path, marked at their
ends, are hashed to FEATURES buckets. Everything runs as DataFrame expressions and Spark's own
DataFrame estimators.

Nulls: a null url, or one without "://", has empty host and path, fits no rule and is judged by the
model's intercept. Without labelled rows the model allows; with a single label it gives that label.
Repeated urls are judged alike.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 13
GRAMS = (3, 4)
LABELLED_ROWS = 20_000  # the training table holds at most so many rows of each label
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits. rules: (verdict, "host/path")."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(text: Column, tag: str) -> Column:
    """Character n-grams of text between end marks, tagged by the part they come from."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
        found = F.transform(places, lambda i: F.concat(F.lit(tag), F.substr(marked, i, F.lit(n))))
        return F.when(F.length(marked) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of_size, GRAMS))


def featured(urls: DataFrame) -> DataFrame:
    """urls(host, path, ...) with a vector of hashed n-grams."""
    with_grams = urls.withColumn("url_grams", F.concat(grams(F.col("host"), "h"), grams(F.col("path"), "p")))
    return HashingTF(inputCol="url_grams", outputCol="url_features", numFeatures=FEATURES, binary=True).transform(with_grams).drop("url_grams")


def labelled_sample(labelled: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """At most so many distinct (host, path) of each label(0 or 1), by the order of their hash."""
    distinct = labelled.select("host", "path", "label").distinct()
    parts = [distinct.filter(F.col("label") == v).orderBy(F.xxhash64("host", "path"), "host", "path").limit(most) for v in (0, 1)]
    return parts[0].union(parts[1])


def train(labelled: DataFrame):
    """A model of labelled(host, path, label), label 1 for block; the only label, or 0, if there are not both."""
    rows = featured(labelled_sample(labelled)).select("url_features", F.col("label").cast("double").alias("label"))
    rows = rows.coalesce(1).cache()  # bounded, and one partition makes the fit repeatable
    found = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(found) < 2:
        rows.unpersist()
        return found[0] if found else 0.0
    model = LogisticRegression(featuresCol="url_features", labelCol="label", regParam=1e-3, maxIter=40, probabilityCol="url_probability", rawPredictionCol="url_raw", predictionCol="url_prediction").fit(rows)
    rows.unpersist()
    return model


def blocked(urls: DataFrame, model) -> DataFrame:
    """urls(host, path, ...) with block_probability."""
    if isinstance(model, float):
        return urls.withColumn("block_probability", F.lit(model))
    scored = model.transform(featured(urls))
    return scored.withColumn("block_probability", vector_to_array("url_probability")[1]).drop("url_features", "url_raw", "url_probability", "url_prediction")


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url) as page_id, host, path, rule, verdict, block_probability.

    labelled(url, label) trains the model. Without it the urls that a rule decides are the labels.
    """
    def parsed(rows: DataFrame, *keep: Column) -> DataFrame:
        host, path = host_and_path(F.col("url").cast("string"))
        return rows.select(*keep, host.alias("host"), path.alias("path"))

    rows = parsed(pages, F.col("page_id"))
    rule, by_rule = rule_for(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("by_rule", by_rule)
    if labelled is None:
        known = ruled.filter(F.col("by_rule").isNotNull()).select("host", "path", (F.col("by_rule") == "block").cast("int").alias("label"))
    else:
        known = parsed(labelled, F.col("label").cast("int").alias("label"))
    scored = blocked(ruled, train(known))
    by_model = F.when(F.col("block_probability") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "block_probability")
