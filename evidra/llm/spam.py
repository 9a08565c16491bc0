"""Keyword-stuffed, link-list and product-list pages."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.pages import NAMES, page_features
from evidra.session import materialize

#: At most so many weakly labelled rows of either class are used to train.
MOST_TRAINING = 40_000
TREES, DEPTH = 50, 10
#: How much the rate of a page's host counts against what the page's own trees say, and how many pages a host's rate is drawn to the mean by.
HOST_WEIGHT, HOST_PRIOR = 0.15, 20


def weak_label(f: str = "f") -> Column:
    """1.0 for clear spam, 0.0 for clear writing or records, null where rules of thumb shouldn't decide."""
    x = lambda name: F.col(f"{f}.{name}")
    written = F.exp(x("words")) - 1
    bare = ((x("function_words") < 0.08) | (x("bare_share") > 0.6)) & (x("times") < 0.2) & ((x("digits") < 0.2) | (x("models") > 0.12))
    repeated = (written >= 12) & (x("bare_distinct") < 0.45) & ((x("distinct_pairs") < 0.8) | (x("bare_distinct") < 0.35))
    linked = (x("link_share") > 0.45) & (x("sentences") < 0.05)
    mostly_linked = (x("link_share") > 0.6) & (x("times") < 0.2)
    listed = (written >= 12) & ((x("tags") > 0.3) | ((x("trails") > 0.8) & (x("line_words") < 15)) | (x("models") > 0.12))
    spam = (bare & (repeated | listed | linked)) | mostly_linked
    prose = (x("function_words") > 0.17) & (x("link_share") < 0.3) & (x("bare_share") < 0.4)
    varied = (x("distinct_pairs") > 0.85) & (x("sentences") > 0.03) & (x("link_share") < 0.3)
    records = (x("link_share") < 0.1) & ((x("times") >= 0.8) | ((x("labels") > 0.4) & (x("distinct") > 0.45)) | ((x("digits") > 0.2) & (x("prices") < 0.02) & (x("models") < 0.05)))
    short = (written < 8) & (x("link_share") == 0)
    return F.when(spam, 1.0).when(prose | varied | records | short, 0.0)


def spam_scores(pages: DataFrame, page_id: str, text: str, host: str, most_training: int = MOST_TRAINING) -> DataFrame:
    """How likely each page is spam: page_id, page_score (of the trees) and score (smoothed by the host's rate).

    Method: features of every page are computed once; weak labels name the clear cases; bagged decision trees (bootstrap
    samples, all features at every node) learn from at most `most_training` of either class, chosen by a hash of the id, both classes weighing the same;
    all pages are scored; the rate of each host, over all its pages and drawn towards the overall rate, shifts the
    doubtful ones. Without a clear case of either class nothing can be learned: clear pages keep their label, and
    doubtful ones score 0.5, which is not spam.

    A null host is a host of its own kind: such pages get the overall rate. Null and empty texts score 0. Repeated rows
    are scored alike. Extra columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(page_id).alias("id"), F.col(host).alias("host"), F.col(text).alias("text"))
    rows = page_features(rows, "text").select("id", "host", "f", F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("written"))
    rows = materialize(rows.withColumn("label", F.when(F.col("written"), weak_label())), "page-features")
    counts = {r["label"]: r["count"] for r in rows.where("label is not null").groupBy("label").count().collect()}
    if len(counts) < 2:
        clear = F.when(F.col("written"), F.coalesce("label", F.lit(0.5))).otherwise(0.0)
        return rows.select(F.col("id").alias(page_id), clear.alias("page_score"), clear.alias("score"))
    share = F.when(F.col("label") == 1, min(1.0, most_training / counts[1.0])).otherwise(min(1.0, most_training / counts[0.0]))
    drawn = F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(1_000_000)) < share * 1_000_000
    assembler = VectorAssembler(inputCols=[f"f_{x}" for x in NAMES], outputCol="features")
    flat = lambda df: assembler.transform(df.select("*", *(F.col(f"f.{x}").alias(f"f_{x}") for x in NAMES)))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=True, weightCol="weight", seed=7)
    drawn_counts = {k: min(n, most_training) for k, n in counts.items()}
    weight = F.when(F.col("label") == 1, 1.0 / drawn_counts[1.0]).otherwise(1.0 / drawn_counts[0.0]) * min(drawn_counts.values())
    # a fixed order, so that the bootstrap samples don't depend on how the rows were laid out
    training = rows.where("label is not null").where(drawn).repartition(8, "id").sortWithinPartitions("id")
    model = forest.fit(flat(training).select("features", "label", weight.alias("weight")))

    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(flat(rows)).select("id", "host", F.when(F.col("written"), p).otherwise(0.0).alias("page_score"))
    scored = materialize(scored, "page-scores")
    overall = scored.agg(F.avg("page_score")).first()[0]
    rates = scored.where("host is not null").groupBy("host").agg(((F.sum("page_score") + HOST_PRIOR * overall) / (F.count("*") + HOST_PRIOR)).alias("rate"))
    # a written table has a known size: rates of few hosts go to the pages, of many the join is split where a host is hot
    joined = scored.join(materialize(rates, "host-rates"), "host", "left")
    score = F.col("page_score") * (1 - HOST_WEIGHT) + F.coalesce(F.col("rate"), F.lit(overall)) * HOST_WEIGHT
    return joined.select(F.col("id").alias(page_id), "page_score", F.when(F.col("page_score") > 0, score).otherwise(0.0).alias("score"))
