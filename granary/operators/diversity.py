"""Diversity of a collection: distinct n-grams, self-BLEU in linear time, entropy of clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.session import cut, spread


def distinct_n(texts: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """Distinct n-grams over all n-grams of ``texts`` (text), overall or ``by`` columns; null where there is none."""
    by = by or []
    grams = spread(texts.select(*by, "text")).select(*by, F.explode_outer(T.ngrams(T.tokens(F.col("text")), n)).alias("g"))
    counted = grams.groupBy(*by, "g").agg(F.count("g").alias("c"))
    return counted.groupBy(*by).agg(F.try_divide(F.count("g").cast("double"), F.sum("c")).alias(f"distinct_{n}"))


def self_bleu(texts: DataFrame, max_n: int = 4, epsilon: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """``self_bleu``: mean BLEU of each text (id, text) against all others, overall or ``by`` columns; null with fewer than two
    texts with words.

    The clipped count of a gram is bounded by its largest count in another text, so it is the text's own count but where
    this text alone has the largest: then the second largest. So per gram only the two largest counts matter. Texts are
    spread by id, after which grams are counted without a shuffle; of each gram a task hands on two rows at most, whatever
    its frequency. Orders that a text lacks are left out; an order without a match counts epsilon; the brevity penalty uses
    the other text of closest length, the shorter of two. Orders are weighted alike.
    """
    by = by or []

    def numbered_grams(h: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), *[F.get(h, i + j) for j in range(n)]).alias("g")))
        return F.when(F.size(h) >= n, made).otherwise(F.array().cast("array<struct<n:int,g:bigint>>"))

    group = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    placed = texts.select(*by, "id", group.alias("_grp"), "text").repartition("_grp", "id")
    words = placed.select(*by, "id", "_grp", T.tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    # grams are hashed from their words' hashes, which are bound by a lambda, so that each word is hashed once
    every = F.transform(F.array(F.transform("w", lambda t: F.xxhash64(t))), lambda h: F.concat(*[numbered_grams(h, n) for n in range(1, max_n + 1)]))[0]
    grams = words.select("_grp", "id", F.explode(every).alias("x"))
    counts = grams.groupBy("_grp", "id", F.col("x.n").alias("n"), F.col("x.g").alias("g")).agg(F.count(F.lit(1)).alias("c"))
    two = counts.withColumn("r", F.row_number().over(Window.partitionBy("_grp", "n", "g").orderBy(F.col("c").desc(), "id"))).filter("r <= 2")
    tops = two.groupBy("_grp", "n", "g").agg(F.max("c").alias("top"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("c"))), F.lit(0)).alias("second"), F.max(F.when(F.col("r") == 1, F.col("id"))).alias("id"))
    lost = tops.filter("top > second").groupBy("_grp", "id").pivot("n", list(range(1, max_n + 1))).agg(F.sum(F.col("top") - F.col("second")))
    lengths = cut(words.select(*by, "_grp", "id", F.size("w").alias("len")))
    own = lengths.join(lost, ["_grp", "id"], "left")
    terms = []
    for n in range(1, max_n + 1):
        total = F.col("len") - (n - 1)
        hit = total - F.coalesce(F.col(str(n)), F.lit(0))
        terms.append(F.when(total > 0, F.log(F.when(hit == 0, F.lit(epsilon)).otherwise(hit) / total)))
    present = F.array_compact(F.array(*terms))
    precision = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v) / F.size(present)
    sizes = lengths.groupBy("_grp", "len").agg(F.count(F.lit(1)).alias("n"))  # distinct lengths: few rows in a group
    w = Window.partitionBy("_grp").orderBy("len")
    near = sizes.select("_grp", "len", "n", F.lag("len").over(w).alias("low"), F.lead("len").over(w).alias("high"))
    closest = F.when(F.col("n") > 1, F.col("len")).when(F.col("low").isNull(), F.col("high")).when(F.col("high").isNull(), F.col("low")).when(F.col("len") - F.col("low") <= F.col("high") - F.col("len"), F.col("low")).otherwise(F.col("high"))
    refs = near.select("_grp", "len", closest.alias("ref")).filter("ref is not null")
    brevity = F.when(F.col("len") >= F.col("ref"), F.lit(0.0)).otherwise(1 - F.col("ref") / F.col("len"))
    return own.withColumn("_lp", precision).join(refs, ["_grp", "len"]).groupBy(*by).agg(F.avg(F.exp(F.col("_lp") + brevity)).alias("self_bleu"))


def cluster_entropy(vectors: DataFrame, k: int = 8, seed: int = 0, iterations: int = 50) -> DataFrame:
    """``entropy`` in nats of the sizes of k-means clusters of L2-normalised vectors (embedding); null where there is none.

    k is at most the number of distinct vectors. Centres come from the distributed k-means of Spark, so a result
    agrees with another implementation's within what other starting points give.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = vectors.filter("embedding is not null and size(embedding) > 0").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    distinct = vectors.select("embedding").distinct().limit(k).count()
    if distinct == 0:
        return vectors.sparkSession.createDataFrame([(None,)], "entropy double")
    unit = Normalizer(inputCol="raw", outputCol="features").transform(rows)
    made = KMeans(k=min(k, distinct), seed=seed, maxIter=iterations).fit(unit).transform(unit) if distinct > 1 else unit.withColumn("prediction", F.lit(0))
    sizes = made.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("t"))
    return sizes.crossJoin(F.broadcast(total)).agg(F.sum(-(F.col("n") / F.col("t")) * F.log(F.col("n") / F.col("t"))).alias("entropy"))


def entropy(counts: list[int]) -> float:
    total = sum(counts)
    return -sum(c / total * math.log(c / total) for c in counts if c)
