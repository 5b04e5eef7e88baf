"""BM25 retrieval over an inverted index held as DataFrames."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.session import cut, spread, staged


@dataclass
class Bm25Index:
    """Staged tables: an index is made once and serves any number of searches."""

    postings: DataFrame  #: term, id, tf, dl
    terms: DataFrame  #: term, df, idf
    average: float  #: mean length of a document, those without words included


#: Most query terms that are sent to every task; with more, postings are joined by shuffle.
MAX_TERMS = 100_000


def build_index(docs: DataFrame, epsilon: float = 0.25) -> Bm25Index:
    """Index of ``docs`` (id, text). Documents without words have length 0 and no postings; idf is
    ln(N - df + 0.5) - ln(df + 0.5), and negative values become epsilon x the mean idf, negatives included.

    Texts are read into words once; all else is counted from the staged postings."""
    words = spread(docs.select("id", "text")).select("id", T.tokens(F.col("text"), folded=False).alias("w")).filter(F.size("w") > 0)
    counted = words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    postings = staged(counted.select("term", "id", "tf", "dl"), "postings")
    n = docs.count()
    average = (postings.agg(F.sum("tf")).first()[0] or 0) / n if n else 0.0
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0]
    return Bm25Index(postings, raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon * (mean or 0.0))).otherwise(F.col("raw")).alias("idf")), average)


def search(index: Bm25Index, queries: DataFrame, top: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, id, score, rank``: best documents of each query (query_id, text).

    A term repeated in a query scores again. Documents that share no term are no hits; ties go to the smaller id. Query
    terms, with their idf, go to the postings if they are at most MAX_TERMS; each task keeps its best per query.
    """
    terms = queries.select("query_id", F.explode(T.tokens(F.col("text"), folded=False)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = cut(terms)
    few = terms.count() <= MAX_TERMS
    weighted = index.terms.select("term", "idf").join(F.broadcast(terms) if few else terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    hits = index.postings.join(F.broadcast(weighted) if few else weighted, "term")
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.average)))
    scored = hits.select("query_id", "id", part.alias("part")).groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")  # sums of equal parts in another order are ties
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def build_query(description: str, keywords: list[str]) -> str:
    """A description and its keywords, underscores read as spaces."""
    return " ".join([description, *(k.replace("_", " ") for k in keywords)])


def retrieve_and_extract(index: Bm25Index, docs: DataFrame, description: str, keywords: list[str], extract: Callable[[str, list[str]], list[str]], iterations: int = 3, sample: int = 5, top: int = 5, cap: int = 200, seed: int = 0) -> tuple[list[str], list[dict]]:
    """Keywords widened by what ``extract`` finds in the passages that BM25 ranks first for a sample of them; with the history.

    The same seed gives the same samples. A round that brings nothing new ends the loop, as does the cap."""
    rng, known, history = random.Random(seed), list(dict.fromkeys(keywords))[:cap], []
    for i in range(iterations):
        query = build_query(description, rng.sample(known, min(sample, len(known))))
        frame = docs.sparkSession.createDataFrame([(i, query)], "query_id int, text string")
        hits = search(index, frame, top).select("id", "rank").join(docs, "id").orderBy("rank").collect()  # top passages only
        added: list[str] = []
        for h in hits:
            added += [k for k in extract(h["text"], known + added) if k not in known and k not in added]
        added = added[: cap - len(known)]
        history.append({"iteration": i, "query": query, "documents": [h["id"] for h in hits], "added": added})
        known += added
        if not added or len(known) >= cap:
            break
    return known, history
