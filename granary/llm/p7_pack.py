"""Packing documents into containers of fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import cut, ship

#: Documents packed together in one task; the number of tasks grows with the data, the work of one doesn't.
SHARD_DOCS = 20_000
#: Packs, each of which takes all documents, in one call.
MAX_PACKS = 1_000
ROWS = "pack_id int, doc_id bigint, piece int, pieces bigint, start_token bigint, n_tokens bigint, container_id string"


@dataclass
class Packing:
    rows: DataFrame  #: pack_id, doc_id, piece, pieces, start_token, n_tokens, container_id
    fill: DataFrame  #: pack_id, container_id, capacity_tokens, n_pieces, used_tokens, fill


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item. Each item goes, largest first, where the sum over gaps of squared counts of open bins becomes
    smallest (a new bin is one of the choices); ties go to the smallest remaining gap, then to an open bin."""
    open_at = np.zeros(capacity + 1, dtype=np.int64)  # open bins by residual gap; full bins are closed
    bins: dict[int, list[int]] = {}
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        gaps = np.flatnonzero(open_at[s:]) + s if made else np.empty(0, dtype=np.int64)
        best, gain = -1, 2 * open_at[capacity - s] + 1 if s < capacity else 0
        if len(gaps):
            after = gaps - s
            change = 2 - 2 * open_at[gaps] + 2 * open_at[after]
            change[after == 0] -= 1  # a bin that is full is no longer counted
            k = int(np.argmin(change))
            if change[k] <= gain:
                best = int(gaps[k])
        if best < 0:
            b, left = made, capacity - s
            made += 1
        else:
            b, left = bins[best].pop(), best - s
            open_at[best] -= 1
        out[i] = b
        if left > 0:
            open_at[left] += 1
            bins.setdefault(left, []).append(b)
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
    first = pdf.iloc[0]
    to = sum_of_squares(pdf["n_tokens"].to_numpy(), int(first["capacity_tokens"]))
    prefix = f"{first['pack_id']}-{first['shard']}-"
    return pd.DataFrame({**{c: pdf[c] for c in ("pack_id", "doc_id", "piece", "pieces", "start_token", "n_tokens")}, "container_id": [f"{prefix}{b}" for b in to]})


def pack(docs: DataFrame, containers: DataFrame, shard_docs: int = SHARD_DOCS) -> Packing:
    """Assign every document to a container of each pack of ``containers`` (pack_id, capacity_tokens).

    A size is the UTF-8 bytes of the text plus 1 (a null text: 1). A document over the capacity is split: whole
    capacities fill containers of their own, and its last piece is packed as an item. Documents are hashed into
    shards of about ``shard_docs`` rows, each packed apart, so work per task is bounded and shards run in parallel.
    A null or non-positive capacity gives no containers; repeated rows are items of their own; an empty table gives none.
    """
    ship(docs.sparkSession)
    sized = cut(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size")))
    shards = max(1, -(-sized.count() // shard_docs))
    cap = F.col("capacity_tokens")
    lots = containers.filter("capacity_tokens > 0").select(F.col("pack_id").cast("int").alias("pack_id"), cap.cast("bigint").alias("capacity_tokens"))
    if (n := lots.count()) > MAX_PACKS:
        raise ValueError(f"{n} packs; at most {MAX_PACKS} are packed at a time")
    lots = F.broadcast(lots)
    each = sized.crossJoin(lots).withColumn("pieces", F.ceil(F.col("size") / cap).cast("bigint"))  # every document goes into every pack
    whole = (
        each.filter("pieces > 1")
        .withColumn("piece", F.explode(F.expr("sequence(0, cast(pieces as int) - 2)")))
        .select("pack_id", "doc_id", "piece", "pieces", (F.col("piece") * cap).cast("bigint").alias("start_token"), cap.alias("n_tokens"), F.concat(F.col("pack_id").cast("string"), F.lit("-d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container_id"))
    )
    start = (F.col("pieces") - 1) * cap
    items = each.select("pack_id", "capacity_tokens", "doc_id", (F.col("pieces") - 1).cast("int").alias("piece"), "pieces", start.alias("start_token"), (F.col("size") - start).alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    packed = items.groupBy("pack_id", "shard").applyInPandas(_pack, ROWS)
    rows = whole.unionByName(packed)
    fill = (
        rows.groupBy("pack_id", "container_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("used_tokens"))
        .join(lots, "pack_id")
        .select("pack_id", "container_id", "capacity_tokens", "n_pieces", "used_tokens", (F.col("used_tokens") / cap).alias("fill"))
    )
    return Packing(rows, fill)
