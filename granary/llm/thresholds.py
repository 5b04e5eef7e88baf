"""Nested hash thresholds: which rows of a group fit a budget, found from histograms instead of a sort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12
LEVELS = 5
#: Most budgets that are held on the driver; they are rows of a target table, not of the data.
MAX_BUDGETS = 100_000


def hash63(*cols: Column, seed: str = "") -> Column:
    """A non-negative 63-bit hash of the key, the same however rows are partitioned."""
    return F.xxhash64(*cols, F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


@dataclass
class Cut:
    """Rows of ``group`` with a hash below ``below`` make up ``weight`` of the budget."""

    group: tuple
    budget: float
    below: int
    weight: float = 0


def _bucket(h: Column, level: int) -> Column:
    return F.shiftrightunsigned(h, 63 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def histogram(rows: DataFrame, by: list[str], h: str = "h", size: str = "size") -> DataFrame:
    """Sizes and rows by group and first hash bucket: partial sums are combined before the shuffle."""
    return rows.groupBy(*by, _bucket(F.col(h), 0).alias("bucket")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n"))


def find_thresholds(rows: DataFrame, by: list[str], budgets: list[tuple[tuple, float]], h: str = "h", size: str = "size", first: list | None = None) -> list[Cut]:
    """For each (group, budget) the largest hash threshold whose rows do not exceed the budget.

    ``rows`` has the columns ``by``, a 63-bit hash and a size. Each level sums sizes by the next 12 bits of
    the hash, within the bucket where the budget ends only; it stops when each such bucket holds one hash.
    Rows with equal hashes are taken or left together. The driver holds at most budgets x 4096 sums.
    """
    if len(budgets) > MAX_BUDGETS:
        raise ValueError(f"{len(budgets)} budgets; at most {MAX_BUDGETS} are supported")
    spark = rows.sparkSession
    cuts = [Cut(g, b, 0) for g, b in budgets]
    open_ = list(range(len(cuts)))
    for level in range(LEVELS):
        if not open_:
            break
        if level == 0:
            got = first if first is not None else histogram(rows, by, h, size).collect()
            sums: dict = {}
            for r in got:
                sums.setdefault(tuple(r[c] for c in by), []).append((r["bucket"], r["size"], r["n"]))
            per = {i: sums.get(cuts[i].group, []) for i in open_}
        else:
            shift = 63 - BITS * level
            at = spark.createDataFrame([(i, cuts[i].below >> shift, *cuts[i].group) for i in open_], schema=_at_schema(rows, by))
            inner = rows.join(F.broadcast(at), [F.col(f"__{c}") == rows[c] for c in by] + [F.shiftrightunsigned(rows[h], shift) == F.col("__prefix")])
            got = inner.groupBy("__i", _bucket(F.col(h), level).alias("bucket")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).collect()
            per = {i: [] for i in open_}
            for r in got:
                per[r["__i"]].append((r["bucket"], r["size"], r["n"]))
        unit, still = 1 << (63 - BITS * (level + 1)), []
        for i in open_:
            c = cuts[i]
            for bucket, s, n in sorted(per[i]):
                if c.weight + s > c.budget:
                    c.below = c.below + bucket * unit
                    if n > 1 and level + 1 < LEVELS:
                        still.append(i)
                    break
                c.weight += s
            else:
                c.below = c.below + (unit << BITS) if level else 1 << 62 << 1
        open_ = still
    for c in cuts:
        c.below = min(c.below, (1 << 63) - 1)
    return cuts


def _at_schema(rows: DataFrame, by: list[str]):
    from pyspark.sql import types as T

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return T.StructType([T.StructField("__i", T.LongType()), T.StructField("__prefix", T.LongType())] + [T.StructField(f"__{c}", kinds[c]) for c in by])
