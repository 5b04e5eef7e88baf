"""Near-duplicate records: banded MinHash candidates, estimated by odd sketches, then checked exactly.

Each text gets MinHash samples by one permutation hashing of its character shingles. The samples are hashed into bands
(candidates share a band) and folded into a parity bitmap, the odd sketch: the population count of two sketches' XOR
estimates how many samples differ, precisely where similarity is high (Mitzenmacher, Pagh and Pham, 2014). Exact copies
are one class from the start, so that a group of copies costs one row in every later step.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import arrow_map, cut, spread, staged

SHINGLE = 5
#: MinHash samples, bands and samples per band: a pair of similarity 0.83 shares no band with probability 1e-3, of 0.86 with
#: 1e-4, of 0.9 with 4e-7; one of 0.4 shares a band with probability 0.02, so that the usual turns of a collection stay few.
BINS, BANDS, ROWS = 256, 26, 8
#: Samples that are folded into a sketch.
FOLDED = 128
#: Bits of an odd sketch, and the estimate under which a candidate is given up (5 standard deviations under 0.8
#: where samples are independent; those that bins borrow are not).
BITS = 256
LEAST_ESTIMATE = 0.60
#: Texts with fewer bins of their own, as under 256 shingles fill, go to the exact check whatever the estimate.
OWN_BINS = 162
SIMILARITY = 0.8

#: Tables told apart in a row id: id x TABLES + code of the table.
TABLES = 8
INDEX = "rid bigint, hi bigint, lo bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, few boolean, bands array<bigint>"
_WORDS = re.compile(r"\w+")
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def normalise(text: str) -> str:
    """Casefolded; every run of characters that are no letter, digit or underscore becomes one space; ends trimmed."""
    return " ".join(_WORDS.findall(text.casefold()))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def samples(texts: list[str]) -> np.ndarray:
    """BINS MinHash samples of each text's shingles; texts without shingles keep the largest value everywhere."""
    return _lent(_minima(texts))


def _minima(texts: list[str]) -> np.ndarray:
    out = np.full((len(texts), BINS), _EMPTY, dtype=np.uint64)
    flat = out.reshape(-1)
    at = 0
    while at < len(texts):  # about a million characters at a time
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) < 1_000_000):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        if len(codes) >= SHINGLE:
            h = codes[: len(codes) - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - SHINGLE + 1 + k]
            h = _mix(h)
            ends = np.cumsum(lengths)
            doc = np.repeat(np.arange(at, end), lengths)[: len(h)]
            keep = np.arange(len(h)) + SHINGLE <= np.repeat(ends, lengths)[: len(h)]
            h, doc = h[keep], doc[keep]
            np.minimum.at(flat, doc * BINS + (h >> np.uint64(56)).astype(np.int64), h & np.uint64((1 << 56) - 1))
        at = end
    return out


def _lent(out: np.ndarray) -> np.ndarray:
    some = (out != _EMPTY).any(axis=1)
    rows = np.flatnonzero(some & (out == _EMPTY).any(axis=1))
    if len(rows):  # an empty bin borrows from the next bin that has a sample, marked with the distance
        given = out[rows].copy()
        filled = given.copy()
        for k in range(1, BINS):
            hole = filled == _EMPTY
            if not hole.any():
                break
            lent = np.roll(given, -k, axis=1)
            use = hole & (lent != _EMPTY)
            filled[use] = _mix(lent[use] + np.uint64(k)) & np.uint64((1 << 56) - 1)
        out[rows] = filled
    return out


def bands(s: np.ndarray, tbl: np.ndarray) -> np.ndarray:
    """One key per band, which holds for one table only."""
    s = s[:, : BANDS * ROWS].reshape(len(s), BANDS, ROWS)
    key = _mix(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(256) + tbl.astype(np.uint64)[:, None])
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key.view(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """BITS parities of the samples, as four 64-bit words."""
    s = s[:, :: BINS // FOLDED]
    spot = (_mix(s + _mix(np.arange(FOLDED, dtype=np.uint64))[None, :]) % np.uint64(BITS)).astype(np.int64)
    counts = np.zeros((len(s), BITS), dtype=np.uint8)
    np.add.at(counts.reshape(-1), (np.arange(len(s))[:, None] * BITS + spot).reshape(-1), 1)
    return np.packbits(counts & 1, axis=1).view(np.int64).reshape(len(s), BITS // 64)


def estimate(differing: int) -> float:
    """Similarity by the population count of two odd sketches' XOR."""
    share = 1 - 2 * differing / BITS
    return 1 + BITS / (4 * FOLDED) * math.log(share) if share > 0 else 0.0


#: Most differing bits of a candidate that is kept.
MOST_BITS = max(d for d in range(BITS // 2) if estimate(d) >= LEAST_ESTIMATE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [normalise(t) for t in b.column(1).to_pylist()]
        keep = [k for k, t in enumerate(texts) if len(t) >= SHINGLE]
        d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(texts[k].encode("utf-8", "surrogatepass")) for k in keep), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))], ["rid", "hi", "lo"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rid = np.array(b.column(0).to_pylist(), dtype=np.int64)
        texts = [normalise(t) for t in b.column(1).to_pylist()]
        keep = np.array([len(t) >= SHINGLE for t in texts], dtype=bool)
        if not keep.any():
            continue
        texts, rid = [t for t, k in zip(texts, keep) if k], rid[keep]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts), dtype=np.int64).reshape(-1, 2)
        s = _minima(texts)
        few = (s != _EMPTY).sum(axis=1) < OWN_BINS
        s = _lent(s)
        sk, bd = odd_sketch(s), bands(s, rid % TABLES)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bd.size + 1, BANDS, dtype=np.int32)), pa.array(bd.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(rid), *[pa.array(np.ascontiguousarray(digests[:, i])) for i in range(2)], *[pa.array(np.ascontiguousarray(sk[:, i])) for i in range(4)], pa.array(few), lists], ["rid", "hi", "lo", "s0", "s1", "s2", "s3", "few", "bands"])


def shingles(text: str) -> set[str]:
    return {text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1)}


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kept, sims, last, held = b.to_pydict(), [], [], None, set()
            for k, (x, y) in enumerate(zip(rows["text_a"], rows["text_b"])):
                if x != last:
                    last, held = x, shingles(normalise(x))
                other = shingles(normalise(y))
                common = len(held & other)
                sim = common / (len(held) + len(other) - common) if held or other else 0.0
                if sim > least:
                    kept.append(k)
                    sims.append(sim)
            yield pa.RecordBatch.from_arrays([pa.array([rows["a"][k] for k in kept], pa.int64()), pa.array([rows["b"][k] for k in kept], pa.int64()), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return run


class NearDuplicates:
    """Near-duplicates among ``texts`` (tbl tinyint, id bigint, text string): similarity of 5-character shingle sets over ``least``.

    Only records of one ``tbl`` (0 to 7) are compared; ids are unique in it; one beyond 61 bits raises. Null texts and texts under five characters after
    :func:`normalise` have no shingles and are near nothing. A record is a class with its exact copies (equal after
    :func:`normalise`); candidates, estimates and checks are between class representatives (the smallest id). Nothing
    is capped: a band shared by many classes is joined as it is, and AQE splits it where it is skewed.
    """

    def __init__(self, texts: DataFrame, least: float = SIMILARITY):
        self.everyone = texts.select("tbl", "id")
        fits = F.when(F.col("id").between(-(1 << 60), (1 << 60) - 1), F.col("id")).otherwise(F.raise_error(F.lit("ids must lie within 61 bits")))
        rows = texts.filter("text is not null").select((fits.cast("bigint") * TABLES + F.col("tbl")).alias("rid"), "text")
        #: rid, hi, lo: digest of every record; records of one table with one digest are copies
        self.index = staged(arrow_map(spread(rows), _digests, "rid bigint, hi bigint, lo bigint"), "digests")
        sketched = arrow_map(spread(rows), _index, INDEX)
        classes = sketched.groupBy((F.col("rid") % TABLES).alias("tbl"), "hi", "lo").agg(F.min(F.struct("rid", "s0", "s1", "s2", "s3", "few", "bands")).alias("r"), F.count(F.lit(1)).alias("copies"))
        self.classes = staged(classes.select("hi", "lo", "copies", "r.*"), "classes")
        banded = self.classes.select("rid", F.explode("bands").alias("key"))
        pairs = banded.alias("x").join(banded.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rid") < F.col("y.rid")))
        candidates = pairs.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()
        sketch = lambda s: self.classes.select(F.col("rid").alias(s), *[F.col(f"s{i}").alias(f"{s}{i}") for i in range(4)], F.col("few").alias(f"{s}_few"))
        differing = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
        close = cut(candidates.join(sketch("a"), "a").join(sketch("b"), "b").filter((differing <= MOST_BITS) | F.col("a_few") | F.col("b_few")).select("a", "b"))
        ends = close.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
        needed = staged(rows.join(ends, "rid", "left_semi"), "texts")
        text = lambda s: needed.select(F.col("rid").alias(s), F.col("text").alias(f"text_{s}"))
        both = close.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
        #: a, b, similarity: pairs of class representatives by row id, a < b
        self.links = cut(arrow_map(both, _verify(least), "a bigint, b bigint, similarity double"))

    def members(self) -> DataFrame:
        """rid, rep: rows of classes with copies."""
        many = self.classes.filter("copies > 1").select((F.col("rid") % TABLES).alias("tbl"), "hi", "lo", F.col("rid").alias("rep"))
        return self.index.withColumn("tbl", F.col("rid") % TABLES).join(many, ["tbl", "hi", "lo"]).select("rid", "rep")

    def pairs(self) -> DataFrame:
        """tbl, id_a, id_b of all pairs of records over the threshold, copies included."""
        m = self.members()
        copies = m.alias("x").join(m.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.rid") < F.col("y.rid"))).select(F.col("x.rid").alias("x"), F.col("y.rid").alias("y"))
        side = lambda s: m.select(F.col("rep").alias(s), F.col("rid").alias(f"{s}_rid"))
        wide = self.links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_rid", "a").alias("x"), F.coalesce("b_rid", "b").alias("y"))
        both = copies.unionByName(wide)
        whole = lambda c: F.expr(f"{c} div {TABLES}")
        return both.select((F.col("x") % TABLES).cast("tinyint").alias("tbl"), F.least(whole("x"), whole("y")).alias("id_a"), F.greatest(whole("x"), whole("y")).alias("id_b"))

    def groups(self) -> DataFrame:
        """tbl, id, group_id (smallest id of the group), links (near classes of the record's class): one row per record with shingles."""
        comp = components(self.links.select("a", "b"))
        degree = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        per = self.classes.select((F.col("rid") % TABLES).alias("tbl"), "hi", "lo", F.col("rid").alias("rep")).join(comp.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
        return self.index.withColumn("tbl", F.col("rid") % TABLES).join(per, ["tbl", "hi", "lo"]).select(F.col("tbl").cast("tinyint").alias("tbl"), F.expr(f"rid div {TABLES}").alias("id"), F.expr(f"coalesce(component, rep) div {TABLES}").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))

    def all_groups(self) -> DataFrame:
        """As :func:`groups`, with one row per record: those without shingles, null texts too, are a group of their own without links."""
        own = self.everyone.join(self.groups(), ["tbl", "id"], "left")
        return own.select("tbl", "id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id): connected components by alternating large and small stars, which end in
    logarithmically many rounds; each round is checkpointed."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        # large star: larger neighbours are linked to the smallest of all neighbours and the node itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, ["u"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        new = cut(small)
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            break
        edges = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
