"""Exact set similarity: records against a small collection, records among each other, and order-dependent deduplication."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.session import arrow_map, cut, spread, staged

#: Items that are held against the texts in one pass; a larger collection takes several passes.
MAX_ITEMS = 50_000
#: Bits of the narrowest sketch of a set of shingles.
LEAST_BITS = 256
#: Sketches of the smallest block, and blocks that a sketch goes to on average at most.
BLOCK, COPIES = 4096, 8
#: Sketches of two blocks that are compared at a time, so that what is counted stays in the cache.
TILE, COLUMNS = 16, 8192
#: Words of the sketches are compared until other texts are so many times over what near ones may differ in; the rest only of pairs that are left.
ENOUGH = 1.3


def _normalised_shingles(t: str, k: int) -> set[str]:
    """What :func:`granary.functions.text.shingles` gives for a normalised text, for items that are on the driver."""
    n = " ".join(re.findall(r"\w+", t.casefold()))
    return set() if not n else {n} if len(n) <= k else {n[i : i + k] for i in range(len(n) - k + 1)}


def _passes(items: DataFrame, columns: list[str], key: str) -> Iterator[list]:
    """The rows of ``items`` in parts of some MAX_ITEMS, by hash of the key; in one part if they are no more."""
    some = items.select(*columns)
    n = some.count()
    parts = -(-n // MAX_ITEMS)
    for p in range(parts):
        yield (some if parts == 1 else some.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == p)).collect()


def best_match(texts: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """``id, item_id, score``: of each text (id, text) the item (item_id, text) of highest Jaccard similarity.

    Ties go to the smallest item id. Texts that share no shingle with any item, or are null or empty, have no row. The
    items are the query set of a held-out or seed collection; they go to executors as an inverted index, in passes of
    MAX_ITEMS, and each text is scored against all of a pass at a time, without a shuffle but for joining several passes.
    """
    kind, item_kind = dict(texts.dtypes)["id"], dict(items.dtypes)["item_id"]
    schema = f"id {kind}, item_id {item_kind}, score double"
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    if item_kind not in kinds:
        raise TypeError(f"item ids are {item_kind}, not one of {sorted(kinds)}")
    found = None
    for rows in _passes(items.filter("text is not null"), ["item_id", "text"], "item_id"):
        one = arrow_map(spread(texts.select("id", "text")), _against(rows, k, kinds[item_kind]), schema)
        found = one if found is None else found.unionByName(one)
        several = found is not one
    if found is None:
        return texts.sparkSession.createDataFrame([], schema)
    if several:
        best = F.min(F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("item_id")))
        found = found.groupBy("id").agg(best.alias("b")).select("id", "b.item_id", (-F.col("b.s")).alias("score"))
    return found


def _against(rows: list, k: int, kind: pa.DataType):
    sets = sorted((r["item_id"], _normalised_shingles(r["text"], k)) for r in rows)
    ids = [i for i, _ in sets]
    sizes = np.array([len(s) for _, s in sets], dtype=np.int64)
    postings: dict[str, list[int]] = {}
    for j, (_, s) in enumerate(sets):
        for g in s:
            postings.setdefault(g, []).append(j)
    index = {g: np.array(p, dtype=np.int32) for g, p in postings.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = _normalised_shingles(t, k) if t else set()
                hits = [index[g] for g in own if g in index]
                if not hits:
                    continue
                common = np.bincount(np.concatenate(hits), minlength=len(ids))
                score = common / (len(own) + sizes - common)
                j = int(score.argmax())
                out.append((i, ids[j], float(score[j])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.schema.field(0).type), pa.array([o[1] for o in out], kind), pa.array([o[2] for o in out], pa.float64())], ["id", "item_id", "score"])

    return run


def classes(texts: DataFrame, k: int = 5) -> DataFrame:
    """``id, class_id``: records of equal normalised text share a class, named by its smallest id."""
    return _classes(cut(texts.select("id", F.sha2(T.normalise(F.col("text")), 256).alias("digest"))).filter("digest is not null"))


def _classes(keyed: DataFrame) -> DataFrame:
    first = keyed.groupBy("digest").agg(F.min("id").alias("class_id"))
    return keyed.join(first, "digest").select("id", "class_id")


def similarity_join(texts: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """``a, b, score``: all pairs a < b of different texts (id, text) whose Jaccard similarity exceeds ``threshold``.

    Every text becomes a sketch of some 1.1 bits a shingle: the parity of
    the number of its shingles in each slot of a hash. Two sketches differ in no more bits than the sets differ in shingles,
    which for sets over the threshold are at most (1 - t) / (1 + t) of both sizes: what differs in more bits is no pair, so no pair
    is lost. Sketches are compared by blocks of like size (:func:`_blocks`) with all that are in reach of the size ratio; only these
    are shuffled, not shingles. The pairs that are left are checked exactly on their texts. The comparisons are quadratic in the
    texts of like size. Give it class representatives, not copies: a family of n different near texts has up to n x n links,
    which are the result.
    """
    return _similar(texts, staged(_sketched(texts, k).drop("digest"), "sketches"), threshold, k)


def _sketched(texts: DataFrame, k: int) -> DataFrame:
    """``id, digest, size, bits``: of each text the digest of what it is normalised to, and the size and the sketch of its shingles."""
    plain = spread(texts.select("id", "text")).select("id", T.normalise(F.col("text")).alias("t"))
    return arrow_map(plain, _sketches(k), f"id {dict(texts.dtypes)['id']}, digest binary, size int, bits binary")


def _similar(texts: DataFrame, sketches: DataFrame, threshold: float, k: int) -> DataFrame:
    """What :func:`similarity_join` gives, for those texts that have a row in ``sketches`` (a staged table)."""
    kind = dict(texts.dtypes)["id"]
    sketches = sketches.filter("size > 0")
    blocks = _blocks({r["size"]: r["count"] for r in sketches.groupBy("size").count().collect()}, threshold)
    placed = arrow_map(sketches, _placed(*blocks), f"block int, other boolean, id {kind}, size int, bits binary")
    placed = placed.repartition(max(1, len(blocks[-1])), "block").sortWithinPartitions("block", "other", "size")
    near = arrow_map(placed, _compared(threshold), f"x {kind}, y {kind}")
    candidates = cut(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b"))
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if candidates.count() <= MAX_ITEMS:  # so few ids go to the texts, not the texts to them
        wanted = F.broadcast(wanted)
    own = staged(texts.select("id", "text").join(wanted, "id", "left_semi"), "candidates")
    side = lambda c: own.select(F.col("id").alias(c), T.normalise(F.col("text")).alias(f"t_{c}"))
    both = candidates.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")
    return arrow_map(both, _scored(k), f"a {kind}, b {kind}, score double").filter(F.col("score") > threshold)


def _hashed_shingles(k: int):
    """Sorted 64-bit hashes of a text's distinct k-grams; a text of k characters or fewer is one gram."""
    powers = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(k)]

    def hashed(t: str) -> np.ndarray:
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        c = (c + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        c ^= c >> np.uint64(29)
        n = max(1, len(c) - k + 1)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(min(k, len(c))):
            h += c[j : j + n] * powers[j]
        h ^= h >> np.uint64(32)
        return np.unique(h * np.uint64(0xD6E8FEB86659FD93))

    return hashed


def _width(size: int) -> int:
    """Bits of the sketch of a set: a power of two, so that a wider sketch can be folded to a narrower one's width."""
    return max(LEAST_BITS, 1 << math.ceil(0.75 * size - 1).bit_length())


def _sketches(k: int):
    hashed = _hashed_shingles(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            digests, sizes, bits = [], [], []
            for t in b.column(1).to_pylist():
                h = hashed(t) if t else np.zeros(0, dtype=np.uint64)
                width = _width(len(h))
                odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                digests.append(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest())
                sizes.append(len(h))
                bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], ["id", "digest", "size", "bits"])

    return run


def _blocks(counts: dict[int, int], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Sizes in ascending order, the first block and the number of blocks of each, and for each block the first block that has it in reach.

    Blocks are ranges of sizes; a size of very many texts has several. They grow with the collection, so that a sketch
    goes to COPIES blocks on average at most.
    """
    sizes = sorted(counts)
    least = BLOCK
    while True:
        first, parts, bounds, full = [], [], [], least
        for s in sizes:
            n = max(1, counts[s] // least)
            if full >= least or n > 1:
                first.append(len(bounds))
                bounds += [[s, s, -(-counts[s] // n)] for _ in range(n)]
                full = least if n > 1 else counts[s]
            else:
                first.append(len(bounds) - 1)
                bounds[-1][1:] = s, full + counts[s]
                full += counts[s]
            parts.append(n)
        reach, p = [], 0
        for q, (low, _, _) in enumerate(bounds):
            while p < q and bounds[p][1] <= threshold * low * (1 - 1e-9):
                p += 1
            reach.append(p)
        if sum((q - reach[q] + 1) * n for q, (_, _, n) in enumerate(bounds)) <= COPIES * max(1, sum(counts.values())):
            return np.array(sizes, dtype=np.int64), np.array(first, dtype=np.int64), np.array(parts, dtype=np.uint64), reach
        least *= 2


def _placed(sizes: np.ndarray, first: np.ndarray, parts: np.ndarray, reach: list[int]):
    """Every sketch in its own block, and as another one in all earlier blocks that have it in reach."""
    reach = np.array(reach, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(sizes, b.column("size").to_numpy())
            part = np.array([int.from_bytes(x[:8], "little") for x in b.column("bits").to_pylist()], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            block = first[at] + ((part >> np.uint64(33)) % parts[at]).astype(np.int64)
            copies = block - reach[block] + 1
            row = np.repeat(np.arange(len(block)), copies)
            to = block[row] - (np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies))
            for i in range(0, len(row), 10_000):  # bounds the batches
                r = row[i : i + 10_000]
                own = b.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(to[i : i + 10_000], pa.int32()), pa.array(to[i : i + 10_000] != block[r]), own.column("id"), own.column("size"), own.column("bits")], ["block", "other", "id", "size", "bits"])

    return run


def _by_width(ids: pa.Array, sizes: np.ndarray, bits: list[bytes]) -> list[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Width, ids, sizes and words (a row for each word, a column for each sketch) of the sketches of each width, in order of size."""
    order = np.argsort(sizes, kind="stable")
    widths = np.array([8 * len(bits[i]) for i in order], dtype=np.int64)
    out = []
    for w in np.unique(widths).tolist():
        own = order[widths == w]
        words = np.frombuffer(b"".join(bits[i] for i in own), dtype="<u8").reshape(len(own), w // 64)
        out.append((w, ids.take(pa.array(own)), sizes[own], np.ascontiguousarray(words.T)))
    return out


def _folded(words: np.ndarray, n: int) -> np.ndarray:
    while len(words) > n:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _near(xs: list[tuple], ys: list[tuple], threshold: float) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids of the pairs of x and y (of each pair once, if they are the same list) whose sketches don't exclude them."""
    share = (1 - threshold) / (1 + threshold)
    for wx, ids_x, sizes_x, words_x in xs:
        for wy, ids_y, sizes_y, words_y in ys:
            if xs is ys and wx > wy:
                continue
            n = min(wx, wy) // 64
            low = np.searchsorted(sizes_y, threshold * sizes_x * (1 - 1e-9))
            high = np.searchsorted(sizes_y, sizes_x / threshold * (1 + 1e-9), "right") if threshold > 0 else np.full(len(sizes_x), len(sizes_y))
            x, y = _folded(words_x, n), _folded(words_y, n)
            kind = np.uint16 if n < 1024 else np.uint32
            for i in range(0, len(sizes_x), TILE):
                rows = slice(i, min(i + TILE, len(sizes_x)))
                triangle = xs is ys and wx == wy
                begin, end = max(int(low[i]), i + 1 if triangle else 0), int(high[rows.stop - 1])
                for j in range(begin, end, COLUMNS):
                    columns = slice(j, min(j + COLUMNS, end))
                    most = np.minimum((sizes_x[rows.stop - 1] + sizes_y[columns]) * share + 1e-6, 64 * n).astype(kind)  # of the tile's largest
                    some = min(n, 2 * int(most[-1] * ENOUGH / 56) + 2)  # of other texts' words some 28 bits differ
                    differing = _differing(x[:some, rows], y[:some, columns], kind)
                    r, c = np.nonzero(differing <= most)
                    if len(r):
                        d, r, c = differing[r, c], r + i, c + j
                        d = d + np.bitwise_count(x[some:, r] ^ y[some:, c]).sum(axis=0, dtype=np.int64)
                        left = (d <= (sizes_x[r] + sizes_y[c]) * share + 1e-6) & (c >= low[r]) & (c < high[r]) & ((c > r) if triangle else True)
                        if left.any():
                            yield ids_x.take(pa.array(r[left])), ids_y.take(pa.array(c[left]))


def _differing(x: np.ndarray, y: np.ndarray, kind: type) -> np.ndarray:
    """How many bits of each sketch of x (words, rows) and y (words, columns) differ."""
    shape = x.shape[1], y.shape[1]
    total, mixed, few, some = np.zeros(shape, kind), np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape, np.uint8)
    for k in range(0, len(x), 2):  # widths have an even number of words; 128 bits fit in a byte
        np.bitwise_count(np.bitwise_xor(x[k][:, None], y[k], out=mixed), out=few)
        np.bitwise_count(np.bitwise_xor(x[k + 1][:, None], y[k + 1], out=mixed), out=some)
        total += np.add(few, some, out=few)
    return total


def _compared(threshold: float):
    """The pairs of each block, and of a block with the others in its reach; its own sketches come first, only these are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, own = None, [], None

        def closed() -> Iterator[tuple[pa.Array, pa.Array]]:
            nonlocal own
            if parts:
                own = _by_width(pa.concat_arrays([p.column("id") for p in parts]), np.concatenate([p.column("size").to_numpy() for p in parts]), [x for p in parts for x in p.column("bits").to_pylist()])
                parts.clear()
                yield from _near(own, own, threshold)

        def found() -> Iterator[tuple[pa.Array, pa.Array]]:
            nonlocal block, own
            for b in batches:
                key = b.column("block").to_numpy() * np.int64(2) + b.column("other").to_numpy(zero_copy_only=False)
                at = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
                for i, j in zip(at, at[1:]):
                    if i == j:
                        continue
                    if key[i] >> 1 != block:
                        yield from closed()
                        block, own = key[i] >> 1, None
                    part = b.slice(i, j - i)
                    if key[i] & 1:
                        yield from closed()
                        yield from _near(own or [], _by_width(part.column("id"), part.column("size").to_numpy(), part.column("bits").to_pylist()), threshold)
                    else:
                        parts.append(part)
            yield from closed()

        for x, y in found():
            yield pa.RecordBatch.from_arrays([x, y], ["x", "y"])

    return run


def _scored(k: int):
    """Exact similarity of pairs of normalised texts (a, b, t_a, t_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = lru_cache(256)(_hashed_shingles(k))  # texts come again in the pairs of a family
        for b in batches:
            scores = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = hashed(x), hashed(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                scores.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["a", "b", "score"])

    return run


def near_duplicates(texts: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """``id, class_id, links``: one row per record with text: the class of its exact copies, and how many other classes are near."""
    sketches = staged(_sketched(texts, k), "sketches")
    own = cut(_classes(sketches.select("id", "digest")))
    reps = staged(sketches.select("id", "size", "bits").join(own.filter("id = class_id").select("id"), "id", "left_semi"), "representatives")
    pairs = _similar(texts, reps, threshold, k)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return own.join(degree, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def keep_first(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, kept``: in order of id, a record is kept unless it is near an earlier kept one.

    Rounds: a record is decided once all its earlier neighbours are; it is dropped when one of them is kept. The number
    of rounds is the longest chain of conflicts; each round is checkpointed.
    """
    edges = cut(edges.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).distinct())
    state = cut(nodes.select("id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        seen = edges.join(state.withColumnRenamed("id", "early"), "early").groupBy(F.col("late").alias("id")).agg(F.max("kept").alias("any_kept"), F.sum(F.col("kept").isNull().cast("int")).alias("open"))
        new = cut(state.join(seen, "id", "left").select("id", F.coalesce("kept", F.when(F.col("any_kept"), False).when(F.coalesce("open", F.lit(0)) == 0, True)).alias("kept")))
        if new.filter("kept is null").isEmpty():
            return new
        state = new


def overlap_layer(records: DataFrame, held_out: DataFrame, seeds: DataFrame, limit: float = 0.8, k: int = 5) -> DataFrame:
    """``id, source, item_id, score, code``: best seed and held-out match of each record (id, text); a score over the limit, not equal to it, is an issue."""
    parts = [best_match(records, items, k).withColumn("source", F.lit(name)) for name, items in (("held_out", held_out), ("seed", seeds))]
    both = parts[0].unionByName(parts[1])
    return both.select("id", "source", "item_id", "score", F.when(F.col("score") > limit, F.concat("source", F.lit("_overlap"))).alias("code"))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, top: int = 1) -> DataFrame:
    """``query_id, vec_id, cosine, rank``: nearest vectors (vec_id, embedding) of each query (vec_id, embedding) but itself.

    The queries are a stated set that goes to executors in passes of MAX_ITEMS; each batch keeps its ``top`` best per query,
    and only those are shuffled. Vectors without length match nothing; ties go to the smaller id.
    """
    schema = "query_id bigint, vec_id bigint, cosine double"
    found = None
    for rows in _passes(queries.filter("embedding is not null"), ["vec_id", "embedding"], "vec_id"):
        one = arrow_map(vectors.select("vec_id", "embedding"), _nearest(rows, top), schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _nearest(rows: list, top: int):
    q = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in rows]
    q = [(i, v / n) for i, v in q if (n := float(np.linalg.norm(v))) > 0]
    ids = np.array([i for i, _ in q], dtype=np.int64)
    mat = np.array([v for _, v in q]).reshape(len(q), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v]
            out: list[tuple[np.ndarray, ...]] = []
            if rows and len(ids):
                x = np.array([v for _, v in rows], dtype=np.float64)
                n = np.linalg.norm(x, axis=1)
                x, own = x[n > 0] / n[n > 0][:, None], np.array([i for i, _ in rows], dtype=np.int64)[n > 0]
                for a in range(0, len(ids), 1024):  # bounds the product's memory
                    c = mat[a : a + 1024] @ x.T
                    for j, row in enumerate(c):
                        row[own == ids[a + j]] = -np.inf
                        k = min(top, len(row))
                        least = np.partition(row, len(row) - k)[len(row) - k] if k else np.inf
                        near = np.flatnonzero((row >= least) & np.isfinite(row))  # with ties at the last place
                        near = near[np.lexsort((own[near], -row[near]))[:top]]
                        out.append((np.full(len(near), ids[a + j]), own[near], row[near]))
            cols = [np.concatenate(x) for x in zip(*out)] if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "cosine"])

    return run
