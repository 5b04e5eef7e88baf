"""Evaluation texts in training text: latent semantic retrieval of passages, then word subsequences and answers.

Passages are windows of WINDOW words at steps of half a window. Word weights come from counts over all texts; a
randomised subspace iteration over passages, run in blocks on the executors, gives the latent space. The items are a
stated query set that all texts are held against: an exact prefix bound on shared words says which items a stretch of
text may contain at all, passages of these texts are projected and compared with those of the items, and pairs over a
cosine are checked by longest common subsequences, and by the item's answer where the words alone fall a little short.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.sampling import by_hash
from granary.llm.words import hashes, slices
from granary.session import arrow_map, spread, staged

WINDOW, STEP = 64, 32
#: Hashed vocabulary, latent dimensions, extra columns of the range finder, rounds of subspace iteration.
BUCKETS, DIMS, EXTRA, ROUNDS = 1 << 16, 112, 16, 2
#: Texts on whose passages the latent space is fitted, by hash order; all items' passages are added.
SAMPLE_TEXTS = 6_000
#: Low enough that half of an item, in a passage with other words, is over it; an exact bound on shared words keeps the checks few.
COSINE = 0.15
#: Share of an item's words that must stand in a text in order, within STRETCH times the item's length.
SHARE, STRETCH = 0.5, 1.35
#: Share from which a text that also has the item's answer is a leak: a paraphrase keeps fewer of the words.
WITH_ANSWER = 0.45
#: Part of the words an item needs in common that must be among its rarest: the prefix bound.
PREFIX = 0.5
#: Words of a block; stretches that may contain an item are told by block.
BLOCK = 16
#: Items that are counted together, for memory.
TOGETHER = 1_000
#: Items that are held against the texts in one pass; a larger set takes several passes.
MAX_ITEMS = 20_000
#: Most entries of a dense table of word places by item; beyond it the same table is searched by key.
DENSE_TABLE = 1 << 23

def buckets(found: np.ndarray) -> np.ndarray:
    """Bucket of each hashed word, from the hash's highest bits."""
    return found >> 47


def blocks(ids: np.ndarray, lengths: list[int], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of table rows over windows of each text; the text and first word of each window.

    Windows start at multiples of STEP; the last one of a text may be shorter, as is that of a short text."""
    per = np.array([max(1, -(-n // STEP)) for n in lengths])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(lengths)), per)
    order = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    starts = first[owner] + order * STEP
    sums = np.add.reduceat(table[ids], np.minimum(starts, len(ids) - 1), axis=0)
    joined = sums.copy()
    same = owner[1:] == owner[:-1]
    joined[:-1][same] += sums[1:][same]
    keep = (order == 0) | (order < per[owner] - 1)  # the last block by itself is part of the window before
    return joined[keep], owner[keep], order[keep] * STEP


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, passages = np.zeros(BUCKETS, dtype=np.int64), 0
    for b in batches:
        for _, found, lengths in slices(b.column(0).to_pylist()):
            per = -(-lengths // WINDOW)
            tile = np.repeat(np.cumsum(per) - per, lengths) + (np.arange(len(found)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // WINDOW
            counts += np.bincount(np.unique(tile * BUCKETS + buckets(found)) % BUCKETS, minlength=BUCKETS)
            passages += int(per.sum())
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(counts[some], passages))], ["bucket", "n"])


@dataclass
class Sparse:
    """A table by bucket of which only the rows that are not zero are sent."""

    buckets: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, table: np.ndarray) -> Sparse:
        some = np.flatnonzero(table if table.ndim == 1 else np.abs(table).sum(axis=1))
        return cls(some.astype(np.int32), table[some].astype(np.float32))

    def table(self) -> np.ndarray:
        out = np.zeros((BUCKETS, *self.rows.shape[1:]), dtype=np.float32)
        out[self.buckets] = self.rows
        return out


def _start() -> np.ndarray:
    """The random start of the range finder: made anew where it is needed, never sent."""
    return np.random.default_rng(1).normal(size=(BUCKETS, DIMS + EXTRA)).astype(np.float32)


def _gram(sent_weights: Sparse, sent: Sparse | None):
    """Partial sums of A'(A basis) over the passages of a task's texts, as rows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        weights, basis = sent_weights.table(), _start() if sent is None else sent.table()
        table = (basis * weights[:, None]).astype(np.float32)
        for b in batches:
            for _, found, lengths in slices(b.column(0).to_pylist()):
                ids = buckets(found)
                if total is None:
                    total = np.zeros((BUCKETS, basis.shape[1]), dtype=np.float32)
                y, owner, at = blocks(ids, lengths, table)
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                norm = np.empty(len(y), dtype=np.float32)
                spans = []
                for k, (o, a) in enumerate(zip(owner, at)):
                    s = first[o] + a
                    e = min(first[o] + lengths[o], s + WINDOW)
                    spans.append((s, e))
                    u, c = np.unique(ids[s:e], return_counts=True)
                    norm[k] = float(((c * weights[u]) ** 2).sum()) or 1.0
                y = y / norm[:, None]  # unit length of both factors
                for (s, e), row in zip(spans, y):
                    np.add.at(total, ids[s:e], weights[ids[s:e], None] * row)
        if total is not None:
            some = np.flatnonzero(np.abs(total).sum(axis=1))
            for i in range(0, len(some), 4096):
                part = some[i : i + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([r.tobytes() for r in total[part]], pa.binary())], ["bucket", "v"])

    return run


def _sum_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(v, dtype=np.float32)
            total[k] = total[k] + x if k in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["bucket", "v"])


@dataclass
class Space:
    sent: Sparse  #: weighted latent vector of every bucket
    weights: Sparse  #: weight of every bucket: the rarer its words, the larger


def fit_space(texts: DataFrame, items: list[str]) -> Space:
    """Word weights from all of ``texts`` (text); the latent space from SAMPLE_TEXTS of them and all items.

    Driver and executors hold BUCKETS x (DIMS + EXTRA) numbers, whatever the size of the data."""
    spark = texts.sparkSession
    counts = np.zeros(BUCKETS)
    passages = 0
    for r in arrow_map(spread(texts.select("text")), _frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            passages = r["n"]
        else:
            counts[r["bucket"]] = r["n"]
    weights = np.log((passages + 1) / (counts + 1)).clip(0)
    sample = by_hash(texts.select("text"), SAMPLE_TEXTS, "text", seed="space").unionByName(spark.createDataFrame([(t,) for t in items], "text string"))
    sample = staged(sample.repartition(max(2, min(8, spark.sparkContext.defaultParallelism))), "sample")
    basis = None
    for _ in range(ROUNDS):
        parts = arrow_map(sample, _gram(Sparse.of(weights), None if basis is None else Sparse.of(basis)), "bucket int, v binary").repartition(2, "bucket").sortWithinPartitions("bucket")
        product = np.zeros((BUCKETS, DIMS + EXTRA), dtype=np.float32)
        for r in parts.mapInArrow(_sum_vectors, "bucket int, v binary").collect():
            product[r["bucket"]] = np.frombuffer(r["v"], dtype=np.float32)
        some = np.flatnonzero(np.abs(product).sum(axis=1))
        q, r = np.linalg.qr(product[some].astype(np.float64))
        basis = np.zeros_like(product)  # a small vocabulary fills fewer columns
        basis[some, : q.shape[1]] = q @ np.linalg.svd(r, full_matrices=False)[0]  # columns by falling singular value
    return Space(Sparse.of(basis[:, :DIMS] * weights[:, None]), Sparse.of(weights))


# ---------------------------------------------------------------------------- checks


def lcs_lengths(masks: Masks, item: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each item with the words of its row of ``region`` (places in the vocabulary, -1 for
    words no item has), by bit-parallel rows over all pairs at a time."""
    wide = masks.wide
    v = np.full((wide, len(item)), ~np.uint64(0), dtype=np.uint64)
    for step in range(region.shape[1]):
        m = masks.of(item, region[:, step])
        carry = np.zeros(len(item), dtype=np.uint64)
        for w in range(wide):
            u = v[w] & m[:, w]
            total = v[w] + u
            over = total < u
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            v[w] = total | (v[w] ^ u)
    return (wide * 64 - np.bitwise_count(v).sum(axis=0)).astype(np.int64)


class Masks:
    """By item and word, the places of the word in the item as bits. Bits past an item's end are never unset."""

    def __init__(self, items: list[np.ndarray], n_words: int):
        self.n = n_words + 1
        self.wide = max(1, -(-max(map(len, items)) // 64))
        key = np.concatenate([k * self.n + g for k, g in enumerate(items)])
        place = np.concatenate([np.arange(len(g)) for g in items])
        self.keys, slot = np.unique(key, return_inverse=True)
        self.bits = np.zeros((len(self.keys) + 1, self.wide), dtype=np.uint64)
        np.bitwise_or.at(self.bits, (slot, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        self.dense = None
        if len(items) * self.n <= DENSE_TABLE:
            self.dense = np.full(len(items) * self.n, len(self.keys), dtype=np.int32)
            self.dense[self.keys] = np.arange(len(self.keys))

    def of(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = item * self.n + np.where(word < 0, self.n - 1, word)
        if self.dense is not None:
            return self.bits[self.dense[key]]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return self.bits[np.where(self.keys[at] == key, at, len(self.keys))]


def subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        if u := v & places.get(w, 0):
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def stretch_of(n: int) -> int:
    """Words of a stretch that is not much longer than an item of n words."""
    return int(n * STRETCH) + 6


def best_share(item: list[int], text: list[int], least: float = SHARE) -> float:
    """The largest share of the item's words that stand in order in a stretch of ``text`` not much longer than the item; 0
    where it is under ``least``."""
    size, need = stretch_of(len(item)), least * len(item)
    step = max(1, len(item) // 6)
    bag = set(item)
    hits = np.concatenate([[0], np.cumsum([w in bag for w in text])]).tolist()
    best = 0
    for s in range(0, max(1, len(text) - size + step), step):
        e = min(len(text), s + size)
        if hits[e] - hits[s] > best and hits[e] - hits[s] >= need:  # an upper bound of the subsequence
            best = max(best, subsequence(item, text[s:e]))
    return best / len(item) if best >= need else 0.0


class Items:
    """The items as places in their common vocabulary; which of them a stretch of text may contain.

    Prefix bound: in order of rarity, a text that shares ``need`` of an item's n words shares at least j of its first
    n - need + j ones, for any j; j is PREFIX of ``need``. Repeats of a word in a text count each, so no leak is lost."""

    def __init__(self, texts: list[str], weights: np.ndarray, least: list[float]):
        self.hashes = [hashes([t])[0] for t in texts]
        self.vocabulary = np.unique(np.concatenate(self.hashes))
        self.items = [np.searchsorted(self.vocabulary, h) for h in self.hashes]
        self.masks = Masks(self.items, len(self.vocabulary))
        self.known = np.zeros(BUCKETS, dtype=bool)
        self.known[buckets(self.vocabulary)] = True
        rare = weights[buckets(self.vocabulary)]
        own: list[list[int]] = [[] for _ in self.vocabulary]
        self.least, self.need, self.span = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
        distinct = [np.unique(g, return_counts=True) for g in self.items]
        most = max(len(u) for u, _ in distinct)
        self.words, self.times = np.full((len(texts), most), len(self.vocabulary)), np.zeros((len(texts), most), dtype=np.int16)
        for k, g in enumerate(self.items):
            self.least[k] = need = math.ceil(least[k] * len(g) - 1e-9)
            self.need[k] = j = max(1, math.ceil(PREFIX * need))
            for w in np.unique(g[np.lexsort((g, -rare[g]))][: len(g) - need + j]).tolist():
                own[w].append(k)
            self.span[k] = -(-(stretch_of(len(g)) - 1) // BLOCK) + 2  # blocks that a stretch from one of two neighbouring blocks on touches
            u, n = distinct[k]
            self.words[k, : len(u)], self.times[k, : len(u)] = u, np.minimum(n, 32_767)
        self.often = np.array([len(o) for o in own])
        self.first = np.cumsum(self.often) - self.often
        self.postings = np.concatenate([np.array(o, dtype=np.int64) for o in own])

    def places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that some item has, and their places in the vocabulary."""
        at = np.flatnonzero(self.known[buckets(found)])
        g = np.searchsorted(self.vocabulary, found[at])
        g[g == len(self.vocabulary)] = 0
        same = self.vocabulary[g] == found[at]
        return at[same], g[same]

    def possible(self, at: np.ndarray, g: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first block and item of stretches over the prefix bound; every other block is a start."""
        first = np.cumsum(lengths) - lengths
        per = -(-lengths // BLOCK)
        begin = np.cumsum(per) - per
        owner = np.repeat(np.arange(len(lengths)), lengths)[at]
        often = self.often[g]
        which = self.postings[np.repeat(self.first[g] - (np.cumsum(often) - often), often) + np.arange(int(often.sum()))]
        block = np.repeat(begin[owner] + (at - first[owner]) // BLOCK, often)
        text = np.repeat(np.arange(len(per)), per)
        start = np.arange(int(per.sum()))
        even = (start - begin[text]) % 2 == 0
        text, start = text[even], start[even]
        out = []
        for low in range(0, len(self.items), TOGETHER):  # bounds the table below
            n = min(TOGETHER, len(self.items) - low)
            inside = slice(None) if n == len(self.items) else (which >= low) & (which < low + n)
            table = np.bincount(block[inside] * n + which[inside] - low, minlength=int(per.sum()) * n).astype(np.int32).reshape(-1, n)
            upto = np.concatenate([np.zeros((1, n), dtype=np.int32), np.cumsum(table, axis=0, dtype=np.int32)])
            span, need = self.span[low : low + n], self.need[low : low + n]
            for r in np.unique(span).tolist():
                own = np.flatnonzero(span == r)
                end = np.minimum(start + r, begin[text] + per[text])
                s, k = np.nonzero(upto[end][:, own] - upto[start][:, own] >= need[own])
                out.append((text[s], start[s] - begin[text[s]], own[k] + low))
        return tuple(np.concatenate(x) for x in zip(*out))

    def shared(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, g: np.ndarray) -> np.ndarray:
        """How many words, repeats counted as often as both have them, each item shares with positions lo to hi."""
        out = np.zeros(len(item), dtype=np.int64)
        order = np.lexsort((hi, lo))
        same = np.concatenate([[True], (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)])
        window = np.cumsum(same) - 1  # of each pair in order
        a, e = np.searchsorted(at, lo[order][same]), np.searchsorted(at, hi[order][same])
        wide = len(self.vocabulary) + 1
        step = max(1, (1 << 21) // wide)
        for w in range(0, len(a), step):
            n = e[w : w + step] - a[w : w + step]
            idx = np.repeat(a[w : w + step] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            table = np.bincount(np.repeat(np.arange(len(n)), n) * wide + g[idx], minlength=len(n) * wide).reshape(-1, wide)
            table = np.minimum(table, 32_767).astype(np.int16)
            x, y = np.searchsorted(window, [w, w + step])
            for p in range(x, y, 16_384):
                pair = order[p : min(y, p + 16_384)]
                rows = window[p : min(y, p + 16_384)] - w
                out[pair] = np.minimum(table[rows[:, None], self.words[item[pair]]], self.times[item[pair]]).sum(axis=1)
        return out


def answer_words(text: str, answer: str | None) -> list[int]:
    """Hashed words of the option that the answer's letter names, else of the answer itself; none where there are fewer than
    two, as a letter or a number stands in many a text."""
    told = (answer or "").strip()
    if len(told) == 1:
        m = re.search(rf"(?m)^\s*\(?{re.escape(told)}[).:]\s*(.+)$", text)
        told = m.group(1) if m else ""
    found = hashes([told])[0].tolist()
    return found if len(found) > 1 else []


def _contains(text: list[int], part: list[int]) -> bool:
    """Whether ``part`` stands in ``text``, word after word."""
    n = len(part)
    return n > 0 and any(text[i : i + n] == part for i, w in enumerate(text[: len(text) - n + 1]) if w == part[0])


def _search(space: Space, items: list[tuple[int, str, str | None]], with_answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights = space.sent.table(), space.weights.table()
        answers = [answer_words(t, x) for _, t, x in items]
        least = [min(SHARE, with_answer) if a else SHARE for a in answers]
        own = Items([t for _, t, _ in items], weights, least)
        listed = [h.tolist() for h in own.hashes]
        q, of, _ = blocks(buckets(np.concatenate(own.hashes)), [len(h) for h in own.hashes], table)
        q /= np.linalg.norm(q, axis=1, keepdims=True) + 1e-9
        item_first = np.searchsorted(of, np.arange(len(items)))
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("tbl", "rec_id", "item_id", "cosine", "share", "answer_found")}
            tbl, rec = b.column(0).to_pylist(), b.column(1).to_pylist()
            for rows, found, lengths in slices(b.column(2).to_pylist()):
                at, g = own.places(found)
                text, start, item = own.possible(at, g, lengths)
                if not len(text):
                    continue
                first = np.cumsum(lengths) - lengths
                # passages of the texts that may contain an item, and their cosines with the items they may contain
                some = np.unique(text)
                x, of_text, _ = blocks(buckets(found[np.repeat(np.isin(np.arange(len(lengths)), some), lengths)]), lengths[some].tolist(), table)
                x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
                near = np.maximum.reduceat(x @ q.T, item_first, axis=1)
                begin, count = np.searchsorted(of_text, np.arange(len(some))), np.bincount(of_text, minlength=len(some))
                t = np.searchsorted(some, text)
                from_, to = start * BLOCK // STEP - 1, ((start + own.span[item]) * BLOCK - 1) // STEP  # passages that overlap the stretch
                cosine = np.full(len(t), -1.0, dtype=np.float32)
                for j in range(int((to - from_).max()) + 1):
                    p = np.clip(np.minimum(from_ + j, to), 0, count[t] - 1)
                    cosine = np.maximum(cosine, near[begin[t] + p, item])
                pick = np.flatnonzero(cosine >= COSINE)
                text, start, item, cosine = text[pick], start[pick], item[pick], cosine[pick]
                lo = first[text] + start * BLOCK
                hi = np.minimum(lo + own.span[item] * BLOCK, first[text] + lengths[text])
                pick = np.flatnonzero(own.shared(item, lo, hi, at, g) >= own.least[item])
                a, e = np.searchsorted(at, lo), np.searchsorted(at, hi)
                pick = pick[np.argsort((e - a)[pick], kind="stable")]
                done: dict[tuple[int, int], tuple[float, float]] = {}
                for i in range(0, len(pick), 8192):
                    part = pick[i : i + 8192]
                    idx = a[part][:, None] + np.arange(int((e - a)[part].max()))
                    region = np.where(idx < e[part][:, None], g[np.minimum(idx, len(g) - 1)], -1)
                    common = lcs_lengths(own.masks, item[part], region)
                    for p in part[common >= own.least[item[part]]].tolist():  # all of the region has enough: now its stretches
                        k, key = int(item[p]), (int(text[p]), int(item[p]))
                        share = best_share(listed[k], found[lo[p] : hi[p]].tolist(), least[k])
                        if share >= least[k] and share > done.get(key, (0.0,))[0]:
                            done[key] = (share, float(cosine[p]))
                for (t1, k), (share, c) in done.items():
                    r = int(rows[t1])
                    told = _contains(found[first[t1] : first[t1] + lengths[t1]].tolist(), answers[k])
                    if share >= SHARE or told:
                        for col, v in zip(out, (tbl[r], rec[r], items[k][0], c, share, told)):
                            out[col].append(v)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return run


def find_leaks(texts: DataFrame, held_out: DataFrame, with_answer: float = WITH_ANSWER) -> DataFrame:
    """``tbl, rec_id, item_id, cosine, share, answer_found``: items whose words stand in texts, one row per text and item.

    ``texts``: tbl, rec_id, text (several rows per record are several texts). ``held_out``: item_id, text, answer. Every
    text is held against every item, in passes of MAX_ITEMS items at most, each of which goes to the executors with the
    latent table. ``share`` is the part of the item's words found in order; ``answer_found`` tells whether its answer's
    words follow each other in the text. Leaks have SHARE of the words, or ``with_answer`` of them and the answer. Items
    listed twice count each. Null and blank texts and items have no match.
    """
    schema = "tbl string, rec_id bigint, item_id bigint, cosine double, share double, answer_found boolean"
    spark = texts.sparkSession
    rows = held_out.select("item_id", "text", "answer").filter("text is not null")
    passes = -(-rows.count() // MAX_ITEMS)
    found = None
    some = texts.filter("text is not null").select("tbl", "rec_id", "text")
    for n in range(passes):
        part = rows if passes == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(2 * passes)).isin(2 * n, 2 * n + 1))
        known = [(r["item_id"], r["text"], r["answer"]) for r in part.collect()]
        known = [k for k in known if len(hashes([k[1]])[0])]
        if not known:
            continue
        space = fit_space(some, [t for _, t, _ in known])
        hits = arrow_map(spread(some), _search(space, known, with_answer), schema)
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], schema) if found is None else found
