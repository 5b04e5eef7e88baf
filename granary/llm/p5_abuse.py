"""Abusive, hateful or sexual content: a convolutional text classifier trained in numpy on hashed word embeddings."""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.abuse_phrases import ABUSIVE, HARMLESS
from granary.llm.languages import quick_language
from granary.llm.thresholds import hash63
from granary.session import arrow_map, cut, ship, spread, staged

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 20, 16, 12, (1, 2, 3)
#: Most labelled rows, which people write: more raise. Texts per table, by hash, whose sentences serve as mostly harmless examples for a start.
MAX_LABELS, BACKGROUND_TEXTS = 1_000_000, 2_000
#: Of these sentences, how many a member learns from: at random, at least of each language, and those it is least sure of.
BASE_UNITS, PER_LANGUAGE, HARD_UNITS = 18_000, 700, 6_000
#: Background sentences over this score are neither: they are left out of training, and so are those over SURE by members that
#: know all examples. Those under NEAR have taught their lesson.
SUSPECT, SURE, NEAR = 0.7, 0.8, 0.05
#: Share of a language's background sentences (four at least) a word must occur in to be learnt from them, and share of rarer ones learnt all the same.
COMMON, SHOWN, RARE = 0.001, 0.05, ""
#: Thresholds that are tried; the strict one; by which part more background may be over a threshold than over that.
GRID, STRICT, GROWTH = np.arange(0.6, 0.9, 0.01).tolist(), 0.9, 0.06
EDGES = np.array([*GRID, STRICT])
MEMBERS = 3
#: Epochs in which members learn all examples; sentences of all texts that a task trains a member on.
REFIT, GROUP = 3, 24_000
#: Tokens of a training stretch; longer sentences become several.
PIECE = 56
BATCH, RATE, SEED = 128, 0.007, 7

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
#: Letters of other scripts that look like Latin ones.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһԛԝɡνοικαρτευη", "aeopcyxijsdhqwgvoikaptevn")
LEET = str.maketrans("0134578@$!|", "oieastbasil")
_UNIT = re.compile(r"(?<=[!?。！？।؟…])\s*|(?<=[.])\s+|\n\s*\n")
_STRETCHED = re.compile(r"([a-z])\1{2,}")
_DENSE = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
_L = r"[^\W_]"
_M = r"\u0610-\u061a\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"  # marks that belong to words
_TOKEN = re.compile(rf"(?:(?<!{_L})[@$](?=[a-z]))?{_L}[\w{_M}]*(?:['’*@$!]{_L}[\w{_M}]*|\*+[\w{_M}]*)*")
_SPACED = re.compile(r"(?<![\w*])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_MASKED = re.compile(r"(?=.{3})[^\W\d_]+\*+[^\W\d_]*")
_DIGIT_IN = re.compile(r"(?=.*\d)(?=.*[a-z])[a-z0-9@$!|]+\Z")
_MIXED = re.compile("[Ͱ-ϿЀ-ԯ]")


def clean(text: str) -> str:
    """Compatibility forms folded, invisible characters removed, letters that only look Latin replaced in words with Latin ones."""
    if text.isascii():
        low = text.lower()
    else:
        low = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()
        if _MIXED.search(low) and re.search("[a-z]", low):
            low = " ".join(w.translate(LOOKALIKE) if re.search("[a-z]", w) or len(w) > 2 and w.translate(LOOKALIKE).isascii() else w for w in low.split(" "))
    if _SPACED.search(low):
        low = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), low)
    return low


def normal(t: str) -> str:
    """The form under which a raw token is known: plural s dropped, stretched letters shortened, digits in words read as
    letters; numbers are one token, masked words another."""
    if "*" in t:
        return "*masked*" if _MASKED.match(t) else t.replace("*", "")
    if t.isdigit():
        return "#"
    if t.isascii():
        if _STRETCHED.search(t):
            t = _STRETCHED.sub(r"\1", t)
        if not t.isalpha() and _DIGIT_IN.match(t):
            w = t.translate(LEET)
            if not w.isalpha() or t[0].isdigit() and not re.match(r"[0-9]+[a-z]+[0-9]", t):
                return "#"
            t = w
    return t[:-1] if len(t) > 3 and t[-1] == "s" else t


def raw_tokens(text: str) -> list[str]:
    """Words of cleaned text, and pairs of letters in scripts without spaces."""
    found = _TOKEN.findall(text)
    if not text.isascii() and _DENSE.search(text):
        return [c for t in found for c in ([t[i : i + 2] for i in range(max(1, len(t) - 1))] if _DENSE.search(t) else (t,))]
    return found


def tokens(text: str) -> list[str]:
    return [normal(t) for t in raw_tokens(text)]


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


def units(text: str) -> list[str]:
    """Stretches that are scored by themselves: sentences, cut after closing marks and line breaks."""
    return [u for u in _UNIT.split(text) if u and not u.isspace()]


@dataclass
class Network:
    """Word vectors by bucket, one matrix per filter width, and a logistic output; ``thresholds`` by language."""

    vectors: dict[int, np.ndarray]
    filters: list[np.ndarray]  # (width x DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float]

    def threshold(self, lang: str) -> float:
        return self.thresholds.get(lang, self.thresholds["*"])


@dataclass
class Committee:
    """Networks that start and sample differently; a score is the mean of theirs."""

    members: list[Network]
    thresholds: dict[str, float]
    #: by language, how many held-out examples are found, and which share of the background is over the threshold
    held_out: dict[str, dict[str, float]] = field(default_factory=dict)

    def threshold(self, lang: str) -> float:
        return self.thresholds.get(lang, self.thresholds["*"])


class Buckets(dict):
    """Buckets of raw tokens, kept by token."""

    def __missing__(self, token: str) -> int:
        place = bucket(normal(token))
        if len(self) < 2_000_000:
            self[token] = place
        return place


class Scorer:
    """Applies one network or several: every known word's products with all filter columns are computed once. Filters whose
    output weight is zero are left out."""

    def __init__(self, net: Network | Committee):
        self.nets = net.members if isinstance(net, Committee) else [net]
        self.blocks: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # width, filters of all networks, their biases, output weights by network
        columns = []
        for i, w in enumerate(WIDTHS):
            own = [(k, f) for k, n in enumerate(self.nets) for f in np.flatnonzero(n.out[i * FILTERS : (i + 1) * FILTERS])]
            outs = np.zeros((len(own), len(self.nets)), dtype=np.float32)
            for j, (k, f) in enumerate(own):
                outs[j, k] = self.nets[k].out[i * FILTERS + f]
            for j in range(w):
                for k, f in own:
                    columns.append(np.zeros(len(self.nets) * DIM, dtype=np.float32))
                    columns[-1][k * DIM : (k + 1) * DIM] = self.nets[k].filters[i][j * DIM : (j + 1) * DIM, f]
            if own:
                self.blocks.append((w, len(own), np.array([self.nets[k].biases[i][f] for k, f in own], dtype=np.float32), outs))
        self.bias = np.array([n.bias for n in self.nets], dtype=np.float32)
        known = sorted({place for n in self.nets for place in n.vectors})
        self.row = np.zeros(BUCKETS + 1, dtype=np.int32)  # row 0: unknown words, and padding, whose bucket is BUCKETS
        self.row[known] = np.arange(1, len(known) + 1)
        vectors = np.zeros((len(known) + 1, len(self.nets) * DIM), dtype=np.float32)
        for k, n in enumerate(self.nets):
            for place, v in n.vectors.items():
                vectors[self.row[place], k * DIM : (k + 1) * DIM] = v
        self.table = vectors @ np.array(columns, dtype=np.float32).reshape(len(columns), len(self.nets) * DIM).T
        self.buckets = Buckets()

    def each(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Scores between 0 and 1 of segments, given by the buckets of all their words and their numbers of words: a row per
        segment, a column per network."""
        out = np.empty((len(lens), len(self.nets)), dtype=np.float32)
        pad = max(WIDTHS)
        at = np.concatenate([[0], np.cumsum(lens + pad)])
        idx = np.full(at[-1], BUCKETS)
        idx[np.arange(len(ids)) + np.repeat(np.arange(len(lens)) * pad, lens)] = ids
        idx = self.row[idx]
        k = 0
        while k < len(lens):  # bounded slices keep memory flat and in the cache
            e = int(np.searchsorted(at, at[k] + 2_000, "right")) - 1
            e = max(e, k + 1)
            part = self.table[idx[at[k] : at[e]]]
            # a segment's windows begin at its words or at the first word of its padding; later ones reach into the next segment
            ends = np.stack([at[k:e], at[k + 1 : e + 1] - pad + 1], axis=1).ravel() - at[k]
            total = np.tile(self.bias, (e - k, 1))
            off = 0
            for w, n, b, outs in self.blocks:
                c = part[:, off : off + n].copy()
                for j in range(1, w):
                    c[:-j] += part[j:, off + j * n : off + (j + 1) * n]
                off += w * n
                total += np.maximum(np.maximum.reduceat(c, ends, axis=0)[::2] + b, 0) @ outs
            out[k:e] = 1 / (1 + np.exp(-total))
            k = e
        return out

    def score(self, segments: list[str]) -> np.ndarray:
        """Scores of cleaned segments between 0 and 1: the mean of the networks' scores."""
        return self.each(*read_words(segments, self.buckets)).mean(axis=1)


def read_words(segments: list[str], buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of all cleaned segments, and the number of words of each."""
    ids: list[int] = []
    lens: list[int] = []
    for s in segments:
        found = raw_tokens(s)
        lens.append(len(found))
        ids.extend(map(buckets.__getitem__, found))
    return np.array(ids, dtype=np.int64), np.array(lens, dtype=np.int64)


def pieces(found: list[str]) -> list[list[str]]:
    """Tokens in stretches of PIECE for training, which overlap by the widest filter: no token is left out."""
    step = PIECE - max(WIDTHS) + 1
    return [found[i : i + PIECE] for i in range(0, max(1, len(found) - max(WIDTHS) + 1), step)]


def train(texts: list[list[str]], labels: list[float], weights: list[float], epochs: int, start: Network | None = None, seed: int = SEED) -> Network:
    """Adam on weighted cross-entropy; word vectors, filters and output are learnt together, from those of ``start`` if given.

    ``texts`` are lists of at most PIECE tokens or buckets. Of the word vectors only those of a batch's words are moved.

    Output weights never fall under zero: a filter tells abuse or nothing, and no harmless word beside a remark takes
    away from it, however often it stood in harmless sentences."""
    rng = np.random.default_rng(seed)
    toks = [[-1 if t == RARE else bucket(t) if isinstance(t, str) else t for t in x] for x in texts]
    seen = sorted({t for x in toks for t in x} - {-1})
    place = {t: i + 1 for i, t in enumerate(seen)} | {-1: 0}
    ids = np.zeros((len(toks), PIECE + max(WIDTHS) + 1), dtype=np.int64)
    for i, x in enumerate(toks):
        ids[i, : len(x)] = [place[t] for t in x]
    sizes = np.array([len(x) for x in toks])
    y, wt = np.array(labels, dtype=np.float32), np.array(weights, dtype=np.float32)
    params = {"E": rng.normal(0, 0.1, (len(seen) + 1, DIM)), "o": np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))), "c": np.full(1, -2.0)}
    for w in WIDTHS:
        params[f"W{w}"] = rng.normal(0, np.sqrt(2 / (w * DIM)), (w * DIM, FILTERS))
        params[f"b{w}"] = np.zeros(FILTERS)
    params["E"][0] = 0
    if start is not None:
        for t, i in place.items():
            if t in start.vectors:
                params["E"][i] = start.vectors[t]
        params["o"], params["c"] = start.out.copy(), np.array([start.bias])
        for i, w in enumerate(WIDTHS):
            params[f"W{w}"], params[f"b{w}"] = start.filters[i].copy(), start.biases[i].copy()
    params = {k: v.astype(np.float32) for k, v in params.items()}
    steps, mean, taken = epochs * -(-len(y) // BATCH), None, 0
    m1, m2, step = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            sel = order[a : a + BATCH]
            length = max(int(sizes[sel].max()) + 1, max(WIDTHS) + 1)
            x = ids[sel][:, :length]
            keep = (rng.random(x.shape) > 0.1)[:, :, None]  # word dropout
            e = params["E"][x] * keep
            pooled, where, wins = [], [], []
            for w in WIDTHS:
                win = np.concatenate([e[:, j : length - w + 1 + j] for j in range(w)], axis=2)
                act = win @ params[f"W{w}"] + params[f"b{w}"]
                best = act.argmax(axis=1)
                pooled.append(np.take_along_axis(act, best[:, None, :], axis=1)[:, 0])
                where.append(best)
                wins.append(win)
            h = np.concatenate(pooled, axis=1)
            on = h > 0
            drop = ((rng.random(h.shape) > 0.3) / 0.7).astype(np.float32)
            hr = np.where(on, h, 0) * drop
            p = 1 / (1 + np.exp(-(hr @ params["o"] + params["c"][0])))
            g = (p - y[sel]) * wt[sel] / len(sel)
            grads = {"o": hr.T @ g + 1e-4 * params["o"], "c": np.array([g.sum()])}
            gh = g[:, None] * params["o"][None, :] * on * drop
            used, slot = np.unique(x, return_inverse=True)
            slot = slot.reshape(x.shape)
            back_rows, back_values = [], []
            for i, w in enumerate(WIDTHS):
                gi = gh[:, i * FILTERS : (i + 1) * FILTERS]
                rows = np.arange(len(sel))[:, None]
                picked = wins[i][rows, where[i]]  # (batch, filter, w x DIM)
                grads[f"W{w}"] = np.einsum("bfd,bf->df", picked, gi) + 2e-5 * params[f"W{w}"]
                grads[f"b{w}"] = gi.sum(axis=0)
                back = gi[:, :, None] * params[f"W{w}"].T[None]
                for j in range(w):
                    pos = where[i] + j
                    back_rows.append(slot[rows, pos].ravel())
                    back_values.append((back[:, :, j * DIM : (j + 1) * DIM] * keep[rows, pos]).reshape(-1, DIM))
            moved = np.zeros((len(used), DIM), dtype=np.float32)
            np.add.at(moved, np.concatenate(back_rows), np.concatenate(back_values))
            moved += 2e-5 * params["E"][used]
            moved[used == 0] = 0
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for k, at, v in [(k, slice(None), v) for k, v in grads.items()] + [("E", used, moved)]:
                m1[k][at] = 0.9 * m1[k][at] + 0.1 * v
                m2[k][at] = 0.999 * m2[k][at] + 0.001 * v * v
                params[k][at] -= (rate * (m1[k][at] / (1 - 0.9**step)) / (np.sqrt(m2[k][at] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            np.maximum(params["o"], 0, out=params["o"])  # filters tell abuse: what stands beside it takes nothing away
            if step > 0.7 * steps and step % 16 == 0:  # the mean of late steps varies less than the last one
                taken += 1
                mean = {k: v.copy() for k, v in params.items()} if mean is None else {k: mean[k] + (v - mean[k]) / taken for k, v in params.items()}
    params = mean or params
    return Network({t: params["E"][i].astype(np.float32) for t, i in place.items() if i}, [params[f"W{w}"].astype(np.float32) for w in WIDTHS], [params[f"b{w}"].astype(np.float32) for w in WIDTHS], params["o"].astype(np.float32), float(params["c"][0]), {"*": 0.5})


@dataclass
class Example:
    """A labelled text's sentences with the share of raters (or of authors of examples) that call it abusive."""

    parts: list[str]
    label: float
    weight: float
    lang: str


def examples(labelled: list[tuple[str, float | None, float | None]]) -> list[Example]:
    """Labelled rows and the example remarks. Raters' votes are averaged, nulls left out; where raters differ a text counts little."""
    out = []
    for text, a, b in labelled:
        votes = [v for v in (a, b) if v is not None]
        if text and votes and (parts := units(text)):
            v = sum(votes) / len(votes)
            out.append(Example(parts, float(v > 0.5), (4.0 if v else 1.0) if v in (0.0, 1.0) else 0.1, quick_language(text, "en")))
    for lang, remarks in ABUSIVE.items():
        out += [Example([r], 1.0, 1.5, lang) for r in remarks]
        out += [Example([h], 0.0, 1.5, lang) for h in HARMLESS.get(lang, ())]
    return out


def divided(background: list[str], rng: np.random.Generator) -> tuple[list[str], list[str]]:
    """Sentences drawn at random, with some of each language, and the rest."""
    base, rest, took = [], [], Counter()
    for i, k in enumerate(rng.permutation(len(background))):
        u = background[k]
        lang = quick_language(u, "en")
        (base if i < BASE_UNITS or took[lang] < PER_LANGUAGE else rest).append(u)
        took[lang] += 1
    return base, rest


def common_words(background: list[str]) -> set[tuple[str, int]]:
    """Languages and buckets of words that are not rare in the background."""
    cleaned = [(quick_language(u, "en"), tokens(clean(u))) for u in background]
    counts = Counter((lang, bucket(t)) for lang, ts in cleaned for t in set(ts))
    least = {lang: max(4.0, n * COMMON) for lang, n in Counter(lang for lang, _ in cleaned).items()}
    return {key for key, n in counts.items() if n >= least[key[0]]}


def harmless(units: list[tuple[str, list[int]]], common: set[tuple[str, int]], rng: np.random.Generator) -> list[tuple[list, float, float]]:
    """Training rows of background sentences, given by their languages and the buckets of their words. Words that are rare
    in the background teach nothing there: what little abuse it holds would unteach its own words."""
    return [(p, 0.0, 1.0) for lang, ids in units for p in pieces([t if (lang, t) in common or rng.random() < SHOWN else RARE for t in ids])]


def as_read(background: list[str]) -> list[tuple[str, list[int]]]:
    return [(quick_language(u, "en"), [bucket(t) for t in tokens(clean(u))]) for u in background]


def remarks(known: list[Example], scorer: Scorer | None = None) -> list[tuple[list, float, float]]:
    """Training rows of examples. Which sentence of a longer abusive text is the remark: the one that ``scorer`` scores
    highest; without it these are left out."""
    rows = []
    for e in known:
        parts = e.parts
        if e.label and len(parts) > 1:
            parts = [parts[int(np.argmax(scorer.score([clean(u) for u in parts])))]] if scorer else []
        rows += [(p, e.label, e.weight) for u in parts for p in pieces(tokens(clean(u))) for _ in range(2)]
    return rows


def learn(rows: list[tuple[list, float, float]], epochs: int, start: Network | None, seed: int) -> Network:
    return train([t for t, _, _ in rows], [v for _, v, _ in rows], [w for _, _, w in rows], epochs, start, seed)


def fit_one(known: list[Example], background: list[str], seed: int) -> Network:
    """Train on labelled texts, example remarks and background sentences.

    Most background is harmless, some of it is not, and nobody says which. Sentences drawn at random teach a first network
    as harmless. What it calls abusive all the same (SUSPECT) is left out from then on; of the rest, those it is least sure
    of join in as harder examples."""
    rng = np.random.default_rng(seed)
    base, rest = divided(background, rng)
    common = common_words(background)
    net = learn(remarks(known) + harmless(as_read(base[: BASE_UNITS // 3]), common, rng), 3, None, seed)
    rows = remarks(known, Scorer(net))
    net = learn(rows + harmless(as_read(base), common, rng), 2, net, seed)
    sure = Scorer(net).score([clean(u) for u in base])
    base = [u for u, s in zip(base, sure) if s < SUSPECT]
    hard: list[str] = []
    if rest:
        s = Scorer(net).score([clean(u) for u in rest])
        hard = [rest[i] for i in np.argsort(-s) if s[i] < SUSPECT][:HARD_UNITS]
    return learn(rows + harmless(as_read(base + hard), common, rng), 4, net, seed)


def refit(known: list[Example], background: list[str], starts: list[Network], k: int, common: set[tuple[str, int]], near: list[tuple[str, list[int]]] | None = None, seed: int = SEED) -> Network:
    """Member k trained on from ``starts[k]`` with all examples, sentences drawn from the background and ``near``, or all
    others there that the committee is not sure of (over NEAR).

    Members that are kept from a third of the examples miss what only that third shows, and the mean of three falls under
    a threshold with them. What the committee calls abusive (SUSPECT) is left out of the harmless sentences."""
    rng = np.random.default_rng(seed + k)
    judge = Scorer(Committee(starts, {}))
    base, rest = divided(background, rng)
    calm = [u for u, s in zip(base, judge.score([clean(u) for u in base])) if s < SUSPECT]
    if near is None:
        near = as_read([u for u, s in zip(rest, judge.score([clean(u) for u in rest])) if NEAR <= s < SUSPECT])
    return learn(remarks(known, judge) + harmless(as_read(calm) + near, common, rng), REFIT, starts[k], seed + k)


def fit(labelled: list[tuple[str, float | None, float | None]], background: list[str], members: int = MEMBERS, seed: int = SEED) -> Committee:
    """Train a committee (see :func:`fit_fold`), set a threshold for each language (see :func:`calibrated`), then train its
    members on with all examples (see :func:`refit`)."""
    known = examples(labelled)
    folds = [fit_fold(known, background, k, members, seed) for k in range(members)]
    net = calibrated(folds, known, background)
    common = common_words(background)
    net.members = [refit(known, background, folds, k, common, seed=seed) for k in range(members)]
    return net


def fold_of(text: str, members: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) // 7 % members


def fit_fold(known: list[Example], background: list[str], k: int, members: int, seed: int = SEED) -> Network:
    """Member k, which never sees fold k of examples and background: its scores of these are held out."""
    return fit_one([e for e in known if fold_of(e.parts[0], members) != k], [u for u in background if fold_of(u, members) != k], seed + k)


def lowest(over: np.ndarray) -> int:
    """The place in GRID of the lowest threshold, given how many sentences are over each of EDGES."""
    return int(np.flatnonzero(over <= (1 + GROWTH) * over[-1] + 1)[0])


def calibrated(members: list[Network], known: list[Example], background: list[str]) -> Committee:
    """A committee with a threshold for each language, from scores that members give to what they were not trained on.

    All background sentences of the language take part, in whatever order. Some of them are abusive, so their number over
    a threshold never falls to zero; going down from a strict one (STRICT) it first hardly grows, then harmless sentences
    come in. The threshold is the lowest of GRID at which it has grown by no more than GROWTH. ``held_out`` tells,
    by language, what this finds of the abusive examples. Languages with fewer than 200 background sentences have the
    threshold of all languages together."""
    net = Committee(members, {"*": 0.5})
    scorers = [Scorer(m) for m in members]

    def scores(texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        folds = np.array([fold_of(t, len(members)) for t in texts], dtype=np.int64)
        for k, s in enumerate(scorers):
            own = np.flatnonzero(folds == k)
            out[own] = s.score([clean(texts[i]) for i in own])
        return out

    abusive = [e for e in known if e.label and e.weight >= 1]
    hits: dict[str, list[float]] = {"*": []}
    best = np.zeros(len(abusive))
    for k, s in enumerate(scorers):
        own = [i for i, e in enumerate(abusive) if fold_of(e.parts[0], len(members)) == k]
        for i in own:
            best[i] = s.score([clean(u) for u in abusive[i].parts]).max()
    for e, v in zip(abusive, best.tolist()):
        hits.setdefault(e.lang, []).append(v)
        hits.setdefault("*", []).append(v)
    calm: dict[str, list[float]] = {}
    for u, v in zip(background, scores(background).tolist()):
        calm.setdefault(quick_language(u, "en"), []).append(v)
        calm.setdefault("*", []).append(v)
    for lang, own in calm.items():
        if lang == "*" or len(own) >= 200:
            c = np.sort(own)
            net.thresholds[lang] = GRID[lowest(len(c) - np.searchsorted(c, EDGES))]
    net.held_out = {lang: {"examples": len(own), "found": float(np.mean(np.array(own) >= net.threshold(lang))), "background": len(calm.get(lang, ())), "over": float(np.mean(np.array(calm.get(lang) or [0.0]) >= net.threshold(lang)))} for lang, own in sorted(hits.items())}
    return net


READ = "tbl string, rec_id bigint, langs array<string>, folds binary, lens binary, words binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets = Buckets()
    for b in batches:
        made: list[tuple] = []
        for t in b.column(2).to_pylist():
            parts = units(clean(t)) if t else []
            words, lens = read_words(parts, buckets)
            made.append(([quick_language(u, "en") for u in parts], bytes(fold_of(u, MEMBERS) for u in parts), lens.astype(np.int32).tobytes(), words.astype(np.int32).tobytes()))
        langs, folds, lens, words = zip(*made) if made else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.int64()), pa.array(langs, pa.list_(pa.string())), pa.array(folds, pa.binary()), pa.array(lens, pa.binary()), pa.array(words, pa.binary())], ["tbl", "rec_id", "langs", "folds", "lens", "words"])


def read_texts(texts: DataFrame) -> DataFrame:
    """A row per row of ``texts`` (tbl, rec_id, text) with its sentences' languages, folds, numbers of words, and the buckets
    of all words: what scoring needs, so that texts are read into words once."""
    return arrow_map(spread(texts.select("tbl", "rec_id", "text")), _read, READ)


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of all sentences of a batch: the row they are in, language, fold, number of words; and all words."""
    langs = b.column(2).to_pylist()
    folds, lens, words = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=t).astype(np.int64) for k, t in ((3, np.uint8), (4, np.int32), (5, np.int32)))
    return np.repeat(np.arange(len(langs)), [len(x) for x in langs]), [x for own in langs for x in own], folds, lens, words


def _scores(net: Committee):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            owner, langs_of, _, lens, words = _unpacked(b)
            s = scorer.each(words, lens).mean(axis=1).astype(float)
            best, margin = np.zeros(b.num_rows), np.full(b.num_rows, -1.0)
            langs: list[str | None] = [None] * b.num_rows
            np.maximum.at(best, owner, s)
            for i in np.flatnonzero(s >= 0.3).tolist():
                k, lang = owner[i], langs_of[i]
                if s[i] - net.threshold(lang) > margin[k]:
                    margin[k], langs[k] = s[i] - net.threshold(lang), lang
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best), pa.array(langs, pa.string()), pa.array(margin >= 0)], ["tbl", "rec_id", "score", "lang", "abusive"])

    return run


def fit_on(labels: DataFrame, texts: DataFrame, read: DataFrame | None = None) -> Committee:
    """Fit on all labelled rows and all texts; ``read`` are these texts as :func:`read_texts` gives them, if they are at hand.

    A first committee starts from the sentences of at most BACKGROUND_TEXTS texts of each table, by hash order (one job
    counts the texts of all tables, one reads those under a hash; tables are taken by name). It then meets every sentence of
    every text (see :func:`meet`): thresholds and common words are counted over all of them, and all different ones that it is
    not sure of train its members on, in tasks of GROUP sentences whose networks are averaged. What it is sure to be
    harmless would move them by next to nothing."""
    rows = labels.select("text", F.col("rater_a").cast("double"), F.col("rater_b").cast("double")).filter("text is not null")
    labelled = [tuple(r) for r in rows.orderBy(hash63("text"), "rater_a", "rater_b").limit(MAX_LABELS + 1).collect()]
    if len(labelled) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labelled rows are not supported")
    some = texts.filter("text is not null").select("tbl", "rec_id", "text")
    sizes = {r["tbl"]: r["n"] for r in some.groupBy("tbl").agg(F.count(F.lit(1)).alias("n")).collect()}
    h = hash63("rec_id", "text", seed="background")
    limit = F.lit(0)
    for tbl, n in sizes.items():
        limit = F.when(F.col("tbl") == tbl, F.lit(int((1 << 63) * min(1.0, 2 * BACKGROUND_TEXTS / n)) - 1)).otherwise(limit)
    drawn: dict[str, list[tuple[int, str]]] = {}
    for r in some.select("tbl", "text", h.alias("h")).filter(F.col("h") <= limit).collect() if sizes else ():
        drawn.setdefault(r["tbl"], []).append((r["h"], r["text"]))
    background = [u for tbl in sorted(drawn) for _, t in sorted(drawn[tbl])[:BACKGROUND_TEXTS] for u in units(clean(t))]  # as they are scored
    known = examples(labelled)
    spark = texts.sparkSession
    folds = _members(spark, lambda k: fit_fold(known, background, k, MEMBERS))
    first = common_words(background)
    whole = _members(spark, lambda k: refit(known, background, folds, k, first))
    over: dict[str, np.ndarray] = {}
    if folds:
        over, common, near = meet(staged(read_texts(texts), "words") if read is None else read, folds, whole)
        whole = _averaged(near, whole, lambda k, own: refit(known, background, whole, k, common, own))
    net = calibrated(folds, known, background)
    for k, member in enumerate(whole):
        net.members[k] = member
    return with_counts(net, over) if over else net


def with_counts(net: Committee, over: dict[str, np.ndarray]) -> Committee:
    """Thresholds and rates of the background from counts over all sentences (see :func:`meet`)."""
    net.thresholds = {lang: GRID[lowest(n[1:])] for lang, n in over.items() if lang == "*" or n[0] >= max(200, over["*"][0] * COMMON)}
    for lang, rates in net.held_out.items():
        n = over.get(lang, np.zeros(len(EDGES) + 1))
        rates |= {"background": int(n[0]), "over": float(n[1 + GRID.index(net.threshold(lang))] / max(n[0], 1))}
    return net


def _meets(folds: list[Network], whole: list[Network]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other, judge = [Scorer(n) for n in folds], Scorer(Committee(folds, {})), Scorer(Committee(whole, {}))
        over: dict[str, np.ndarray] = {}
        words_in: dict[str, np.ndarray] = {}
        for b in batches:
            _, langs, fold, lens, words = _unpacked(b)
            name = sorted(set(langs))
            code_of = {code: j for j, code in enumerate(name)}
            lang = np.array([code_of[code] for code in langs], dtype=np.int64)
            place = np.repeat(np.arange(len(lens)), lens)
            held, s = np.zeros(len(lens)), judge.each(words, lens)
            for k, scorer in enumerate(own):
                held[fold == k] = scorer.each(words[fold[place] == k], lens[fold == k])[:, 0]
            for j, code in enumerate(name):
                mine = held[lang == j]
                n = over.setdefault(code, np.zeros(len(EDGES) + 1, dtype=np.int64))
                n[0] += len(mine)
                n[1:] += (mine[:, None] >= EDGES).sum(axis=0)
            met = np.sort(place * BUCKETS + words)
            met = met[np.diff(met, prepend=-1) > 0]  # a word counts once in a sentence
            of = lang[met // BUCKETS]
            met %= BUCKETS
            for j, code in enumerate(name):
                words_in[code] = words_in.get(code, 0) + np.bincount(met[of == j], minlength=BUCKETS).astype(np.int32)
            at = np.concatenate([[0], np.cumsum(lens)])
            some = np.flatnonzero((np.maximum(s.mean(axis=1), held) >= NEAR) & (s.mean(axis=1) < SURE))
            parts = [words[at[i] : at[i + 1]] for i in some.tolist()]
            both = np.concatenate([s[some], other.each(np.concatenate([words[:0], *parts]), lens[some])], axis=1).mean(axis=1)
            rows = [(0, langs[i], None, None, p.astype(np.int32).tobytes()) for i, p, v in zip(some.tolist(), parts, both.tolist()) if v < SUSPECT]
            yield _met(rows)
        for code, n in over.items():
            yield _met([(1, code, k, v, None) for k, v in enumerate(n.tolist())])
        for code, n in words_in.items():
            yield _met([(2, code, k, int(n[k]), None) for k in np.flatnonzero(n).tolist()])

    return run


def _met(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["kind", "lang", "place", "n", "words"])


def meet(read: DataFrame, folds: list[Network], whole: list[Network]) -> tuple[dict[str, np.ndarray], set[tuple[str, int]], DataFrame]:
    """What a committee makes of every sentence: by language (and for all, "*") how many there are and how many are over each of
    EDGES by the member they were kept from; languages and words that are not rare; and the different sentences, as languages
    and words, that it is neither sure to be harmless (under NEAR) nor calls abusive (SURE, or SUSPECT together with the folds).

    A language of under a thousandth (COMMON) of all sentences is mostly another one misread: it has no common words and, as in :func:`with_counts`, the threshold of all together."""
    met = staged(arrow_map(read, _meets(folds, whole), "kind int, lang string, place int, n bigint, words binary"), "met")
    over: dict[str, np.ndarray] = {"*": np.zeros(len(EDGES) + 1, dtype=np.int64)}
    for r in met.filter("kind = 1").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect():
        over.setdefault(r["lang"], np.zeros(len(EDGES) + 1, dtype=np.int64))[r["place"]] = r["n"]
        over["*"][r["place"]] += r["n"]
    least = {lang: max(4.0, n[0] * COMMON) for lang, n in over.items() if lang != "*" and n[0] >= over["*"][0] * COMMON}
    enough = F.lit(False)
    for lang, n in least.items():
        enough = enough | ((F.col("lang") == lang) & (F.col("n") >= n))
    common = {(r["lang"], r["place"]) for r in met.filter("kind = 2").groupBy("lang", "place").agg(F.sum("n").alias("n")).filter(enough).collect()}
    return over, common, met.filter("kind = 0").select("lang", "words").distinct()


def _averaged(near: DataFrame, members: list[Network], make: Callable[[int, list[tuple[str, list[int]]]], Network]) -> list[Network]:
    """Members trained on with all sentences of ``near``: by groups of some GROUP sentences, each in a task of its own, whose
    networks are averaged one by one. Which group a sentence is in depends on nothing but the sentence and their number."""
    near = cut(near)
    groups = max(1, round(near.count() / GROUP))
    keys = near.sparkSession.range(len(members) * groups)
    rows = keys.join(near.withColumn("group", hash63("lang", "words") % groups), F.col("id") % groups == F.col("group"), "left").select("id", "lang", "words")

    def run(t: pa.Table) -> pa.Table:
        i = t.column("id")[0].as_py()
        own = sorted((lang, w) for lang, w in zip(t.column("lang").to_pylist(), t.column("words").to_pylist()) if lang is not None)
        net = make(i // groups, [(lang, np.frombuffer(w, dtype=np.int32).tolist()) for lang, w in own])
        return pa.table({"id": pa.array([i], pa.int64()), "net": pa.array([pickle.dumps(net)], pa.binary())})

    ship(near.sparkSession)
    nets = staged(rows.repartition(4 * len(members) * groups, "id").groupBy("id").applyInArrow(run, "id bigint, net binary"), "nets")
    out: list[list[Network]] = [[] for _ in members]
    for r in nets.orderBy("id").toLocalIterator():
        k, net = r["id"] // groups, pickle.loads(r["net"])
        out[k] = [mean_of(out[k][0], net, r["id"] % groups)] if out[k] else [net]
    return [own[0] for own in out]


def mean_of(mean: Network, net: Network, n: int) -> Network:
    """The mean of ``n`` networks and another one; a word that one of the two does not know has the other's vector."""
    step = lambda a, b: a + (b - a) / (n + 1)
    vectors = {t: step(mean.vectors.get(t, v), net.vectors.get(t, v)).astype(np.float32) for t, v in (net.vectors | mean.vectors).items()}
    return Network(vectors, [step(a, b) for a, b in zip(mean.filters, net.filters)], [step(a, b) for a, b in zip(mean.biases, net.biases)], step(mean.out, net.out), float(step(mean.bias, net.bias)), mean.thresholds)


def _members(spark: SparkSession, make: Callable[[int], Network]) -> list[Network]:
    """Members of a committee, each trained by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pickle.dumps(make(k)) for k in b.column(0).to_pylist()], pa.binary())], ["id", "net"])

    nets = arrow_map(spark.range(0, MEMBERS, 1, MEMBERS), run, "id bigint, net binary").collect()
    return [pickle.loads(r["net"]) for r in sorted(nets, key=lambda r: r["id"])]


def score_texts(texts: DataFrame, net: Committee) -> DataFrame:
    """``tbl, rec_id, score, lang, abusive``: a row per row of ``texts`` (tbl, rec_id, text), of which a record may have several.

    A text's score is the largest of its sentences; it is abusive if one reaches the threshold of that sentence's
    language. Null and blank texts score 0. Whole texts are read in one pass without a shuffle.
    """
    return score_read(read_texts(texts), net)


def score_read(read: DataFrame, net: Committee) -> DataFrame:
    """:func:`score_texts` of texts that are read into words."""
    return arrow_map(read, _scores(net), "tbl string, rec_id bigint, score double, lang string, abusive boolean")


def score_records(texts: DataFrame, net: Committee) -> DataFrame:
    """``tbl, rec_id, score, lang, abusive`` with one row per record: its highest score and that sentence's language.
    ``texts`` may be as :func:`read_texts` gives them."""
    scored = score_read(texts, net) if "words" in texts.columns else score_texts(texts, net)
    return scored.groupBy("tbl", "rec_id").agg(F.max("score").alias("score"), F.max_by("lang", "score").alias("lang"), F.max("abusive").alias("abusive"))
