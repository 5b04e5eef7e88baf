"""Sentence boundaries: statistics learnt per language without labels, then a decision for each mark.

Training counts word types with and without a final period, and the pairs around periods, per language. Log-likelihood
ratios over these counts name the abbreviations, the collocations that span a period, and the frequent sentence
starters (Kiss and Strunk, 2006). Splitting reads each text once and uses these tables, scripts and quotations.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.languages import quick_language
from granary.session import arrow_map, spread

#: Thresholds of the published method: abbreviations, collocations, starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Share of a word's period-final uses that one follower must have to hold the period inside a fixed expression.
FIXED = 0.8
#: Least share of an abbreviation's followers that are no sentence starters, and of a starter's uses in lower case.
INSIDE, SEEN_LOWER = 0.75, 0.02
#: Share of an abbreviation's capitalised followers that begin sentences from which it is taken to end sentences too.
ENDS_AT = 0.1
#: Most learnt entries that are sent to executors: vocabularies of abbreviations and starters are closed classes.
MAX_ENTRIES = 500_000
UNSPACED = {"zh", "ja", "th"}

#: Combining marks that belong to words and are no ``\\w``.
MARKS = r"\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"
TOKEN = re.compile(rf"[^\W_][\w{MARKS}'’\-]*(?:[.,][^\W_][\w{MARKS}'’\-]*)*\.?")
NUMBER = re.compile(r"\d")
MARKER = re.compile(r"[ \t　]*(?:[-*•–—·▪◦‣●○■□]|#{1,6}|\(?\d{1,3}[.)）、]|[（(]?[一二三四五六七八九十]{1,3}[）)、]|\(?[A-Za-z][)]|\([ivxIVX]{1,4}\))[ \t　]+(?=\S)")
LINE_MARKER = re.compile(r"(?m)^" + MARKER.pattern)
LABEL = re.compile(r"[ \t　]*[^\W\d_a-zà-ÿ][\w.'’\-]{0,24}(?: [\w.'’\-]{1,24}){0,2}[:：](?:\s|$)|[ \t　]*[ऀ-෿฀-๿؀-ۿ぀-鿿가-힯][\w ]{0,20}[:：](?:\s|$)")
MARK = re.compile(r"(?:\.(?![0-9a-z])|[．｡。!！?？؟।॥۔…‽⁇⁈⁉])[.．｡。!！?？؟।॥۔…‽⁇⁈⁉]*")
CLOSERS = ")]}\"”’»」』）】›'"
CLOSED = re.compile(r"(?:[)\]}\"”’»」』）】›']|[   ]»)*")
AHEAD = re.compile(r"[\s\"“„‘«‹(\[¿¡「『（【'—–-]*")
WORD = re.compile(rf"[^\W_][\w{MARKS}'’\-]*(?:[.,][^\W_][\w{MARKS}'’\-]*)*")
QUOTED = re.compile(r"[\"“”„‘«»‹›「」『』（）()\[\]【】《》]")
PAIRS = {"“": "”", "‘": "’", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "„": "“”", '"': '"'}
BRACKETS = "(（[【《"
THAI_SPACE = re.compile(r"(?<=[฀-๿\"”»)])[ \t \n\r　]+(?=[\"“«(]?[฀-๿])")
THAI = re.compile(r"[฀-๿]")
HIRAGANA = re.compile(r"[ぁ-ゟ]")
HAN = re.compile(r"[㐀-鿿゠-ヿ]")
URLISH = re.compile(r"@|/|www\.")


@dataclass
class Model:
    """Learnt sets by language."""

    abbreviations: dict[str, set[str]] = field(default_factory=dict)
    collocations: dict[str, set[tuple[str, str]]] = field(default_factory=dict)
    starters: dict[str, set[str]] = field(default_factory=dict)
    openers: dict[str, set[str]] = field(default_factory=dict)  #: starters and names that open sentences
    enders: dict[str, set[str]] = field(default_factory=dict)  #: abbreviations that close sentences at times


def kind(token: str) -> str:
    return "##" if NUMBER.match(token) else token


def blocks_of(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between blank lines."""
    start, at = None, 0
    for line in text.split("\n"):
        if line.strip():
            if start is None:
                start = at
            end = at + len(line)
        elif start is not None:
            yield start, end
            start = None
        at += len(line) + 1
    if start is not None:
        yield start, end


# ---------------------------------------------------------------------------- learning


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    pairs: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            lang = "und"
            for s, e in blocks_of(text or ""):
                block = text[s:e]
                lang = quick_language(block, lang)
                if lang in UNSPACED:
                    continue
                tokens = TOKEN.findall(LINE_MARKER.sub("", block))
                words.setdefault(lang, Counter()).update(tokens)
                pairs.update([(lang, x[:-1], y) for x, y in zip(tokens, tokens[1:]) if x[-1] == "."])
        if sum(map(len, words.values())) + len(pairs) > 1_000_000:  # hand on partial counts so that memory stays bounded
            yield from _counts(words, pairs)
            words.clear()
            pairs.clear()
    yield from _counts(words, pairs)


def _counts(words: dict[str, Counter], pairs: Counter) -> Iterator[pa.RecordBatch]:
    rows: Counter = Counter()
    for lang, own in words.items():
        for t, n in own.items():
            period = t[-1] == "."
            rows[lang, kind(t[:-1] if period else t), None, period] += n
    for (lang, x, y), n in pairs.items():
        rows[lang, kind(x).lower(), kind(y[:-1] if y[-1] == "." else y), True] += n
    keys = list(rows)
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part]), pa.array([k[1] for k in part]), pa.array([k[2] for k in part], pa.string()), pa.array([k[3] for k in part]), pa.array([rows[k] for k in part], pa.int64())], ["lang", "a", "b", "period", "n"])


def _ln(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-12)))


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    return k * _ln(p) + (n - k) * _ln(1 - p)


def _ratio(ca: Column, cb: Column, cab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of b following a; counts of a, of b, of both, and of all."""
    p = cb / n
    p1, p2 = cab / ca, (cb - cab) / F.greatest(n - ca, F.lit(1))
    return -2 * (_likelihood(cab, ca, p) + _likelihood(cb - cab, n - ca, p) - _likelihood(cab, ca, p1) - _likelihood(cb - cab, n - ca, p2))


def _few(df: DataFrame) -> list:
    rows = df.limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError("more learnt entries than a language's closed classes can hold")
    return rows


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Statistics over all rows; words and pairs are counted in each task and summed by key before anything is decided."""
    from granary.session import cut

    counts = cut(arrow_map(spread(docs.select(text)), _count, "lang string, a string, b string, period boolean, n bigint").groupBy("lang", "a", "b", "period").agg(F.sum("n").alias("n")))
    forms = counts.filter("b is null")
    types = forms.groupBy("lang", F.lower("a").alias("a")).agg(F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("final"), F.sum("n").alias("n"))
    totals = F.broadcast(types.groupBy("lang").agg(F.sum("n").alias("tokens"), F.sum("final").alias("periods")))  # a row per language
    p1 = F.col("periods") / F.col("tokens")
    letters = F.length(F.regexp_replace("a", r"\.", ""))
    plain = F.col("n") - F.col("final")
    score = 2 * (F.col("final") * (F.log(F.lit(0.99)) - _ln(p1)) + plain * (F.log(F.lit(0.01)) - _ln(1 - p1)))
    candidates = _few(
        types.filter("final > 0 and a <> '##'").join(totals, "lang")
        .withColumn("score", score * F.exp(-letters) * (F.length("a") - letters + 1) * F.pow(letters.cast("double"), -plain.cast("double")))
        .filter(F.col("score") >= ABBREVIATION).filter(F.col("a").rlike(r"\p{L}")).select("lang", "a")
    )
    model = Model()
    pairs = counts.filter("b is not null").groupBy("lang", "a", "b").agg(F.sum("n").alias("both"))
    b_form = forms.groupBy("lang", F.col("a").alias("b")).agg(F.sum("n").alias("b_n"))
    known = pairs.join(_known(docs, candidates), ["lang", "a"], "left").withColumn("abbr", F.col("known").isNotNull() | F.col("a").rlike(r"^\p{L}$"))
    # a period closes a sentence here unless its word is an abbreviation or initial, or the next word is in lower case
    at_break = known.filter(~F.col("abbr") & ~F.col("b").rlike(r"^\p{Ll}") & (F.col("b") != "##") & (F.col("a") != "##")).groupBy("lang", "b").agg(F.sum("both").alias("both"))
    breaks = F.broadcast(at_break.groupBy("lang").agg(F.sum("both").alias("breaks")))
    lower = forms.filter(F.col("a").rlike(r"^\p{Ll}")).groupBy("lang", F.col("a").alias("low")).agg(F.sum("n").alias("low_n"))
    starts = _few(
        at_break.join(b_form, ["lang", "b"]).join(totals, "lang").join(breaks, "lang")
        .filter((F.col("both") > 1) & (F.col("tokens") / F.col("breaks") > F.col("b_n") / F.col("both")))
        .filter(_ratio(F.col("breaks"), F.col("b_n"), F.col("both"), F.col("tokens")) >= STARTER)
        .withColumn("low", F.lower("b")).join(lower, ["lang", "low"], "left")
        # names open sentences too, but are never seen in lower case: only other words tell that a sentence begins
        .select("lang", "b", (~F.col("b").rlike(r"^\p{Lu}") | F.coalesce(F.col("low_n") >= SEEN_LOWER * F.col("b_n"), F.lit(False))).alias("tells"))
    )
    for r in starts:
        model.openers.setdefault(r["lang"], set()).add(r["b"])
        if r["tells"]:
            model.starters.setdefault(r["lang"], set()).add(r["b"])
    starts = [r for r in starts if r["tells"]]
    begins = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["b"], True) for r in starts], "lang string, b string, begins boolean"))
    # a true abbreviation also stands inside sentences: what follows it begins no sentence, most of the time
    followed = pairs.join(begins, ["lang", "b"], "left").groupBy("lang", "a").agg((F.sum(F.when(F.col("begins"), 0).otherwise(F.col("both"))) / F.sum("both")).alias("goes_on"))
    capital = pairs.filter(~F.col("b").rlike(r"^\p{Ll}") & (F.col("b") != "##")).join(begins, ["lang", "b"], "left").groupBy("lang", "a").agg((F.sum(F.when(F.col("begins"), F.col("both")).otherwise(0)) / F.sum("both")).alias("share"))
    kept = _few(_known(docs, candidates).join(followed, ["lang", "a"], "left").filter((F.col("goes_on") >= INSIDE) | F.col("a").contains(".")).select("lang", "a"))
    for r in kept:
        model.abbreviations.setdefault(r["lang"], set()).add(r["a"])
    known = pairs.join(_known(docs, kept), ["lang", "a"], "left").withColumn("abbr", F.col("known").isNotNull() | F.col("a").rlike(r"^\p{L}$"))
    final = types.select("lang", "a", "final", F.col("n").alias("a_n"))
    for r in _few(
        known.join(final, ["lang", "a"]).join(b_form, ["lang", "b"]).join(totals, "lang")
        .filter((F.col("both") > 1) & ~F.col("b").rlike(r"^\p{Ll}"))
        .filter((F.col("abbr") | (F.col("a") == "##") | (F.col("both") >= FIXED * F.col("final"))))
        .filter(F.col("tokens") / F.col("a_n") > F.col("b_n") / F.col("both"))
        .filter(_ratio(F.col("a_n"), F.col("b_n"), F.col("both"), F.col("tokens")) >= COLLOCATION).select("lang", "a", "b", "both", "final")
    ):
        model.collocations.setdefault(r["lang"], set()).add((r["a"], r["b"]))
    for r in _few(capital.filter(F.col("share") >= ENDS_AT).join(_known(docs, kept), ["lang", "a"]).select("lang", "a")):
        model.enders.setdefault(r["lang"], set()).add(r["a"])
    for lang, found in model.collocations.items():  # a frequent starter after a number, or after what may end a sentence, is a new sentence
        ends = model.enders.get(lang, set())
        model.collocations[lang] = {(a, b) for a, b in found if b not in (model.openers if a in ends else model.starters).get(lang, ())}
    return model


def _known(docs: DataFrame, rows: list) -> DataFrame:
    return F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["a"], True) for r in rows], "lang string, a string, known boolean"))


# ---------------------------------------------------------------------------- splitting


def outer_pairs(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets of text[s:e]; openers without a closer are ignored."""
    stack: list[tuple[int, str]] = []
    found: list[tuple[int, int]] = []
    for m in re.finditer(r"[\"“”„‘’«»‹›「」『』（）()\[\]【】《》]", text[s:e]):
        i, c = s + m.start(), m.group()
        before, after = text[i - 1] if i > s else " ", text[i + 1] if i + 1 < e else " "
        hit = next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][1]), None)
        if c == "’" and (hit is None or after.isalpha()):
            continue
        if c == '"' and hit is not None and before.isspace() and not after.isspace():
            hit = None
        if hit is not None:
            found.append((stack[hit][0], i))
            del stack[hit:]
        elif c in PAIRS and not (c == "‘" and before.isalnum()) and not (c == '"' and before.isalnum()):
            stack.append((i, PAIRS[c]))
    found.sort()
    out: list[tuple[int, int]] = []
    for o, c in found:
        if not out or o > out[-1][1]:
            out.append((o, c))
    return out


def _last_token(text: str, begin: int, p: int) -> list[str]:
    """What stands before position p in the unit, cut at its last white space: the last item is the token, whatever its length."""
    back = 60
    while True:
        low = max(begin, p - back)
        parts = text[low:p].rsplit(None, 1)
        if low == begin or len(parts) > 1:
            return parts
        back *= 4


class Splitter:
    def __init__(self, model: Model):
        self.model = model

    def sentences(self, text: str | None) -> list[tuple[int, int]]:
        """Start and end of each sentence of a text, in code points, end exclusive. Null and blank texts have none."""
        out: list[tuple[int, int]] = []
        lang = "und"
        for s, e in blocks_of(text or ""):
            lang = quick_language(text[s:e], lang)
            at = unit = s
            for line in text[s:e].split("\n"):
                if at > unit and (MARKER.match(line) or LABEL.match(line)):
                    self._unit(text, unit, at, lang, out)
                    unit = at
                at += len(line) + 1
            self._unit(text, unit, e, lang, out)
        return out

    def _unit(self, text: str, s: int, e: int, lang: str, out: list) -> None:
        if lang != "th" and not text.isascii() and THAI.search(text, s, e):
            lang = "th" if len(THAI.findall(text[s:e])) * 2 > e - s else lang
        m = MARKER.match(text, s, e)
        first = s if not m else m.end()
        begin = s
        pairs = outer_pairs(text, s, e) if QUOTED.search(text, s, e) else []
        opens = [p[0] for p in pairs]
        cuts: list[int] = []
        for m in MARK.finditer(text, first, e):
            if m.start() < begin:
                continue
            stop = self._boundary(text, s, e, begin, m.start(), m.end(), m.group(), pairs, opens, lang)
            if stop:
                cuts.append(stop)
                begin = stop
        if lang == "th":
            for m in THAI_SPACE.finditer(text, first, e):
                i = m.start()
                if text[i - 1] == "ๆ" or text[i - 1] in "\"”»)" and not self._thai_close(text, i, pairs, opens):
                    continue
                k = bisect_right(opens, i) - 1
                if k >= 0 and i < pairs[k][1]:
                    continue
                if "\n" in m.group():
                    continue
                cuts.append(i)
            cuts.sort()
        at = s
        for c in [*cuts, e]:
            piece = text[at:c]
            bare = piece.strip()
            if bare and (len(bare) > 8 or any(c.isprintable() for c in bare)):  # invisible characters alone are no sentence
                lo = at + len(piece) - len(piece.lstrip())
                out.append((lo, lo + len(bare)))
            at = c

    @staticmethod
    def _thai_close(text, i, pairs, opens) -> bool:
        """A closing quotation ends a Thai sentence only if words of the sentence stand before it."""
        k = bisect_right(opens, i - 1) - 1
        return k >= 0 and pairs[k][1] == i - 1 and text[max(0, pairs[k][0] - 2) : pairs[k][0]].strip() != ""

    def _boundary(self, text, s, e, begin, p, q, mark, pairs, opens, lang) -> int:
        """Where the sentence ends if the mark text[p:q] ends one, else 0."""
        k = bisect_right(opens, p) - 1
        inside = k >= 0 and p < pairs[k][1]
        if inside:
            o, c = pairs[k]
            before = bool(WORD.search(text, begin, o))
            quote = text[o] not in BRACKETS
            if text[q:c].strip(CLOSERS + "   ") == "":  # at the closing mark
                stop = CLOSED.match(text, c, e).end() or c + 1
                if not self._ends(text, e, begin, p, q, stop, mark, lang):
                    return 0
                return 0 if self._continues(text, e, o, stop, before, quote, lang) else stop
            if before or self._continues(text, e, o, CLOSED.match(text, c, e).end(), before, quote, lang):
                return 0
        stop = CLOSED.match(text, q, e).end()
        for i in range(q, stop):  # a quotation that opens here is no closer
            if i in opens:
                stop = i
                break
        return stop if self._ends(text, e, begin, p, q, stop, mark, lang) else 0

    @staticmethod
    def _continues(text, e, o, stop, before, quote, lang) -> bool:
        """Whether the sentence goes on behind a quotation or bracket that closed at ``stop``."""
        i = AHEAD.match(text, stop, e).end()
        if i >= e:
            return False
        if text[stop] in ",;:，、；：)）":
            return True
        c = text[i]
        if c.islower():
            w = WORD.match(text, i, e)
            return not (w and any(x.isupper() for x in w.group()[1:]))
        if c.isupper() or not c.isalpha() or not quote:
            return False
        if HIRAGANA.match(c):
            return True
        if i > stop and not text[stop:i].isspace():  # another quotation follows
            return False
        if HAN.match(c) and before:
            return text[:o].rstrip()[-1:] not in (":", "：", ",", "，", "、") and lang != "ja"
        return not before

    def _ends(self, text, e, begin, p, q, stop, mark, lang) -> bool:
        if stop >= e:
            return True
        follow = text[stop]
        spaced = follow.isspace()
        i = AHEAD.match(text, stop, e).end()
        if i >= e:
            return True
        n = text[i]
        last = mark[-1]
        if last in "。．｡！？।॥۔؟" and last not in "．":
            return follow not in ",，、；;：:"
        if "…" in mark or len(mark) > 1 and set(mark) == {"."}:
            if not spaced:
                return n.isupper() and "…" not in mark
            return not n.islower() and not n.isdigit() and not HAN.match(n)
        if not spaced:
            if i > stop and follow not in "“„‘«¿¡\"(":
                return False
            if not (n.isupper() or (n.isalpha() and not n.islower() and lang not in UNSPACED)):
                return False
            w = WORD.match(text, i, e)
            if last == "." and (w is None or "." in w.group() or not (p and (text[p - 1].islower() or text[p - 1] in ")%\"”’")) or (len(w.group()) > 1 and w.group().isupper() and i == stop)):
                return False
            token = _last_token(text, begin, p)
            if token and (URLISH.search(token[-1]) or (last == "." and "." in token[-1] and "%" not in token[-1])):
                return False
            if last == "." and token and token[-1].lower().lstrip("(“\"‘«") in self.model.abbreviations.get(lang, ()):
                return False
            return True
        w = WORD.match(text, i, e)
        word = w.group() if w else ""
        if n.islower() and not any(c.isupper() for c in word[1:]):
            return False
        if last != ".":
            return True
        return self._period(text, begin, p, word, lang)

    def _period(self, text, begin, p, word, lang) -> bool:
        """The decision for one period before a space and a word that is not in lower case."""
        token = _last_token(text, begin, p)
        prev = token[-1].lstrip("([{“„\"‘'«¿¡") if token else ""
        if not prev:
            return False
        low = kind(prev).lower()
        nxt = kind(word)
        starters = self.model.starters.get(lang, ())
        if (low, nxt) in self.model.collocations.get(lang, ()):
            return False
        initial = len(prev) == 1 and prev.isalpha()
        if initial or low in self.model.abbreviations.get(lang, ()):
            if nxt == "##" or not word:
                return False
            return word in starters or (low in self.model.enders.get(lang, ()) and word in self.model.openers.get(lang, ()))
        if low == "##" and nxt != "##" and begin == p - len(prev):  # a number by itself begins the unit
            return False
        return True


def _split(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(model)
        for b in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, e in splitter.sentences(text):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_pos", "end_pos"])

    return run


def split_sentences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, start_pos, end_pos`` of every sentence of ``docs`` (doc_id, text); see :class:`Splitter`.

    Without ``model`` the statistics are learnt from the same rows first. Two scans; the only shuffle sums counts by
    word type. Rows with one doc_id are split each by itself; null, empty and blank texts give no row.
    """
    model = model or learn(docs)
    return arrow_map(spread(docs.select("doc_id", "text")), _split(model), "doc_id bigint, start_pos int, end_pos int")
