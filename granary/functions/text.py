"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers and underscore, as in a Unicode ``\\w``; white space as in a Unicode ``\\s``.
W = r"\p{L}\p{N}_"
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Characters that are lower case but fold further (final sigma, long s, ligatures and the like), from Unicode's own rules.
_FOLDS = {c: f for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if (f := c.casefold()) != c and c == c.lower()}
_SINGLE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_LONGER = {c: f for c, f in _FOLDS.items() if len(f) > 1}


#: The usual ones, replaced at once; texts that may hold a rarer one are looked up letter by letter.
_USUAL = ("ß", "ς", "ſ", "µ")


def _around(chars: list[str], gap: int = 96) -> str:
    """A short class of ranges that holds the characters, and some between near ones: a quick test of what may need folding."""
    ranges: list[list[int]] = []
    for p in sorted(map(ord, chars)):
        if ranges and p - ranges[-1][1] <= gap:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


_MAY_FOLD = _around([c for c in _FOLDS if c not in _USUAL])


def casefold(x: Column) -> Column:
    """Full Unicode case folding; null stays null."""
    low = F.lower(x)
    for c in _USUAL:
        low = F.replace(low, F.lit(c), F.lit(_FOLDS[c]))
    table = F.create_map(*[F.lit(v) for pair in _LONGER.items() for v in pair])

    def rest(t: Column) -> Column:
        spelled = F.array_join(F.transform(F.split(F.translate(t, "".join(_SINGLE), "".join(_SINGLE.values())), ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        return F.when((F.octet_length(t) > F.length(t)) & t.rlike(_MAY_FOLD), spelled).otherwise(t)

    return F.transform(F.array(low), rest)[0]  # bound by a lambda, so that it is computed once


def unicode_classes(pattern: str) -> str:
    """A pattern in Python's syntax for Java's matcher, with Python's meaning: ``\\w``, ``\\d``, ``\\s`` and ``\\b`` of all
    scripts, named groups without the P."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            n = pattern[k + 1]
            if n in "wds":
                kind = {"w": W, "d": r"\p{Nd}", "s": _SPACE}[n]
                out.append(kind if inside else f"[{kind}]")
            elif n in "WDS":
                out.append("[^" + {"W": W, "D": r"\p{Nd}", "S": _SPACE}[n] + "]")
            elif n == "b" and not inside:
                out.append(f"(?:(?<![{W}])(?=[{W}])|(?<=[{W}])(?![{W}]))")
            else:
                out.append(c + n)
            k += 2
            continue
        if c == "[" and inside:
            out.append("\\[")
        elif pattern.startswith("(?P<", k) and not inside:
            out.append("(?<")
            k += 3
        else:
            inside = (inside or c == "[") and not (inside and c == "]")
            out.append(c)
        k += 1
    return re.sub(r"\(\?([aims]*)i([aims]*)([:)])", r"(?\1iu\2\3", "".join(out))


def normalise(x: Column) -> Column:
    """Casefolded; every run of characters that are no letter, digit or underscore is one space; ends trimmed."""
    return F.trim(F.regexp_replace(casefold(x), f"[^{W}]+", " "))


def shingles(x: Column, k: int = 5) -> Column:
    """Distinct character k-grams of a normalised text; a text of k characters or fewer is one shingle, an empty one has none."""
    # the characters are bound by an outer lambda, so that they are split once and not for each gram
    grams = F.transform(F.array(F.split(x, "")), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.concat(*[F.get(c, i + j) for j in range(k)])))[0]
    return F.when(x.isNull() | (x == ""), F.array().cast("array<string>")).when(F.length(x) <= k, F.array(x)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tokens(x: Column, folded: bool = True) -> Column:
    """Words of a text; ``folded`` for casefold, else plain lower case."""
    return F.regexp_extract_all(casefold(x) if folded else F.lower(x), F.lit(f"([{W}]+)"), F.lit(1))


def ngrams(words: Column, n: int) -> Column:
    """n-grams of a list of words, joined by a space; none where the list is shorter."""
    if n == 1:
        return words
    grams = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)])))[0]
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def keyword(x: Column) -> Column:
    """Lower case, runs of white space and hyphens as one underscore, only ``a-z0-9_.`` kept, outer ``_`` and ``.`` dropped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"[\s-]+", "_"), "[^a-z0-9_.]", ""), r"^[_.]+|[_.]+$", "")


def keywords(x: Column) -> Column:
    """Keywords of a comma or line separated list, in order of first mention; a leading ``keywords:`` label is dropped."""
    parts = F.transform(F.split(F.regexp_replace(x, r"(?i)^\s*keywords:\s*", ""), r"[,\n]"), keyword)
    return F.array_distinct(F.filter(parts, lambda k: k != ""))


#: What str.split() splits at.
_SPACES = f"[{_SPACE}]+"


def strip(x: Column) -> Column:
    """White space of any script removed at both ends."""
    return F.regexp_replace(x, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def excerpt(x: Column, n: int) -> Column:
    """White space of any script collapsed, cut to n characters, right end trimmed."""
    return F.rtrim(F.substring(F.trim(F.regexp_replace(x, _SPACES, " ")), 1, n))


def json_object(x: Column) -> Column:
    """The outermost ``{...}`` of a model's reply as a string, code fences ignored; null where there is none or it is no JSON."""
    found = F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def _last_of(x: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(-1))


def boxed_answer(x: Column) -> Column:
    """Last ``\\boxed{..}``, else the rest of the line behind the last ``final answer is``, both stripped, else the last number
    as written (with its sign, or without a digit before the point); commas are dropped first."""
    y = F.replace(x, F.lit(","), F.lit(""))
    return F.coalesce(strip(_last_of(y, r"(?d)\\boxed\{(.*?)\}")), strip(_last_of(y, rf"(?idu)final answer is:?[{_SPACE}]*(.*)")), _last_of(y, r"([-+]?\p{Nd}*\.?\p{Nd}+)"))


def numeric_answer(x: Column) -> Column:
    """First number behind the last ``final answer``, or what stands there where it is no number; without the words, the last
    number of the text. Commas are dropped from numbers."""
    number = r"([-+]?\p{Nd}[\p{Nd},]*\.?\p{Nd}*)"
    tail = _last_of(x, rf"(?d)[Ff]inal [Aa]nswer:?[{_SPACE}]*(.+)")
    bare = lambda n: F.replace(n, F.lit(","), F.lit(""))
    there = F.try_element_at(F.regexp_extract_all(tail, F.lit(number), F.lit(1)), F.lit(1))
    return F.when(tail.isNotNull(), F.coalesce(bare(there), strip(tail))).otherwise(bare(_last_of(x, number)))


def choice_answer(x: Column) -> Column:
    """Letter behind the first ``Answer:``, else the first letter A to D that stands by itself."""
    return F.coalesce(F.nullif(F.regexp_extract(x, rf"[Aa]nswer:[{_SPACE}]*([A-D])", 1), F.lit("")), F.nullif(F.regexp_extract(x, rf"(?<![{W}])([A-D])(?![{W}])", 1), F.lit("")))


def yes_no_maybe(x: Column) -> Column:
    """yes, no or maybe behind the first ``answer:``, else the one that the text begins with, also as part of a word."""
    low = F.lower(strip(x))
    begins = F.when(low.startswith("yes"), "yes").when(low.startswith("no"), "no").when(low.startswith("maybe"), "maybe")
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(x, rf"(?iu)answer:[{_SPACE}]*(yes|no|maybe)", 1)), F.lit("")), begins)


def option_labels(x: Column) -> Column:
    """Letters of the options that stand at line starts, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?m)^\s*\(?([A-D])[).:]\s"), F.lit(1)))


def token_estimate(x: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(x) / 4)


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price in units per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def content_id(*parts: Column) -> Column:
    """sha256 over length-prefixed parts: equal only for equal parts; a null part is told from an empty one by a minus."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-:")) for p in parts]), 256)


def prompt_hash(prompt: Column) -> Column:
    """sha256 of a prompt, named by its algorithm."""
    return F.concat(F.lit("sha256:"), F.sha2(prompt, 256))


def candidate_seed(*parts: Column) -> Column:
    """First eight bytes of the sha256 of run seed, cell and index, joined by colons, as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def message_path(i: Column) -> Column:
    return F.format_string("messages[%d].content", i)


def record_text(messages: Column) -> Column:
    """Contents of messages joined by line breaks, null contents left out, white space at the ends trimmed."""
    return strip(F.array_join(F.transform(messages, lambda m: m["content"]), "\n"))
