"""Language votes from scripts and stop words."""

from __future__ import annotations

import re

import regex

#: Frequent function words by language.
STOPWORDS = {
    "en": "the of and to in is that this these those it for on with as are was be by not or at from have has will which an our every each any after before until when what your you we they one its their if than but both would should can",
    "de": "der die das und den dem des ein eine einen einem einer ist nicht mit auf für von zu im am zur zum nach bei aus bis durch oder als auch sich wird werden hat ohne über unter vor trotz innerhalb welche wenn dass ihr wir sie ich ist am sowie kann",
    "fr": "le la les de des du et un une est dans en pour que qui ne pas sur avec au aux par ce cette ces son sa ses ou mais aussi sans sous dès jusqu à après avant pendant hors plus il elle nous vous quelle quel si être",
    "es": "el la los las de del y un una es en para que no con por se su sus al lo como más pero también sin hasta después antes durante fuera pese sobre este esta estos ambas qué cuál si ser o según entre",
    "it": "il lo gli della delle dei degli e un una è nel nella per che non con su al alla dal come più ma anche senza fino dopo prima durante questo questa quale se essere sono",
    "pt": "o os as da das do dos e um uma é em no na nos nas para que não com por ao à se seu sua mais mas também sem até depois antes durante este esta qual ser são",
    "nl": "de het een en van in is dat die niet met op voor te zijn aan er ook als maar bij door naar uit om tot zonder na voor deze dit welke wordt worden",
}
_OWNERS: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words.split()):
        _OWNERS[_w] = (*_OWNERS.get(_w, ()), _lang)

_WORD = re.compile(r"[^\W\d_]+")
#: Scripts that name a language by themselves, most specific first.
_SCRIPTS = [("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("ko", regex.compile(r"\p{Hangul}")), ("zh", regex.compile(r"\p{Han}")), ("th", regex.compile(r"\p{Thai}")), ("hi", regex.compile(r"\p{Devanagari}")), ("ar", regex.compile(r"\p{Arabic}")), ("he", regex.compile(r"\p{Hebrew}")), ("ru", regex.compile(r"\p{Cyrillic}")), ("el", regex.compile(r"\p{Greek}"))]
_OTHER = regex.compile(r"[^\P{L}\p{Latin}]")


def language_votes(text: str, words: list[str] | None = None) -> dict[str, float]:
    """Votes by language: shared stop words split their vote; letters of a telling script vote as words of three letters."""
    votes: dict[str, float] = {}
    for own in [_OWNERS[w] for w in (_WORD.findall(text.lower()) if words is None else words) if w in _OWNERS]:
        share = 1.0 / len(own)
        for lang in own:
            votes[lang] = votes.get(lang, 0.0) + share
    if not text.isascii() and (others := len(_OTHER.findall(text))):
        for lang, p in _SCRIPTS:
            if n := len(p.findall(text)):
                if lang == "ja":  # kana decide for Japanese; its Han letters are no Chinese
                    n = others
                votes[lang] = votes.get(lang, 0.0) + n / 3
                if lang in ("ja", "zh"):
                    break
    return votes


def winner(votes_by: dict[str, float], least: float = 1.5, lead: float = 1.5) -> str | None:
    """The language with the most votes, or None where they are too few or too close."""
    votes = sorted(votes_by.items(), key=lambda x: -x[1])
    if not votes or votes[0][1] < least:
        return None
    if len(votes) > 1 and votes[0][1] < lead * votes[1][1]:
        return None
    return votes[0][0]


_SETS = {lang: frozenset(words.split()) for lang, words in STOPWORDS.items()}
_ALL = frozenset().union(*_SETS.values())
_TELLING = re.compile(r"[\u0370-\u03ff\u0400-\u04ff\u0590-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]+")


_RANGES = [("ko", re.compile(r"[\uac00-\ud7a3]+")), ("th", re.compile(r"[\u0e00-\u0e7f]+")), ("hi", re.compile(r"[\u0900-\u097f]+")), ("ar", re.compile(r"[\u0600-\u06ff]+")), ("he", re.compile(r"[\u0590-\u05ff]+")), ("ru", re.compile(r"[\u0400-\u04ff]+")), ("el", re.compile(r"[\u0370-\u03ff]+")), ("zh", re.compile(r"[\u3400-\u9fff]+"))]
_KANA = re.compile(r"[\u3041-\u30fa]")


def quick_language(text: str, before: str = "und") -> str:
    """The language of a stretch of text by its distinct stop words, or by script; ``before`` where that is unclear."""
    if not text.isascii() and sum(map(len, _TELLING.findall(text))) * 4 > len(text) - text.count(" "):
        if _KANA.search(text):
            return "ja"
        return max((sum(map(len, p.findall(text))), lang) for lang, p in _RANGES)[1]
    words = _ALL.intersection(text.lower().split())
    best, second, name = 0, 0, before
    for lang, own in _SETS.items():
        n = len(words & own)
        if n > best:
            best, second, name = n, best, lang
        elif n > second:
            second = n
    return name if best > second else before
