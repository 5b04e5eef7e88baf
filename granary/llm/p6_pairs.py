"""Broken question and response pairs."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from granary.llm.languages import language_votes, winner
from granary.session import arrow_map, spread

#: What stands for nothing, after case, brackets and punctuation are dropped.
PLACEHOLDERS = set(
    "none;null;nil;nan;na;n a;empty;blank;missing;undefined;no response;no answer;no response given;no answer given;no content;not available;not provided;not applicable;unknown;left blank;"
    "empty response;empty answer;response;answer;tbd;tba;todo;void;no data;pending;none given;"
    "keine;keine antwort;leer;nicht verfügbar;keine angabe;k a;ohne antwort;aucune;aucune réponse;vide;pas de réponse;sans réponse;néant;sans objet;"
    "ninguna;ninguno;sin respuesta;vacío;vacio;no disponible;sin contenido;nada;无;無;空;空白;无回答;無回答;なし;回答なし;未回答;कोई उत्तर नहीं;रिक्त;ไม่มี;ไม่มีคำตอบ;ว่าง;لا يوجد;لا إجابة;فارغ".split(";")
)
#: Phrases that decline. They are matched in lower case with straight apostrophes.
REFUSALS = [
    *[f"{a} {b}" for a in ("i can't", "i cannot", "i can not", "i am unable to", "i'm unable to", "i am not able to", "i'm not able to", "i won't", "i will not", "i must decline to", "i have to decline to", "i decline to", "i am not permitted to", "i'm not permitted to", "i am not allowed to", "i'm not allowed to", "i would rather not", "i'd rather not", "we cannot", "we can't", "we are unable to", "i do not feel able to", "i'm not in a position to", "i am not in a position to", "i refuse to", "unable to", "not able to")
      for b in ("answer", "assist", "help", "respond", "provide", "give", "offer", "comply", "discuss", "pick", "choose", "select", "engage", "continue", "complete", "fulfil", "fulfill", "share", "advise", "comment", "recommend", "say which", "address", "support", "do that", "do this", "handle", "take part", "process")],
    "against my guidelines", "against my policy", "against our guidelines", "against our policy", "goes against the guidelines", "it would be inappropriate", "would not be appropriate", "not appropriate for me", "as an ai", "as an automated assistant", "as a language model", "i must decline", "i have to decline", "must respectfully decline", "i decline",
    "not something i can", "nothing i can help with", "can't be of help", "cannot be of help", "asked not to answer", "been asked not to", "been told not to", "instructed not to", "outside what i can", "outside my scope", "beyond what i can", "beyond my scope", "not permitted to answer", "unable to answer", "decline to answer", "decline to respond", "refrain from answering", "my instructions prevent", "my guidelines prevent", "do not allow me to", "don't allow me to", "i'm afraid i can't", "i am afraid i cannot", "no comment on this", "rather not take", "rather not say", "not take a position", "no position on this", "cannot take a position", "can't take a position", "not comfortable answering",
    "ich kann nicht", "ich kann diese", "kann ich nicht", "kann ich leider nicht", "ich darf nicht", "darf ich nicht", "nicht beantworten", "keine antwort geben", "ich muss ablehnen", "lehne ich ab", "möchte ich nicht", "es wäre unangemessen", "gegen meine richtlinien", "nicht behilflich sein", "leider nichts sagen", "nichts dazu sagen", "möchte dazu nichts", "keine stellung nehmen", "nicht weiterhelfen", "nicht helfen", "bin nicht in der lage", "bin ich nicht in der lage", "als automatischer assistent", "als ki",
    "je ne peux pas", "je ne peux", "je ne suis pas en mesure", "je ne suis pas autorisé", "je dois refuser", "je dois décliner", "je refuse", "je préfère ne pas", "il serait inapproprié", "contraire à mes", "contre mes consignes", "je regrette de ne pas pouvoir", "impossible de répondre", "pas possible de répondre", "en tant qu'assistant", "en tant qu'ia", "ne peux pas vous aider", "pas vous aider",
    "no puedo", "no me es posible", "no estoy en condiciones", "no estoy autorizado", "no estoy autorizada", "debo rechazar", "debo declinar", "tengo que rechazar", "sería inapropiado", "sería inadecuado", "no sería apropiado", "va contra mis", "contra mis directrices", "contra mis normas", "prefiero no", "me niego a", "como asistente", "como ia", "no podemos responder",
    "无法回答", "不能回答", "无法提供", "不能提供", "无法协助", "无法帮助", "拒绝回答", "答えることはできません", "お答えできません", "回答できません", "お手伝いできません", "回答を控え", "उत्तर नहीं दे सकता", "उत्तर नहीं दे सकती", "मदद नहीं कर सकता", "ไม่สามารถตอบ", "ไม่สามารถช่วย", "ไม่สามารถให้", "لا أستطيع", "لا يمكنني", "أعتذر عن", "لست قادرا",
]
#: Labels that stand before an answer or its reason.
LABEL = regex.compile(r"(?im)^\s*(?:answer|reason|response|explanation|solution|rationale|antwort|grund|begründung|erklärung|réponse|reponse|raison|explication|justification|respuesta|razón|razon|explicación|motivo|答案|答え|回答|理由|原因|उत्तर|कारण|คำตอบ|เหตุผล|الإجابة|السبب|you asked|question|frage|pregunta|vous demandez|sie fragten)\s*[:：]\s*")
GIVES_LETTER = regex.compile(r"(?i)(?:^|\n)\s*(?:answer|antwort|réponse|respuesta|答案|答え|回答|उत्तर|คำตอบ|الإجابة)\s*[:：]\s*\(?[A-E]\b|\b(?:answer|antwort|réponse|respuesta|option|choice)\b[^.\n]{0,25}?\b(?:is|ist|est|es)\s+\(?[A-E]\b|\b(?-i:[A-E])\b\s+(?:is|ist|est|es)\s+(?:correct|right|best|richtig|exacte?|correcta?|juste)|^\s*\(?(?-i:[A-E])[).:]|^\s*(?-i:[A-E])\s*$|(?-i:\b[A-E]\b)\s*[,，]?\s*(?:because|since|weil|car|porque)")
LETTER_ONLY = regex.compile(r"^\W*(?:[A-E]|[a-e])\W*$")
LAST_LETTER = regex.compile(r"(?:^|\n)\s*[^\n.:：]{1,24}[:：]\s*\(?[A-Ea-e]\)?\s*$")
OPTION_LINE = regex.compile(r"(?m)^\s*\(?([A-E])[).:：]\s*")
OPTION_ANY = regex.compile(r"(?:^|\s)\(?[A-E][).]\s")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}\p{Z}\u2800\u3164\s]+")
ENDS = regex.compile(r"[.!?。！？।॥؟…．｡۔][\"'”’»」』)\]）】›]*$")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "«": "»", "“": "”", "„": "“”"}, set(")]}）」』】»”")
#: Shares of the response, and of the question's stem, that must be copied in runs of RUN words or more.
COPIED, OF_STEM, RUN = 0.70, 0.50, 3

_refusing: ahocorasick.Automaton | None = None


def refusal_automaton() -> ahocorasick.Automaton:
    global _refusing
    if _refusing is None:
        _refusing = ahocorasick.Automaton()
        for p in REFUSALS:
            _refusing.add_word(p, p)
        _refusing.make_automaton()
    return _refusing


class SuffixAutomaton:
    """All substrings of a sequence of words."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for w in words:
            cur, p = len(self.next), last
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def runs(self, words: list[str]) -> list[int]:
        """At each word, the length of the longest suffix read so far that is a substring."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            out.append(n)
        return out


def words_of(text: str) -> list[str]:
    """Words in lower case; letters of scripts without spaces are words of their own."""
    if not text.isascii() and DENSE.search(text):
        return [c for w in WORD.findall(text.lower()) for c in (w if DENSE.search(w) else [w])]
    return WORD.findall(text.lower())


def _covered(runs: list[int], least: int) -> int:
    covered, until = 0, len(runs)
    for i in range(len(runs) - 1, -1, -1):
        if runs[i] >= least:
            lo = i - runs[i] + 1
            covered += max(0, min(until, i + 1) - lo)
            until = min(until, lo)
    return covered


def copied(question: str, whole: list[str], r: list[str]) -> tuple[float, float]:
    """Shares of the response's words ``r`` and of the question's stem that stand in common runs of words; ``whole``: the question's words."""
    if not r or not whole:
        return 0.0, 0.0
    vocabulary = set(whole)
    if sum(w in vocabulary for w in r) < COPIED * len(r):  # an upper bound of what can be copied
        return 0.0, 0.0
    cut = OPTION_LINE.search(question) or OPTION_ANY.search(question)
    stem = words_of(question[: cut.start()]) if cut and cut.start() > 0 else whole
    if not stem:
        return 0.0, 0.0
    least = min(RUN, len(stem), len(r))
    of_response = _covered(SuffixAutomaton(whole).runs(r), least) / len(r)
    if of_response < COPIED:
        return of_response, 0.0
    return of_response, _covered(SuffixAutomaton(r).runs(stem), least) / len(stem)


def unclosed(text: str) -> bool:
    """Whether a bracket or quotation opened in the text is left open at its end."""
    stack: list[str] = []
    for c in text:
        if c in OPEN and not (c == "“" and stack and stack[-1] == "“”"):
            stack.append(OPEN[c])
        elif stack and c in stack[-1]:
            stack.pop()
    return bool(stack) or text.count('"') % 2 == 1


def truncated(text: str) -> bool:
    """Whether a response breaks off: no closing mark at its end, or an open delimiter, and no final answer letter."""
    t = text.strip()
    if LAST_LETTER.search(t) or LETTER_ONLY.match(t):
        return False
    if unclosed(t):
        return True
    if ENDS.search(t):
        return False
    if regex.search(r"\p{Thai}[\p{M}]*$", t):  # Thai closes sentences with no mark
        return False
    return True


#: The longest placeholder; a response of more words is none, whatever its length in characters.
MOST_WORDS = max(len(p.split()) for p in PLACEHOLDERS)


def defect(question: str | None, response: str | None) -> str | None:
    """The defect of a pair, or None.

    Null, blank and placeholder responses are ``empty``; a bare option letter is complete. Then, first match
    wins: ``refusal`` (a declining phrase and no option named), ``copies_question``, ``other_language``
    (stop-word votes, labels removed, only where both sides have clear votes), ``truncated``. A null
    question can't be copied and has no language. Whole texts are read.
    """
    if response is None:
        return "empty"
    text = unicodedata.normalize("NFC", response)
    first = [m.group() for m in itertools.islice(WORD.finditer(text.lower().replace("/", " ")), MOST_WORDS + 1)]
    bare = " ".join(first)
    if not bare or bare in PLACEHOLDERS:
        return "empty"
    if LETTER_ONLY.match(text):
        return None
    body = LABEL.sub("", text)
    words = words_of(body)
    if not words:
        return "empty"
    low = " ".join(text.lower().replace("’", "'").split())
    gives: bool | None = None
    if next(refusal_automaton().iter(low), None):
        gives = bool(GIVES_LETTER.search(text))
        if not gives:
            return "refusal"
    q = unicodedata.normalize("NFC", question) if question else ""
    if q:
        whole = words_of(q)
        of_response, of_stem = copied(q, whole, words)
        if of_response >= COPIED and of_stem >= OF_STEM and not (bool(GIVES_LETTER.search(text)) if gives is None else gives):
            return "copies_question"
        votes = language_votes(body, words)
        mine, theirs = winner(votes), winner(language_votes(q, whole))
        if mine and theirs and mine != theirs and votes.get(theirs, 0.0) * 2 < votes[mine]:
            return "other_language"
    return "truncated" if truncated(text) else None


def _defects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, kinds = [], []
        for i, q, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if d := defect(q, r):
                ids.append(i)
                kinds.append(d)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], ["seed_id", "defect"])


def find_defects(pairs: DataFrame) -> DataFrame:
    """``seed_id, defect`` for every broken pair of ``pairs`` (seed_id, question, response); see :func:`defect`.

    One pass, no shuffle but for spreading a single small file. Other columns are not read.
    """
    return arrow_map(spread(pairs.select("seed_id", "question", "response")), _defects, "seed_id bigint, defect string")
