"""Personal information in free text: its place and kind, and the text with typed, format-preserving pseudonyms."""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import arrow_map, spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

#: Words that end a name or a suburb written in lower case, and are no names.
STOP = set(
    "a about above across after again against ahead all along also although an and any are as asking at because been before behind being below beside between beyond both but by can could did do does during each either every for from had has have he her here him his how i if in inside into is it its just keeps like may me might more most must my near neither no nor not of off on once one only onto or our out outside over own per please provided shall she should since so than that the their them then there these they this those though through to told too under unless until up upon us via was we were what when where whereas whether which while who whom whose why will with within without would yet you your yesterday today tomorrow".split()
)
DETERMINERS = set("a an the this that these those each every our your their its his her my one any some all no".split())
#: Given names that are ordinary words too; alone they are names only where something introduces them.
WORDY = set("april may june august mark will bill rich rose hope grace faith frank penny chase sterling jasper basil dale dean drew earl glen grant guy heath hunter jade joy lance miles olive ray robin ruby sandy summer violet wade ivy daisy lily iris crystal victor max art gene norm pat sue wren felix leo dara".split())
#: Words of businesses, which follow no person's name.
BUSINESS = set("ltd pty plc inc llc llp co corp company group partners trust holdings collective co-op coop cooperative gmbh ag sa sarl bv sons & limited incorporated associates brothers foundation society club bank".split())
TITLE = r"(?:mr|mrs|ms|mx|miss|dr|prof|professor|sir|dame|rev|hon)\b\.?"
STREET = r"(?:street|st|road|rd|avenue|ave|av|lane|ln|drive|dr|court|crt|ct|parade|pde|crescent|cres|cr|place|pl|terrace|tce|way|highway|hwy|close|cl|boulevard|blvd|bvd|esplanade|esp|grove|gr|square|sq|quay|walk|circuit|cct|rise|row|mews|loop|track|gardens|promenade)"
STATE = r"(?:NSW|VIC|QLD|SA|WA|TAS|NT|ACT|New South Wales|Victoria|Queensland|South Australia|Western Australia|Tasmania|Northern Territory)"

EMAIL = re.compile(r"[^\W_][\w.+%'-]*@[^\W_][\w-]*(?:\.[^\W_][\w-]*)+")
EMAIL_SAID = re.compile(r"(?i)[^\W_][\w.+%-]*\s?(?:[(\[{<]\s?at\s?[)\]}>]\s?[^\W_][\w-]*(?:(?:\s?(?:[(\[{<]\s?dot\s?[)\]}>]|\bdot\b)\s?|\.)[^\W_][\w-]*)+|\bat\s[^\W_][\w-]*(?:\.[\w-]+)*(?:\sdot\s[^\W_][\w-]*(?:\.[\w-]+)*)+)")
ID = re.compile(
    r"(?i)\b(?:tfn|abn|acn|a\.b\.n\.|t\.f\.n\.|a\.c\.n\.|ssn|nino|dl|crn|nhs|tax\s+(?:file|identification|payer)|tax\s+id|(?:australian\s+)?business|company\s+registration|passport|travel\s+document|(?:driver'?s?|driver’s|driving)\s+licen[cs]e|licen[cs]e|medicare|health(?:\s+insurance|\s+care|\s+fund)?\s+card|health\s+card|pension\s+card|identity(?:\s+card|\s+document)?|identification|id\s+card|national\s+id|social\s+security|national\s+insurance|personnummer|steuer-?id|steuernummer|ausweis|numéro\s+fiscal|dni|nie|pasaporte|passeport|reisepass)"
    r"(?:\s+(?:card|no\.?|nos?\.|number|num\.?|nr\.?|id))*(?:\s+on\s+file)?\s*(?:(?:is|was|ist|est|es)\b|:|=|#|–|-)?\s*(?:number\s+)?"
    r"(?P<v>(?=[A-Za-z]{0,4}[ -]?\d)[A-Za-z]{0,4}[ -]?\d(?:[ \-./]{0,1}\d){3,15}(?:[A-Za-z]\b)?(?!\w))"
)
PHONE = re.compile(r"(?<![\w$€£#@/])(?<!\d[.,:-])(?P<n>\+\d{1,3}[\s.-]?(?:\(\d{1,4}\)[\s.-]?)?\d{1,4}(?:[\s.-]?\d{2,4}){1,4}|\(\d{2,4}\)[\s.-]?\d{3,4}[\s.-]?\d{3,4}|0\d{1,4}(?:[\s.-]?\d{2,4}){1,4}|1[38]00(?:[\s.-]?\d{2,3}){2,3}|13(?:[\s.-]?\d{2}){2}|\d{3}[.-]\d{3}[.-]\d{4})(?P<x>,?\s*(?:ext(?:ension)?\.?|x)\s*\d{1,6})?(?![\w/]|[.,-]\d)", re.I)
CALLED = re.compile(r"(?i)(?:call|ring|phone|tel|telephone|mobile|cell|text|fax|reach|dial|number|whatsapp|sms)\W[^.!?\n]{0,40}$")
OTHER_NUMBER = re.compile(r"(?i)\b(?:invoice|ticket|receipt|shipment|consignment|product|order|tracking|batch|version|parcel|serial|sku|item|docket|booking|case|reference|ref|code|part|model|asset|barcode|policy)\b[^.!?\n]{0,14}$")
ADDRESS = re.compile(
    r"(?P<pre>\b(?:unit|level|shop|suite|apartment|apt|flat|floor|lot|office|villa|townhouse|lvl|ste)\s+\d{0,4}[A-Za-z]?(?<=[\dA-Za-z]),?\s+)*"
    r"(?<![\w$€£.,/-])(?:\d{1,4}[A-Za-z]?\s?/\s?)?\d{1,5}[A-Za-z]?(?:\s?-\s?\d{1,5}[A-Za-z]?)?,?\s+(?P<name>(?:[^\W\d_][\w'’-]*\s+){1,3}?)" + STREET + r"\b\.?(?P<rest>)", re.I
)
PO_BOX = re.compile(r"(?i)\b(?:p\.?\s?o\.?|gpo)\s+box\s+\d{1,6}(?P<rest>)")
AFTER = re.compile(r"(?:,?\s+(?P<suburb>[A-Z][\w'’-]*(?:\s+[A-Z][\w'’-]*){0,2}?))??(?:,?\s+(?P<state>" + STATE + r")\b)?(?:,?\s+(?P<post>\d{4})\b)")
PLACE = re.compile(r",?\s+(?P<suburb>[A-Z][\w'’-]+(?:\s+[A-Z][\w'’-]+){0,2})")
STATE_POST = re.compile(r",?\s+" + STATE + r"\b(?:,?\s+\d{4}\b)?|,?\s+\d{4}\b(?!\s*[%/.-]?\d)", re.I)

_W = r"(?:[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’][^\W\d_]+)?(?:-[^\W\d_a-zß-öø-ÿ][\w'’]*)*)"
_PART = r"(?:(?i:van|von|de|der|den|del|della|da|di|la|le|du|al|bin|ibn|ten|ter)\s+){0,3}"
WORD = re.compile(_W)
SURNAME = re.compile(rf"(?:[A-Z]\.\s+)?{_PART}{_W}(?:\s+(?!I\b){_PART}{_W})?")
TITLED = re.compile(rf"(?i:{TITLE})\s+(?P<n>{SURNAME.pattern})")
NAME = re.compile(rf"(?:(?P<s1>{_PART}{_W}),\s+(?P<g1>{_W}(?:\s+[A-Z]\.)?)|(?P<i2>[A-Z]\.(?:\s?[A-Z]\.){{0,2}}\s+{_PART}{_W})|(?P<g3>{_W})(?:\s+(?P<m3>[A-Z]\.)(?![A-Za-z]))?(?:\s+(?P<s3>{_PART}{_W}))?)")
_w = r"[^\W\d_][\w'’-]*"
LOWER = re.compile(rf"(?:{_w},\s+{_w}|{_w}(?:\s+[a-z]\.)?(?:\s+(?:van|von|de|der|den|da|di|la|le|al)\s+{_w}|\s+{_w})?)")
CUE = re.compile(
    r"(?i)(?:\bmy\s+name\s+is|\bi\s+am|\bi['’]m|\bthis\s+is|\bit['’]s|\bregards,?|\bsincerely,?|\bcheers,|\bthanks,|\bcc:?|\bsigned(?:\s+off)?\s+by|\bspeak\s+to|\bspoke\s+(?:to|with)|\bask\s+for|\btell|\bnamed|\bcalled|\baccording\s+to|\bmy\s+(?:partner|wife|husband|colleague|boss|brother|sister|son|daughter|mother|father|accountant)|\byesterday,?|\bplease\s+add|\bwho\s+is|\bcame\s+from|\bor\s+so|\bis\s+in|\bcontact|\battention:?|\battn:?|\bdear|\bhello|\bmet\s+with|\bmanager|\bdirector|\badviser|\badvisor|\banalyst|\baccountant|\bsecretary|\bbookkeeper|\b" + TITLE.replace(r"\b\.?", "") + r"\b\.?)\s+(?=[^\W\d_])"
)
#: Cues that stand before much besides names: behind them a name must be known, have a surname, or be followed by a telling word.
LOOSE = re.compile(r"(?i)(?:this\s+is|it['’]s|i\s+am|i['’]m|is\s+in|tell|yesterday,?|called|thanks,|my\s+accountant|hello|dear|contact|director|analyst|secretary|accountant|bookkeeper|cheers,|manager|adviser|advisor)\s+$")
TELLING = re.compile(r"(?i)\s+(?:again|here|at\s+your|speaking|from|reviews|expects|says|said|told|that)\b|\s+and\s+[^.!?]{2,40}['’]s\s|['’]s\s+[a-z]|\s*\(|,\s+(?:an?|our|the|my)\b|\s+and\s+i\b")


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    kind: str


def _words_back(spaced: str, at: int, n: int) -> int:
    """Where the ``n`` words before ``at`` begin, however long they are; white space is one space each."""
    for _ in range(n + 1):
        at = spaced.rfind(" ", 0, at)
        if at < 0:
            return 0
    return at + 1


def _words_on(spaced: str, at: int, n: int) -> int:
    """Where the ``n`` words behind ``at`` end."""
    for _ in range(n + 1):
        at = spaced.find(" ", at + 1)
        if at < 0:
            return len(spaced)
    return at


class Finder:
    """Finds personal data in one text. ``names``: known given names, neither complete nor unambiguous."""

    def __init__(self, names: list[str]):
        self.known = {n.casefold() for n in names if n}
        self.scan = ahocorasick.Automaton()  # one pass names the places where the patterns below are tried
        words: dict[str, list[str]] = {}
        for kind, literals in (("cue", CUES), ("id", ID_WORDS), ("street", STREETS), ("said", SAID), ("name", sorted(self.known - WORDY))):
            for w in literals:
                words.setdefault(w, []).append(kind)
        for w, kinds in words.items():
            self.scan.add_word(w, (len(w), tuple(kinds)))
        self.scan.make_automaton()

    def pieces(self, text: str | None) -> list[Piece]:
        """All pieces in text order; of overlapping ones the first of e-mail, identity number, phone, address and name stays.

        Null and empty texts have none. Whole texts are read, whatever their length.
        """
        if not text:
            return []
        found: list[Piece] = []
        taken: list[tuple[int, int]] = []

        def add(s: int, e: int, kind: str) -> None:
            if s < e and not any(s < b and a < e for a, b in taken):
                taken.append((s, e))
                found.append(Piece(s, e, kind))

        at: dict[str, list[tuple[int, int]]] = {}
        low = text.lower().translate(_SPACES)
        if len(low) != len(text):  # a few letters grow in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text).translate(_SPACES)
        for last, (size, kinds) in self.scan.iter(low):
            s = last - size + 1
            if s and low[s - 1].isalnum() and low[s].isalnum():
                continue
            for kind in kinds:
                at.setdefault(kind, []).append((s, last + 1))
        if "@" in text:
            for m in EMAIL.finditer(text):
                add(*m.span(), "email")
        for s, e in at.get("said", ()):
            for m in EMAIL_SAID.finditer(text, _words_back(low, s, 4), _words_on(low, e, 30)):
                add(*m.span(), "email")
        for s, _ in at.get("id", ()):
            if (m := ID.match(text, s)) and sum(c.isdigit() for c in m["v"]) >= 5:
                s, e = m.span("v")
                add(s + len(m["v"]) - len(m["v"].lstrip(" -")), e, "id_number")
        if _DIGITS.search(text):
            for m in PHONE.finditer(text):
                if self._is_phone(text, m):
                    add(*m.span(), "phone")
        for s, e in at.get("street", ()):
            if e < len(low) and low[e].isalnum():
                continue
            if low[e - 3 : e] == "box":
                if m := PO_BOX.search(text, max(0, s - 8), min(len(text), e + 12)):
                    add(m.start(), self._suburb(text, m.end(), True), "street_address")
                continue
            for m in ADDRESS.finditer(text, _words_back(low, s, 14), min(len(text), e + 1)):
                a, b = self._address(text, m)
                add(a, b, "street_address")
        for s, e in self._names(text, low, at):
            add(s, e, "person_name")
        return sorted(found, key=lambda p: p.start)

    @staticmethod
    def _is_phone(text: str, m: re.Match) -> bool:
        n = m["n"]
        digits = sum(c.isdigit() for c in n)
        if OTHER_NUMBER.search(text, max(0, m.start() - 30), m.start()):
            return False
        if n[0] == "+":
            return 8 <= digits <= 15
        if n[0] == "(" or n.startswith(("1800", "1300")):
            return 8 <= digits <= 11 if n[0] == "(" else digits == 10
        if n[0] == "0":
            return digits == 10 or (8 <= digits <= 12 and bool(CALLED.search(text, max(0, m.start() - 60), m.start())))
        return (digits == 10 or digits == 6) and bool(CALLED.search(text, max(0, m.start() - 60), m.start()))

    def _address(self, text: str, m: re.Match) -> tuple[int, int]:
        name = m["name"].split()
        if any(w.lower() in STOP for w in name) or name[0].lower() in MONTHS or name[0][0].islower() != name[-1][0].islower():
            return 0, 0
        end = m.end()
        if text[end - 1] == "." and not re.match(r"\s+(?:[a-z]|" + STATE + r"\b)|,", text[end : end + 24]):
            end -= 1
        s = m.start()
        return s, self._suburb(text, end, name[0][0].isupper())

    @staticmethod
    def _suburb(text: str, end: int, cased: bool) -> int:
        """The end of what follows a street: suburb, state and postcode as far as they are given."""
        at = end
        if cased:
            m = PLACE.match(text, at)
            if m and (text[at] == "," or STATE_POST.match(text, m.end()) or re.fullmatch(STATE, m["suburb"]) or text[end - 1].isupper()):
                words = m["suburb"].split()
                keep = len(words)
                for k, w in enumerate(words):
                    if w.lower() in STOP:
                        keep = k
                        break
                if keep:
                    stop, left = m.start("suburb"), keep
                    for w in re.finditer(r"\S+", m["suburb"]):
                        if left == 0:
                            break
                        stop, left = m.start("suburb") + w.end(), left - 1
                    at = stop
        else:
            # written in lower case: words up to a function word or punctuation; a verb before a determiner is left out
            words: list[tuple[str, int]] = []
            p = at
            while len(words) < 4 and (m := re.compile(r",?\s+([^\W\d_][\w'’-]*)").match(text, p)):
                w = m.group(1)
                if w.lower() in STOP or re.fullmatch(STATE, w, re.I):
                    break
                words.append((w.lower(), m.end()))
                p = m.end()
            nxt = re.compile(r"\s+([^\W\d_]+)").match(text, p)
            if words and nxt and nxt.group(1).lower() in DETERMINERS:
                words.pop()
            if words and len(words) <= 3:
                at = words[-1][1]
        if m := STATE_POST.match(text, at):
            at = m.end()
            if m2 := re.compile(r",?\s+\d{4}\b").match(text, at):
                at = m2.end()
        return at

    # -- names

    def _names(self, text: str, low: str, at: dict) -> Iterator[tuple[int, int]]:
        done: set[int] = set()
        for s, e in at.get("cue", ()):
            m = CUE.match(text, s)
            if not m or m.end() in done:
                continue
            done.add(m.end())
            title = _TITLE_END.search(text, m.start(), m.end())
            yield from self._after_cue(text, m.end(), bool(LOOSE.search(text, m.start(), m.end())) and not title, bool(title))
        for s, e in at.get("name", ()):
            if (s and text[s - 1] in "'’@._-") or (e < len(text) and (text[e].isalnum() or text[e] in "@_")) or not text[s].isupper():
                continue
            if (got := self._read(text, s)) and got[0] == s and not self._business(text, got[1]) and not text[s:e].isupper():
                yield got

    def _after_cue(self, text: str, p: int, loose: bool, title: bool) -> Iterator[tuple[int, int]]:
        for k in range(4):  # names joined by "and"
            loose = loose and not k and not TITLED.match(text, p)
            got = self._read(text, p, title)
            if got is None:
                got = self._read_lower(text, p, loose, k > 0)
            if got is None:
                return
            s, e = got
            if self._business(text, e):
                return
            first = WORD.match(text, s)
            plain = text[s:e].casefold()
            known = any(w in self.known for w in re.findall(r"[^\W\d_]+", plain))
            several = len(re.findall(r"[^\W\d_]+", plain)) > 1
            if loose and not (known or (several and TELLING.match(text, e)) or (several and first and re.match(r"[A-Z]\.", text[s : s + 2]))):
                if not (TELLING.match(text, e) and known) and not (several and first and not text[s:e].islower() and _PERSONAL.search(text, max(0, s - 40), s)):
                    return
            yield got
            nxt = _AND.match(text, e)
            if not nxt:
                return
            p = nxt.end()
            if t := re.compile(rf"(?i)(?:{TITLE})\s+").match(text, p):
                p, title = t.end(), True
            else:
                title = False

    def _read(self, text: str, p: int, title: bool = False) -> tuple[int, int] | None:
        """A name in capitals or with capital initials that starts at ``p``; a title in front is left out."""
        if m := TITLED.match(text, p):
            return m.span("n")
        m = NAME.match(text, p)
        if not m:
            return None
        if title and (m2 := SURNAME.match(text, p)):
            return m2.span()
        if m["s1"]:
            given = m["g1"].split()[0]
            if given.lower() in STOP and given.casefold() not in self.known or m["s1"].lower() in STOP or m["s1"].lower() in MONTHS and given.casefold() not in self.known:
                return self._one(text, m.start("s1"), m.end("s1"))
            if given.casefold() in self.known or (m["s1"].casefold() not in self.known and not self._business(text, m.end()) and len(m["s1"].split()) == 1 and not title):
                return m.start(), m.end()
            return self._one(text, m.start("s1"), m.end("s1"))
        if m["i2"]:
            return m.start(), m.end()
        g = m["g3"]
        if g.lower() in STOP and g.casefold() not in self.known or len(g) < 2:
            return None
        end = m.end("g3")
        if m["m3"]:
            end = m.end("m3")
        if m["s3"] and m["s3"].split()[-1].lower() not in STOP and m["s3"].lower().split()[-1] not in BUSINESS:
            end = m.end("s3")
        if text[end - 2 : end].lower() in ("'s", "’s"):
            end -= 2
        return m.start(), end

    @staticmethod
    def _one(text: str, s: int, e: int) -> tuple[int, int] | None:
        return None if text[s:e].lower() in STOP or e - s < 2 else (s, e)

    def _read_lower(self, text: str, p: int, loose: bool, joined: bool) -> tuple[int, int] | None:
        m = LOWER.match(text, p)
        if not m or not text[p].islower():
            return None
        words = re.findall(r"[^\W\d_][\w'’-]*", m.group())
        if words[0] in STOP and not (words[0] in self.known and len(words) > 1 and words[1] not in STOP):
            return None
        if len(words) > 1 and "," in m.group():
            if words[1].casefold() in self.known:
                return m.span()
            words, e = words[:1], p + len(words[0])
        else:
            e = m.end()
        if len(words) > 1 and words[-1] in STOP:
            e = p + len(words[0])
            words = words[:1]
        if text[e - 2 : e] in ("'s", "’s"):
            e -= 2
        if words[0].casefold() in self.known and (words[0] not in WORDY or len(words) > 1):
            return p, e
        if not loose and len(words) >= 2 and not any(_ORDINARY.search(w) for w in (words[0], words[-1])):
            follow = _NEXT_WORDS.match(text, e).group().split()
            if joined or TELLING.match(text, e) or not follow or follow[0].lower().strip(".,") in STOP:
                return p, e
        return None

    @staticmethod
    def _business(text: str, e: int) -> bool:
        for w in _NEXT_WORDS.match(text, e).group().split():
            if w.lower().strip(".,") in BUSINESS:
                return True
            if not (w[0].isupper() or w == "&"):
                return False
        return False


_SPACES = {9: " ", 10: " ", 13: " ", 160: " ", 8239: " ", 8217: "'"}
_TITLE_END = re.compile(rf"(?i)(?:{TITLE})\s+$")
#: Literals in lower case at which the patterns are tried.
CUES = [w.strip() for w in "my name is;i am;i'm;this is;it's;regards;sincerely;cheers;thanks;cc;signed by;signed off by;speak to;spoke to;spoke with;ask for;tell;named;called;according to;my partner;my wife;my husband;my colleague;my boss;my brother;my sister;my son;my daughter;my mother;my father;my accountant;yesterday;please add;who is;came from;or so;is in;contact;attention;attn;dear;hello;met with;manager;director;adviser;advisor;analyst;accountant;secretary;bookkeeper;mr;mrs;ms;mx;miss;dr;prof;professor;sir;dame;rev;hon".split(";")]
ID_WORDS = "tfn;abn;acn;a.b.n.;t.f.n.;a.c.n.;ssn;nino;dl;crn;nhs;tax file;tax identification;tax payer;tax id;business;company registration;passport;travel document;driver;driving;licence;license;medicare;health;pension card;identity;identification;id card;national id;social security;national insurance;personnummer;steuer;ausweis;numéro fiscal;dni;nie;pasaporte;passeport;reisepass".split(";")
STREETS = [" " + w for w in "street;st;road;rd;avenue;ave;av;lane;ln;drive;dr;court;crt;ct;parade;pde;crescent;cres;cr;place;pl;terrace;tce;way;highway;hwy;close;cl;boulevard;blvd;bvd;esplanade;esp;grove;gr;square;sq;quay;walk;circuit;cct;rise;row;mews;loop;track;gardens;promenade;box".split(";")]
SAID = ["(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", " dot "]
MONTHS = set("january february march april may june july august september october november december".split())
_DIGITS = re.compile(r"\d(?:[\s().\-/]{0,3}\d){4}")
#: Endings of ordinary words, which unknown names in lower case seldom have.
_ORDINARY = re.compile(r"(?:s|ed|ing|tion|ment|al|ive|ly|ous|able|ible|ance|ence|ity|ness|ager|ser|sor|ist|ant|ent|ate|ble|ful|less|ry|ty|th|ee|ive)$")
_AND = re.compile(r"\s+(?:and|&|und|et|y)\s+", re.I)
_NEXT_WORDS = re.compile(r"(?:\s+[\w&'’.-]+){0,3}")
_PERSONAL = re.compile(r"(?i)(?:name\s+is|manager|adviser|advisor|director)\s+$")

# ---------------------------------------------------------------------------- pseudonyms

ROUNDS = 10


def feistel(value: int, size: int, key: bytes, tweak: str = "") -> int:
    """A keyed permutation of range(size): a balanced Feistel network over the next square, walked until it falls inside."""
    if size < 2:
        return value
    side = math.isqrt(size - 1) + 1
    label = f"{tweak}|{size}|".encode()
    x = value
    while True:
        a, b = divmod(x, side)
        for r in range(ROUNDS):
            digest = hashlib.blake2b(label + b"%d|%d" % (r, b), digest_size=8, key=key[:64]).digest()
            a, b = b, (a + int.from_bytes(digest, "big")) % side
        x = a * side + b
        if x < size:
            return x


def _tfn_digit(d: str) -> int:
    """The ninth digit that validates eight; 10 where there is none."""
    return sum(int(c) * w for c, w in zip(d, (1, 4, 3, 7, 5, 8, 6, 9))) % 11


def _abn_digits(d: str) -> str:
    """The two leading digits that validate nine."""
    return str(-sum(int(c) * w for c, w in zip(d, (3, 5, 7, 9, 11, 13, 15, 17, 19))) % 89 + 10)


def _luhn_digit(d: str) -> str:
    return str(-sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(d))) % 10)


def _permute(d: str, key: bytes, tweak: str) -> str:
    """Digits permuted among those of their length; a number with valid check digits among the valid ones: the free
    digits are permuted and the check digits made anew."""
    move = lambda x, t: str(feistel(int(x), 10 ** len(x), key, f"{tweak}{t}{len(d)}")).zfill(len(x))
    if len(d) == 11 and d[0] != "0" and _abn_digits(d[2:]) == d[:2]:
        free = move(d[2:], "abn")
        return _abn_digits(free) + free
    if len(d) == 9 and _tfn_digit(d[:8]) == int(d[8]):
        free = move(d[:8], "tfn")
        while _tfn_digit(free) == 10:  # no valid number begins so: walk on along the permutation
            free = move(free, "tfn")
        return free + str(_tfn_digit(free))
    if len(d) >= 12 and _luhn_digit(d[:-1]) == d[-1]:
        free = move(d[:-1], "luhn")
        return free + _luhn_digit(free)
    valid = lambda x: len(x) == 11 and x[0] != "0" and _abn_digits(x[2:]) == x[:2] or len(x) == 9 and _tfn_digit(x[:8]) == int(x[8]) or len(x) >= 12 and _luhn_digit(x[:-1]) == x[-1]
    out = move(d, "")
    while valid(out):  # invalid numbers stay among themselves, so that equal results come from equal numbers only
        out = move(out, "")
    return out


def permute_number(text: str, key: bytes, tweak: str = "") -> str:
    """Digits and letters permuted in place: separators, lengths and letter case stay, and a number with valid check
    digits becomes another valid one. Equal digits give equal results whatever the separators."""
    digits = "".join(c for c in text if c.isdigit() and c.isascii())
    d = _permute(digits, key, tweak) if digits else ""
    out, k = [], 0
    for i, c in enumerate(text):
        if c.isdigit() and c.isascii():
            out.append(d[k])
            k += 1
        elif c.isascii() and c.isalpha():
            x = chr(97 + feistel(ord(c.lower()) - 97, 26, key, f"{tweak}letter{i}"))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


DATE = re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b")


def permute_date(text: str, key: bytes) -> str:
    """An ISO date permuted among all dates of 1900 to 2099; a text that is no such date stays."""
    import datetime

    first, days = datetime.date(1900, 1, 1), 73_049
    try:
        n = (datetime.date.fromisoformat(text) - first).days
    except ValueError:
        return text
    return (first + datetime.timedelta(days=feistel(n, days, key, "date"))).isoformat() if 0 <= n < days else text


_MONTHS = [m.split() for m in ("january januar janvier enero jan jän janv ene", "february februar février febrero feb févr", "march märz mars marzo mar mrz", "april april avril abril apr avr abr", "may mai mai mayo", "june juni juin junio jun", "july juli juillet julio jul juil", "august august août agosto aug ago", "september september septembre septiembre sept sep", "october oktober octobre octubre oct okt", "november november novembre noviembre nov", "december dezember décembre diciembre dec dez déc dic")]
_MONTH = {w: k + 1 for k, words in enumerate(_MONTHS) for w in words}
_M = "(?:" + "|".join(sorted(_MONTH, key=len, reverse=True)) + r")\b\.?"
#: Dates by the order of their parts; years have four digits, or two behind a day and a month.
_WRITTEN = rf"\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-/.]\s?\d{{1,2}}[-/.]\s?(?:\d{{4}}|\d{{2}})|\d{{1,2}}(?:st|nd|rd|th|er|\.)?[\s-]+(?:of\s+|de\s+)?{_M},?[\s-]+(?:de\s+|del\s+)?\d{{4}}|{_M}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}"
_PART = re.compile(rf"(?i)\d+(?:st|nd|rd|th|er)?|{_M}")


def permute_written_date(text: str, key: bytes) -> str:
    """A date in a usual format permuted as :func:`permute_date` does, in the same format; where day and month may be either, the day is first."""
    parts = list(_PART.finditer(text))
    if len(parts) != 3:
        return text
    raw = [p.group() for p in parts]
    number = [_MONTH.get(w.rstrip(".").casefold()) or int(re.match(r"\d+", w).group()) for w in raw]
    if len(raw[0]) == 4 and raw[0].isdigit():
        order = "ymd"
    elif not raw[0][0].isdigit() or raw[1][0].isdigit() and number[1] > 12:
        order = "mdy"
    else:
        order = "dmy"
    y, m, d = (number[order.index(c)] for c in "ymd")
    short = len(raw[order.index("y")]) == 2
    iso = f"{y + 1900 * short:04}-{m:02}-{d:02}"
    new = permute_date(iso, key)
    if new == iso:
        return text
    made = dict(zip("ymd", map(int, new.split("-"))))
    out, at = [], 0
    for c, p, w in zip(order, parts, raw):
        if w[0].isdigit():
            v = f"{made[c] % 100:02}" if c == "y" and short else f"{made[c]:0{len(re.match(r'[0-9]+', w).group())}}"
            v += re.sub(r"\d+", "", w)
        else:  # the same language and length of name
            forms = _MONTHS[number[order.index("m")] - 1]
            k = forms.index(w.rstrip(".").casefold())
            v = _MONTHS[made["m"] - 1][min(k, 3) if k < 4 and len(_MONTHS[made["m"] - 1]) > 3 else 0]
            v = v.capitalize() if w[0].isupper() else v
        out += [text[at : p.start()], v]
        at = p.end()
    return "".join(out) + text[at:]


_EXT = re.compile(r"(?i)(,?\s*(?:ext(?:ension)?\.?|x)\s*)(\d+)$")


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """What stands for a value: a permuted number in the same format, else a keyed mark of the value without case and spacing."""
    if kind in ("id_number", "phone"):
        m = _EXT.search(value) if kind == "phone" else None
        head, tail = (value[: m.start()], m.group(1) + permute_number(m.group(2), key, "ext")) if m else (value, "")
        return permute_number(head, key, kind) + tail
    plain = re.sub(r"\s*[(\[{<]?\bat\b[)\]}>]?\s*", "@", re.sub(r"\s*[(\[{<]?\bdot\b[)\]}>]?\s*", ".", value.casefold())) if kind == "email" else " ".join(re.findall(r"\w+", value.casefold()))
    return hmac.new(key, f"{kind}|{plain}".encode(), hashlib.sha256).hexdigest()[:10]


BORN = re.compile(r"(?i)\b(?:born(?:\s+on)?|d\.?o\.?b\.?|date\s+of\s+birth|geboren(?:\s+am)?|née?\s+le|nacid[oa]\s+el)(?:\s+is)?\s*:?\s*(" + _WRITTEN + r")\b")


def redact(text: str, pieces: list[Piece], key: bytes) -> str:
    """The text with ``[kind pseudonym]`` in place of each piece; dates of birth in usual forms are permuted where they stand."""
    out, at = [], 0
    for p in pieces:
        out.append(text[at : p.start])
        out.append(f"[{p.kind} {pseudonym(text[p.start : p.end], p.kind, key)}]")
        at = p.end
    out.append(text[at:])
    return BORN.sub(lambda m: m.group()[: m.start(1) - m.start()] + permute_written_date(m.group(1), key), "".join(out))


# ---------------------------------------------------------------------------- operators


def _find(names: list[str], key: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("tbl", "rec_id", "turn", "start_pos", "end_pos", "kind", "pseudonym")}
            for tbl, i, turn, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                for p in finder.pieces(text):
                    for c, v in zip(out, (tbl, i, turn, p.start, p.end, p.kind, pseudonym(text[p.start : p.end], p.kind, key) if key else None)):
                        out[c].append(v)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return run


def _redact(names: list[str], key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for b in batches:
            texts = b.column(3).to_pylist()
            made = [None if t is None else redact(t, finder.pieces(t), key) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.string())], ["tbl", "rec_id", "turn", "text"])

    return run


#: Most known given names that are sent to executors with the function.
MAX_NAMES = 1_000_000


def _known_names(names: DataFrame) -> list[str]:
    got = [r[0] for r in names.select("name").filter("name is not null").distinct().limit(MAX_NAMES + 1).collect()]
    if len(got) > MAX_NAMES:
        raise ValueError("the list of given names is too large to send with a function")
    return sorted(got)


def find_personal(texts: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """Every piece of personal data in ``texts`` (tbl, rec_id, turn, text), with its pseudonym; one pass without a shuffle.

    Equal numbers have equal pseudonyms in every document, in any spelling; so have names and addresses of e-mail but
    for case and spacing. Null texts have no piece.
    """
    return arrow_map(spread(texts.select("tbl", "rec_id", "turn", "text").filter(F.col("text").isNotNull())), _find(_known_names(names), key), "tbl string, rec_id bigint, turn int, start_pos int, end_pos int, kind string, pseudonym string")


def redact_personal(texts: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """``texts`` with typed placeholders; see :func:`find_personal`. Null texts stay null."""
    return arrow_map(spread(texts.select("tbl", "rec_id", "turn", "text")), _redact(_known_names(names), key), "tbl string, rec_id bigint, turn int, text string")
