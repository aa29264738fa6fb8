"""Sentence units of documents in many languages and scripts.

Method: document-centred disambiguation. Whether a word with a stop is an abbreviation and whether the next word is a
name is settled by what both do elsewhere, where it is unambiguous: first in the document itself; where that says
nothing, in the whole corpus, whose statistics Spark counts over all texts; where that says nothing either, by a list
of well-known abbreviations. The statistics of frequent words are sent to all tasks. Texts whose decisions ask for rarer
words that have statistics, which the first pass finds out, are split once more with those joined to them. Scripts have
their own end marks, and Thai ends a unit with white space.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import copied, dealt, hot_keys
from ..session import durable
from .arrow_text import slices, strings

# Abbreviations that something always follows in the same sentence, by language, without the last stop. These lists are
# the last resort, for words that neither the document nor the corpus knows.
_FOLLOWED = """
mr mrs ms messrs dr prof gen lt col maj sgt capt cpl adm cmdr st ft mt rev hon gov sen rep pres supt fig figs eq eqs
sec secs vol vols no nos pp p ch art cf vs v approx ca i.e e.g viz resp est
hr fr frl z.b d.h u.a bzw ggf inkl exkl evtl mio mrd nr str abs bd s vgl sog ing dipl geb kath evang
mme mlle mm mgr me chap av env éd
sr sra srta dra dña d pág págs núm art aprox ej p.ej ud uds vda
sr.ª exmo exma eng arq dr.ª tel
tj tzn np m.in dr hab inż ks św ul al pl os prof mjr płk por rys tab zob
ул т т.е т.к т.н им пр просп пер д стр рис см проф акад тыс руб кв напр
د أ م
डॉ श्री प्रो
"""
# Abbreviations that may also be the last word of a sentence.
_MAY_END = """
etc a.m p.m am pm u.n u.s u.k u.s.a e.u d.c co inc ltd corp bros plc llc jr ph.d m.d b.a m.a b.sc m.sc dept univ
jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun et al al min max avg
usw u.s.w ff e.v gmbh jh std
itd itp r w
т.д т.п др г гг в вв
"""
# Abbreviations of a year or century; the name behind one goes on with the sentence.
_OF_YEAR = "r г гг w в вв"
# German months, which follow an ordinal written with a stop.
_MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember"

FOLLOWED, MAY_END, OF_YEAR, MONTHS = (frozenset(x.split()) for x in (_FOLLOWED, _MAY_END, _OF_YEAR, _MONTHS))
#: Two-letter spellings that are abbreviations only before a number or a name, so as not to take ordinary words.
_AMBIGUOUS = frozenset("no art p s v d m me ch fr al am pm sun sat mar mon min w в д м أ os pl".split())

#: Times a word must be met for the corpus to say anything about it, whatever the size of the corpus.
LEAST = 5
#: Share of all words counted from which a word's statistics are sent to all tasks; at most 1 / share words reach it.
#: The others are joined to the texts, so it decides how they get there and nothing else.
SENT_SHARE = 2e-5
#: What the corpus says of a word: written in lower case; begins sentences; an abbreviation, by what follows its stop; a
#: title, before names only; ordinary, though met with a stop; mostly before a capital; follows the stop of a number.
COMMON, STARTER, ABBREVIATION, TITLE, ORDINARY, TENDS, ORDINAL = (1 << k for k in range(7))
LISTED = 1 << 7  # an abbreviation by the list alone
FIRM = 1 << 8  # an abbreviation that is hardly ever met before a capital

_STOPS = ".!?…‽⁇⁈⁉"
_WIDE = "。！？｡．⋯"
_OWN = "।॥؟۔។៕။።፧՜։܀܁"
_CLOSERS = "”’»›\"')\\]）］」』〉》】"
_SPAN = r"“[^“”]*”|„[^“”„]*[“”]|«[^«»]*»|‹[^‹›]*›|「[^「」]*」|『[^『』]*』|《[^《》]*》|\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|(?<!\w)\"(?=\S)[^\"]*\"|‘(?:[^‘’]|’(?=\w))*’|(?<![\w'])'(?=\w)(?:[^'\n]|'(?=\w)|\n(?!\s*\n))*(?<=[^\s'])'(?!\w)"
_POINT = re.compile(rf"[{_STOPS}{_WIDE}{_OWN}“„«‹「『《(（\['‘\"]")
_EVENT = re.compile(rf"(?P<span>{_SPAN})|(?!\.\d)[{_STOPS}]+[{_CLOSERS}]*|[{_WIDE}]+[{_CLOSERS}]*|[{_OWN}]+[{_CLOSERS}]*")
_BREAK = r"(?:\r\n|[\n\x0b\x0c\x85  ]|\r(?!\n))"
_PARAGRAPHS = re.compile(rf"{_BREAK}\s*?{_BREAK}\s*| \s*")
#: What any such stretch begins with; looked for by itself, since that is much faster.
_LINE_END = re.compile("[\r\n\x0b\x0c\x85\u2028\u2029]")
_SPACE = re.compile(r"\s+")
_AHEAD = re.compile(r"(\s*)(?:[^\w\s]*([^\W_]+))?")
_BEFORE = re.compile(r"[^\s“”„«»‹›\"()\[\]（）「」—–,;:!?¿¡/]+$")
_OPENERS = "(['‘“„\"«¿¡"
_THAI = re.compile(r"[ก-๛]")
_DEVANAGARI = re.compile(r"[ऀ-ॣ०-ॿ]")
_INNER = re.compile(r"(?<=[\w,;:]) (\S+)")
_FIRST = re.compile(r"[^\W\d_]+")
_GOES_ON = re.compile(rf"\.\s+[{re.escape(_OPENERS)}]*(?![A-Z])(\w\w?)")
_NEXT_TOKEN = re.compile(r"\w+\.?")


@dataclass
class Corpus:
    """What the whole corpus says about words."""

    common: frozenset[str] = frozenset()  # words that occur in lower case
    starters: frozenset[str] = frozenset()  # words that begin sentences
    stops: dict[str, tuple[int, int]] = field(default_factory=dict)  # word before a stop: times before a capital, times before lower case or a number
    said: dict[str, int] | None = None  # all of it as flags

    def __post_init__(self):
        if self.said is None:
            self.said = {w: COMMON for w in self.common}
            for w in self.starters:
                self.said[w] = self.said.get(w, 0) | STARTER
            for w, (capital, other) in self.stops.items():
                kind = ABBREVIATION if 4 * other > capital + other else ORDINARY
                self.said[w] = self.said.get(w, 0) | kind | (TENDS if capital > other else 0) | (FIRM if other > 4 * (capital + 1) else 0)


class Asking(dict):
    """What is known of frequent words; remembers the others that are asked for."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.asked: set[str] = set()

    def __missing__(self, word: str) -> int:
        self.asked.add(word)
        return 0


class Silent(dict):
    """What is known, and nothing of other words."""

    def __missing__(self, word: str) -> int:
        return 0


class Words:
    """What one text has of words, where it is unambiguous: the words with a stop before lower case, before a number, and
    before a capital, with the next word and whether the text has that in lower case too; the words behind a number with a stop, and behind another word with one; how
    often a form occurs."""

    def __init__(self, text: str):
        cased = not (text.islower() or text.isupper())
        self.parts = text.split() if cased else []
        self.line = " ".join(self.parts)
        self.before_lower, self.before_number, self.before_capital = {}, {}, {}
        self.ordinal, self.begins = set(), set()
        self.ending: set[str] = set()  # words with a stop before one that the text has in lower case too: they end sentences
        self._names: dict[str, int] = {}
        self._counts: dict[str, int] | None = None
        self.forms = set(self.parts)
        before = ""
        for sentence in self.line.split(". "):
            if before:
                token, gap, _ = sentence.partition(" ")
                self._stop(before.lstrip(_OPENERS), token if gap else token + ".")
            before = sentence.rpartition(" ")[2]

    @property
    def counts(self) -> dict[str, int]:
        if self._counts is None:
            self._counts = Counter(self.parts)
        return self._counts

    def _stop(self, word: str, token: str) -> None:
        if not word:
            return
        if word.isdigit():
            if len(word) <= 2 and (m := _FIRST.match(token)):
                self.ordinal.add(m[0].lower())
            return
        if not word[0].isalpha() or word[-1] == ".":
            return
        if token.isalnum():
            after = token
        elif m := _NEXT_TOKEN.match(token.lstrip(_OPENERS)):
            # A single letter with a stop is an initial, as good as a name.
            after = m[0] if len(m[0]) == 2 else m[0].rstrip(".")
        else:
            return
        word, first = word.lower(), after[0]
        if first.islower() and not _mixed(after):
            self.before_lower[word] = self.before_lower.get(word, 0) + 1
        elif first.isdigit():
            self.before_number[word] = self.before_number.get(word, 0) + 1
        else:
            self.begins.add(after.lower())
            self.before_capital[word, after] = both = self.has_lower(after)
            if both:
                self.ending.add(word)

    def has_lower(self, word: str) -> bool:
        """Whether the text has a word that is given as a name in lower case as well."""
        low = word.lower()
        return low != word and (low in self.forms or low + "," in self.forms)

    def times(self, form: str) -> int:
        """How often a form of a word occurs, with no stop of its own."""
        get = self.counts.get
        return get(form, 0) + get(form + ",", 0) + get(form + ";", 0) + get(form + ":", 0)

    def name(self, word: str) -> int:
        """How often the word, given in lower case, occurs as a name within sentences: behind a word or comma."""
        if word not in self._names:
            name, n = word[:1].upper() + word[1:], 0
            for form in {name, name + ",", name + ";", name + ":"} & self.forms if name != word else ():
                at = -1
                for _ in range(self.counts.get(form, 0)):
                    at = self.parts.index(form, at + 1)
                    n += at > 0 and (self.parts[at - 1][-1].isalnum() or self.parts[at - 1][-1] in ",;:")
            self._names[word] = n
        return self._names[word]

    def inner(self) -> list[str]:
        """The tokens within sentences, that is behind a word or comma."""
        # Where a stretch has no capital at all, names are in lower case too.
        line = self.line  # without line ends
        for mark in ".!?…":
            line = line.replace(mark + " ", mark + "\n")
        return _INNER.findall(" . ".join([x for x in line.split("\n") if not x.islower() and not x.isupper()]))


_EDGES = ",;:!?()[]\"'“”„«»…"


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Begin and end of the stretches between blank lines, white space around them excluded; blank ones left out."""
    out, begin, at = [], 0, 0
    while end := _LINE_END.search(text, at):
        at = end.end()
        if m := _PARAGRAPHS.match(text, end.start()):
            out.append((begin, m.start()))
            begin = at = m.end()
    out.append((begin, len(text)))
    return [x for x in (trimmed(text, a, b) for a, b in out) if x[0] < x[1]]


def trimmed(text: str, begin: int, end: int) -> tuple[int, int]:
    while begin < end and text[begin].isspace():
        begin += 1
    while end > begin and text[end - 1].isspace():
        end -= 1
    return begin, end


class _Document:
    """Decisions for one text. Evidence from the document is gathered when a decision first asks for it."""

    def __init__(self, text: str, said: dict[str, int]):
        self.text, self.said = text, said
        self._words: Words | None = None
        low = text.lower()
        self._lower_text = low if len(low) == len(text) else text
        self._places: dict[str, tuple[int, int]] = {}
        self._going: dict[str, list[tuple[int, bool]]] | None = None
        self._danda = "।" in text

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words = Words(self.text)
        return self._words

    def is_common(self, word: str) -> bool:
        """Whether the word, given in lower case, is one that is written so: by how often the document has it in lower case
        and as a name within sentences, and by the corpus where that is equal."""
        lower, names = self.words.times(word), self.words.name(word)
        return lower > names or lower == names and bool(self.said[word] & COMMON)

    def starts(self, word: str) -> bool:
        """Whether the word begins sentences even where case is missing."""
        return bool(self.said[word] & STARTER)

    def kind(self, word: str, this: int = 0) -> int:
        """TITLE, ABBREVIATION (with TENDS if a sentence mostly ends with it, LISTED if only the list has it) or ORDINARY, 0 if nothing is known; ``this``
        is 1 where the place that is asked for is itself before lower case or a number."""
        said = self.said[word] & (TITLE | ABBREVIATION | ORDINARY | TENDS | FIRM)
        lower, number = self._goes_on(word)
        if said & ABBREVIATION and lower + number > this:
            return said  # both say so
        if lower > this and self._alone(word):
            return ABBREVIATION
        if said:
            return said
        if number > this and self._alone(word):
            return ABBREVIATION
        return TITLE if word in FOLLOWED and word not in _AMBIGUOUS else ABBREVIATION | LISTED if word in MAY_END and word not in _AMBIGUOUS else 0

    def _alone(self, word: str) -> bool:
        """Whether the document has the word with a stop only, and never at an end that is plain."""
        return word not in self.words.ending and not self.words.times(word) and not self.words.name(word)

    def units(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        thai = _THAI.search(self.text)
        for begin, end in paragraphs(self.text):
            part = self.text[begin:end]
            if thai and len(_THAI.findall(part)) * 3 > len(part):
                ends = [m.start() for m in _SPACE.finditer(part)]
            else:
                ends = self._ends(part)
            at = 0
            for e in (*ends, len(part)):
                a, b = at, e
                while a < b and part[a].isspace():
                    a += 1
                while b > a and part[b - 1].isspace():
                    b -= 1
                if a < b:
                    out.append((begin + a, begin + b))
                at = e
        return out

    def _ends(self, part: str) -> list[int]:
        ends: list[int] = []
        begin, size, pos = 0, len(part), 0
        while point := _POINT.search(part, pos):
            at = point.start()
            if part[at] == "." and part[at + 1 : at + 2] == " " and part[at + 2] not in "»›":
                # A stop and a space, as most are: what the rules below come to for it.
                pos = at + 1
                word, _, following = self._following(part, pos)
                if following in ",;:)]»”" and following or not self._stop_ends(part, begin, at, word, word[:1].islower() and not _mixed(word)):
                    continue
                ends.append(pos)
                begin = pos + 1
                while part[begin].isspace():
                    begin += 1
                continue
            m = _EVENT.match(part, at)
            if not m:
                pos = point.end()
                continue
            pos = m.end()
            if m.lastgroup == "span":
                if not self._span_ends(part, m, begin):
                    continue
                while pos < size and part[pos] in "”’»\"')]）」』":
                    pos += 1
            else:
                if pos < size and part[pos] in " \xa0 " and part[pos + 1 : pos + 2] in ("»", "›") and "«" not in part[begin:pos].rpartition("»")[2]:
                    pos += 2
                if not self._mark_ends(part, m, pos, begin):
                    continue
            if pos >= size:
                break
            ends.append(pos)
            begin = pos
            while begin < size and part[begin].isspace():
                begin += 1
        return ends

    def _following(self, part: str, pos: int) -> tuple[str, bool, str]:
        """The next word; whether white space comes before it; the first character that is none."""
        m = _AHEAD.match(part, pos)
        at = m.end(1)
        return m[2] or "", at > pos, part[at : at + 1]

    def _span_ends(self, part: str, m: re.Match, begin: int) -> bool:
        """Whether a quotation or bracket that ends with an end mark also ends the sentence."""
        inner = m.group()[1:-1].rstrip()
        mark = inner[-1:]
        if not mark or mark not in _STOPS + _WIDE + _OWN:
            return False
        pos = m.end()
        if pos >= len(part):
            return True
        word, spaced, following = self._following(part, pos)
        whole = m.start() == begin
        if following in ",;:—–，、،；：-" or following and following in _STOPS + _WIDE + _OWN:
            return False
        if m.group()[0] in "([（《":
            return whole and m.group()[0] not in "《" and (not word[:1].islower() or inner.count(" ") > 2)
        if mark in _WIDE + _OWN and mark != "؟":
            return not whole and (spaced or bool(word)) or whole and following in "“「『《"
        if not spaced and not word[:1].isupper():
            return False
        if word[:1].islower() and not _mixed(word):
            return not self.text_has_case() and self.starts(word) and mark == "." and not whole
        if mark in ".…":
            return True
        if whole and word.isupper() and len(word) > 1 and inner.upper() == inner:
            return self.starts(word.lower())
        # A quotation at the beginning that asks or cries: a name behind it says whose it is.
        return not whole or self.is_common(word.lower()) or word[:1].isdigit()

    def text_has_case(self) -> bool:
        return not (self.text.islower() or self.text.isupper())

    def _mark_ends(self, part: str, m: re.Match, pos: int, begin: int) -> bool:
        marks = m.group()
        mark = marks.rstrip("”’»›\"')]）］」』〉》】“")[-1]
        if pos >= len(part):
            return True
        if mark in _WIDE:
            return not (mark == "．" and part[pos].isdigit())
        if mark in _OWN and mark not in "؟۔":
            return True
        word, spaced, following = self._following(part, pos)
        if not spaced:
            return self._ends_without_space(part, begin, m, pos, word, mark)
        if following in ",;:)]»”" and following:
            return False
        lower = word[:1].islower() and not _mixed(word)
        if mark in "!?؟۔‽⁇⁈⁉":
            return not lower or self.starts(word) or part[begin : m.start()].islower()
        if mark == "…" or _dots(marks):
            free = m.start() > 0 and part[m.start() - 1].isspace()
            return not lower and not (free and _caseless(part, m.start(), word))
        return self._stop_ends(part, begin, m.start(), word, lower)

    def _ends_without_space(self, part: str, begin: int, m: re.Match, pos: int, word: str, mark: str) -> bool:
        """Two sentences run together: an ordinary word, a mark, a capitalised word."""
        last = _token_before(part, begin, m.start())
        closed = m.end() - m.start() > 1 and part[m.end() - 1] in "”»\"')]）"
        if not part[pos].isalnum():
            return part[pos] in "“«„¿¡(" and word[:1].isupper() and mark != "…" and (len(last) > 1 or closed)
        if mark in "!?؟":
            return not word[:1].islower() and not word[:1].isdigit() or self.starts(word)
        if _dots(m.group()) or not word or word[:1].isdigit():
            return closed and bool(word)
        if closed:
            return word[:1].isupper()
        if "." in last or len(last) < 2 or not last[-1].isalnum():
            return False
        end = pos + len(word)
        if end < len(part) and part[end] in "._@" and part[end + 1 : end + 2].isalnum():
            return False  # a host or file name
        if word[:1].isupper():
            kind = self.kind(last.lower())
            return (len(word) == 1 or word[1:].islower() or last.isupper()) and not kind & TITLE and not (last[:1].isupper() and kind & ABBREVIATION)
        if word[:1].islower():
            return self.starts(word) and bool(self.said[last.lower()] & COMMON)
        return True  # a script without case

    def _stop_ends(self, part: str, begin: int, at: int, word: str, lower: bool) -> bool:
        last = _token_before(part, begin, at)
        t = _plain(last.lower().lstrip("'‘’-"))
        low = word.lower()
        if not t:
            return not lower or self.starts(word)
        if t[-1].isdigit():
            if t.isdigit() and len(t) <= 2 and self._follows_ordinals(low):
                return False
            return not lower or self.starts(word)
        if self._danda and _DEVANAGARI.search(t):
            return False  # such a text ends its sentences with another mark
        caseless = word.isupper() and _caseless(part, at, word)
        kind = self.kind(t, int(lower or word[:1].isdigit()))
        number_before = (len(t) == 1 or t in OF_YEAR) and part[max(0, at - len(last) - 3) : at - len(last)].rstrip()[-1:].isdigit()
        if number_before and (kind & (TITLE | ABBREVIATION) or t in OF_YEAR):
            # The year's abbreviation: a name goes on, an ordinary word begins the next sentence.
            return not lower and self.is_common(low) and not caseless
        if len(t) == 1 and t.isalpha():
            if number_before:  # a unit
                return not lower or self.starts(low)
            if len(word) == 1 and word.isalpha() and re.match(rf"\s*{word}\.", part[at + 1 : at + 8]):
                return False  # an abbreviation or name of several letters
            return not (kind & (TITLE | ABBREVIATION) or t in FOLLOWED or t in OF_YEAR or last.isupper() or t.upper() == t.lower() or caseless or lower)
        if t in _AMBIGUOUS and kind & (TITLE | ABBREVIATION) == 0 and (word[:1].isdigit() or last[:1].isupper()):
            kind = TITLE if t in FOLLOWED else ABBREVIATION | LISTED if t in MAY_END else 0
        if kind & TITLE:
            return False
        if kind & ABBREVIATION or "." in t:
            tends = bool(kind & TENDS)
            if lower or caseless:
                return tends and (self.starts(low) or not lower and not self.is_common(low))
            if word[:1].isdigit():
                return tends
            return tends or kind == 0 or bool(kind & LISTED) or (self.starts(low) if kind & FIRM else self.is_common(low))
        if lower:
            return self.starts(low) or self.is_common(t)
        return True

    def _goes_on(self, word: str) -> tuple[int, int]:
        """How often the document has the word with a stop before lower case, and before a number."""
        if word not in self._places:
            if self._going is None:
                self._going = self._stops_that_go_on()
            lower = number = 0
            low, text, size = self._lower_text, self.text, len(word)
            for stop, is_lower in self._going.get(word[-1:], ()):
                at = stop - size
                if at >= 0 and low.startswith(word, at) and not (at > 0 and text[at - 1].isalnum()):
                    lower, number = lower + is_lower, number + (not is_lower)
            # Only what the document has with a stop once more can be settled by it.
            self._places[word] = (lower, number) if (lower or number) and low.count(word + ".") > 1 else (0, 0)
        return self._places[word]

    def _stops_that_go_on(self) -> dict[str, list[tuple[int, bool]]]:
        """By the character before a stop: the stops before lower case (True) or a number (False)."""
        going: dict[str, list[tuple[int, bool]]] = {}
        for m in _GOES_ON.finditer(self.text):
            after, at = m[1], m.start()
            if at and (after[0].islower() or after[0].isdigit()) and not _mixed(after):
                going.setdefault(self._lower_text[at - 1], []).append((at, after[0].islower()))
        return going

    def _follows_ordinals(self, word: str) -> bool:
        return bool(self.said[word] & ORDINAL) or word in MONTHS


def _token_before(part: str, begin: int, at: int) -> str:
    """What stands before a mark without white space, brackets, quotation marks and the like in it. A token above 4,096
    characters is cut: it is no word."""
    token = part[part.rfind(" ", begin, at) + 1 or begin : at]
    if token.isalnum():
        return token
    width = 40
    while True:
        low = max(begin, at - width)
        m = _BEFORE.search(part, low, at)
        if m is None or m.start() > low or low == begin or width > 4096:
            return m.group() if m else ""
        width *= 8


def _plain(token: str) -> str:
    """The token, without accents if only so it is a known abbreviation."""
    if token.isascii() or token in FOLLOWED or token in MAY_END:
        return token
    bare = "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))
    return bare if bare in FOLLOWED or bare in MAY_END else token


def _dots(marks: str) -> bool:
    return marks.startswith("..")


def _mixed(word: str) -> bool:
    """A lower-case letter and a capital behind it, as in some names."""
    return len(word) > 1 and word[0].islower() and word[1].isupper()


def _caseless(part: str, at: int, word: str) -> bool:
    """Whether the text around is all capitals."""
    around = part[max(0, at - 24) : at]
    return len(word) > 1 and word.isupper() and around.upper() == around and any(c.isupper() for c in around[:-3])


def document_units(text: str, said: dict[str, int]) -> list[tuple[int, int]]:
    """Begin and end of a text's units, by what is said of words; a word that is missing there must give 0."""
    return _Document(text, said if isinstance(said, (Asking, Silent)) else Silent(said)).units()


def sentence_units(text: str | None, corpus: Corpus | None = None) -> list[tuple[int, int]]:
    """Begin and end of the units of a text; none for null and blank texts."""
    return document_units(text, (corpus or Corpus()).said) if text else []


_COUNTS = ("lower", "names", "capital", "unseen", "other", "ordinal", "begins")


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, kind (a place in _COUNTS), n: a word's counts in each run of texts: times within sentences in lower case and as a name; with a stop before a
    capital, before one whose word the text has nowhere in lower case, and before lower case or a number; behind a number with a stop; behind another word with a stop."""
    for whole in batches:
        for batch in slices(whole, "text", 32_000_000):
            lower, names, capital, unseen, other, ordinal, begins = counts = tuple(Counter() for _ in _COUNTS)
            tokens: Counter[str] = Counter()
            for text in strings(batch.column(0)):
                if not text or text.islower() or text.isupper():
                    continue
                words = Words(text)
                tokens.update(words.inner())
                # Once a text: what one text repeats says no more about a word.
                other.update(words.before_lower.keys() | words.before_number.keys())
                for (word, after), both in words.before_capital.items():
                    capital[word] += 1
                    # A word without case tells nothing about names.
                    if not both and after[0].isupper():
                        unseen[word] += 1
                ordinal.update(words.ordinal)
                begins.update(words.begins)
            for token, n in tokens.items():
                form = token.strip(_EDGES)
                if form.isalpha():
                    low = form.lower()
                    if form == low:
                        lower[low] += n
                    elif len(form) == 1 or not form.isupper():
                        names[low] += n
            kinds = np.repeat(np.arange(len(counts), dtype=np.int32), [len(c) for c in counts])
            words = [w for c in counts for w in c]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(kinds), pa.array([n for c in counts for n in c.values()], pa.int64())], ["word", "kind", "n"])


def _flags() -> Column:
    """What a word's counts say, as flags."""
    c = {n: F.col(n) for n in _COUNTS}
    common = (c["lower"] >= LEAST) & (c["lower"] > 4 * c["names"])
    stops = c["capital"] + c["other"]
    # A sentence goes on in lower case or with a number behind an abbreviation; behind an ordinary word only by mistake.
    abbreviation = (stops >= LEAST) & (4 * c["other"] > stops)
    # Of the words that begin sentences, texts have many in lower case as well; names they don't.
    title = (c["capital"] >= 2 * LEAST) & ((c["capital"] - c["unseen"]) * 25 <= c["capital"]) & ~abbreviation & ((c["lower"] + c["names"]) * 10 < stops)
    # Some names are spelt like a word. One may begin sentences too; what is never met in lower case tells nothing where case is missing.
    starter = common & (c["begins"] >= LEAST)
    ordinal = (c["ordinal"] >= LEAST) & (c["ordinal"] > c["names"]) & (c["ordinal"] > c["begins"]) & ~common
    kinds = ((common, COMMON), (starter, STARTER), (abbreviation, ABBREVIATION), (title, TITLE), ((stops >= LEAST) & ~abbreviation & ~title, ORDINARY), ((stops >= LEAST) & (c["capital"] > c["other"]), TENDS), (ordinal, ORDINAL), (abbreviation & (c["other"] > 4 * (c["capital"] + 1)), FIRM))
    return sum((F.when(k, f).otherwise(0) for k, f in kinds), F.lit(0)).cast("int")


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """word, said, capital, other, total of the words of which anything can be said."""
    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_contexts, "word string, kind int, n bigint")
    sums = sums.groupBy("word").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(_COUNTS)))
    known = sums.select("word", _flags().alias("said"), "capital", "other", sum(F.col(c) for c in _COUNTS).alias("total"))
    return durable(known.filter(F.col("said") > 0))


#: A text's results: rows of whole numbers and strings.
Each = Callable[[str, dict[str, int]], list[tuple]]

#: Rows of one text that a task gets.
COPIES = 10_000
#: The most bytes of texts' own words that are broadcast.
BROADCAST_BYTES = 32_000_000


def _first_pass(each: Each, kinds: dict[str, pa.DataType], frequent: dict[str, int]):
    """From _id, text, _key: the results of each text by what is known of frequent words, as an array, and the other
    words it asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = Asking(frequent)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, asked, sizes, n_asked = [], [], [0], [0]
                for text in strings(batch.column(1)):
                    said.asked.clear()
                    rows += each(text, said) if text else ()
                    asked += said.asked
                    sizes.append(len(rows)), n_asked.append(len(asked))
                fields = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())]
                lists = [pa.ListArray.from_arrays(pa.array(n, pa.int32()), x) for n, x in ((sizes, pa.StructArray.from_arrays(fields, list(kinds))), (n_asked, pa.array(asked, pa.string())))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["_id", "_key", "rows", "asked"])

    return run


def _again(each: Each, kinds: dict[str, pa.DataType], known: dict[str, int]):
    """From _id, text, _words: a row for each result, by what is known and what is said of the text's own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                owner, rows = [], []
                for i, (text, words) in enumerate(zip(strings(batch.column(1)), batch.column(2).to_pylist())):
                    found = each(text, Silent({**known, **{w["word"]: w["said"] for w in words}} if words else known)) if text else ()
                    owner += [i] * len(found)
                    rows += found
                fields = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *fields], ["_id", *kinds])

    return run


def with_statistics(rows: DataFrame, of: DataFrame, corpus: Corpus | None, each: Each, kinds: dict[str, pa.DataType]) -> DataFrame:
    """_id and the results of ``each`` for every text of ``rows`` (_id, text), by what the texts ``of`` (text) say of words.

    Frequent words are sent to all tasks. A text that asks for others is done again if any of them has statistics;
    both passes give the same where they are given the same. A given ``corpus`` stands for all of it.
    """
    id_kind = rows.schema["_id"].dataType.simpleString()
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}
    columns = [(n, names[k]) for n, k in kinds.items()]
    flat = f"_id {id_kind}, " + ", ".join(f"{n} {k}" for n, k in columns)
    said_of = "array<struct<word:string,said:int>>"
    if corpus:
        return rows.withColumn("_words", F.lit(None).cast(said_of)).mapInArrow(_again(each, kinds, corpus.said), flat)
    counted = _counted(of, "text")
    most = (counted.agg(F.sum("total")).first()[0] or 0) * SENT_SHARE
    frequent = {r.word: r.said for r in counted.filter(F.col("total") >= most).select("word", "said").collect()}
    keyed = rows.withColumn("_key", F.unhex(F.md5("text")))
    struct = ",".join(f"{n}:{k}" for n, k in columns)
    first = durable(keyed.select("_id", "text", "_key").mapInArrow(_first_pass(each, kinds, frequent), f"_id {id_kind}, _key binary, rows array<struct<{struct}>>, asked array<string>"))
    asked = first.filter("_key IS NOT NULL").select("_key", F.explode("asked").alias("word")).distinct()
    rarer = counted.filter(F.col("total") < most).select("word", "said")
    found = durable(asked.join(rarer, "word").groupBy("_key").agg(F.collect_set(F.struct("word", "said")).alias("_words")))
    size = found.agg(F.sum(F.size("_words") * 48 + 64)).first()[0] or 0
    if not size:
        return first.select("_id", F.inline("rows"))
    if size <= BROADCAST_BYTES:
        # Counted, so it may be sent: neither results nor texts are shuffled.
        settled = first.filter("size(rows) > 0").join(F.broadcast(found.select("_key")), "_key", "left_anti").select("_id", F.inline("rows"))
        again = keyed.join(F.broadcast(found), "_key").select("_id", "text", "_words").mapInArrow(_again(each, kinds, frequent), flat)
        return settled.unionByName(again)
    # A text may have many copies: their rows are dealt out.
    hot = hot_keys(first.groupBy("_key").agg(F.count(F.lit(1)).alias("n")), ["_key"], "n", COPIES)
    once = copied(found, hot, ["_key"])
    settled = dealt(first.filter("size(rows) > 0"), hot, ["_key"]).join(once.select("_key", "_turn"), ["_key", "_turn"], "left_anti").select("_id", F.inline("rows"))
    again = dealt(keyed, hot, ["_key"]).join(once, ["_key", "_turn"]).select("_id", "text", "_words").mapInArrow(_again(each, kinds, frequent), flat)
    return settled.unionByName(again)


def corpus_statistics(docs: DataFrame, text_col: str = "text") -> Corpus:
    """All that the texts say about words, at once; for corpora whose words fit into memory."""
    rows = _counted(docs, text_col).select("word", "said", "capital", "other").collect()
    of = lambda flag: frozenset(r.word for r in rows if r.said & flag)
    return Corpus(of(COMMON), of(STARTER), {r.word: (r.capital, r.other) for r in rows if r.capital + r.other >= LEAST}, {r.word: r.said for r in rows})


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corpus: Corpus | None = None) -> DataFrame:
    """``id_col``, sent_start, sent_end: one row for each sentence unit, offsets in code points, the end excluded.

    White space around a unit is no part of it; every other character is in exactly one unit. Blank lines end
    units. Null and blank texts give no rows; null and repeated ids stay as they are. The statistics are those of
    ``docs`` unless given.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return with_statistics(rows, rows, corpus, document_units, {"sent_start": pa.int64(), "sent_end": pa.int64()}).withColumnRenamed("_id", id_col)
