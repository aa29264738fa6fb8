"""Column functions that clean text, and the stop words they drop by default."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two classes of punctuation that become spaces.
PUNCTUATION = r"""[.,;:"'!?`´()$£€\-^|=/<>]"""
SPECIAL = r"""["'`´()$£€\-_^|=/<>~]"""
# Bracket tokens of treebanks.
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}
#: White space as Unicode has it; ``\s`` of Java and RE2 is ASCII.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The default of every function that drops stop words; callers pass their own list for another language or task.
STOP_WORDS: tuple[str, ...] = tuple(
    """a about after again all also am an and any are as at be because been before being below between both but by can could did do does
    down during each few for from further had has have he her here him his how i if in into is it its just may me might more most must my
    no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they
    this those through to too under until up very was we were what when where which while who why will with would you your""".split()
)

Step = Callable[[Column], Column]


def chain(text: Column, steps: Sequence[Step]) -> Column:
    """The steps one after another."""
    for step in steps:
        text = step(text)
    return text


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, " ")


def remove_special_characters(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, " ")


def remove_hyphens_and_dots(text: Column) -> Column:
    """Hyphens become spaces, dots go."""
    return F.translate(text, "-.", " ")


def remove_line_breaks(text: Column) -> Column:
    return F.regexp_replace(text, r"[\n\r\t]+", " ")


def squeeze(text: Column) -> Column:
    """Two or more white-space characters become a space; a single one stays."""
    return F.regexp_replace(text, SPACE + "{2,}", " ")


def words(text: Column) -> Column:
    """The stretches between white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def remove_stop_words(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Drops the stop words as they are written, letter case included; the rest is joined by spaces."""
    return F.array_join(F.filter(words(text), lambda w: ~w.isin(*stop)), " ")


def content_words(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """The words in lower case without stop words."""
    return F.filter(words(F.lower(text)), lambda w: ~w.isin(*stop))


def unescape_brackets(text: Column) -> Column:
    for token, bracket in BRACKETS.items():
        text = F.replace(text, F.lit(token), F.lit(bracket))
    return text


def truncate_words(text: Column, most: int) -> Column:
    """The first words, joined by spaces."""
    return F.array_join(F.slice(words(text), 1, most), " ")


def has_free_punctuation(phrase: Column) -> Column:
    """Whether stripping the punctuation leaves another number of words: a mark stands by itself."""
    return F.size(words(phrase)) != F.size(words(F.regexp_replace(phrase, r"[!-/:-@\[-`{-~]", "")))


def clean_document(text: Column) -> Column:
    """The cleaning of line-broken abstracts: joins lines, drops brackets and paragraph marks.

    White space or a comma before a line break goes with it; a break behind a letter, digit, comma or white space
    becomes a space; white space is squeezed to its first character; brackets and tabs become spaces.
    """
    kept = "\x01"
    text = F.regexp_replace(text, r"[ \t\r\n,]+\n", "\n")
    text = F.regexp_replace(text, r"(^|[^a-zA-Z0-9, \t\r\n])\n", "$1" + kept)
    text = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(kept), F.lit("\n"))
    text = F.regexp_replace(text, r"([ \t\r\n])[ \t\r\n]+", "$1")
    text = F.regexp_replace(text, r"[<>\[\]{}\t]", " ")
    return F.trim(F.replace(F.replace(text, F.lit(" /p \n"), F.lit("\n")), F.lit(" p "), F.lit("\n")), F.lit(" \n"))


def clean_phrase(phrase: Column, stem: Callable[[Column], Column] | None = None) -> Column:
    """A gold phrase in comparable form; empty ones become null. ``stem`` gets it before apostrophes are dropped."""
    phrase = F.trim(F.lower(phrase))
    phrase = F.replace(F.replace(phrase, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(""))
    phrase = squeeze(remove_hyphens_and_dots(phrase))
    phrase = F.trim(F.replace(stem(phrase) if stem else phrase, F.lit("'"), F.lit("")))
    return F.when(phrase != "", phrase)


def normalize_for_model(text: Column) -> Column:
    """Text as the rankers read it: no punctuation, single spaces, trimmed."""
    return F.trim(squeeze(remove_punctuation(text)))


def length_and_words(phrase: Column, longer_than: int, most_words: int | None = None) -> Column:
    """Filter: strictly longer than so many characters, and at most so many words."""
    ok = F.length(phrase) > longer_than
    return ok if most_words is None else ok & (F.size(words(phrase)) <= most_words)


def annotate(text: Column, phrase: Column, marker: str) -> Column:
    """Puts a marker for every occurrence of the phrase that no letter or digit follows."""
    quoted = F.regexp_replace(phrase, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    return F.regexp_replace(text, F.concat(F.lit("(?i)"), quoted, F.lit(r"(?![\p{L}\p{N}])")), F.lit(marker))
