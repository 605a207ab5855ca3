"""Characters: base letters with combining marks, escapes, normal forms, character classes.

A character is a string: a base letter and its marks in order. Python functions parse any text (escapes, stacked marks); the
Column forms cover bulk text of precomposed letters, where Spark's own string functions suffice.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Escapes and the combining marks they stand for.
MARKS = {"\\`": "̀", "\\'": "́", "\\^": "̂", "\\~": "̃", "\\-": "̄", "\\v": "̆", '\\"': "̈", "\\c": "̧", "\\_": "̱"}
# Character sets.
BANNED = "@$%"
UNIVERSAL_PUNCTUATION = ["&", ".", ",", "[", "]", "-", "*", "§", "¶"]
LIGATURES = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe"}
LONG_S = "ſ"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
VOWELS = "aeiou"
REPLACEABLE = LETTERS + "ç"

ESCAPES = {mark: code for code, mark in MARKS.items()}
#: Precomposed letters by base and mark: every vowel with seven marks, and n with tilde, c with cedilla, in both cases.
PRECOMPOSED = {b + m: unicodedata.normalize("NFC", b + m) for b in VOWELS + VOWELS.upper() for m in "̀́̂̃̄̆̈"} | {b + m: unicodedata.normalize("NFC", b + m) for b, m in (("n", "̃"), ("N", "̃"), ("c", "̧"), ("C", "̧"))}
DECOMPOSED = {whole: parts for parts, whole in PRECOMPOSED.items()}
_COMBINING = [(0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)]
_ACCENTED, _PLAIN = "".join(DECOMPOSED), "".join(x[0] for x in DECOMPOSED.values())


class CharError(ValueError):
    """A text that isn't a sequence of characters: a dangling escape, a mark without a letter, a mark on a non-letter."""


def is_combining(c: str) -> bool:
    return any(low <= ord(c) <= high for low, high in _COMBINING)


def parse(text: str, strict: bool = True) -> list[tuple[str, list[str]]]:
    """Characters of a text as (base, marks): marks of a precomposed letter, combining marks, then escapes, innermost first.

    ``strict`` raises ``CharError`` where the text is malformed; otherwise the offending symbol stands for itself.
    """
    out, at, n = [], 0, len(text)
    while at < n:
        if text.startswith("\\\\", at):
            out.append(("\\\\", []))
            at += 2
            continue
        begin, codes = at, []
        while at < n and text[at] == "\\":
            codes.append(text[at : at + 2])
            at += 2
        try:
            if at >= n:
                raise CharError(f"an escape without a letter: {text[begin:]!r}")
            if is_combining(text[at]):
                raise CharError(f"a combining mark without a letter: {text[begin : at + 1]!r}")
            base, *marks = DECOMPOSED.get(text[at], text[at])
            at += 1
            while at < n and is_combining(text[at]):
                marks.append(text[at])
                at += 1
            for code in reversed(codes):
                if code == "\\i":
                    if base != "i":
                        raise CharError("\\i only goes with the letter i")
                    base = "ı"
                elif code in MARKS:
                    marks.append(MARKS[code])
                else:
                    raise CharError(f"Unrecognized escape sequence: [{code}]")
            if marks and not base.isalpha():
                raise CharError(f"a mark on something that isn't a letter: {text[begin:at]!r}")
            out.append((base, marks))
        except CharError:
            if strict:
                raise
            out += [(c, []) for c in text[begin : max(at, begin + 1)]]
            at = max(at, begin + 1)
    return out


def split_chars(text: str, strict: bool = True) -> list[str]:
    return [base + "".join(marks) for base, marks in parse(text, strict)]


def normalize_char(char: str) -> str:
    found = split_chars(char)
    if len(found) != 1:
        raise CharError(f"not one character: {char!r}")
    return found[0]


def base_of(char: str) -> str:
    return parse(char)[0][0]


def unescape_char(char: str, precomposed_only: bool = False) -> str:
    """The character with its first mark joined to the letter where a precomposed one exists; other marks follow it, or with ``precomposed_only`` go before it as escapes."""
    if char == "\\\\":
        return "\\"
    ((base, marks),) = parse(char)
    if not marks:
        return base
    whole = PRECOMPOSED.get(base + marks[0])
    if not precomposed_only:
        return (whole or base + marks[0]) + "".join(marks[1:])
    before, after = "", ""
    for m in marks[1:] if whole else marks:
        if m in ESCAPES:
            before = ESCAPES[m] + before
        else:
            after += to_unicode(m)
    return before + (whole or base) + after


def fully_escape_char(char: str) -> str:
    """Base letter with all marks as escapes before it, outermost first; a dotless i is ``\\ii``."""
    if char == "\\\\":
        return char
    ((base, marks),) = parse(char)
    return "".join(ESCAPES.get(m, m) for m in reversed(marks)) + ("\\ii" if base == "ı" else base)


def to_unicode(text: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in text)


def is_punctuation(char: str) -> bool:
    """True if every code point of the base is neither white space, letter nor digit; of more than one character is an error."""
    if char == "\\\\":
        return True
    return all(not (c.isspace() or c.isalpha() or c.isdigit()) for c in base_of(normalize_char(char)))


def add_tilde(char: str) -> str:
    return normalize_char(char + MARKS["\\~"])


def tilde_form(char: str) -> str | None:
    """What a letter looks like that carries an elision tilde: letters a to z, and vowels with grave or acute, have one."""
    ((base, marks),) = parse(char)
    plain = not marks and base in LETTERS and len(base) == 1
    return add_tilde(base) if plain or accent_dropped(char) else None


def accent_dropped(char: str) -> str | None:
    """The bare vowel of a vowel with a grave or acute."""
    ((base, marks),) = parse(char)
    return base if base in VOWELS and len(base) == 1 and {"̀", "́"} & set(marks) else None


def char_classes(chars: list[str]) -> list[dict]:
    """A row of predicates and mapped forms for each character of an index."""
    return [{"char": c, "is_punctuation": is_punctuation(c), "can_be_replaced": c in REPLACEABLE, "valid_substitution": c in LETTERS, "doublable": c in LETTERS, "elidable": c in LETTERS, "tilde_form": tilde_form(c), "accent_dropped": accent_dropped(c), "ligature": LIGATURES.get(c)} for c in chars]


class CharIndex:
    """Characters by number; spellings of the same character share one. A locked index takes no new ones."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.locked = False

    def number(self, char: str) -> int:
        char = normalize_char(char)
        if char not in self.numbers:
            if self.locked:
                raise KeyError(char)
            self.numbers[char] = len(self.numbers)
        return self.numbers[char]

    def char(self, number: int) -> str:
        return list(self.numbers)[number]


@F.pandas_udf(T.ArrayType(T.StringType()))
def read_chars(text: pd.Series) -> pd.Series:
    """Characters of any text, malformed symbols for themselves; null stays null."""
    return text.map(lambda x: None if x is None else split_chars(x, strict=False))


def count_of(text: str) -> int:
    """How many characters ``split_chars`` finds; a text without escapes and combining marks has one for each code point."""
    if "\\" not in text and (text.isascii() or not any(map(is_combining, set(text)))):
        return len(text)
    return len(parse(text, strict=False))


@F.pandas_udf(T.IntegerType())
def count_chars(text: pd.Series) -> pd.Series:
    """How many characters ``read_chars`` gives; null stays null."""
    return text.map(lambda x: None if x is None else count_of(x)).astype("Int32")


def strip_diacritics(text: Column) -> Column:
    """Text with its precomposed letters reduced to their bases."""
    return F.translate(text, _ACCENTED, _PLAIN)


def remove_punctuation(text: Column) -> Column:
    """Text without punctuation, white space normalised."""
    return normalize_space(F.regexp_replace(text, r"[^\s\p{IsAlphabetic}\p{Nd}]+", ""))


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Entities of XML, first to last, and of letters with a tilde.
ENTITIES = (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ("'", "&apos;"), ('"', "&quot;"))
LETTER_ENTITIES = (("p̃", "&#112;&#771;"), ("P̃", "&#80;&#771;"), ("q̃", "&#113;&#771;"), ("Q̃", "&#81;&#771;"))


def xml_escape(text: Column) -> Column:
    """Characters that XML reserves as entities, and p and q with a tilde as their letter entities."""
    for a, b in (*ENTITIES, *LETTER_ENTITIES):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# What stands for a part of a page's file name that isn't there.
NO_PAGE, NO_NUMBER, NO_FILE = "Error: page ID unknown", "Error: ID Number unknown", "Error: filename unknown"


def _part(path: Column, pattern: str, missing: str) -> Column:
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found).otherwise(F.lit(missing))


def page_id(path: Column) -> Column:
    """Archive id of a page by its file name, e.g. pl_blac_047_00039."""
    return _part(path, r"(pl_[a-z]+_[0-9]+_[0-9]+)", NO_PAGE)


def page_number(path: Column) -> Column:
    """The last number of an archive id."""
    return _part(path, r"pl_[a-z]+_[0-9]+_([0-9]+)", NO_NUMBER)


def page_file(path: Column) -> Column:
    """The file name from the archive id on."""
    return _part(path, r".*(pl_[a-z]+_[0-9]+_[0-9]+.*)", NO_FILE)
