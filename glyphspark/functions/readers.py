"""Text readers: stages that turn a line into the line that a model sees. Column to Column, in a fixed order.

Basic, banned characters, optional character set, optional diacritic removal, optional long s, then replacement rules. All but
the rules are expressions inside one projection; rules count their matches across lines (``operators.cascade``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspark.functions import charset
from glyphspark.operators.cascade import Rule, replace_in_order, walk


@dataclass(frozen=True)
class Reader:
    """Options of a language's reader."""

    escapes: bool = False
    banned: str = charset.BANNED
    allowed: str | None = None
    disregard_diacritics: bool = False
    remove_diacritics: bool = False
    long_s: bool = False
    rules: list[Rule] = field(default_factory=list)


def basic(line: Column, escapes: bool = False) -> Column:
    """Quotation marks of two strokes become one, tabs four spaces; without ``escapes`` a backslash stands for itself."""
    if not escapes:
        line = F.replace(line, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(F.replace(line, F.lit("``"), F.lit('"')), F.lit("''"), F.lit('"')), F.lit("\t"), F.lit("    "))


def without(line: Column, banned: str = charset.BANNED) -> Column:
    return F.translate(line, banned, "")


def only(line: Column, allowed: str, disregard_diacritics: bool = False) -> Column:
    """Keep characters of a set and spaces; ``disregard_diacritics`` judges a letter by its base and keeps it as it is."""
    if not allowed:
        raise ValueError("an empty character set")
    keep = [*allowed, " "]
    if disregard_diacritics:
        keep += [whole for whole, parts in charset.DECOMPOSED.items() if parts[0] in allowed]
    pattern = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(keep)) + "]"
    return F.regexp_replace(line, pattern, "")


def long_s(line: Column) -> Column:
    """An s before a letter becomes long, but for the second of two before an i. Exact for text without literal long s."""
    return F.regexp_replace(F.regexp_replace(line, r"s(?=\p{L})", "ſ"), "ſſ(?=[iìíîïĩīĭ])", "ſs")


def read(line: Column, reader: Reader) -> Column:
    line = without(basic(line, reader.escapes), reader.banned)
    if reader.allowed is not None:
        line = only(line, reader.allowed, reader.disregard_diacritics)
    if reader.remove_diacritics:
        line = charset.strip_diacritics(line)
    return long_s(line) if reader.long_s else line


def flip_uv(line: Column, keep: float, key: Column) -> Column:
    """Exchange u and v, each with probability 1 - ``keep``, drawn from a hash of ``key`` and the place, so always alike."""
    drawn = lambda i: F.pmod(F.xxhash64(key, i), F.lit(1_000_000)) / 1_000_000.0
    return F.array_join(F.transform(F.split(line, ""), lambda c, i: F.when(drawn(i) < keep, c).otherwise(F.translate(c, "uvUV", "vuVU"))), "")


def replace_some(lines: DataFrame, rules: list[Rule], key: str = "lang", order: tuple[str, str] = ("doc_id", "line_no"), text: str = "line") -> DataFrame:
    """Replace every n-th match of each rule, counting matches from the first line of each ``key`` on; later rules see earlier output.

    A match that is replaced is consumed, one that isn't moves on by a character, so that matches of a pattern that overlaps
    itself depend on the count so far. Rules match glyphs: a letter with a combining mark isn't the letter. All rules go in one pass over
    laid out blocks (``cascade``); no group is gathered in one task.
    """
    for rule in rules:
        if not rule.old or rule.every < 1:
            raise ValueError(f"a rule needs a pattern and a positive number: {rule}")
    return replace_in_order(lines, rules, key, order, text) if rules else lines


def parsed_rules(text: str) -> list[Rule]:
    """Rules of a file's text: old, new and number by tabs; fields may hold escapes; empty lines are skipped, any other count of fields is an error."""
    composed = lambda field: "".join(charset.unescape_char(c) for c in charset.split_chars(field))
    out = []
    for line in text.split("\n"):
        if line.strip():
            parts = line.split("\t")
            if len(parts) != 3:
                raise ValueError(f"a rule has three fields: {line!r}")
            out.append(Rule(composed(parts[0]), composed(parts[1]), int(parts[2])))
    return out


def replace_some_in_order(lines: list[str], rules: list[Rule]) -> list[str]:
    """The same on a list, for tests and small inputs."""
    counts = [0] * len(rules)
    out = []
    for line in lines:
        for k, rule in enumerate(rules):
            line, counts[k] = walk(line, rule, counts[k])
        out.append(line)
    return out
