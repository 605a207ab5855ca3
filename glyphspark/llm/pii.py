"""Op 5: personal data by weak supervision. DataFrame functions only; nothing is shuffled but counts of vote patterns.

Base patterns give the sure spans. Looser patterns give candidates, on the text with the sure spans of the kind blanked out. All get
votes by three labelers: a format labeler (regex), a gazetteer labeler (top-level domains, calling codes, issuer prefixes,
address ranges) and a context labeler (words before the span). The number of candidates by kind, votes and length class
is a table of bounded size; from it, expectation-maximisation on the driver estimates each labeler's reliability for
each kind, and a span classifier (naive Bayes on votes and length class, from the estimated labels) is trained. Its decisions
for all possible patterns go back as a literal set. Candidates that it accepts are added; sure spans stay whatever it says.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns, with possessive repeats and no starts inside a run that has failed already: the same
# matches in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = rf"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})(?:\.|$)){{4}}$"
# Looser candidates: disguised mail addresses, addresses with marked dots or in hexadecimal groups, numbers of a card's or a
# phone's length in other groupings.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:[\[(](?i:at)[\])]|@)\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(](?i:dot)[\])]\x20?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:\x20?[\[(](?:\.|dot)[\])]\x20?[0-9]{1,3}){3}(?![0-9])|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}(?![0-9A-Za-z:]))",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{15,16}(?![0-9])|(?<![0-9])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Gazetteers.
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "eu", "uk", "de", "fr", "es", "it", "nl", "at", "ch", "be", "us", "ca", "mx", "ar", "br"]
CALLING_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "64", "81", "82", "86", "90", "91"]
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CONTEXT = {
    "email": (r"(?i)\b(?:e-?mail|contact|write|courriel|correo|kontakt)\b", r"(?i)\b(?:version|package|git)\b"),
    "ip": (r"(?i)\b(?:ip|host|server|address|client|login)\b", r"(?i)\b(?:version|release|section|chapter)\b"),
    "card": (r"(?i)\b(?:card|visa|credit|debit|payment|carte|karte|tarjeta)\b", r"(?i)\b(?:isbn|order|invoice|serial|id|ref|tracking)\b"),
    "phone": (r"(?i)\b(?:phone|tel|call|fax|mobile|cell|telefon|tel[eé]fono)\b", r"(?i)\b(?:isbn|order|invoice|serial|id|ref|version)\b"),
}
CONTEXT_CHARS, ACCEPT, EM_ROUNDS, TRUST = 48, 0.9, 60, 4.0
_SPAN = "array<struct<a:int,b:int,m:string,before:string>>"
_FOUND = "array<struct<a:int,kind:int,b:int,base:boolean,key:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside lambdas, what isn't a variable is computed again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _placed(both: Column) -> Column:
    """Matches (gap before, characters before, match) with their places (start, end, match, characters before).

    Places are running sums, taken in blocks of about the root of their number and then over the blocks, so that a text with very many
    matches doesn't copy them again for every match.
    """
    side = F.greatest(F.ceil(F.sqrt(F.size(both))).cast("int"), F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.length(x["m"])
        return F.struct(b.alias("at"), F.array_append(acc["out"], F.struct(a.alias("a"), b.alias("b"), x["m"].alias("m"), x["before"].alias("before"))).alias("out"))

    def join(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda s: F.struct((s["a"] + acc["at"]).alias("a"), (s["b"] + acc["at"]).alias("b"), s["m"].alias("m"), s["before"].alias("before")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    none = F.array().cast(_SPAN)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(both) / side).cast("int") - 1, F.lit(0))), lambda i: F.slice(both, i * side + 1, side))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), none.alias("out")), step))
    return F.flatten(F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), join, lambda acc: acc["out"]))


def _between(text: Column, pattern: str) -> tuple[Column, Column]:
    """What lies between the matches of a pattern (one more than there are), and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)


def spans_of(text: Column, pattern: str, when: Column) -> Column:
    """Matches of a pattern, leftmost and apart, as (start, end, match, characters before), in code points."""
    pieces, matches = _between(text, pattern)
    none = F.array().cast(_SPAN)
    both = lambda m: F.zip_with(F.slice(pieces, F.lit(1), F.size(m)), m, lambda p, x: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT_CHARS)).alias("before"), x.alias("m")))
    return F.when(when, _let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(_let(both(m), _placed)))).otherwise(none)


def blanked(text: Column, kind: str, pattern: str, when: Column) -> Column:
    """The text with a mark that no pattern takes in place of every code point of the kind's sure spans."""
    pieces, matches = _between(text, pattern)
    hidden = F.transform(matches, lambda m: F.when(_valid(kind, m), F.repeat(F.lit("\x01"), F.length(m))).otherwise(m))
    return F.when(when, F.array_join(F.flatten(F.zip_with(pieces, F.concat(hidden, F.array(F.lit(""))), lambda p, m: F.array(p, m))), "")).otherwise(text)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(IP_PARTS)
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(m))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _votes(kind: str, m: Column, before: Column) -> list[Column]:
    """Format, gazetteer and context votes (-1, 0, 1) and the length class (0 to 3)."""
    digits = _digits(m)
    n = F.length(digits)
    one, none, against = F.lit(1), F.lit(0), F.lit(-1)
    if kind == "email":
        form = F.when(m.rlike(r"^[^@]++@[^@\x20]++$"), one).otherwise(none)
        known = F.when(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS), one).otherwise(against)
        size = F.when(F.length(m) < 8, 0).when(F.length(m) < 40, 1).otherwise(2)
    elif kind == "ip":
        dots = F.regexp_replace(m, r"\x20?[\[(](?:\.|dot)[\])]\x20?", ".")
        form = F.when(dots.rlike(IP_PARTS) | m.contains(":"), one).otherwise(against)
        known = F.when(dots.rlike(r"^0*(?:[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\.") | m.rlike("^(?i:2[0-9a-f]{3}|3[0-9a-f]{3}|f[cde][0-9a-f]{2}):"), one).otherwise(against)
        size = F.when(m.contains(":"), 2).when(F.length(dots) < 9, 0).otherwise(1)
    elif kind == "card":
        form = F.when(F.call_function("luhn_check", digits), one).otherwise(against)
        known = F.when(digits.rlike(ISSUERS), one).otherwise(against)
        size = F.when(n == 16, 1).when(n == 15, 2).otherwise(0)
    else:
        form = F.when(m.rlike(r"^\+[0-9]") & n.between(10, 15), one).when(m.contains("("), one).otherwise(none)
        known = F.when(m.startswith("+"), F.when(F.regexp_extract(m, r"^\+([0-9]{1,2})", 1).isin(CALLING_CODES) | F.regexp_extract(m, r"^\+([0-9])", 1).isin(CALLING_CODES), one).otherwise(against)).otherwise(none)
        size = F.when(n < 10, 0).when(n <= 11, 1).when(n <= 15, 2).otherwise(3)
    good, bad = CONTEXT[kind]
    context = F.when(before.rlike(good), one).when(before.rlike(bad), against).otherwise(none)
    return [form, known, context, size]


def candidates(text: Column) -> Column:
    """All base spans and loose candidates of a text: (a, b, kind, base, key); ``key`` names kind, votes and length class."""
    digit = text.rlike("[0-9]")
    base = {"email": (EMAIL, text.contains("@")), "ip": (IP, text.rlike(r"[0-9]\.[0-9]")), "card": (CARD, digit), "phone": (PHONE, text.contains("+"))}
    loose = {
        "email": text.rlike(r"(?i)[\[(]at[\])]|@\x20|\x20@|[\[(]dot[\])]"),
        "ip": text.rlike(r"[0-9]\x20?[\[(](?:\.|dot)[\])]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]"),
        "card": text.rlike("[0-9]{4}"),
        "phone": text.rlike("[0-9]{3}[ .-][0-9]{4}"),
    }
    parts = []
    for kind in KINDS:
        parts.append(_rows(text, kind, True, *base[kind]))
        none = F.array().cast(_FOUND)
        parts.append(F.when(loose[kind], _let(blanked(text, kind, *base[kind]), _looser(kind))).otherwise(none))
    return F.concat(*parts)


def _looser(kind: str) -> Callable[[Column], Column]:
    return lambda t: _rows(t, kind, False, LOOSE[kind], F.lit(True))


def _rows(text: Column, kind: str, sure: bool, pattern: str, when: Column) -> Column:
    found = spans_of(text, pattern, when)
    if sure:
        found = F.filter(found, lambda s: _valid(kind, s["m"]))

    def row(s: Column) -> Column:
        key = F.concat_ws("|", F.lit(kind), *[v.cast("string") for v in _votes(kind, s["m"], s["before"])])
        return F.struct(s["a"].alias("a"), F.lit(KINDS.index(kind)).alias("kind"), s["b"].alias("b"), F.lit(sure).alias("base"), key.alias("key"))

    return F.transform(found, row)


def _of_kind(spans: str, k: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == k)


def estimate(counts: dict[tuple[str, int, int, int, int], int], rounds: int = EM_ROUNDS) -> dict[str, float]:
    """Probability that a candidate is personal data, by key, for all keys there can be.

    ``counts`` are candidates by (kind, three votes, length class). For each kind: expectation-maximisation over the votes
    (a labeler's votes depend on the truth alone), from the majority vote on; then naive Bayes on votes and length
    class with the estimated truth as labels. A labeler starts out as one that agrees with the truth ``TRUST`` times for every time
    that it doesn't, which tells the two classes apart and decides alone where a kind has no candidates.
    """
    out = {}
    for kind in KINDS:
        own = {k[1:]: n for k, n in counts.items() if k[0] == kind}
        total = sum(own.values())
        truth = {k: min(0.95, max(0.05, 0.5 + 0.3 * sum(k[:3]))) for k in own}

        def shares(column: int, values: tuple[int, ...], truth: dict, own: dict) -> list[dict[int, float]]:
            agree = [lambda v: TRUST if v < 0 else 1.0, lambda v: TRUST if v > 0 else 1.0] if column < 3 else [lambda v: 1.0] * 2
            sums = [{v: agree[y](v) for v in values} for y in range(2)]
            for k, n in own.items():
                sums[1][k[column]] += n * truth[k]
                sums[0][k[column]] += n * (1 - truth[k])
            return [{v: x / sum(s.values()) for v, x in s.items()} for s in sums]

        def posterior(k: tuple, tables: list, prior: float) -> float:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[1][k[c]] / t[0][k[c]]) for c, t in tables)
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))

        def prior_of(truth: dict, own: dict, total: int) -> float:
            return (sum(n * truth[k] for k, n in own.items()) + 1) / (total + 2)

        for _ in range(rounds if own else 0):
            tables = [(c, shares(c, (-1, 0, 1), truth, own)) for c in range(3)]
            prior = prior_of(truth, own, total)
            truth = {k: posterior(k, tables, prior) for k in own}
        tables = [(c, shares(c, (-1, 0, 1), truth, own)) for c in range(3)] + [(3, shares(3, (0, 1, 2, 3), truth, own))]
        prior = prior_of(truth, own, total)
        for k in itertools.product((-1, 0, 1), (-1, 0, 1), (-1, 0, 1), (0, 1, 2, 3)):
            out["|".join(map(str, (kind, *k)))] = posterior(k, tables, prior)
    return out


def fit(docs: DataFrame) -> dict[str, float]:
    """``estimate`` from all candidates of ``docs``; what is collected is one row for each pattern of votes (432 at most)."""
    keys = docs.select(F.explode(F.transform(candidates(F.coalesce(F.col("text"), F.lit(""))), lambda c: c["key"])).alias("key"))
    rows = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {}
    for r in rows:
        kind, *votes = r["key"].split("|")
        counts[(kind, *map(int, votes))] = r["n"]
    return estimate(counts)


def find(docs: DataFrame, model: dict[str, float], accept: float = ACCEPT) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text).

    Rows: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of ``kind:start:end`` by start, then kind,
    comma-joined), spans (the base spans and those added, joined likewise). Places are in code points, end exclusive.
    A null or empty text has no spans. Rows repeat as the input's do; a null doc_id stays null, other columns are ignored, and
    an empty table gives an empty one. Of the added spans none overlaps a base span of its kind.
    """
    added = sorted(k for k, p in model.items() if p >= accept)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(F.coalesce(F.col("text"), F.lit(""))).alias("c"))
    found = found.select("doc_id", F.filter("c", lambda c: c["base"]).alias("base"), F.filter("c", lambda c: c["base"] | c["key"].isin(added)).alias("every"))
    names = F.array(*[F.lit(k) for k in KINDS])
    plain = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["a"], s["kind"], s["b"]))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["a"].cast("string"), s["b"].cast("string")))
    counts = [F.size(_of_kind("base", k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.array_join(plain("base"), ","), 256).alias("base_sha256"), F.array_join(plain("every"), ",").alias("spans"))
