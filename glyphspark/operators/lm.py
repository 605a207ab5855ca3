"""Character language models as staged joins on n-gram tables, one or two joins a stage, each on the full key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspark.operators import ngrams as N
from glyphspark.operators.lm_store import StoredStats, stored
from glyphspark.operators.shared import checkpointed

#: Discount of Kneser-Ney and absolute discounting, probability of what was never seen, usual power.
DISCOUNT, UNSEEN, LM_POWER = 0.75, 4.5399929762484854e-05, 4.0


def history() -> Column:
    return F.expr("substring(g, 1, n - 1)")


def shorter() -> Column:
    return F.expr("substring(g, 2, n - 1)")


def _with_history(tok: DataFrame) -> DataFrame:
    """(lang, g, n, t, t_h): n-grams with the count of their history (of all tokens for order 1)."""
    total = tok.where("n = 1").groupBy("lang").agg(F.sum("t").alias("t_h"))
    ones = tok.where("n = 1").join(F.broadcast(total), "lang")  # a row a language
    higher = tok.where("n > 1").withColumn("h", history())
    hist = tok.select("lang", F.col("g").alias("h"), F.col("t").alias("t_h"))
    return ones.select("lang", "g", "n", "t", "t_h").union(higher.join(hist, ["lang", "h"]).select("lang", "g", "n", "t", "t_h"))


def mle(tok: DataFrame) -> DataFrame:
    """(lang, g, n, p): share of the history's occurrences."""
    return _with_history(tok).select("lang", "g", "n", (F.col("t") / F.col("t_h")).alias("p"))


def absolute_discount(tok: DataFrame, order: int) -> DataFrame:
    """(lang, g, n, p): absolute discounting, backed by the next shorter n-gram."""
    own, hist = _with_history(tok), N.history_types(tok)
    level = own.where("n = 1").select("lang", "g", "n", (F.col("t") / F.col("t_h")).alias("p"))
    out = level
    for n in range(2, order + 1):
        level = _discounted(own.where(F.col("n") == n), hist, level)
        out = out.union(level)
    return out


def _discounted(own: DataFrame, hist: DataFrame, lower: DataFrame) -> DataFrame:
    lower = lower.select("lang", F.col("g").alias("s"), F.col("p").alias("below"))
    rows = own.withColumn("h", history()).withColumn("s", shorter()).join(hist, ["lang", "h"]).join(lower, ["lang", "s"])
    p = F.greatest(F.lit(0.0), F.col("t") - DISCOUNT) / F.col("t_h") + F.col("hist") * DISCOUNT / F.col("t_h") * F.col("below")
    return rows.select("lang", "g", "n", p.alias("p"))


def kneser_ney(tok: DataFrame, order: int) -> DataFrame:
    """(lang, g, n, p) of all observed n-grams up to ``order``: the highest order by counts, those below by types.

    Order 1 is the plain share of tokens. The lower levels take all n-grams that end some longer one.
    """
    own, hist, low, norm = _with_history(tok), N.history_types(tok), N.lower_types(tok), N.lower_normalizers(tok)
    low = low.withColumn("n", F.length("g"))
    pairs = norm.where("m = ''").select("lang", F.col("norm").alias("pairs"))
    level = low.where("n = 1").join(F.broadcast(pairs), "lang").select("lang", "g", "n", (F.col("low") / F.col("pairs")).alias("p"))
    out = own.where("n = 1").select("lang", "g", "n", (F.col("t") / F.col("t_h")).alias("p"))
    for n in range(2, order + 1):
        out = out.union(_discounted(own.where(F.col("n") == n), hist, level))
        if n < order:
            by_type = low.where(F.col("n") == n).withColumn("m", history()).join(norm, ["lang", "m"]).select("lang", "g", "n", F.col("low").alias("t"), F.col("norm").alias("t_h"))
            level = _discounted(by_type, hist, level)
    return out


def powered(prob: DataFrame, power: float = LM_POWER) -> DataFrame:
    return prob.withColumn("p", F.pow("p", F.lit(power)))


def interpolated(long: DataFrame, short: DataFrame, weight: float, cut: int) -> DataFrame:
    """Mixture of a model and one of order ``cut`` that sees the end of the context only; ``weight`` goes to the first."""
    short = short.select("lang", F.col("g").alias("s"), F.col("p").alias("q"))
    rows = long.withColumn("s", F.expr(f"substring(g, greatest(n - {cut} + 1, 1), {cut})")).join(short, ["lang", "s"])
    return rows.select("lang", "g", "n", (F.col("p") * weight + F.col("q") * (1 - weight)).alias("p"))


def uniform(active: DataFrame) -> DataFrame:
    """(lang, char, p): every active character alike."""
    return active.join(F.broadcast(active.groupBy("lang").agg((1.0 / F.count(F.lit(1))).alias("p"))), "lang")


def priors(counts: DataFrame) -> DataFrame:
    """(lang, prior) from (lang, w): shares of the weights, which must be positive."""
    return counts.select("lang", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("prior"))  # a row a language


def check_priors(weights: dict[str, float], keep: float) -> None:
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("priors must be there and positive")
    if not 0 < keep <= 1:
        raise ValueError("the probability to keep a language must be over 0 and 1 at most")


def transitions(prior: DataFrame, keep: float) -> DataFrame:
    """(from_lang, to_lang, p): keep or leave a language, in proportion to priors, scaled to 1 by source. Languages are few."""
    count = F.count(F.lit(1)).over(Window.partitionBy("from_lang"))
    pairs = prior.select(F.col("lang").alias("from_lang")).crossJoin(prior.select(F.col("lang").alias("to_lang"), "prior"))
    share = F.when(F.col("from_lang") == F.col("to_lang"), F.lit(keep)).otherwise(F.lit(1.0 - keep) / (count - 1))
    weighed = pairs.withColumn("x", F.when(count == 1, F.lit(1.0)).otherwise(share * F.col("prior")))
    return weighed.select("from_lang", "to_lang", (F.col("x") / F.sum("x").over(Window.partitionBy("from_lang"))).alias("p"))


def marginal(wanted: DataFrame, tok: DataFrame, prior: DataFrame, order: int, kind: str = "kneser_ney") -> DataFrame:
    """(g, p): probability of any n-grams ``wanted`` (g) over all languages, each language by its own back-off."""
    grid = wanted.select("g").distinct().crossJoin(F.broadcast(prior.select("lang")))  # a row a language
    prob = backed_off(grid, tok, order, kind)
    return prob.join(F.broadcast(prior), "lang").groupBy("g").agg(F.sum(F.col("p") * F.col("prior")).alias("p"))


def shrink(contexts: DataFrame, hist: DataFrame, order: int) -> DataFrame:
    """(lang, context, shrunk): the longest end of a context that has continuations; one join a length, longest first."""
    out = contexts.select("lang", "context").distinct()
    found = []
    for n in range(order, 0, -1):
        known = hist.where(F.length("h") == n).select("lang", F.col("h").alias(f"_s{n}"), F.lit(True).alias(f"_k{n}"))
        out = out.withColumn(f"_s{n}", F.when(F.length("context") >= n, F.right("context", F.lit(n)))).join(known, ["lang", f"_s{n}"], "left")
        found.append(F.when(F.col(f"_k{n}"), F.col(f"_s{n}")))
    return out.select("lang", "context", F.coalesce(*found, F.lit("")).alias("shrunk"))


_STATS = ("t", "low", "hist", "norm")


def _statistics(tok: DataFrame) -> DataFrame:
    """The rows of ``lookup`` before they are added up."""
    none = F.lit(0).cast("long")
    part = lambda df, s, **have: df.select("lang", s.alias("s"), *[have.get(c, none).cast("long").alias(c) for c in _STATS])
    rows = part(tok, F.col("g"), t=F.col("t")).union(part(tok.where("n = 1"), F.lit(""), t=F.col("t")))
    rows = rows.union(part(N.lower_types(tok), F.col("g"), low=F.col("low"))).union(part(N.history_types(tok), F.col("h"), hist=F.col("hist")))
    return rows.union(part(N.lower_normalizers(tok), F.col("m"), norm=F.col("norm")))


def lookup(tok: DataFrame) -> DataFrame:
    """(lang, s, t, low, hist, norm): occurrences of a string, distinct characters before and after it, and pairs around it.

    The empty string has all tokens and all bigram types.
    """
    return _statistics(tok).groupBy("lang", "s").agg(*[F.sum(c).alias(c) for c in _STATS])


def of_endings(strings: DataFrame, rows: DataFrame, order: int) -> DataFrame:
    """(lang, s, v): for each of the distinct ``strings`` (lang, s) the statistics of its endings, the shortest first.

    Statistics ``rows`` and strings are dealt together by their last two characters and sorted from the end, where every ending
    stands right before what ends with it: all lengths are found in the one pass over the sorted rows. Single characters
    come by a join of their own.
    """
    none = F.lit(0).cast("long")
    table = rows.where("s <> '' and lang is not null").select("lang", "s", *_STATS, F.lit(False).alias("asked"))
    both = table.union(strings.where("s <> ''").select("lang", "s", *[none for _ in _STATS], F.lit(True)))
    both = both.withColumn("_2", F.reverse(F.right("s", F.lit(2)))).repartition("lang", "_2")
    both = both.groupBy("lang", "_2", "s").agg(*[F.sum(c).alias(c) for c in _STATS], F.max("asked").alias("asked"))
    back = F.reverse("s")
    both = both.withColumns({f"_{i}": F.substring(back, 1, i) for i in range(3, order + 1)}).withColumn("_all", back)
    own = F.struct(*_STATS)
    for i in range(2, order + 1):
        after = [f"_{k}" for k in range(i + 1, order + 1)] + ["_all"]
        w = Window.partitionBy("lang", *[f"_{k}" for k in range(2, i + 1)]).orderBy(*after).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn(f"_v{i}", F.first(F.when(F.length("s") == i, own)).over(w))
    single = table.where(F.length("s") == 1).groupBy("lang", F.col("s").alias("_c")).agg(*[F.sum(c).alias(c) for c in _STATS]).select(F.col("lang").alias("_l"), "_c", own.alias("_v1"))
    both = both.where("asked").join(single, (F.col("lang") == F.col("_l")) & (F.right("s", F.lit(1)) == F.col("_c")), "left")
    return both.select("lang", "s", F.array(*[F.col(f"_v{i}") for i in range(1, order + 1)]).alias("v"))


def backed_off(wanted: DataFrame, tok: DataFrame, order: int, kind: str = "kneser_ney") -> DataFrame:
    """(lang, g, p) of any n-grams ``wanted`` (lang, g; up to ``order`` characters), seen or not, from counts ``tok``.

    The longest history that was ever seen decides: ``mle`` takes its share, ``absolute`` and ``kneser_ney`` discount and go on with
    shorter ones; what no history knows has the probability ``UNSEEN``. Kneser-Ney takes token counts where the whole n-gram
    is usable, and types below; a history that is only ever at a start has no types and passes to the next shorter one. A
    language without counts gives ``UNSEEN``. All that an n-gram asks for are endings of it and of its history (``of_endings``).
    """
    if kind not in ("mle", "absolute", "kneser_ney"):
        raise ValueError(f"unknown model: {kind!r}")
    wanted = checkpointed(wanted.select("lang", "g").distinct())  # read three times below
    rows = _statistics(tok)
    length = F.length("g")
    before = F.expr("substring(g, 1, length(g) - 1)")
    asked = wanted.select("lang", F.col("g").alias("s")).union(wanted.select("lang", before.alias("s"))).distinct()
    found = of_endings(asked, rows, order)
    totals = rows.where("s = ''").groupBy("lang").agg(F.sum("t").alias("total"), F.sum("norm").alias("pairs"))
    own, context = (found.select(F.col("lang").alias(f"_l{x}"), F.col("s").alias(f"_s{x}"), F.col("v").alias(x)) for x in ("own", "ctx"))
    rows = wanted.withColumn("_before", before)
    rows = rows.join(own, (F.col("lang") == F.col("_lown")) & (F.col("g") == F.col("_sown")), "left").join(context, (F.col("lang") == F.col("_lctx")) & (F.col("_before") == F.col("_sctx")), "left")
    rows = rows.select("lang", "g", "own", "ctx").join(F.broadcast(totals), "lang", "left")  # a row a language

    def of(slot: int, name: str) -> Column:
        """Slot 2 i: the ending of length i; 2 i + 1: what stands before its last character."""
        which = F.get("own", slot // 2 - 1) if slot % 2 == 0 else F.get("ctx", slot // 2 - 2)
        return F.coalesce(which[name], F.lit(0).cast("long")).cast("double")

    level: dict[int, Column] = {}
    for i in range(1, order + 1):
        whole, norm, low, pairs, hist = of(2 * i, "t"), of(2 * i + 1, "t") if i > 1 else F.col("total"), of(2 * i, "low"), of(2 * i + 1, "norm") if i > 1 else F.col("pairs"), of(2 * i + 1, "hist")
        rows = rows.withColumns({f"_t{i}": whole, f"_tn{i}": F.coalesce(norm, F.lit(0.0)), f"_l{i}": low, f"_ln{i}": F.coalesce(pairs, F.lit(0)).cast("double"), f"_h{i}": hist})
        t, tn, l, ln, h = (F.col(f"_{c}{i}") for c in ("t", "tn", "l", "ln", "h"))
        share = F.when(t == 0, F.lit(UNSEEN)).otherwise(F.try_divide(t, tn))
        discounted = lambda x, n, below: F.try_divide(F.greatest(F.lit(0.0), x - DISCOUNT), n) + F.try_divide(h * DISCOUNT, n) * below  # noqa: B023, E731
        if kind == "mle":
            rows = rows.withColumn(f"_p{i}", F.try_divide(t, tn))
        elif kind == "absolute":
            rows = rows.withColumn(f"_p{i}", share if i == 1 else discounted(t, tn, F.col(f"_p{i - 1}")))
        elif i == 1:
            rows = rows.withColumns({"_k1": F.when((l == 0) | (ln == 0), F.lit(UNSEEN)).otherwise(l / ln), "_p1": share})
        else:
            below = F.col(f"_k{i - 1}")
            kn = F.when(ln == 0, below).otherwise(discounted(l, ln, below))
            rows = rows.withColumns({f"_k{i}": kn, f"_p{i}": F.when(length == i, discounted(t, tn, below)).otherwise(kn)})
        level[i] = F.when(tn > 0, F.col(f"_p{i}"))
    return rows.select("lang", "g", F.coalesce(*[level[i] for i in range(order, 0, -1)], F.lit(UNSEEN)).alias("p"))


#: Rows of a probability table that is broadcast (some 60 bytes each) after a count.
BROADCAST_TYPES = 400_000


def log_of(p: Column) -> Column:
    """Natural logarithm of a probability; that of 0 is minus infinity (Spark's own is null, which sums leave out)."""
    return F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))


def perplexity(lines: DataFrame, prob: DataFrame, order: int, by: tuple[str, ...] = ("doc_id",), types: int | None = None, power: float = 1.0) -> DataFrame:
    """(doc_id, n_chars, perplexity): the characters of lines, each after the ``order`` - 1 before it in its line.

    ``prob`` must have every n-gram of the lines (``backed_off``); one that is missing has the probability ``UNSEEN``, and one of
    probability 0 (its history was only ever at an end) makes the perplexity infinite. With ``types``,
    the counted rows of a small ``prob``, it goes to the n-grams where they are counted; else a document's n-grams are counted and joined by a shuffle. All
    probabilities are raised to ``power``, as models raise theirs, and aren't scaled to 1 again.
    """
    prob = prob.select("lang", "g", "p")
    if types is not None and types <= BROADCAST_TYPES:
        seen, prob = N.counted_in_parts(lines, order, (*by, "lang")).withColumnRenamed("t", "k"), F.broadcast(prob)
    else:
        seen = N.contexts(lines, order, (*by, "lang")).withColumnRenamed("t", "k")
    logs = seen.join(prob, ["lang", "g"], "left").withColumn("p", F.coalesce("p", F.lit(UNSEEN)))
    return logs.groupBy(*by).agg(F.sum("k").alias("n_chars"), F.exp(-F.sum(F.col("k") * log_of(F.col("p")) * power) / F.sum("k")).alias("perplexity"))


def runs_of(parts: DataFrame, key: str, order: str) -> DataFrame:
    """(key, run, lang, text): parts of a text (key, order, lang, text) put together as long as the language stays."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag("lang").over(w).eqNullSafe(F.col("lang")), 0).otherwise(1)
    numbered = parts.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "")
    return numbered.groupBy(key, "run").agg(F.first("lang").alias("lang"), joined.alias("text"))


def run_contexts(runs: DataFrame, orders: int | dict[str, int], key: str) -> DataFrame:
    """(key, lang, g, k): n-grams that end at the characters of runs; a context never reaches back over a change of language."""
    most = orders if isinstance(orders, int) else max(orders.values())
    seen = N.contexts(runs.select(key, "lang", F.col("text").alias("line")), most, (key, "lang"))
    if not isinstance(orders, int):
        own = F.create_map(*[F.lit(x) for pair in orders.items() for x in pair])
        seen = seen.withColumn("g", F.right("g", F.coalesce(own[F.col("lang")], F.lit(most)))).groupBy(key, "lang", "g").agg(F.sum("t").alias("t"))
    return seen.withColumnRenamed("t", "k")


def run_perplexity(runs: DataFrame, prob: DataFrame, prior: DataFrame, move: DataFrame, orders: int | dict[str, int], key: str = "doc_id", power: float = 1.0, types: int | None = None) -> DataFrame:
    """(key, n_chars, perplexity) of texts that change language: ``runs`` (key, run, lang, text; neighbours differ in language).

    Every character has the probability of its language's model after its context; the first one also that of its
    language, and one after a space that of staying or of the change (``move``). Languages can't change inside a word;
    texts where they do have a null perplexity. Probabilities of characters are raised to ``power``, those of languages are not.
    With ``types``, the counted rows of a small ``prob``, it goes to the n-grams where they are counted.
    """
    small = types is not None and types <= BROADCAST_TYPES and isinstance(orders, int)
    seen = N.counted_in_parts(runs.select(key, "lang", F.col("text").alias("line")), orders, (key, "lang")).withColumnRenamed("t", "k") if small else run_contexts(runs, orders, key)
    prob = F.broadcast(prob.select("lang", "g", "p")) if small else prob
    logs = seen.join(prob.select("lang", "g", "p"), ["lang", "g"], "left")
    logs = logs.groupBy(key).agg(F.sum("k").alias("n_chars"), F.sum(F.col("k") * log_of(F.coalesce("p", F.lit(UNSEEN))) * power).alias("_c"))
    w = Window.partitionBy(key).orderBy("run")
    inner = F.expr("substring(text, 1, length(text) - 1)")
    turns = runs.select(key, "run", "lang", F.lag("lang").over(w).alias("_from"), F.lag(F.right("text", F.lit(1))).over(w).alias("_end"), (F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit("")))).alias("_stays"))
    moves = move.select(F.col("from_lang").alias("_from"), F.col("to_lang").alias("lang"), F.col("p").alias("_change"))
    stays = move.where("from_lang = to_lang").select(F.col("from_lang").alias("lang"), F.col("p").alias("_stay"))
    turns = turns.join(F.broadcast(prior), "lang").join(F.broadcast(moves), ["_from", "lang"], "left").join(F.broadcast(stays), "lang")  # languages, and their pairs
    enter = F.when(F.col("_from").isNull(), F.log("prior")).when(F.col("_end") == " ", F.log("_change"))
    turns = turns.groupBy(key).agg(F.sum(enter + F.col("_stays") * F.log("_stay")).alias("_s"), F.count_if(enter.isNull()).alias("_bad"))
    out = logs.join(turns, key)
    return out.select(key, "n_chars", F.when(F.col("_bad") == 0, F.exp(-(F.col("_c") + F.col("_s")) / F.col("n_chars"))).alias("perplexity"))


def cross_perplexity(lines: DataFrame, tok: DataFrame, order: int, by: str = "doc_id") -> DataFrame:
    """(doc_id, model, n_chars, perplexity): lines under the model of every language of ``tok``, mostly not their own."""
    models = tok.select("lang").distinct()
    wanted = N.contexts(lines, order, ()).select("g").crossJoin(F.broadcast(models))  # a row a language
    prob = checkpointed(backed_off(wanted, tok, order))
    small = prob.count() <= BROADCAST_TYPES
    seen = (N.counted_in_parts if small else N.contexts)(lines, order, (by,)).withColumnRenamed("t", "k")
    logs = prob.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("lang", log_of(F.col("p")).alias("p")))).alias("m"))
    sums = seen.join(F.broadcast(logs) if small else logs, "g").select(by, "k", F.explode("m").alias("model", "p")).groupBy(by, "model")
    return sums.agg(F.sum("k").alias("n_chars"), F.exp(-F.sum(F.col("k") * F.col("p")) / F.sum("k")).alias("perplexity"))


def mixed(probs: list[tuple[DataFrame, float]]) -> DataFrame:
    """(lang, g, p): models over the same n-grams, mixed by weights that are scaled to 1. Each model has shrunk contexts by itself (``backed_off``)."""
    if not probs or any(w <= 0 for _, w in probs):
        raise ValueError("weights must be there and positive")
    total = sum(w for _, w in probs)
    rows = [df.select("lang", "g", (F.col("p") * (w / total)).alias("p")) for df, w in probs]
    out = rows[0]
    for df in rows[1:]:
        out = out.union(df)
    return out.groupBy("lang", "g").agg(F.sum("p").alias("p"))


class Backoff:
    """A language's model for kernels: the probability of any character after any context, by the rules of ``backed_off``.

    ``stats`` gives the counts of a string as ``lookup`` has them: a dictionary, or a store's.
    """

    def __init__(self, stats: dict[str, tuple[int, int, int, int]] | StoredStats, order: int, power: float = LM_POWER):
        self.stats, self.order, self.power = stats, order, power

    def _kn(self, s: str) -> float:
        low = self.stats.get(s, (0, 0, 0, 0))[1]
        _, _, hist, norm = self.stats.get(s[:-1], (0, 0, 0, 0))
        if len(s) == 1:
            return low / norm if low and norm else UNSEEN
        below = self._kn(s[1:])
        return max(0.0, low - DISCOUNT) / norm + hist * DISCOUNT / norm * below if norm else below

    def raw(self, context: str, char: str) -> float:
        context = context[len(context) - self.order + 1 :] if len(context) >= self.order else context
        whole = context + char
        while context and not self.stats.get(context, (0,))[0]:
            context = context[1:]
        s = context + char
        t = self.stats.get(s, (0,))[0]
        total, _, hist, _ = self.stats.get(context, (0, 0, 0, 0))
        if not context:
            return t / total if t else UNSEEN
        if s == whole:
            return max(0.0, t - DISCOUNT) / total + hist * DISCOUNT / total * self._kn(s[1:])
        return self._kn(s)

    def __call__(self, context: str, char: str) -> float:
        return self.raw(context, char) ** self.power

    def shrink(self, context: str) -> str:
        """The longest end of a context that has continuations."""
        context = context[-(self.order - 1) :] if self.order > 1 else ""
        while context and not self.stats.get(context, (0, 0, 0, 0))[2]:
            context = context[1:]
        return context


class Mixture:
    """A weighted sum of models; each shrinks the context by itself."""

    def __init__(self, parts: list[tuple[Backoff, float]]):
        total = sum(w for _, w in parts)
        self.parts, self.order = [(m, w / total) for m, w in parts], max(m.order for m, _ in parts)

    def __call__(self, context: str, char: str) -> float:
        return sum(w * m(m.shrink(context), char) for m, w in self.parts)


def models_of(tok: DataFrame, order: int, power: float = LM_POWER, path: str | None = None) -> dict[str, Backoff]:
    """A model for each language of the counts ``tok``, over a store at ``path`` (or in the shared folder) that tasks map into memory."""
    return {lang: Backoff(own, order, power) for lang, own in stored(lookup(tok), path).items()}


def switch_table(priors: dict[str, float], keep: float) -> dict[tuple[str, str], float]:
    """``transitions`` on a dictionary, for kernels."""
    check_priors(priors, keep)
    if len(priors) == 1:
        return {(a, a): 1.0 for a in priors}
    raw = {(a, b): (keep if a == b else (1 - keep) / (len(priors) - 1)) * priors[b] for a in priors for b in priors}
    return {(a, b): x / sum(raw[a, c] for c in priors) for (a, b), x in raw.items()}


def reestimated(base: dict[str, Backoff | Mixture], texts: DataFrame, order: int, power: float = LM_POWER, weight: float = 0.5, path: str | None = None) -> tuple[dict[str, Backoff | Mixture], dict[str, float]]:
    """Models and priors after reading ``texts`` (lang, line): each language's first model mixed with one of its new text.

    A language without new text keeps its model. Priors are the characters read, and one more. The new models' store is written at ``path``.
    """
    tok = N.token_counts(texts.select("lang", "line"), order)
    fresh = models_of(tok, order, power, path)
    models, priors = {}, {}
    for lang, model in base.items():
        first = model.parts[0][0] if isinstance(model, Mixture) else model
        new = fresh.get(lang)
        models[lang] = Mixture([(first, 1 - weight), (new, weight)]) if new else model
        priors[lang] = (new.stats[""][0] if new else 0) + 1.0
    total = sum(priors.values())
    return models, {lang: p / total for lang, p in priors.items()}
