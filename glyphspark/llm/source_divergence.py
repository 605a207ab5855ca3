"""Op 13: audit of how the sources of a language differ in their terms. DataFrame functions only.

1. A text's terms are sorted, and runs of equal ones become (term, occurrences): one row for each distinct term of a document,
   so a count of rows is a count of documents. Partial sums by (language, source, term) leave each task before the shuffle,
   whatever share of the rows one source or one term has.
2. Each term is pivoted into a wide vector: an array of counts with a place for every source of the language.
3. Higher-order functions turn counts into smoothed shares, and emit a contribution for each pair of sources, which partial
   sums add up on the map side: only pairs are shuffled, not terms.
The tables that are joined by language hold a row for each language, with arrays as long as its sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspark.llm._spark import checkpointed, join_counted, let

#: What lies between terms (every ASCII character but letters), documents that a kept term needs, terms reported for a group.
BETWEEN, MIN_DOCS, TOP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", 10, 10
#: Shares are whole numbers of billionths.
SCALE = 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(text: Column) -> Column:
    """array<struct<term, n>> of a text's distinct terms."""
    ascii_only = F.length(text) == F.octet_length(text)  # then lowering by character classes is the same, and far cheaper
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    terms = F.sort_array(F.array_remove(F.split(lowered, BETWEEN, -1), ""))

    def runs(of: Column) -> Column:
        ends = F.filter(F.transform(of, lambda x, i: F.when(~x.eqNullSafe(F.get(of, i + 1)), i + 1)), lambda e: e.isNotNull())
        return let(ends, lambda at: F.transform(at, lambda e, k: F.struct(F.get(of, e - 1).alias("term"), (e - F.coalesce(F.get(at, k - 1), F.lit(0))).cast("long").alias("n"))))

    return let(terms, runs)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact beyond 64 bits."""
    wide = lambda x: x.cast("decimal(20,0)")
    return F.call_function("div", (wide(count) + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(kept) * 2) + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): shares are at most SCALE + 1, so it fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def wide_terms(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, term, counts) of the kept terms, counts in the order of the language's sources; and (lang, sources) of all groups."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    groups = rows.select("lang", "source").distinct()
    sources = checkpointed(groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources")))
    found = rows.select("lang", "source", F.inline(term_counts(F.col("text"))))
    counted = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    terms = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source")).where(F.col("docs") >= min_docs)
    terms = join_counted(terms, sources, "lang", "inner")
    return checkpointed(terms.select("lang", "term", F.transform("sources", lambda s: F.coalesce(F.element_at("by_source", s), F.lit(0).cast("long"))).alias("counts"))), sources


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """How the (lang, source) groups of ``docs`` (text, lang, source) differ: lang, source, part, item, value, rank.

    Part ``pair``: a row for every ordered pair of sources of a language, the value summed over the language's kept terms (those in at
    least ``min_docs`` of its rows). Part ``term``: the ``top`` terms of a group whose share exceeds the language's. Higher
    values first, equal ones by item. Null text, lang or source count as empty strings, which are a group like others; a group without
    terms has its pairs and no term rows; a language without kept terms has pairs of value 0, one with a single source has
    none. Rows count as documents, so repeated rows count again. Other columns are ignored; an empty table gives an empty one.
    """
    terms, sources = wide_terms(docs, min_docs)
    totals = terms.select("lang", F.posexplode("counts").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kept"))
    totals = totals.groupBy("lang").agg(F.max("kept").alias("kept"), F.transform(F.sort_array(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("totals"))
    totals = checkpointed(totals.join(sources, "lang"))
    zero = F.lit(0).cast("long")
    shares = F.transform("counts", lambda c, i: share(c, F.get("totals", i), F.col("kept")))
    whole = share(F.aggregate("counts", zero, lambda a, c: a + c), F.aggregate("totals", zero, lambda a, c: a + c), F.col("kept"))
    vectors = join_counted(terms, totals, "lang", "inner").select("lang", "term", "sources", "counts", shares.alias("p"), whole.alias("q"))
    vectors = checkpointed(vectors)  # shares are computed once, not in each of the two parts

    contributions = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b, j: F.struct(i.alias("i"), (i + 1 + j).alias("j"), difference(a, b).alias("f")))))
    sums = vectors.select("lang", F.inline(contributions)).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    sums = sums.select("lang", "i", "j", "value").union(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    others = lambda s, i: F.transform("sources", lambda o, j: F.struct(i.alias("i"), j.alias("j"), s.alias("source"), o.alias("item")))
    grid = sources.select("lang", F.inline(F.flatten(F.transform("sources", others)))).where("i <> j")
    pair = grid.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))

    over = F.filter(F.transform("p", lambda p, i: F.when((F.get("counts", i) > 0) & (p > F.col("q")), F.struct(F.get("sources", i).alias("source"), difference(p, F.col("q")).alias("value")))), lambda x: x.isNotNull())
    term = vectors.select("lang", F.col("term").alias("item"), F.inline(over)).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    return ranked(pair).union(ranked(term).where(F.col("rank") <= top))
