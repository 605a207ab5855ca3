"""Op 10: URL filters by rules, and for what no rule fits by trust that spreads over the host graph.

Host edges are the absolute links of all pages (a relative one leads to its own host) and, both ways, the step from a host to
its parent domain down to two labels, so that the hosts of one site or registrable domain hang together. Trust is a
personalised PageRank from trusted seeds along the edges, distrust one from blocked seeds against them; both run in the
same rounds. A seed weighs as much as the share of its pages that rules allow (block). A host is blocked whose
distrust exceeds its trust by a threshold, in units of the mean over hosts. Ranks are kept by host, a round is one
join and one aggregate with partial sums.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspark.llm._spark import BROADCAST_BYTES, checkpointed

#: (action, rule): a rule is a host and the start of a path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
MAX_RULES, DAMPING, THRESHOLD = 1000, 0.85, 0.5
#: What of the rank's sum may be misplaced when the rounds end: 2 * DAMPING ** rounds at most, on any graph.
RESIDUAL = 0.005
#: Bytes of hosts for each part of a small graph.
PART_BYTES = 8 << 20
ROUNDS = math.ceil(math.log(RESIDUAL / 2) / math.log(DAMPING))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*+=\s*+["']?(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'\s>]++)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action, null where none fits. Of equally long ones, block wins, then the first by name."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[0] != "block", r[1])) if rules else []:
        at = text.find("/")
        own, start = (text[:at], text[at:]) if at >= 0 else (text, "")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between different hosts: absolute links in ``html``, and both ways from each host to its parent domain (two labels at least)."""
    own = pages.select(host_of(F.col("url")).alias("src"), F.col("html")).where("src <> ''")
    links = own.select("src", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    links = links.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    labels = F.split("src", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chain = own.select("src").distinct().where(F.size(labels) > 2).select(above.alias("above"))
    step = chain.select(F.explode(F.arrays_zip(F.slice("above", 1, F.size("above") - 1).alias("src"), F.slice("above", 2, F.size("above")).alias("dst"))).alias("e")).select("e.*").distinct()
    both = step.union(step.select("dst", "src")).withColumn("n", F.lit(1).cast("long"))
    return links.union(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank of several kinds at once: ``edges`` (kind, src, dst, n), ``seeds`` (kind, host, w) to (kind, host, rank).

    Seeds are scaled to a sum of 1 by kind. What a host without edges holds doesn't travel on. Without seeds or edges
    nothing is reached but the seeds themselves. Edges are laid out once and stay where they are: the ranks of a round come to
    them, broadcast where the hosts' bytes were counted and are few, else by a shuffle of the ranks alone. Their lineage
    begins at a checkpoint, so lost ones are laid out again.
    """
    spark = edges.sparkSession
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    steps = checkpointed(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.lit(damping) * F.col("n") / F.col("all")).alias("p")))
    size = lambda *hosts: F.sum(sum((F.octet_length(h) + 64 for h in hosts), F.lit(0)).cast("long"))
    most = (steps.agg(size("host", "dst")).first()[0] or 0) + (seeds.agg(size("host")).first()[0] or 0)  # every host of a rank is in one of them
    few = most <= BROADCAST_BYTES
    parts = -(-most // PART_BYTES) or 1 if few else int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = steps.coalesce(parts) if few else steps.repartition(parts, "kind", "host").persist(StorageLevel.DISK_ONLY)
    total = seeds.groupBy("kind").agg(F.sum("w").alias("all"))
    start = seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("w") / F.col("all")).alias("rank"))  # one row a kind
    laid = lambda df: checkpointed(df.coalesce(parts) if few else df)
    start = laid(start)
    rank = start
    for k in range(rounds):
        moved = steps.join(F.broadcast(rank) if few else rank, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("p")).alias("rank"))
        rank = moved.union(start.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if k % 4 == 3 or k == rounds - 1:
            rank = laid(rank)
    if not few:
        steps.unpersist()
    return rank


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """Verdict on every page of ``pages`` (page_id, url, html).

    Rows: page_id, host, path, rule (the longest fitting one or null), verdict (the rule's, else the graph's), score
    (distrust less trust of the host in units of the mean, rounded to 9 digits; 0 where nothing reaches it). Trusted seeds are
    hosts with pages that an allow rule fits, blocked seeds hosts with pages that a block rule fits, each weighted by the
    share of such pages. A score must exceed the threshold; one equal to it is allowed. A null url or one without ``://`` has empty
    host and path and no rule, and is allowed; a null html has no links. Rows repeat as the input's do, other columns are
    ignored, and an empty table gives an empty one.
    """
    rules = RULES if rules is None else rules
    base = pages.select("page_id", F.col("url").alias("_gs_url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_column(F.col("host"), F.col("path"), rules)
    judged = base.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), rule.alias("rule"), action.alias("action"))
    by_host = judged.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "allow").alias("good"), F.count_if(F.col("action") == "block").alias("bad"))
    by_host = checkpointed(by_host)
    share = lambda kind, pages: by_host.where(F.col(pages) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(pages) / F.col("n")).alias("w"))
    seeds = share("trust", "good").union(share("distrust", "bad"))
    edges = checkpointed(host_edges(pages))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    rank = propagate(both, seeds, rounds=rounds)
    n_hosts = by_host.count()
    score = rank.groupBy("host").agg(F.round(F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(-F.col("rank"))) * n_hosts, 9).alias("score"))
    scored = judged.join(score, "host", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("action", F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
