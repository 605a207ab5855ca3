"""Op 3: Jaccard self-join of word n-gram sets by prefix trees.

1. Every text's shingle set is hashed and summarised; equal sets become one class, so copies are joined only once.
2. Tokens of the classes, a half of them by hash (all of a small class), are dealt by hash in packed blocks; a class stays a candidate if
   so many of them occur in another class that no more are missing than a partner may lack. A token that repeats within a block is told there, so a frequent
   token reaches the task of its hash once for each block. Texts aren't moved: the sets of candidates are made from a second scan.
3. Candidates' tokens get their frequency; rarest first, the prefix that any partner must share a token of links
   classes into candidate groups (connected components).
4. Each group is joined on a prefix tree of its sets (tokens most frequent first, so that sets share their beginnings):
   a query walks the tree once for all sets below a node, carries the overlap so far, and leaves subtrees that
   can't reach the needed overlap with what remains, or, where components alone are asked for, that are all in its own
   component already. Groups beyond ``MAX_GROUP`` classes are joined in blocks, every pair of blocks once. Links are
   counted between classes and weighted by their copies.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.llm import _vec as V
from glyphspark.llm._repeats import repeats
from glyphspark.llm._spark import checkpointed, connected_components

#: Similar: PERCENT * |union| <= 100 * |intersection|.
PERCENT = 75
#: At this similarity and above half of the tokens are enough to find candidates; sets of up to SEND_ALL tokens send all of them, and those of up
#: to JUDGE_ALL, whose partners all do, are judged by all.
HALF_FROM, SEND_ALL, JUDGE_ALL = 70, 72, 48
#: Tokens of one task after dealing (about), classes joined in one tree, bits of the candidates' bitmap as a power of two at most.
TASK_TOKENS, MAX_GROUP, MAX_BITS = 2_000_000, 4000, 28


def class_sets(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: class ids (hashes of whole sets, 0 for empty ones), distinct tokens by text, offsets."""
    for part in V.slices(pa.RecordBatch.from_arrays([column], ["text"])):
        value, _, _, at = V.words(*V.text_bytes(part.column(0)))
        value, at = V.per_text_unique(*V.shingles(value, at, width))
        total = np.concatenate([[np.uint64(0)], np.cumsum(V.mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
        n = np.diff(at)
        yield np.where(n > 0, V.mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)), np.uint64(0)).view(np.int64), value, at


def _sampled(tok: np.ndarray) -> np.ndarray:
    """A half of all tokens, the same for every set."""
    return (tok & np.uint64(1)) == 0


def summaries(docs: DataFrame, width: int = V.WORDS_PER_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, cls, judged) of every text; equal sets have equal cls. ``judged``: tokens that candidates are found by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds: list[list[np.ndarray]] = [[], [], []]
            for cls, tok, at in class_sets(b.column(1), width):
                n = np.diff(at)
                half = np.diff(np.concatenate([[0], np.cumsum(_sampled(tok))])[at])
                for kind, x in zip(kinds, (n, cls, np.where((n <= JUDGE_ALL) | (percent < HALF_FROM), n, half)), strict=True):
                    kind.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.concatenate(x) if x else [], pa.int64()) for x in kinds]], ["doc_id", "n_shingles", "cls", "judged"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(V.releasing(run), "doc_id long, n_shingles long, cls long, judged long")


def _repeated(reps: DataFrame, buckets: int, width: int, percent: int) -> DataFrame:
    """(cls, repeated): how many tokens of a class, of those sent, another class has too (or rarely a few more)."""

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for cls, tok, at in class_sets(batch.column(0), width):
            n = np.diff(at)
            sent = _sampled(tok) | np.repeat((n <= SEND_ALL) | (percent < HALF_FROM), n)
            yield np.repeat(cls, n)[sent], tok[sent]

    return repeats(reps.select("text"), pairs, buckets).select(F.col("owner").alias("cls"), F.col("n").alias("repeated"))


def _bitmap(classes: DataFrame) -> tuple[bytes, int]:
    """A bit for every class (by the top bits of its hash), and the number of bits as a power of two: 32 MB at most."""
    n = classes.count()
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(max(1, 16 * n)))))
    page = 1 << 15
    bit = F.shiftrightunsigned("cls", 64 - bits)
    rows = classes.groupBy(F.floor(bit / page).alias("page")).agg(F.bitmap_construct_agg(bit % page).alias("map")).collect()
    out = bytearray(1 << (bits - 3))
    for r in rows:
        out[r["page"] * page // 8 : (r["page"] + 1) * page // 8] = r["map"]
    return bytes(out), bits


def _sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(cls, n, tok array<long>) of the classes ``wanted`` (cls). A bitmap spares most other sets the way to the join."""
    bitmap, bits = _bitmap(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bitmap, np.uint8)
        for b in batches:
            for cls, tok, at in class_sets(b.column(0), width):
                bit = (cls.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                n = np.diff(at)
                keep = np.flatnonzero((known[bit >> 3] >> (bit & 7) & 1).astype(bool) & (n > 0))
                if keep.size:
                    cls, own = cls[keep], n[keep]
                    tok = tok[np.repeat(at[keep] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32()), pa.array(tok.view(np.int64), pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(own, pa.int64()), lists], ["cls", "n", "tok"])

    found = docs.select("text").mapInArrow(V.releasing(run), "cls long, n long, tok array<long>").dropDuplicates(["cls"])
    return found.join(wanted.hint("shuffle_merge"), "cls", "left_semi")


class _Node:
    __slots__ = ("edge", "ink", "kids", "ends", "low", "deep", "rep", "mixed")

    def __init__(self, edge: list[int]):
        self.edge, self.ink, self.kids, self.ends = edge, frozenset(edge), {}, []
        self.low, self.deep, self.rep, self.mixed = 1 << 60, 0, -1, False


class PrefixTree:
    """Sets as ascending token lists in a path-compressed tree, with a union-find over the sets that were found similar."""

    def __init__(self, percent: int = PERCENT, on_pair: Callable[[int, int], None] | None = None):
        self.root, self.percent, self.up, self.size = _Node([]), percent, [], []
        self.on_pair = on_pair  # called for every similar pair; without it pairs inside a component are skipped

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, tokens: list[int], n: int) -> int:
        """Link a set of n tokens, of which those that others may share are given, to all similar ones, then store it."""
        own = len(self.up)
        self.up.append(own)
        self.size.append(n)
        self._link(own, tokens, n)
        self._store(own, tokens, n)
        return own

    def _link(self, own: int, tokens: list[int], n: int) -> None:
        percent, ink, total, find = self.percent, set(tokens), len(tokens), self.find
        stack = [(k, 0, 0) for k in self.root.kids.values()] if tokens else []
        stack += [(self.root, 0, 0)] if self.root.ends else []
        while stack:
            node, overlap, depth = stack.pop()
            if not self.on_pair and not node.mixed and find(node.rep) == find(own):
                continue
            if node.edge:
                overlap += len(node.ink & ink)
                depth += len(node.edge)
                rest = total - bisect_right(tokens, node.edge[-1])
            else:
                rest = total
            # 100 i >= p (a + b - i), with the smallest set and the longest rest below
            if (100 + percent) * (overlap + min(rest, node.deep - depth)) < percent * (n + node.low):
                continue
            for other in node.ends:
                if (100 + percent) * overlap >= percent * (n + self.size[other]):
                    a, b = find(own), find(other)
                    self.up[max(a, b)] = min(a, b)
                    if self.on_pair:
                        self.on_pair(own, other)
            if node is not self.root:
                stack += [(k, overlap, depth) for k in node.kids.values()]

    def _touch(self, node: _Node, own: int, depth: int, n: int) -> None:
        node.low, node.deep = min(node.low, n), max(node.deep, depth)
        if node.rep < 0:
            node.rep = own
        elif self.find(node.rep) != self.find(own):
            node.mixed = True

    def _store(self, own: int, tokens: list[int], n: int) -> None:
        node, at, total = self.root, 0, len(tokens)
        self._touch(node, own, total, n)
        while at < total:
            kid = node.kids.get(tokens[at])
            if kid is None:
                kid = node.kids[tokens[at]] = _Node(tokens[at:])
                at = total
            else:
                k, edge = 0, kid.edge
                while k < len(edge) and at < total and edge[k] == tokens[at]:
                    k, at = k + 1, at + 1
                if k < len(edge):
                    upper = _Node(edge[:k])
                    upper.low, upper.deep, upper.rep, upper.mixed = kid.low, kid.deep, kid.rep, kid.mixed
                    kid.edge, kid.ink = edge[k:], frozenset(edge[k:])
                    upper.kids[edge[k]] = kid
                    node.kids[upper.edge[0]] = upper
                    kid = upper
            self._touch(kid, own, total, n)
            node = kid
        node.ends.append(own)


def join_group(cls: list[int], n: list[int], sets: list[np.ndarray], percent: int = PERCENT, copies: list[int] | None = None, part: list[int] | None = None) -> tuple[list[int], list[int]]:
    """For each set of a group the smallest class of its component, and with ``copies`` the copies of all similar sets, else 0.

    With ``part``, only pairs of different parts are counted.
    """
    owner = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    token, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(token.size, np.int64)
    rank[np.lexsort((token, -count))] = np.arange(token.size)
    shared = count[place] > 1
    place, owner = rank[place[shared]], owner[shared]
    order = np.lexsort((place, owner))
    place, cuts = place[order], np.searchsorted(owner[order], np.arange(len(sets) + 1))
    turn = sorted(range(len(sets)), key=lambda k: (n[k], cls[k]))
    linked = [0] * len(sets)

    def count(a: int, b: int) -> None:
        a, b = turn[a], turn[b]
        if part is None or part[a] != part[b]:
            linked[a] += copies[b]
            linked[b] += copies[a]

    tree = PrefixTree(percent, count if copies else None)
    for k in turn:
        tree.add(place[cuts[k] : cuts[k + 1]].tolist(), n[k])
    least: dict[int, int] = {}
    for own, k in enumerate(turn):
        root = tree.find(own)
        least[root] = min(least.get(root, cls[k]), cls[k])
    out = [0] * len(sets)
    for own, k in enumerate(turn):
        out[k] = least[tree.find(own)]
    return out, linked


def ngram_components(docs: DataFrame, percent: int = PERCENT, width: int = V.WORDS_PER_SHINGLE, max_group: int = MAX_GROUP, links: bool = False) -> DataFrame:
    """Components of ``docs`` (doc_id, text) under links between similar shingle sets.

    Rows, one for each row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself
    included). A null, empty or wordless text has no shingles, links with nothing and is its own component; a text of fewer
    words than ``width`` has one shingle, the whole sequence. Rows with the same doc_id are one node. A row with a
    null doc_id links nothing and has a null component_id. Other columns are ignored; an empty table gives an empty one. With ``links`` also n_links: how many other rows with a doc_id have
    an equal or similar set; every similar pair of different sets is then tested.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = checkpointed(summaries(docs, width, percent))
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.max("judged").alias("judged"), F.count(F.lit(1)).alias("copies"))
    classes = checkpointed(classes)
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(parts, -(-total // TASK_TOKENS)))
    known = docs.where("doc_id is not null")
    repeated = _repeated(known, buckets, width, percent)
    # a partner lacks so many of a set's tokens at most, whichever of them are judged
    lacking = F.col("n") - F.ceil(F.col("n") * percent / 100)
    near = checkpointed(classes.join(repeated, "cls", "left").where(F.coalesce("repeated", F.lit(0)) >= F.col("judged") - lacking).select("cls"))
    sets = checkpointed(_sets(known, width, near))
    tokens = sets.select("cls", "n", F.explode("tok").alias("tok"))
    often = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_class = tokens.join(often, "tok").groupBy("cls").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("tok"))
    needed = F.ceil(F.col("n") * percent / 100)  # of its own tokens any partner has at least so many
    alone = F.col("n") - F.size("tok")
    prefix = by_class.where(F.size("tok") >= needed).select("cls", F.explode(F.slice("tok", F.lit(1), (F.col("n") - needed + 1 - alone).cast("int"))).alias("t")).select("cls", "t.tok")
    prefix = checkpointed(prefix)
    hub = prefix.groupBy("tok").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("df")).where("df > 1")
    groups = checkpointed(connected_components(prefix.join(hub, "tok").where("cls <> hub").select(F.col("cls").alias("u"), F.col("hub").alias("v")).distinct()))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > max_group).count() > 0
    blocks = F.ceil(F.col("size") * 2 / max_group).cast("int")
    dealt = groups.join(sizes, "component").join(sets.withColumnRenamed("cls", "node"), "node")
    dealt = dealt.withColumn("blocks", F.when(F.col("size") > max_group, blocks).otherwise(1)).withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    if links:
        dealt = dealt.join(classes.select(F.col("cls").alias("node"), "copies"), "node")
    dealt = dealt.select(F.col("node").alias("cls"), "n", "tok", "component", *(["own", "copies"] if links else []), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    bins = int(max(parts, -(-total // TASK_TOKENS)))
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("component", "i", "j"), F.lit(bins)))

    def joined(table: pa.Table) -> pa.Table:
        frame = table.to_pandas()
        u, v, linked = [], [], []
        for (_, i, j), own in frame.groupby(["component", "i", "j"], sort=False):
            cls = own["cls"].tolist()
            if len(cls) > 1:
                more = (own["copies"].tolist(), own["own"].tolist() if i != j else None) if links else ()
                root, count = join_group(cls, own["n"].tolist(), [np.asarray(x, np.int64) for x in own["tok"]], percent, *more)
                u += cls
                v += root
                linked += count
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "linked": pa.array(linked, pa.int64())})

    found = dealt.groupBy("bin").applyInArrow(joined, "u long, v long, linked long")
    extra = ["n_links"] if links else []
    if links:
        found = checkpointed(found)
        counted = found.groupBy(F.col("u").alias("cls")).agg(F.sum("linked").alias("linked"))
        counted = classes.join(counted, "cls", "left").select("cls", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        rows = checkpointed(rows.join(counted, (rows["cls"] == counted["cls"]) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left").select("doc_id", "n_shingles", rows["cls"], F.coalesce("n_links", F.lit(0)).alias("n_links")))
    roots = connected_components(found.select("u", "v")).select(F.col("node").alias("cls"), F.col("component").alias("root")) if large else found.select(F.col("u").alias("cls"), F.col("v").alias("root"))
    roots = checkpointed(roots.where("cls <> root"))
    rooted = rows.where("n_shingles > 0 and doc_id is not null").join(roots, "cls", "left").select("doc_id", "n_shingles", *extra, F.coalesce("root", "cls").alias("root"))
    node = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    # ids that occur more than once tie the components of their rows together
    twice = rooted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("a"), F.max("root").alias("b")).where("k > 1 and a <> b")
    if twice.limit(1).count():
        ties = connected_components(rooted.join(twice.select("doc_id", "a"), "doc_id").select(F.col("root").alias("u"), F.col("a").alias("v")))
        rooted = rooted.join(ties.select(F.col("node").alias("root"), "component"), "root", "left").select("doc_id", "n_shingles", *extra, F.coalesce("component", "root").alias("root"))
        node = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    linked = rooted.join(node.where("members > 1").select("root", "component_id"), "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *extra)
    rest = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *extra)
    return linked.unionByName(rest)
