"""Ops 11, 12 and 13 and the word hash against brute force, on odd rows and with small limits."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphspark.llm import collocations, decontaminate, fingerprints, ngram_join, queries, simhash, source_divergence

DATA = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
_rng = random.Random(5)
WORDS = "the of and to In été naïve x y z data-set don't 中文 a b".split()


def sentence(n, words=WORDS):
    return "".join(_rng.choice(words) + _rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " ; "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, sentence(_rng.choice([0, 1, 2, 5, 40])), _rng.choice(["en", "fr", None, ""]), _rng.choice(["s1", "s2", "s3", None])) for i in range(120)]
    out += [(200, None, "en", "s9"), (201, "", "xx", "s1"), (202, " \n\t ", None, None), (203, sentence(4000), "en", "s1"), (204, "the the the the the", "en", "s2"), (205, "THE OF the of", "en", "s1")]
    return out + [out[5], out[5], (None, "the of and", "en", "s1"), (3, "same id other text", "fr", "s1"), (206, "a b " * 700, "fr", "s3"), (207, "q" * 3000 + " the of", "en", "s2")]


@pytest.fixture(scope="module")
def odd(spark, rows):
    table = [(*r, "clash", 1) for r in rows]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, phrase string, rank int").repartition(3)


def phrases_by_hand(rows, least, top, percent=80):
    f = defaultdict(Counter)
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            for n in range(1, 5):
                f["und" if lang is None else lang].update(w[i : i + n] for i in range(len(w) - n + 1))
    out = []
    for lang, count in f.items():
        candidates = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        dropped = {g[i:j] for g, a in candidates.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) and 100 * a >= percent * count[g[i:j]]}
        found = []
        for g, a in candidates.items():
            score, _, l, r = min((2000000 * a // (count[g[:k]] + count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
            if g not in dropped:
                found.append((-score, -a, " ".join(g).encode(), l, r))
        n = sum(a for g, a in count.items() if len(g) == 1)
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "blocks"), [(2, 2000, None), (3, 7, 50), (1, 40, 17)])
def test_op11(rows, odd, monkeypatch, least, top, blocks):
    if blocks:  # blocks of a few texts, many tasks, nearly every pivot split, eight bytes for most words
        for name, value in (("BLOCK_WORDS", blocks), ("TASK_WORDS", blocks), ("HOT_WORDS", blocks), ("SHORT", 3)):
            monkeypatch.setattr(collocations, name, value)
    got = sorted(tuple(r) for r in collocations.collocations(odd, least, top).collect())
    assert got == phrases_by_hand(rows, least, top) and got


def test_op11_empty(odd):
    assert collocations.collocations(odd.where("false")).collect() == []
    assert collocations.collocations(odd.where("doc_id = 202"), 1).collect() == []


def test_fragments_are_rewritten():
    key = np.array([5, 6, 7, 5, 5, 8, 6], np.uint64)
    level = np.array([2, 3, 1, 2, 2, 0, 3], np.uint8)
    joined = np.array([0, 1, 1, 1, 1, 1, 1], bool)
    rows, weight, keys = collocations.rewritten(key, level, joined)
    assert keys.tolist() == [7, 5, 6]  # rarest first
    assert dict(zip(map(tuple, rows.tolist()), weight.tolist(), strict=True)) == {(0, 0, 0, 2, 3, 0, 0): 1, (0, 2, 3, 1, 2, 2, 0): 1, (0, 0, 0, 2, 2, 0, 0): 1}


def simhash_by_hand(rows, radius=2, width=3):
    prints = []
    for _, text, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]), 42) for i in range(max(min(len(w), 1), len(w) - width + 1))]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("radius", "bucket"), [(2, 4096), (2, 1), (0, 4096), (6, 8)])
def test_op12(spark, rows, odd, radius, bucket):
    got = sorted((tuple(r) for r in simhash.simhash_components(odd, radius, max_bucket=bucket).collect()), key=repr)
    assert got == simhash_by_hand(rows, radius)


def test_op12_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_simhash(spark, DATA)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == simhash_by_hand(docs)
    assert simhash.simhash_components(spark.read.parquet(f"{DATA}/documents.parquet").where("false")).collect() == []


def clustered(rng, n, most):
    seeds, out = [rng.getrandbits(64) for _ in range(4)], set()
    while len(out) < n:
        x = rng.choice(seeds)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9, most])):
            x ^= 1 << rng.randrange(most)
        out.add(x)
    return sorted(out)


def components_by_hand(fp, bucket, radius):
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fp)):
        for j in range(i):
            if bucket[i] == bucket[j] and (fp[i] ^ fp[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


@pytest.mark.parametrize("n", [1, 2, 64, 65, 300])
@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
def test_planes(n, radius):
    rng = random.Random(n * 10 + radius)
    fp = clustered(rng, n, 64)
    bucket = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in fp]
    size = Counter(bucket)
    order = sorted(range(n), key=lambda i: (-size[bucket[i]], bucket[i], fp[i]))
    fp, bucket = [fp[i] for i in order], [bucket[i] for i in order]
    assert simhash.linked(np.array(fp, np.uint64), np.array(bucket, np.uint64), radius).tolist() == components_by_hand(fp, bucket, radius)


def test_majorities():
    rng = random.Random(2)
    counts = [rng.choice([0, 1, 2, 3, 254, 255, 256, 700]) for _ in range(40)]
    at = np.concatenate([[0], np.cumsum(counts)])
    h = np.array([rng.getrandbits(64) for _ in range(at[-1])], np.uint64)
    for k, got in enumerate(simhash.majorities(h, at).tolist()):
        own = h[at[k] : at[k + 1]].tolist()
        assert got == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))


def test_large_buckets_are_dealt_again(spark):
    """A dense cluster that shares most bits, far over the bucket limit: all links stay."""
    fp = clustered(random.Random(9), 700, 14)
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, max_bucket=16)
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    place = {x: i for i, x in enumerate(signed)}
    for u, v in links.collect():
        a, b = find(place[u]), find(place[v])
        assert (fp[place[u]] ^ fp[place[v]]).bit_count() < 15
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fp))] == components_by_hand(fp, [0] * len(fp), 2)


def divergence_by_hand(rows, least, top):
    docs = [(r[2] or "", r[3] or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r[1] or "").translate(LOWER))) for r in rows]
    out = []
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}
        p = {s: {t: share(c[t], sum(c.values()), len(kept)) for t in kept} for s, c in counts.items()}
        all_ = sum(counts.values(), Counter())
        q = {t: share(all_[t], sum(all_.values()), len(kept)) for t in kept}
        for s in counts:
            pair = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            term = [(-apart(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, x.decode(), -v, k + 1) for k, (v, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(10, 10), (1, 3), (10**6, 10)])
def test_op13(rows, odd, least, top):
    assert sorted(tuple(r) for r in source_divergence.divergence(odd, least, top).collect()) == divergence_by_hand(rows, least, top)


def test_op13_empty_and_exact(spark, odd):
    assert source_divergence.divergence(odd.where("false")).collect() == []
    big = 4 * 10**15
    got = spark.range(1).select(source_divergence.share(F.lit(big), F.lit(3 * big), F.lit(7)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (big + 2) // (3 * big + 14)


def test_op13_runs_no_python_and_sums_before_the_shuffle(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    out = StringIO()
    with redirect_stdout(out):
        source_divergence.divergence(spark.read.parquet(f"{DATA}/documents.parquet")).explain("simple")
    assert "partial_sum" in out.getvalue() and not re.search("Python|Arrow|Pandas", out.getvalue())


def thue_morse(n):
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 4096])
def test_long_words_stay_apart(spark, n):
    a, b = thue_morse(n)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs).collect()} == {1: 1, 2: 2, 3: 1}
    one, two, three = (fingerprints.of_text(r["fingerprint"]) for r in fingerprints.fingerprints(docs).orderBy("doc_id").collect())
    assert fingerprints.resemblance(one, two) == 0 and fingerprints.resemblance(one, three) == 1
    rest = " ".join(f"w{i}" for i in range(11))
    items = spark.createDataFrame([(7, f"{a} {rest}")], "item_id long, text string")
    texts = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert {(r["doc_id"], r["n_equal"]) for r in decontaminate.contaminated(texts, items).collect()} == {(1, 12), (2, 11)}


def test_word_hash_tells_long_words_apart():
    import pyarrow as pa

    from glyphspark.llm import _vec as V

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 199, 200, 201, 1500]))) for _ in range(20)) for _ in range(20)]
    texts += [" ".join(thue_morse(1 << k)) for k in range(6, 14)]
    value, _, _, at = V.words(*V.text_bytes(pa.array(texts)))
    words = [w for t in texts for w in t.split()]
    assert len(words) == value.size and len(set(words)) == len(set(value.tolist()))
    assert len({(w, v) for w, v in zip(words, value.tolist(), strict=True)}) == len(set(words))


@pytest.mark.parametrize("percent", [75, 80, 60])
def test_half_of_the_tokens_finds_all_candidates(spark, percent):
    """Sets around the sizes at which half of the tokens are sent or judged, at and just below the threshold."""
    rng = random.Random(percent)
    docs, k = [], 0
    for n in (1, 2, 5, 30, 45, 48, 49, 60, 64, 65, 72, 73, 80, 110, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
            docs.append((k, base))
            cut = rng.randrange(0, max(1, n // 3))
            docs.append((k + 1, base[: n + 4 - cut] + [f"x{rng.randrange(10**9)}" for _ in range(rng.randrange(0, max(1, n // 4)))]))
            k += 2
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or frozenset([tuple(w)]) for i, w in docs}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    want = {i: i - 1 if i % 2 and linked(i - 1, i) else i for i in sets}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(frame, percent).collect()}
    assert got == want and 10 < sum(i != c for i, c in want.items()) < len(docs) // 2


def test_sketches_of_parts_merge(spark, monkeypatch):
    """The union of parts' sketches is the sketch of all their shingles, in any grouping; estimates are exact below k."""
    monkeypatch.setattr(fingerprints, "HELD_GROUPS", 2)
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 30, 400]))), rng.choice(["s1", "s2", None])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    prints = fingerprints.fingerprints(docs).join(docs.select("doc_id", "source"), "doc_id")
    got = {r["source"]: r for r in fingerprints.merged(prints, "source").collect()}
    one = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    for source in ("s1", "s2", None):
        own = [k for k, _, s in rows if s == source]
        every = np.zeros(0, np.uint64)
        for k in own:
            every = np.union1d(every, fingerprints.of_text(one[k]))
        assert got[source]["parts"] == len(own) and got[source]["fingerprint"] == fingerprints.text_of(every[: fingerprints.K])
    shingles = {k: len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if (w := t.split()) else 0 for k, t, _ in rows}
    small = {r["doc_id"]: r["n_distinct"] for r in fingerprints.merged(prints, "doc_id").collect()}
    assert all(small[k] == n for k, n in shingles.items() if n < fingerprints.K) and len(small) == len(rows)
    assert fingerprints.merged(prints.where("false"), "source").collect() == []
