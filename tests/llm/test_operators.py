"""Operators against brute force, on odd cases (nulls, empty and long texts, ties, repeats, extra columns) and on the small tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from glyphspark.llm import _spark, bpe, decontaminate, fingerprints, language_id, line_dedup, ngram_join, pii, queries, suffix_dedup, token_counts, url_filter

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"{a}{b}" for a in "the of ing ré un tion qui ar".split() for b in "a o st el en ir".split()]
LOWER = {i: i + 32 for i in range(65, 91)}
_rng = random.Random(11)


def _text(n):
    return " ".join(_rng.choice(WORDS) for _ in range(n))


PASSAGE, LONG = _text(60), _text(9000)


def odd_rows():
    base = _text(120)
    edited = base.split()
    edited[50] = "other"
    return [
        (1, base), (2, " ".join(edited)), (3, base), (4, None), (5, ""), (6, " \n\t "), (7, "one two three"), (8, "ONE two three"), (9, LONG),
        (10, f"x {PASSAGE} y\nshared line\n" + _text(30)), (11, f"{_text(40)} {PASSAGE}\nShared Line "), (12, "😀" * 80), (13, "😀" * 81 + "é"), (14, "a" * 3000),
        (15, "aaa" * 1200), (16, "<|endoftext|> x"), (17, "mail a@b.co +1 (269) 555-3296 4524132264652876"), (18, "b" * 49), (19, "b" * 49), (20, "c" * 50), (21, "c" * 50),
    ]


ODD = odd_rows()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", i, "x") for i, t in ODD] + [(None, "shared line", None, 0, None), (1, ODD[0][1], "en", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, hash long, component string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def both(odd, docs):
    return [(odd, dict(ODD)), (docs, {r["doc_id"]: r["text"] for r in docs.collect()})]


def test_op1(odd, docs, empty):
    for df, texts in both(odd, docs):
        first, got = {}, by_id(suffix_dedup.dedup_substrings(df))
        for i in sorted(texts):
            b = (texts[i] or "").encode()
            for k in range(len(b) - 49):
                first.setdefault(b[k : k + 50], i)
        assert suffix_dedup.dedup_substrings(df).count() == df.count()
        for i, t in texts.items():
            b = (t or "").encode()
            cut = np.zeros(len(b) + 1, bool)
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    cut[k : k + 50] = True
            kept = bytes(x for x, c in zip(b, cut, strict=False) if not c)
            spans = int((cut[:-1] & ~np.concatenate([[False], cut[:-2]])).sum()) if b else 0
            assert tuple(got[i])[1:] == (len(b), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_op1_lone_shared_passage(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared = text(300)
    frame = spark.createDataFrame([(1, text(400) + "A" + shared + "B" + text(400)), (2, text(500) + "C" + shared + "D" + text(300))], "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup_substrings(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {1: (0, 0), 2: (300, 1)}


def test_op1_frequent_anchors(odd, docs, monkeypatch):
    """However finely windows are dealt, the same bytes go."""
    for df in (odd, docs):
        want = sorted(map(tuple, suffix_dedup.dedup_substrings(df).collect()), key=repr)
        for least, most in ((1, 1), (3, 2)):
            monkeypatch.setattr(suffix_dedup, "MIN_SAMPLED", least)
            monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", most)
            assert sorted(map(tuple, suffix_dedup.dedup_substrings(df).collect()), key=repr) == want
        monkeypatch.undo()


def test_op1_shuffles_texts_once(docs):
    plan = suffix_dedup.dedup_substrings(docs)
    plan.collect()
    steps = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [x for x in steps.split("\n") if " Exchange hashpartitioning(h1" in x and "h2" in x]
    assert "ReusedExchange" in steps and moved, steps


def test_bwt():
    for _ in range(30):
        strings = [bytes(_rng.choice(b"ab") for _ in range(_rng.randint(1, 12))) for _ in range(_rng.randint(1, 20))]
        n = np.array([len(x) for x in strings])
        bwt, lcp = suffix_dedup.collection_bwt(suffix_dedup.aligned(np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16), np.cumsum(n) - n, n), n)
        suffixes = sorted((x[k:], i, k) for i, x in enumerate(strings) for k in range(len(x) + 1))
        assert bwt.tolist() == [strings[i][k - 1] if k else 0xFFFF for _, i, k in suffixes]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp.tolist()[1:] == [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]


def test_op2(spark, odd, docs, empty):
    held = queries.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held))
    rows = language_id.predict(docs, model, keep=["doc_id", "lang"]).join(docs.select("doc_id", held.alias("h")), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows if r["h"]) / sum(r["h"] for r in rows) > 0.9
    got = by_id(language_id.predict(odd, model))
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == got[6]["lang_pred"] == got[12]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows) and got[9]["lang_pred"] in model
    assert language_id.fit(empty) == {} and language_id.predict(empty, {}).count() == 0
    out = queries.op2_language_id(spark, DATA)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == docs.count()


def test_op2_against_brute_force(spark, odd, docs):
    """Every dictionary's compressed size, language by language, of the letters' runs."""
    model = language_id.fit(docs.where(~queries.held_out(F.col("doc_id"))))
    assert all(len(d) <= language_id.DICT_BYTES for d in model.values())
    tricky = ["½ ²", "Ⅷ ①", "1²", "a½b", "x" * 50, "Le été", "DER Die das", "漢字", "_", "é", "e\u0301\u0301"]
    frame = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(tricky)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    frame = frame.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    got = by_id(language_id.predict(frame.withColumn("score", F.lit("old")), model, keep=["doc_id", "score"]))
    for i, t in texts.items():
        runs = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        seen = []
        for w in runs:
            if w not in seen:
                seen.append(w)
        body = " ".join(seen).encode()
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), t
        if body:
            sizes = {}
            for lang, raw in model.items():
                own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=language_id.LEVEL)
                sizes[lang] = len(zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=own, write_content_size=False).compress(body))
            a, b = sorted(sizes.values())[:2]
            assert got[i]["lang_pred"] == min(sizes, key=lambda x: (sizes[x], x)) and got[i]["rejected"] == ((b - a) / b < language_id.MIN_MARGIN)


def test_op2_sample_is_whole_texts(spark):
    rows = [(1, "aa bb", "x"), (2, "cc " * 300_000, "x"), (3, "dd ee ff", "x")] + [(4, "gg hh", "x")] * 50
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(language_id.fit(frame)["x"].split(b"\n")) == [b"aa bb", b"dd ee ff", b"gg hh"]
    assert set(language_id.fit(frame, dict_bytes=7)["x"].split(b"\n")) <= {b"aa bb", b"gg hh"}


def test_op2_too_many_languages(spark):
    rows = spark.range(501).selectExpr("id AS doc_id", "'some words' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="500 languages"):
        language_id.fit(rows)
    assert len(language_id.fit(rows.where("doc_id > 0"))) == 500


def shingle_sets(texts):
    out = {}
    for i, t in texts.items():
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", (t or "").translate(LOWER)) if x]
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def test_op3(odd, docs, empty):
    for df, texts in both(odd, docs):
        sets = shingle_sets(texts)
        pairs, having = Counter(), defaultdict(list)
        for i, s in sets.items():
            for g in s:
                for j in having[g]:
                    pairs[j, i] += 1
                having[g].append(i)
        up = {i: i for i in sets}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for (a, b), k in pairs.items():
            if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        for limit in (4000, 2):
            rows = ngram_join.ngram_components(df, max_group=limit).collect()
            assert len(rows) == df.count()
            assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"])) for r in rows if r["doc_id"] is not None)
    assert ngram_join.ngram_components(empty).count() == 0


def test_op3_links(spark):
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join("x" if k in (3 * i, 5 * i + 1) else w for k, w in enumerate(base)) for i in range(24)]
    rows = [(k, texts[k % 24]) for k in range(30)] + [(40, "nothing alike here at all now"), (41, None), (None, texts[0])]
    sets = shingle_sets({k: t for k, (_, t) in enumerate(rows)})
    similar = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    want = sorted((d, sum(similar(sets[k], sets[m]) for m in range(len(rows) - 1) if m != k)) for k, (d, _) in enumerate(rows[:-1]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (4000, 8):
        got = ngram_join.ngram_components(frame, max_group=limit, links=True).collect()
        assert sorted((r["doc_id"], r["n_links"]) for r in got if r["doc_id"] is not None) == want
        assert [r["n_links"] for r in got if r["doc_id"] is None] == [0]
    assert max(n for _, n in want) > 20


def test_prefix_tree_many_near_copies():
    base = list(range(100))
    tree = ngram_join.PrefixTree()
    for k in range(300):
        tree.add(sorted(set(base) - {_rng.randrange(100)}), 100)
    assert len({tree.find(k) for k in range(300)}) == 1


def test_op4_and_op7(odd, docs, empty):
    library = Tokenizer.from_file(PATH)
    for df, texts in both(odd, docs):
        got = by_id(bpe.bpe(df, PATH, with_ids=True, with_text=True))
        counts = by_id(token_counts.token_counts(df, PATH))
        for i, t in texts.items():
            ids = library.encode(t or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            assert got[i]["ids"] == ids and got[i]["decoded"] == decoded and got[i]["n_tokens"] == len(ids)
            assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert (counts[i]["n_tokens"], counts[i]["n_bytes"], counts[i]["over_limit"]) == (len(ids), len((t or "").encode()), len(ids) > 2048)
    assert bpe.bpe(empty, PATH).count() == token_counts.token_counts(empty, PATH).count() == 0


TRICKY = ["ΟΔΟΣ, Σίσυφος", "don't I'LL 'S ''s !'S x's.", "<|endoftext|>., <|EndOfText|> a<|startoftext|>b", "12 ①² ª ß. İ,X İ́ ", "été é. ̸x ×÷ Éa9é_É", "😀漢字,カ", "a\x00b\x1cc\x85d\x7f", "J̌a ǰ İX", "K" * 500 + " k" + "é" * 150, "", "A" * 199 + " " + "a" * 199 + "." * 300]
_alphabet = "aB'sStTlL.,!-_/@#12 \n\tÉéΣİſŉ×÷̸①漢😀K<|\x1c\x85\u00a0"
TRICKY += ["".join(_rng.choice(_alphabet) for _ in range(_rng.randrange(60))) for _ in range(600)]


def test_bpe_tricky_texts():
    library, own = Tokenizer.from_file(PATH), bpe.WordBpe(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in TRICKY]
    for _ in range(2):  # the second time from its table
        found, which, at = own.entries(pa.array(TRICKY))
        texts = [str(x, "utf-8") for x in bpe._joined([x[1] for x in found], which, at)]
        assert [list(map(int, x.split())) for x in texts] == want
        assert bpe._per_text(np.array([x[0] for x in found])[which], at).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_tricky_texts(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        encode = lambda t, tokenizer=Tokenizer.from_file(path): tokenizer.encode(t, add_special_tokens=False).ids
    texts = [t.replace("\x00", "") for t in TRICKY] + [LONG]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(token_counts.token_counts(frame, path))
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(encode(t)) for t in texts]


def test_token_counts_in_small_blocks(spark, docs, monkeypatch):
    whole = {r["doc_id"]: tuple(r) for r in token_counts.token_counts(docs, PATH).collect()}
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 1 << 12)
    assert {r["doc_id"]: tuple(r) for r in token_counts.token_counts(docs, PATH).collect()} == whole


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sure_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_op5(spark, odd, docs, empty):
    letters = "ab@@..+-  0123456789()%é😀\n"
    rows = ["".join(_rng.choice(letters) for _ in range(_rng.randint(0, 120))) for _ in range(400)]
    rows += ["1.2.3.4.5.6.7.8", "a@b.c+x@d.e", "a@b.c@d.e", "9" * 5000, "a" * 20000, "1-" * 9000, "00001.2.3.004", "1.2.3.256 1.2.3.4"]
    noise = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for df, texts in [*both(odd, docs), (noise, dict(enumerate(rows)))]:
        got = by_id(pii.find(df, pii.fit(df)))
        for i, t in texts.items():
            want = sure_spans(t or "")
            line = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in want)
            assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
            assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[1] == k for x in want) for k in range(4)]
            assert set(filter(None, line.split(","))) <= set(got[i]["spans"].split(","))
    assert pii.find(empty, pii.fit(empty)).count() == 0
    again = pii.estimate({("phone", 1, 1, 0, 1): 90, ("phone", 0, 0, -1, 0): 300, ("phone", 0, 1, 0, 1): 5})
    assert again["phone|1|1|0|1"] > 0.9 and again["phone|0|0|-1|0"] < 0.01


def planted_texts():
    """Texts with disguised personal data (kind, start, end) that no base pattern takes, and with numbers that are none."""
    rng = random.Random(8)
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))

    def card(n):
        body = "4" + digits(n - 2)
        total = sum(int(c) if i % 2 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def four(x, mark):
        return mark.join(x[k : k + 4] for k in range(0, 16, 4))

    name = lambda: rng.choice(WORDS).replace("é", "e")
    true = {
        "email": lambda: (rng.choice(["e-mail ", "contact ", "write to "]), rng.choice([f"{name()}.{name()} [at] {name()}.com", f"{name()}(at){name()}[dot]org", f"{name()} [at] {name()} [dot] net"])),
        "ip": lambda: (rng.choice(["server ", "login from ", "host "]), rng.choice(["[.]".join(str(rng.randint(1, 223)) for _ in range(4)), ":".join(["2001", *(f"{rng.randrange(1, 65536):x}" for _ in range(7))])])),
        "card": lambda: (rng.choice(["card ", "visa ", "credit "]), rng.choice([four(card(16), "."), four(card(16), "/")])),
        "phone": lambda: (rng.choice(["phone ", "call ", "fax "]), f"({rng.randint(200, 989)}) {rng.randint(200, 989)}-{digits(4)}"),
    }
    false = [lambda: ("order ", f"{digits(3)}-{digits(3)}-{digits(4)}"), lambda: ("isbn ", f"{rng.randint(100, 200)}-{digits(3)}-{digits(4)}"), lambda: ("at ", f"{rng.randrange(24)}:{digits(2)}:{digits(2)}"), lambda: ("version ", "[.]".join(str(rng.randint(300, 900)) for _ in range(4))), lambda: ("invoice ", "1111.2222.3333.4446")]
    rows = []
    for i in range(600):
        text, spans = _text(rng.randint(3, 20)) + " ", []
        for _ in range(rng.randrange(4)):
            kind = rng.choice(list(true))
            before, what = true[kind]() if (good := rng.random() < 0.5) else rng.choice(false)()
            if good:
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(what)))
            text += before + what + " " + _text(rng.randint(8, 20)) + " "
        rows.append((i, text, spans))
    return rows


def test_op5_added_spans(spark):
    """Recall and precision of what the method adds to the base spans."""
    rows = planted_texts()
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = by_id(pii.find(frame, pii.fit(frame)))
    base = {i: {f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sure_spans(t)} for i, t, _ in rows}
    for kind in pii.KINDS:
        want = {(i, f"{k}:{a}:{b}") for i, _, spans in rows for k, a, b in spans if k == kind}
        found = {(i, x) for i, _, _ in rows for x in got[i]["spans"].split(",") if x.startswith(kind) and x not in base[i]}
        assert len(want) > 50 and len(want & found) >= 0.9 * len(want) and len(want & found) >= 0.9 * len(found), (kind, len(want), len(found), len(want & found))


def test_op5_many_matches(spark):
    """Places by running sums over blocks, and blanked base spans, against plain loops."""
    texts = ["".join(_rng.choice(["a@b.co", " 1.2.3.4", " 5[.]6[.]7[.]8 ", "é", " x [at] y.org "]) for _ in range(n)) for n in (0, 1, 2, 3, 10, 99, 100, 101, 5000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kind, pattern in (("email", pii.EMAIL), ("ip", pii.IP)):
        rows = frame.select("doc_id", pii.spans_of(F.col("text"), pattern, F.lit(True)).alias("s"), pii.blanked(F.col("text"), kind, pattern, F.lit(True)).alias("t")).collect()
        for r in rows:
            text = texts[r["doc_id"]]
            want = [(a, b) for a, k, b in sure_spans(text) if pii.KINDS[k] == kind]
            assert [(x["a"], x["b"]) for x in r["s"]] == want and all(x["m"] == text[x["a"] : x["b"]] for x in r["s"])
            hidden = list(text)
            for a, b in want:
                hidden[a:b] = "\x01" * (b - a)
            assert r["t"] == "".join(hidden)


def test_op6(odd, docs, empty):
    for df, texts in both(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), docs):
        got, sets = by_id(fingerprints.with_edited_neighbour(df)), shingle_sets(texts)
        order = sorted(texts, reverse=True)
        assert len(got) == len(order)
        for a, b in zip(order, order[1:] + order[:1], strict=True):
            x, y = texts[a] or "", texts[b] or ""
            n = len(x) // 2
            edited = x[: len(x) - n] + y[:n]
            assert got[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[a]["n_chars"] == len(x)
            e = shingle_sets({0: edited})[0]
            for estimate, one, two in ((got[a]["near_edited"], sets[a], e), (got[a]["near_next"], sets[a], sets[b])):
                exact = len(one & two) / len(one | two) if one | two else 1.0
                assert abs(estimate - exact) < (1e-9 if len(one | two) <= fingerprints.K else 0.25)
            share = len(sets[a] & e) / len(sets[a]) if sets[a] else 1.0
            assert abs(got[a]["kept_share"] - share) < (1e-9 if len(sets[a] | e) <= fingerprints.K else 0.3)
            assert abs(got[a]["n_distinct"] - len(sets[a])) <= (1e-9 if len(sets[a]) < fingerprints.K else 0.4 * len(sets[a]))
    assert fingerprints.with_edited_neighbour(odd).count() == odd.count()
    edge = odd.sparkSession.createDataFrame([(-(1 << 63), "a b c d e f"), (None, "a b c d e g"), (3, "x")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in fingerprints.with_edited_neighbour(edge).collect()) == sorted([(str(-(1 << 63)), 11), ("None", 11), ("3", 1)])
    assert fingerprints.with_edited_neighbour(empty).count() == 0


def test_sketches():
    a, b = _text(3000), _text(3000)
    import pyarrow as pa

    one, two, whole = fingerprints.sketches(pa.array([a, b, f"{a} {b}"]))
    merged = fingerprints.merge(one, two)
    assert abs(fingerprints.distinct(merged) / 6000 - 1) < 0.4 and fingerprints.containment(one, whole) > 0.7
    assert (fingerprints.of_text(fingerprints.text_of(one)) == one).all()


def test_op8(odd, docs, empty):
    key = lambda x: x.strip(line_dedup.SPACE).translate(LOWER)
    for df, texts in both(odd, docs):
        seen = Counter(k for t in texts.values() for k in {key(x) for x in (t or "").split("\n")} if k) + Counter({"shared line": int(df is odd)})
        for least in (2, 10):
            got = by_id(line_dedup.dedup_lines(df, least, keep_first=False))
            for i, t in texts.items():
                lines = (t or "").split("\n")
                kept = [x for x in lines if not key(x) or seen[key(x)] < least]
                assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    first = by_id(line_dedup.dedup_lines(odd, 2, keep_first=True))
    assert "shared line" in first[10]["kept_text"] and "Shared" not in first[11]["kept_text"]
    assert line_dedup.dedup_lines(odd).count() == odd.count() and "component" in line_dedup.dedup_lines(odd).columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_op8_streams_sorted_ranges(docs):
    lines = line_dedup._hashed(docs.select("doc_id", "text"))
    plan = line_dedup.common_lines(lines, 10)._jdf.queryExecution().sparkPlan().toString() + line_dedup.common_lines(lines, 10)._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("rangepartitioning(h1")]
    assert "Window" in top and "Sort [h1" in top.replace("#", " #").replace("  ", " ") and "Aggregate" not in top


def test_op8_bitmaps(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nb\nz\nd"), (3, "\n".join(f"r{k % 50}" for k in range(3000))), (4, "\n".join(f"r{k}" for k in range(0, 50, 2))), (5, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept_text", F.lit("old"))
    got = {r["doc"]: (r["bitmap"], r["n_dropped"]) for r in line_dedup.keep_bitmaps(frame, 2).collect()}
    assert got[1] == ([0, 2, 3, 4], 3) and got[2] == ([1, 4, 5, 6], 4) and got[4] == ([0, 25], 25) and 5 not in got
    texts = {r["doc_id"]: (r["kept_text"], r["n_dropped"]) for r in line_dedup.dedup_lines(frame, 2, keep_first=False).collect()}
    assert texts[1] == ("c\ne", 3) and texts[2] == ("x\nz", 4) and texts[4] == ("", 25) and texts[5] == ("y", 0)
    assert texts[3][1] == 1500 and texts[3][0] == "\n".join(f"r{k % 50}" for k in range(3000) if k % 2)


def test_op9(spark, odd, docs, empty, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = {tuple(w[k : k + 13]) for r in bench.collect() for w in [words(r["text"])] for k in range(len(w) - 12)}
    want = {r["doc_id"] for r in docs.collect() for w in [words(r["text"])] if grams & {tuple(w[k : k + 13]) for k in range(len(w) - 12)}}
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()} == want
    changed = PASSAGE.split()
    changed[3::7] = ["zzz"] * len(changed[3::7])
    items = spark.createDataFrame([(1, " ".join(changed)), (2, None), (3, ""), (4, "one two three"), (5, _text(40))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items).collect()}
    assert got == {(10, 1), (11, 1), (7, 4), (8, 4)}
    monkeypatch.setattr(_spark, "BROADCAST_BYTES", -1)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items).collect()} == got
    monkeypatch.setattr(decontaminate, "MAX_BITS", 3 + 13)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items).collect()} == got
    assert decontaminate.decontaminate(odd, items).count() == odd.count() - 4
    assert decontaminate.contaminated(empty, items).count() == decontaminate.contaminated(odd, items.where("false")).count() == 0


def found_pairs(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["n_equal"], r["n_window"]) for r in decontaminate.contaminated(docs, bench).collect()}


def test_op9_cut_off_passages(spark):
    item, around = [f"w{k}" for k in range(40)], [f"x{k}" for k in range(30)]
    texts = [item[10:25], item[-13:] + around, around + item[:12], item[-11:] + around, around + item[:11]]
    texts.append(item[10:13] + ["y"] + item[14:25])
    texts.append(item[-13:-7] + ["y"] * 2 + item[-5:] + around)
    got = found_pairs(spark, [" ".join(t) for t in texts], [" ".join(item)])
    assert got == {(0, 0): (15, 15), (1, 0): (13, 13), (2, 0): (12, 12), (5, 0): (14, 15)}


def test_op9_every_substitution():
    for size, differ in ((12, 3), (13, 3), (14, 3), (15, 3), (16, 4)):
        item = np.arange(1, size + 1, dtype=np.uint64)
        masks = decontaminate.masks_for([])
        for at in itertools.combinations(range(size), differ):
            doc = item.copy()
            doc[list(at)] += np.uint64(1000)
            assert any((decontaminate.seeds(doc, m, k) == decontaminate.seeds(item, m, k)).any() for k, m in enumerate(masks)), at
            assert decontaminate.agreement(doc, item, 0, 16, 0.75) == (size - differ, size)


def test_op9_random_substitutions(spark):
    """Against brute force over all diagonals: passages of 12 to 60 words with 0 to 40 % of their words changed."""
    rng = random.Random(4)
    items = [[f"{rng.choice(WORDS)}{rng.randrange(9)}" for _ in range(rng.choice((3, 9, 12, 15, 40, 70)))] for _ in range(30)]
    texts = []
    for _ in range(250):
        item, share = rng.choice(items), rng.choice((0, 0.1, 0.2, 0.3, 0.4))
        a = rng.randrange(max(1, len(item) - 11))
        own = [f"z{rng.randrange(50)}" if rng.random() < share else w for w in item[a : a + rng.randint(8, 60)]]
        texts.append([f"y{rng.randrange(50)}" for _ in range(rng.randrange(20))] + own + [f"y{rng.randrange(50)}" for _ in range(rng.randrange(20))])
    want = {}
    for d, doc in enumerate(texts):
        for i, item in enumerate(items):
            w = min(16, len(item))
            for start in range(-len(item), len(doc)):
                a, b = max(0, start), min(len(doc), start + len(item))
                if b - a >= min(w, 12):
                    n = min(w, b - a)
                    equal = [doc[k] == item[k - start] for k in range(a, b)]
                    best = max(sum(equal[k : k + n]) for k in range(len(equal) - n + 1))
                    if best >= (math.ceil(0.75 * w) if len(item) >= 12 else len(item)):
                        want[d, i] = max(want.get((d, i), (0, 0)), (best, n))
    assert len(want) > 50 and found_pairs(spark, [" ".join(t) for t in texts], [" ".join(x) for x in items]) == want


def test_op10(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [(1, "http://Good.Example.net/en/1?x", link("friend.org")), (2, "https://bad.net/a#b", None), (3, "http://spam.com/a", link("bad.net", "bad.net")), (4, "http://friend.org/de/", ""), (5, None, None), (6, "nothing", ""), (7, "http://x.example.com/de/y", ""), (8, "http://net", ""), (9, "ftp://a.b.org/fr/?q", None), (9, "ftp://a.b.org/fr/?q", None)]
    rows = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), threshold=0.05).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("good.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("bad.net", "/a", "net/", "block")
    assert got[3][2:] == (None, "block") and got[4][2:] == (None, "allow") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("example.com/de/", "block") and got[8][:3] == ("net", "", None) and got[9][2:] == ("org/fr/", "allow")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pagerank_against_loops(spark, monkeypatch):
    edges = [(_rng.randrange(12), _rng.randrange(12), _rng.randint(1, 4)) for _ in range(40)]
    w = Counter()
    for a, b, n in edges:
        if a != b:
            w[str(a), str(b)] += n
    rank = {"0": 0.5, "1": 0.5}
    for _ in range(6):
        new = Counter({"0": 0.075, "1": 0.075})
        for (a, b), n in w.items():
            new[b] += 0.85 * rank.get(a, 0) * n / sum(x for (c, _), x in w.items() if c == a)
        rank = new
    frame = spark.createDataFrame([("k", a, b, n) for (a, b), n in w.items()], "kind string, src string, dst string, n long")
    seeds = spark.createDataFrame([("k", "0", 2.0), ("k", "1", 2.0)], "kind string, host string, w double")
    for few in (url_filter.BROADCAST_BYTES, -1):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", few)
        got = {r["host"]: r["rank"] for r in url_filter.propagate(frame, seeds, rounds=6).collect()}
        assert all(abs(got.get(h, 0) - x) < 1e-12 for h, x in rank.items())


def test_op10_graph_decides(spark):
    """Pages that no rule fits go by what their host, and the hosts around it, have otherwise: at sf0.01 both verdicts occur."""
    rows = url_filter.filter_urls(spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/pages.parquet")).where("rule is null").collect()
    assert {r["verdict"] for r in rows} == {"allow", "block"} and sum(r["score"] != 0 for r in rows) > 0.5 * len(rows)
    assert all((r["verdict"] == "block") == (r["score"] > url_filter.THRESHOLD) for r in rows)


def test_pipeline(spark, docs):
    rows = by_id(corpus_pipeline.run(spark, DATA))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, DATA).collect()}
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert set(rows) <= kept <= set(texts) and len(rows) > 0.7 * len(texts)
    key = lambda x: x.strip(line_dedup.SPACE).translate(LOWER)
    seen = Counter(k for i in kept for k in {key(x) for x in texts[i].split("\n")} if k)
    first = {}
    for i in sorted(kept):
        for pos, x in enumerate(texts[i].split("\n")):
            first.setdefault(key(x), (i, pos))
    clean = {i: "\n".join(x for pos, x in enumerate(texts[i].split("\n")) if seen[key(x)] < 10 or first[key(x)] == (i, pos)) for i in kept}
    frame = spark.createDataFrame(list(clean.items()), "doc_id long, text string")
    one = {r["doc_id"] for r in ngram_join.ngram_components(frame).collect() if r["doc_id"] == r["component_id"]}
    leaks = {r["doc_id"] for r in decontaminate.contaminated(frame, bench).collect()}
    assert set(rows) == one - leaks
    library = Tokenizer.from_file(PATH)
    assert all(rows[i]["ids"] == library.encode(clean[i], add_special_tokens=False).ids for i in rows)


def test_pipeline_of_large_groups(spark, tmp_path):
    """Of many copies one keeps its text and is encoded; nulls, empty texts, repeated rows and other columns pass or go as stated."""
    english, french = _text(80), _text(80)
    rows = [(k, english + "\n" + french, "en", "s", 1) for k in range(30)] + [(100 + k, f"{_text(60)}", "en", "s", 1) for k in range(20)] + [(500, None, None, None, None), (501, "", "en", "s", 0), (None, _text(50), "en", "s", 1), (119, _text(30), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("hash", F.lit(1)).withColumn("kept_text", F.lit("x"))
    spark.createDataFrame([(1, "nothing that is there at all in any of these texts of ours today so none goes")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for part in (docs, docs.where("false")):
        out = part
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, str(tmp_path))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == corpus_pipeline.COLUMNS
        if part is docs:
            lines = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
            assert lines[0] == english + "\n" + french and all(lines[k] == "" for k in range(1, 30)) and lines[500] == lines[501] == ""
        else:
            assert out.count() == 0


def test_queries_keep_all_rows(spark, docs):
    for name in ("op1_suffix_dedup", "op3_ngram_join", "op4_bpe", "op5_pii", "op6_fingerprints", "op7_token_counts", "op8_line_dedup"):
        assert queries.QUERIES[name](spark, DATA).count() == docs.count(), name
