"""Driver queries of the text operators: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspark.llm import bpe, collocations, decontaminate, fingerprints, language_id, line_dedup, ngram_join, pii, simhash, source_divergence, suffix_dedup, token_counts, url_filter
from glyphspark.llm._spark import documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: F.Column) -> F.Column:
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    return language_id.predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir).select("doc_id", "text"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edited_neighbour(documents(spark, sf_dir).select("doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, keep_first=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir).select("lang", "text"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir).select("doc_id", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(documents(spark, sf_dir).select("text", "lang", "source"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_ngram_join, op4_bpe, op5_pii, op6_fingerprints, op7_token_counts, op8_line_dedup, op9_decontamination, op10_url_filter, op11_collocations, op12_simhash, op13_source_divergence)}

_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(1, n - 48)) AS p, h FROM d WHERE n >= 50),
g AS (SELECT doc_id, p, substr(h, 2 * p - 1, 100) AS s FROM w),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS low FROM g),
c AS (SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m WHERE low < doc_id),
r AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY ALL),
t AS (SELECT doc_id, a, b, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS kept FROM s),
k AS (SELECT t.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * kept - 1, 2 * (a - kept)), '' ORDER BY a) AS body FROM t JOIN d ON t.doc_id = d.doc_id GROUP BY t.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE k.body || substr(h, 2 * k.last - 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op8_line_dedup": f"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id""",
    "op3_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM g),
t AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e2 AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e2.b FROM r JOIN e2 ON r.b = e2.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL""",
    "op9_decontamination": r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM dw),
i AS (SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM iw),
m AS (SELECT doc_id, item_id, d.p - i.p AS start, d.p, d.n AS dn, i.n AS n FROM d JOIN i ON d.w = i.w),
c AS (SELECT *, least(16, n) AS w, least(dn, start + n) - greatest(0, start) AS overlap, count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY p RANGE BETWEEN 15 PRECEDING AND CURRENT ROW) AS k FROM m),
best AS (SELECT doc_id, item_id, max({'k': k, 'w': least(w, overlap)}) AS b FROM c WHERE overlap >= least(w, 12) AND k >= CASE WHEN n < 12 THEN n ELSE ceil(0.75 * w) END GROUP BY ALL)
SELECT doc_id, item_id, b.k::BIGINT AS n_equal, b.w::BIGINT AS n_window FROM best""",
    "op10_url_filter": rf"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT page_id, host, path, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
a AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS action FROM j),
b AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE action = 'allow') AS good, count(*) FILTER (WHERE action = 'block') AS bad FROM a WHERE host <> '' GROUP BY host),
s AS (SELECT 'trust' AS kind, host, good / n AS w FROM b WHERE good > 0 UNION ALL SELECT 'distrust', host, bad / n FROM b WHERE bad > 0),
s1 AS (SELECT kind, host, w / sum(w) OVER (PARTITION BY kind) AS w FROM s),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, 'href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1, 'i')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM h WHERE host <> ''),
p AS (SELECT string_split(host, '.') AS x FROM b),
q AS (SELECT DISTINCT array_to_string(x[i:], '.') AS src, array_to_string(x[i + 1:], '.') AS dst FROM (SELECT x, unnest(range(1, len(x) - 1)) AS i FROM p)),
e AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, 1 AS n FROM l WHERE src <> dst UNION ALL SELECT src, dst, 1 FROM q UNION ALL SELECT dst, src, 1 FROM q) GROUP BY ALL),
t AS (SELECT 'trust' AS kind, src, dst, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY src) AS f FROM e UNION ALL SELECT 'distrust', dst, src, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY dst) FROM e),
y AS (SELECT 0 AS k, kind, host, w FROM s1 UNION ALL SELECT y.k + 1, y.kind, t.dst, sum(y.w * t.f) FROM y JOIN t ON t.kind = y.kind AND t.src = y.host WHERE y.k < {url_filter.ROUNDS} GROUP BY ALL),
r AS (SELECT host, round(sum(CASE WHEN kind = 'distrust' THEN 1 ELSE -1 END * CASE WHEN k < {url_filter.ROUNDS} THEN 0.15 ELSE 1 END * w) * (SELECT count(*) FROM b), 9) AS score FROM y GROUP BY host)
SELECT page_id, a.host, path, rule, coalesce(action, CASE WHEN coalesce(score, 0) > {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(score, 0)::DOUBLE AS score
FROM a LEFT JOIN r ON a.host = r.host""",
    "op11_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0b\f\r]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM w),
t AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g FROM s WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM t WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM t WHERE m > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
b AS (SELECT k.lang, k.g, any_value(k.f) AS a, min({'score': 2000000::HUGEINT * k.f // (x.f + y.f), 'k': k.k, 'l': x.f, 'r': y.f}) AS b
  FROM k JOIN t x ON x.lang = k.lang AND x.g = k.g[1:k.k] JOIN t y ON y.lang = k.lang AND y.g = k.g[k.k + 1:] GROUP BY k.lang, k.g),
i AS (SELECT lang, f, m, unnest([2, 3]) AS q, g FROM c),
e AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, f, unnest(list_transform(range(1, m - q + 2), lambda j: g[j:j + q - 1])) AS g FROM i WHERE q < m) GROUP BY ALL),
u AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.b FROM b LEFT JOIN e ON e.lang = b.lang AND e.g = b.g WHERE e.f IS NULL OR 100::HUGEINT * e.f < 80::HUGEINT * b.a)
SELECT u.lang, row_number() OVER (PARTITION BY u.lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, n.n, b.score::BIGINT AS score
FROM u JOIN n ON n.lang = u.lang QUALIFY rank <= 2000""",
    "op13_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS MATERIALIZED (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (n.n + 2 * v.v) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang JOIN n ON g.lang = n.lang AND g.source = n.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT c.lang, c.term, 1 + 1000000000::HUGEINT * (sum(c.c) + 2)::HUGEINT // ((SELECT sum(n.n) FROM n WHERE n.lang = c.lang)::HUGEINT + 2 * any_value(v.v)) AS q FROM c JOIN v ON c.lang = v.lang GROUP BY c.lang, c.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u QUALIFY part = 'pair' OR rank <= 10""",
}
