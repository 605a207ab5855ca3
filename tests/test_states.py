"""Transcriptions by NumPy over columns of states: findings F1 to F6 of round 4."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphspark.operators import states, transcript
from glyphspark.plans import catalogue

DATA = "/root/testdata/sf0.001"
ODD = ["a-- so, é  x", "   ", "s" * 60 + " ab" * 40, "-", "x² Ⅷ½ a_b\tc", "p̃q̃ <&>\"'", "\U0001f600 o\U0001f600", "sé u", "aaaaaaaaaaaaaaaa,,;; bbbb", " q", "q "]
KERNELS, OPERATORS = {}, {}
KERNELS["alto_pages"], OPERATORS["alto_pages"] = states.alto_bodies(True), lambda d: transcript.alto_pages(d, True)
KERNELS["alto_words"], OPERATORS["alto_words"] = states.alto_rows(False), transcript.alto_items
KERNELS["comparison_report"] = states.report_rows({s: transcript.SIDES[s] for s in ("MN", "MD", "GD", "MS")})
KERNELS["whitespace_layout"], OPERATORS["whitespace_layout"] = states.layout_rows, transcript.whitespace_layout
KERNELS["language_runs"], OPERATORS["language_runs"] = states.run_rows, transcript.language_runs
KERNELS["word_spans"], OPERATORS["word_spans"] = states.span_rows, transcript.word_spans


def odd_documents():
    draw = random.Random(5)
    return [(k, "\n".join(draw.choice([*ODD, ""]) for _ in range(k % 7 + 1)), ("fr", "de", "la")[k % 3]) for k in range(60)]


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_no_state_is_a_row_of_its_own_or_interpreted(spark, name):
    """One exchange of plain lines, then one NumPy step; no lambda over states is left."""
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hash") == 1 and "lambda" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_odd_documents_are_as_by_sql(spark, name, tmp_path):
    """Marks alone, entities, numerals that aren't digits, letters with marks, no-break lines, glyphs beyond 16 bits."""
    spark.createDataFrame(odd_documents(), "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    out = con.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in out.description]
    letters = lambda row: repr(tuple(row)).replace("&#112;&#771;", "p̃").replace("&#113;&#771;", "q̃")  # noqa: E731 (the SQL has no entities of letters)
    assert sorted(map(letters, df.select(*names).collect())) == sorted(map(letters, out.fetchall()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_plain_lines_are_as_their_states(spark, name):
    """States that are made in the task are those of the packed table; a document without a language and rows in any order, too."""
    rows = [(k, i, None if k == 4 else lang, x) for k, text, lang in odd_documents() for i, x in enumerate(text.split("\n")) if x]
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, lang string, line string")
    by_state = transcript.decode_fixture(lines).orderBy(F.rand(3))
    want = sorted(OPERATORS[name](transcript.packed_fixture(lines)).collect(), key=repr)
    assert sorted(OPERATORS[name](lines).collect(), key=repr) == want == sorted(OPERATORS[name](by_state).collect(), key=repr)


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_batches_may_end_anywhere(monkeypatch, name):
    """Documents over several batches, and pieces of one document or line, give the rows of one batch."""
    rows = [(k // 2, i, "fr", x, x if i % 3 else None) for k, text, _ in odd_documents() for i, x in enumerate(text.split("\n"), 10 * (k % 2)) if x]
    rows += [(30, 1, None, None, "gold alone"), (30, 2, "fr", "own  alone", None), (30, 2, None, None, "b"), (30, 2, None, None, "a"), (31, 1, None, None, "")]
    names = ["doc_id", "line_no", "lang", "line", "gold"]
    whole = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names)

    def made(batches, cut):
        out = []
        for part in cut(iter(batches)):
            row, *columns = KERNELS[name](part, states.States.of(part))
            out += list(zip(part.column("doc_id").take(pa.array(row)).to_pylist(), *[pa.array(c).to_pylist() for c in columns], strict=True))
        return out

    cut = states._lines if name in ("word_spans", "whitespace_layout") else states._documents
    want = made([whole], cut)
    draw = random.Random(2)
    for chunk in (1, 40, 1 << 19):
        monkeypatch.setattr(states, "CHUNK", chunk)
        at = sorted({0, whole.num_rows, *[draw.randrange(whole.num_rows) for _ in range(40)]})
        assert made([whole.slice(a, b - a) for a, b in zip(at[:-1], at[1:], strict=True)], cut) == want
    if name == "comparison_report":
        reports = dict(want)
        assert "MN:" not in reports[31] and "GD: \n" in reports[31] and "GD: b\n" in reports[30] and "MN: \nMD: \nGD: gold alone\n" in reports[30]
