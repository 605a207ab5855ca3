import pytest
from pyspark.sql import functions as F

from glyphspark.functions import charset as C
from glyphspark.functions import readers as R


def test_characters():
    assert len(C.PRECOMPOSED) == 74
    assert C.normalize_char("ñ") == C.normalize_char("\\~n") == "ñ"
    assert C.normalize_char("q̃") == "q̃"
    assert C.unescape_char("\\ii") == "ı" and C.fully_escape_char("ı") == "\\ii"
    assert C.unescape_char("\\\\") == "\\" and C.unescape_char("ñ") == "ñ"
    assert C.fully_escape_char("ñ") == "\\~n"
    stacked = C.parse("\\`\\'ñ̄̈")
    assert stacked == [("n", ["̃", "̄", "̈", "́", "̀"])]
    assert C.split_chars("th\\~qr\\\\x") == ["t", "h", "q̃", "r", "\\\\", "x"]
    assert [C.is_punctuation(c) for c in ("t", "q̃", ";", "\\\\")] == [False, False, True, True]
    for bad in ("\\", "\\n", "̃", "\\~;", "\\ia"):
        with pytest.raises(C.CharError):
            C.split_chars(bad)
    with pytest.raises(C.CharError):
        C.is_punctuation(";;")
    assert C.split_chars("a\\", strict=False) == ["a", "\\"]
    assert C.tilde_form("a") == "ã" and C.tilde_form("é") == "ẽ" and C.accent_dropped("è") == "e" and C.accent_dropped("ê") is None


def test_index():
    index = C.CharIndex()
    assert index.number("ñ") == index.number("\\~n") == index.number("ñ")
    index.locked = True
    with pytest.raises(KeyError):
        index.number("z")


def _one(spark, column, text):
    return spark.createDataFrame([(text,)], "line string").select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [("si", "ſi"), ("ssi", "ſsi"), ("assin", "aſsin"), ("asi", "aſi"), ("as", "as"), ("sssi", "ſſsi")])
def test_long_s(spark, text, want):
    assert _one(spark, R.long_s(F.col("line")), text) == want


def test_stages(spark):
    assert _one(spark, R.basic(F.col("line")), "``a''\t\\") == '"a"    \\\\'
    assert _one(spark, R.without(F.col("line")), "thi&s tha$t t$he") == "thi&s that the"
    assert _one(spark, R.only(F.col("line"), "tha"), "that, thé hat") == "that th hat"
    assert _one(spark, R.only(F.col("line"), "the", True), "thé x") == "thé "
    assert _one(spark, C.strip_diacritics(F.col("line")), "ñandú") == "nandu"
    assert _one(spark, C.remove_punctuation(F.col("line")), " a,  b.c ") == "a bc"
    with pytest.raises(ValueError):
        R.only(F.col("line"), "")


def test_replace_some(spark):
    assert R.replace_some_in_order(["ab1ab2ab3ab4ab5ab6ab7ab8"], [R.Rule("ab", "xyz", 3)]) == ["ab1ab2xyz3ab4ab5xyz6ab7ab8"]
    assert R.replace_some_in_order(["xxxx"], [R.Rule("xx", "a", 1)]) == ["aa"]
    lines = [(i, 0, "fr", t) for i, t in enumerate(["ab1ab2", "", "ab3ab", "4ab5ab6ab", "u v"] * 700)]
    rules = [R.Rule("ab", "xyz", 3), R.Rule("z", "ab", 2)]
    got = R.replace_some(spark.createDataFrame(lines, "doc_id long, line_no int, lang string, line string"), rules).orderBy("doc_id").collect()
    assert [r["line"] for r in got] == R.replace_some_in_order([x[3] for x in lines], rules)
