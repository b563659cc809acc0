import pytest
from pyspark.sql import functions as F

from kollate.functions import checksum, text, udfs
from kollate.operators import clean, detect


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("o")).head()["o"]


@pytest.mark.parametrize("value,good", [("2049-3630", True), ("20493630", False), ("1234-5678", False), (None, False), ("", False)])
def test_issn(spark, value, good):
    assert bool(one(spark, value, checksum.issn(F.col("v")))) is good


@pytest.mark.parametrize("value,ten,thirteen", [("0-19-852663-6", True, False), ("0198526630", False, False), ("978-3-16-148410-0", False, True), ("9783161484101", False, False), ("012345647X", False, False)])
def test_isbn(spark, value, ten, thirteen):
    df = spark.createDataFrame([(value,)], "v string").select(checksum.isbn10(F.col("v")).alias("a"), checksum.ean13(F.col("v")).alias("b")).head()
    assert (df.a, df.b) == (ten, thirteen)


@pytest.mark.parametrize("raw,value,fine,codes", [
    ("10.1234/abcd.5678", "10.1234/abcd.5678", True, []),
    ("doi:10.1234/abcd.5678", "10.1234/abcd.5678", True, ["S"]),
    (" 10.1234/abcd.5678 ", "10.1234/abcd.5678", True, ["K"]),
    ("10.1234/ABCD", "10.1234/abcd", True, []),
    ("10.1234 abcd", "10.1234 abcd", False, []),
    ("10.109/abc", "10.109/abc", False, []),
])
def test_doi_codes(spark, raw, value, fine, codes):
    got = one(spark, raw, clean.DOI.clean(F.col("v")))
    assert (got.value, got.wellformed, got.codes) == (value, fine, codes)


def test_null_is_not_checked(spark):
    assert one(spark, None, clean.DOI.clean(F.col("v"))) is None


@pytest.mark.parametrize("raw,value,codes", [("a  title", "a title", ["K"]), ("A Title.", "a title", ["R"]), ("it’s", "it's", ["R"]), ("Title", "title", []), ("", "", [])])
def test_free_text(spark, raw, value, codes):
    df = spark.createDataFrame([(raw,)], "v string")
    got = clean.free_text(df, "v", "c").head().c
    assert (got.value, got.codes) == (value, codes)
    again = clean.free_text(spark.createDataFrame([(got.value,)], "v string"), "v", "c").head().c
    assert again.value == got.value and again.codes == []


@pytest.mark.parametrize("a,b,code", [("a titlehere", "a title here", "K"), ("colour", "color", "B"), ("re-use", "reuse", "R"), ("same", "same", None), ("cat", "cut", None), ("aaa", "abaa", None), ("abc", "abcde", None)])
def test_indel(a, b, code):
    assert udfs.indel_code_of(a, b) == code


def test_jaro_winkler(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("same", "same"), ("", "x"), (None, "x")], "a string, b string")
    got = [r.s for r in df.select(udfs.jaro_winkler("a", "b").alias("s")).collect()]
    assert got[0] == pytest.approx(0.961111, abs=1e-5) and got[1:3] == [1.0, 0.0] and got[3] is None


@pytest.mark.parametrize("value,surname", [("Bell, S.; Quiggin, J.", "BELL"), ("Bjornlund H.", "BJORNLUND"), ("Kepa Brian Morgan", "MORGAN"), (None, None), ("", None)])
def test_surname(spark, value, surname):
    assert one(spark, value, text.first_surname("v")) == surname


@pytest.mark.parametrize("value,status", [("1914-1918", "valid"), ("1914–1918", "adjusted"), ("1914 to 1918", None), ("none", None)])
def test_year_range(spark, value, status):
    assert one(spark, value, detect.year_range(F.col("v"))) == status


def test_presence(spark):
    df = spark.createDataFrame([("x",), (" N/A ",), (" ",), (None,), ("-",)], "v string")
    assert [r.p for r in df.select(text.presence("v").alias("p")).collect()] == ["present"] + ["missing"] * 4


def test_normalisers(spark):
    assert one(spark, "0-123456-47-X", text.isbn("v")) == "012345647X"
    assert one(spark, "12345", text.isbn("v")) is None
    assert one(spark, " DOI:10.1/AB ", text.doi("v")) == "10.1/ab"
    assert one(spark, "https://index.example/W123", text.digits_id("v")) == 123
    assert one(spark, "a;b; c", text.listed("v")) == 3
    assert one(spark, None, text.listed("v")) == 0
    assert one(spark, "PMC12345/x", text.pmc_number("v")) == 12345
    assert one(spark, "A: b (c)", text.search_phrase("v")) == 'TITLE("A b c")'


def test_vocabulary_is_tristate(spark):
    rows = spark.createDataFrame([("Book", "Edited Work"), ("Book", "nothing"), ("Film", "x")], "kind string, value string")
    vocabulary = spark.createDataFrame([("Book", "edited-work")], "kind string, label string")
    got = {(r.kind, r.value): r.ok for r in clean.in_vocabulary(rows, "value", "kind", vocabulary, "ok").collect()}
    assert got == {("Book", "Edited Work"): True, ("Book", "nothing"): False, ("Film", "x"): None}


def test_consensus_vocabulary(spark):
    rows = spark.createDataFrame([("1", "Proc of X."), ("1", "proc  of x"), ("1", "other"), ("00000", "y"), (None, "z"), ("2", None)], "k string, v string")
    assert [tuple(r) for r in clean.consensus_vocabulary(rows, "k", "v").collect()] == [("1", "proc of x")]
