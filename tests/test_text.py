import re
import urllib.parse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorevane.functions import text as T


def column(spark, values, f):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in frame.orderBy("i").select(f(F.col("x"))).collect()]


def test_cleaner(spark):
    cases = {
        None: "", "": "", "```markdown\n# A\n```": "# A", "Here is the file\n\n\nbody": "body", "body\n\nHope this helps! x": "body",
        "a Here is z\nb": "a Here is z\nb", "body\nPlease adjust it\nmore": "body\nmore",
    }
    assert column(spark, list(cases), T.clean_transcript) == list(cases.values())


def test_quote(spark):
    assert column(spark, ["a b/c~d*e+f(1).pdf"], T.quote_path) == ["a%20b/c~d%2Ae%2Bf%281%29.pdf"]


def test_names(spark):
    assert column(spark, ["1. 下載", "１２、x", "y"], T.without_number) == ["下載", "x", "y"]
    assert column(spark, ["a.PDF", "b.docx.doc", "c.txt"], T.without_extension) == ["a", "b.docx", "c.txt"]
    assert column(spark, ["a\\b/c*?:\"<>|d"], T.safe_name) == ["abcd"]


def test_chunks(spark):
    sizes = lambda n: F.transform(T.chunks(F.array(*(F.lit(str(i)) for i in range(n))) if n else F.array().cast("array<string>"), 3), F.size)
    one = spark.range(1)
    assert [one.select(sizes(n)).collect()[0][0] for n in (7, 5, 0)] == [[3, 3, 1], [3, 2], []]
    last = spark.sql("select array('a','b') a, array('a','b','c','d') b").select(T.last_of(F.col("a"), 3), T.last_of(F.col("b"), 3)).collect()[0]
    assert list(last) == [["a", "b"], ["b", "c", "d"]]


def test_fill_does_not_fill_twice(spark):
    out = spark.range(1).select(T.fill("<{a}|{b}>", a=F.lit("{b}"), b=F.lit("x"))).collect()[0][0]
    assert out == "<{b}|x>"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab \t\n\r\x0b\x1c\x85  　​中")), min_size=1, max_size=30))
def test_strip_is_pythons(spark, values):
    assert column(spark, values, T.strip) == [v.strip() for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0xD7FF)), min_size=1, max_size=20))
def test_quote_is_pythons(spark, values):
    assert column(spark, values, T.quote_path) == [urllib.parse.quote(v) for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["Here is x\n", "```markdown\n", "```\n", "body ", "\n", "\nHope this helps", " y\n"]), max_size=8).map("".join), min_size=1, max_size=20))
def test_clean_has_no_space_around(spark, values):
    assert all(x == x.strip() and not re.search("(?m)^```markdown", x) for x in column(spark, values, T.clean_transcript))
