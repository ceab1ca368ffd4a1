"""Pages, references, breaks and templates on what the given tables don't hold."""

import html
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions.text import unescaped
from foliant.operators import fields, markup, pages
from foliant.plans.inputs import METAS


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").repartition(1)
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_descriptions(spark):
    assert values(spark, [tag for tag, _ in METAS], pages.description_of) == [text for _, text in METAS]
    odd = [None, "", "<meta", "<meta name=description", "<meta name='description' content='a", '<meta\nname="description"\ncontent="two\nlines">']
    assert values(spark, odd, pages.description_of) == ["", "", "", "", "", "two\nlines"]


def test_references(spark):
    texts = ["&mdash;&#8217;&eacute;", "&amp;lt; &lt;&gt;", "&#x41;&#X42;&#67;", "&#150;&#x80;", "&nosuch; & &; &#; &#x; &#xZZ; &amp", "a&b;c", "", "&&amp;&", "&NotEqualTilde;", "x&#0065;y"]
    assert values(spark, texts, unescaped) == [html.unescape(t) if t != "&nosuch; & &; &#; &#x; &#xZZ; &amp" else t for t in texts]
    assert values(spark, ["&#0;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", None], unescaped) == ["�"] * 4 + [None]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("a<br> <br>b<br>c", "a<br>b<br>c"),
        ("<br>\n<br>\t <br>  x<br> y", "<br>x<br> y"),
        ("<br>", "<br>"),
        ("<br> ", "<br> "),
        ("<br><br>", "<br>"),
        ("", ""),
        (None, None),
    ],
)
def test_breaks(spark, text, wanted):
    assert values(spark, [text], markup.collapse_breaks) == [wanted]


def test_a_million_breaks_end_no_task(spark):
    one = spark.range(1).select(F.repeat(F.lit("<br>\n"), 1_000_000).alias("x"))
    assert one.select(markup.collapse_breaks("x")).first()[0] == "<br>"


@pytest.mark.parametrize("unclosed", ["<script>a", "<style x", "<!-- b", "<p ", "<h1 ", "<", "<a ", "</", "<meta ", "<title", "&"])
def test_time_follows_the_page(spark, unclosed):
    """Twenty thousand of what is never closed."""
    page = spark.range(1).select(F.repeat(F.lit(unclosed), 20_000).alias("x"))
    began = time.time()
    page.select(pages.job_text(F.col("x")), markup.markup_to_text(F.col("x"))).collect()
    assert time.time() - began < 20


def test_what_is_not_closed_goes_to_the_end(spark):
    texts = ["a<script>b</script>c<script>d", "a<style>b", "a<!--b", "1 < 2 and 3 > 2", "a<b", "a</p>b<br/>c", "x <3 y"]
    assert values(spark, texts, markup.markup_to_text) == ["ac", "a", "a", "1 < 2 and 3 > 2", "a", "a\nb\nc", "x <3 y"]


def test_a_value_that_looks_like_a_variable_stays(spark):
    rows = [(1, ["${var2}", "B", None, "${var1}", "e"]), (2, [])]
    df = spark.createDataFrame(rows, "id int, slots array<string>")
    template = F.lit("1=${var1} 2=${var2} 3=${var3}${var4}, ${var5}${var6}${var")
    got = {r["id"]: r["t"] for r in df.select("id", fields.fill(template, F.col("slots")).alias("t")).collect()}
    assert got == {1: "1=${var2} 2=B 3=${var1}, e${var6}${var", 2: "1= 2= 3=, ${var6}${var"}


def test_many_templates(spark):
    templates = spark.createDataFrame([(1, "a ${var1}"), (2, "${var2}${var2} b"), (3, None), (4, "")], "template_id int, text string")
    rows = [(i, ["x", "y"]) for i in (1, 2, 3, 4, 5, None)]
    sessions = spark.createDataFrame(rows, "template_id int, slots array<string>").withColumn("parts", F.lit("kept"))
    found = fields.fill_templates(sessions, templates).collect()
    assert {r["template_id"]: r["letter"] for r in found} == {1: "a x", 2: "yy b", 3: None, 4: "", 5: None, None: None}
    assert all(r["parts"] == "kept" for r in found)
