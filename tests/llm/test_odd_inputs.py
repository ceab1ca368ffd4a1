"""Layouts, samples and registered queries on what the given tables don't hold."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foliant.llm import html_text, language_id, warc
from foliant.llm.queries import QUERIES


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table>foo<tr><td>a", "foo\na"),
        ("<table><tr><td>a</td>loose</tr><tr><td>b</table>z", "loose\na\nb\n\nz"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A  b\n   c\nd  e"),
        ("<table><tr><td rowspan=0>A<td rowspan=2 colspan=2>B<td>c<tr><td>d<tr><td>e</table>", "A  B    c\n        d\n   e"),
        ("<table><tr><td>x<br>y<td>1<tr><td>long cell<td>2<br>3<td>4</table>", "x          1\ny\nlong cell  2  4\n           3"),
        ("<table><tr><td colspan=2>wide one<td>r<tr><td>a<td>b<td>c</table>", "wide one  r\na  b  c"),
        ('<span style="display:block">a</span><span>b', "a\nb"),
        ('<b style="color:red; display : flex">a</b>b', "a\nb"),
        ("<ol><li>a<li value=7>b<li>c", "1. a\n7. b\n8. c"),
    ],
)
def test_layout(page, text):
    assert html_text.render(page) == text


def test_tables_by_brute_force():
    """Random grids: each cell's lines stand under each other at its column, in rows of their own."""
    rng = random.Random(8)
    for _ in range(200):
        columns = rng.randint(1, 5)
        grid = [["\n".join("x" * rng.randint(1, 6) for _ in range(rng.randint(0, 3))) for _ in range(columns)] for _ in range(rng.randint(1, 5))]
        lines = html_text._table_lines([[(cell, 1, 1) for cell in row] for row in grid])
        widths = [max(len(x) for row in grid for x in row[c].split("\n")) for c in range(columns)]
        starts = [sum(widths[:c]) + 2 * c for c in range(columns)]
        wanted = []
        for row in grid:
            cells = [cell.split("\n") for cell in row]
            for i in range(max(map(len, cells))):
                line = ""
                for c, cell in enumerate(cells):
                    if i < len(cell) and cell[i]:
                        line = line.ljust(starts[c]) + cell[i]
                wanted += [line] if line else []
        assert lines == wanted


def test_time_of_a_cell_of_many_lines():
    began = time.time()
    html_text.render("<table><tr><td>" + "a<br>" * 4000 + "<td>x" * 4000)
    assert time.time() - began < 4


PAGES = [(None, None), (1, ""), (1, ""), (2, None), (3, "<p>" + "a " * 5000), (4, "x"), (5, "x")]


def test_pages_with_odd_rows_and_columns(spark):
    names = ("text", "payload", "page", "html_", "row", "sha", "n")
    pages = spark.createDataFrame(PAGES, "page_id long, html string").withColumns({n: F.lit("other") for n in ("url", *names)})
    found = html_text.visible_text(pages).collect()
    assert sorted(map(repr, ((r["page_id"], r["text"]) for r in found))) == sorted(map(repr, ((i, html_text.render(h)) for i, h in PAGES)))
    records = warc.read_records(warc.write_packages(pages)).collect()
    assert len(records) == len(PAGES)
    assert sorted(r["payload_bytes"] for r in records) == sorted(len((h or "").encode()) for _, h in PAGES)


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.visible_text(pages).count() == 0
    assert warc.read_records(warc.write_packages(pages)).count() == 0


def test_rows_that_repeat_an_id_are_learned_once(spark):
    rows = [(1, "the cat sat", "en")] * 60 + [(i, f"der hund {i}", "de") for i in range(2, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = {r["lang"]: r for r in language_id.learn(docs, sample_docs=4, sample_chars=50).collect()}
    assert models["en"]["n_chars"] == len("the cat sat")
    assert 0 < models["de"]["n_chars"] <= 50
    with pytest.raises(ValueError, match="16 bits"):
        language_id.learn(docs, sample_chars=10**6)


def test_ties_go_to_the_first_language(spark):
    rows = [(1, "same words", "b"), (2, "same words", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(docs, language_id.learn(docs)).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("a", 0.5)}


def test_the_quality_query_on_unseen_labels(spark, sf_dir):
    found = QUERIES["op8_quality_model"](spark, sf_dir)
    rows = found.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held_out = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held_out) >= 0.9 * len(held_out)
