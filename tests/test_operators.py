"""Small inputs for each rule that the given tables don't show, and properties of edits and matches."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions.text import trimmed
from foliant.operators import compose, edits, fields, markup, match, pages, tokens
from foliant.sources import files, postings


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).first()["x"]


def of_text(spark, function, text):
    return one(spark, function(F.col("t")), t=text)


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("-C++- c# #a x1-", ["x1"]),
        ("e-mail c#x", ["e-mail", "c#x"]),
        ("", []),
        ("the of", []),
        ("Éa éouoi -ab--cd-", ["ouoi", "ab--cd"]),
    ],
)
def test_content_words(spark, text, words):
    assert of_text(spark, tokens.content_array, text) == words
    assert of_text(spark, lambda t: F.filter(tokens.token_array(t), tokens.is_content), text) == words


def test_ties_go_to_the_word_seen_first(spark):
    docs = spark.createDataFrame([(1, "bb aa bb aa cc"), (2, None), (None, "bb")], "doc_id long, text string")
    for n, words in ((10, ["bb", "aa", "cc"]), (2, ["bb", "aa"])):
        found = {r["doc_id"]: r["words"] for r in tokens.top_lists(docs, n=n).collect()}
        assert found == {1: words, None: ["bb"]}


def test_frequencies_count_each_word(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "x1", "the"]) for _ in range(500))
    words = [w for w in text.split() if w != "the"]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = {f["word"]: (f["n"], f["first_pos"]) for f in tokens.word_frequencies(docs).collect()}
    assert found == {w: (words.count(w), words.index(w)) for w in set(words)}


def test_highlight_falls_back_to_the_resume(spark):
    rows = [(0, "alpha beta gamma", "delta"), (1, "alpha beta", "beta alpha"), (2, "", ""), (None, None, "x")]
    pairs = spark.createDataFrame(rows, "id long, resume string, posting string")
    text = match.highlight_text(F.col("posting_words"), F.col("resume_words"))
    for keys in ({}, {"resume_key": "id", "posting_key": "id"}):
        found = {r["id"]: r["h"] for r in match.with_keywords(pairs, **keys).select("id", text.alias("h")).collect()}
        assert found == {0: "alpha, beta, gamma", 1: "beta, alpha", 2: "", None: ""}


@pytest.mark.parametrize(
    ("posting", "title"),
    [("Engineer\nmore", "Engineer"), ("  \nEngineer", ""), ("", "the role"), ("\nwe want a Data Engineer!", "Data Engineer")],
)
def test_titles(spark, posting, title):
    assert of_text(spark, compose.title_of, posting) == title


@pytest.mark.parametrize(
    ("text", "name"),
    [("name: Ada Byron\nx", "Ada Byron"), ("x\nAda Byron\ny", "Ada Byron"), ("Name: Ada Byron", ""), ("Ada", ""), ("", "")],
)
def test_names(spark, text, name):
    assert of_text(spark, compose.name_of, text) == name


def test_achievements(spark):
    text = "first\nI led a team\nbuilt it"
    assert of_text(spark, compose.achievement_of, text) == "first"
    assert of_text(spark, lambda t: compose.achievement_of(t, "intended"), text) == "I led a team"
    assert of_text(spark, compose.achievement_of, "\nx") == compose.NO_ACHIEVEMENT


def test_letters_of_empty_texts(spark):
    pairs = spark.createDataFrame([("", ""), ("", "Engineer"), (None, None)], "resume string, posting string")
    letters = [r["letter"] for r in compose.render_letter(pairs).collect()]
    assert letters[0] == letters[2] == ""
    assert "experience in  and" in letters[1] and "[Your Name]" in letters[1] and "interest in Engineer." in letters[1]


def test_requests_need_a_key(spark):
    rows = spark.createDataFrame([("r", "p", ""), ("r", "p", "k"), ("r", "p", None)], "resume string, posting string, key string")
    assert compose.build_prompts(rows, key="key").count() == 1


@pytest.mark.parametrize(
    ("reply", "text"),
    [
        ('{"choices":[{"text":"t"}]}', "t"),
        ('{"choices":[{"message":{"content":"c"},"text":"t"}]}', "c"),
        ('{"choices":[{"message":{"content":""},"text":"t"}]}', "t"),
        ('{"a":1}', '{"a":1}'),
    ],
)
def test_replies(spark, reply, text):
    assert of_text(spark, compose.reply_text, reply) == text


@pytest.mark.parametrize(
    ("text", "clean"),
    [("a<br><br>}}x{{<br/>", "a\nx<br/>"), ("{}}{", ""), ("a\n\n\nb", "a\nb"), ("", "")],
)
def test_clean_export(spark, text, clean):
    assert of_text(spark, markup.clean_export, text) == clean


def test_breaks(spark):
    assert of_text(spark, markup.collapse_breaks, "a<br> <br>b<br>c") == "a<br>b<br>c"
    assert of_text(spark, markup.text_to_markup, "a\r\nb\nc\r") == "a<br>b<br>c\r"
    assert of_text(spark, trimmed, " x﻿") == "x"


PAGE = '<title>T</title><script>"<p>no</p>"</script><p>a<p>b</p><pre>c</pre><p> </p><p class="x">&amp;lt; d<div>e</div>'


def test_paragraphs(spark):
    assert of_text(spark, pages.paragraph_array, PAGE) == ["a", "b", "&lt; d"]
    assert of_text(spark, lambda h: pages.paragraph_array(h, 1), PAGE) == ["a"]
    assert of_text(spark, pages.paragraph_array, "") == of_text(spark, pages.paragraph_array, None) == []


def test_titles_and_descriptions_of_pages(spark):
    assert of_text(spark, pages.title_of, PAGE) == "T"
    assert of_text(spark, pages.title_of, "<h1 id=x>A <b>c</b></h1><h1>d</h1>" + PAGE) == "A c"
    assert of_text(spark, pages.description_of, '<meta content="d" name="description">') == "d"
    assert of_text(spark, pages.description_of, '<meta property="og:description" content="o">') == "o"
    assert of_text(spark, pages.job_text, "<p>x</p>") == "\n\n\n\nx"


def _drops(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, seq int, offset int, value string")


@pytest.mark.parametrize(
    ("drops", "text"),
    [
        ([(1, 1, 1, "")], "a}}{{b"),
        ([(1, 1, 99, "x")], "ab}}x{{"),
        ([(1, 2, 1, "y"), (1, 1, 1, "x")], "a}}y{{}}x{{b"),
        ([(1, 1, None, "x")], "ab"),
        ([(2, 1, 0, "x")], "ab"),
    ],
)
def test_insert_markers(spark, drops, text):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert edits.insert_markers(docs, _drops(spark, drops)).first()["text"] == text


def test_inserted_markup_is_escaped(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    found = edits.insert_markers(docs, _drops(spark, [(1, 1, 0, "<&")]), wrap="span").first()["text"]
    assert found == '<span style="color: red;">}}&lt;&amp;{{</span>ab'


def test_markers_add_their_length(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "x" * rng.randrange(20)) for i in range(20)], "doc_id long, text string")
    # At either end: a drop within the braces of an earlier one would split its marker.
    rows = [(i % 20, i, rng.choice((0, 10_000)), "v" * rng.randrange(5)) for i in range(100)]
    before = {r["doc_id"]: len(r["text"]) for r in docs.collect()}
    added = {d: sum(len(v) + 4 for e, _, _, v in rows if e == d) for d in before}
    bare = {d: sum(len(v) for e, _, _, v in rows if e == d) for d in before}
    found = edits.insert_markers(docs, _drops(spark, rows))
    for row in found.withColumn("bare", markup.without_markers(F.col("text"))).collect():
        assert len(row["text"]) == before[row["doc_id"]] + added[row["doc_id"]]
        assert len(row["bare"]) == before[row["doc_id"]] + bare[row["doc_id"]]


def test_edits_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "ab", "e", "e")], "doc_id long, text string, edits string, Edits_ string")
    found = edits.insert_markers(docs, _drops(spark, [(1, 1, 0, "x")]))
    assert found.columns == docs.columns and found.first()["text"] == "}}x{{ab" and found.first()["edits"] == "e"


def test_moves(spark):
    slots = spark.createDataFrame([(1, list("abcd"))], "session long, slots array<string>")

    def after(*moves):
        rows = [(1, i, a, b) for i, (a, b) in enumerate(moves)]
        table = spark.createDataFrame(rows, "session long, seq int, `from` int, `to` int")
        return "".join(edits.move_fields(slots, table).first()["slots"])

    assert after((0, 2)) == "bcad"
    assert after((3, 0)) == "dabc"
    for a in range(4):
        for b in range(4):
            assert after((a, b), (b, a)) == "abcd"


def test_fields(spark):
    slots = F.array(*[F.lit("")] * 10)
    assert of_text(spark, lambda t: fields.with_fields(t, slots), "t") == "t" + "\n" * 11
    assert of_text(spark, fields.truncated, "x" * 25) == "x" * 20
    assert of_text(spark, lambda t: F.array_join(fields.labels(F.array(t, F.lit(""))), ","), "v") == "v,Field 2"
    assert of_text(spark, lambda t: fields.fill(t, F.array(F.lit("p"))), "${var1}-${var2}") == "p-"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.md").write_text("")
    found = {r["name"]: r["text"] for r in files.load_text(spark, str(tmp_path)).collect()}
    assert found["a.txt"] == "one\ntwo"
    names = spark.createDataFrame([("A.TXT",), ("b.md",), ("c.pdf",), ("d.docx",)], "name string")
    assert [r["route"] for r in files.route_files(names, on_other="ignored").collect()] == ["text", "text", "paged", "ignored"]
    with pytest.raises(ValueError):
        files.route_files(names, on_other="x")


def test_letters_are_written_and_read_back(spark, tmp_path):
    letters = spark.createDataFrame([(1, "a\nb", "final.txt")], "doc_id long, letter string, kind string")
    files.write_letters(letters, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/text/kind=final.txt"), wholetext=True).first()["value"] == "a\nb\n"
    assert spark.read.parquet(str(tmp_path / "out/rows")).first()["letter"] == "a\nb"


def test_approved_versions(spark):
    rows = [(1, 1, "a", True), (1, 2, "b", True), (1, 3, "c", False), (2, 1, "d", False)]
    table = spark.createDataFrame(rows, "doc_id long, version long, text string, approved boolean")
    assert [tuple(r) for r in files.approved_version(table).collect()] == [(1, 2, "b")]


def test_posting_records(spark):
    good = '{"title":"t","datePosted":"2024-01-01T00:00:00+00:00","description":"<p>x</p>","jobLocation":{"address":{"addressLocality":"c"}}}'
    rows = spark.createDataFrame([(1, good), (2, "{bad"), (3, None)], "id long, json string")
    read = postings.load_job_postings(rows)
    assert [r["status"] for r in read.orderBy("id").collect()] == ["ok", "error", "error"]
    flat = postings.flatten_posting(read, keep=("id",)).orderBy("id").first()
    assert (flat["title"], flat["city"], flat["organisation"]) == ("t", "c", None)


def test_results_dont_depend_on_partitioning(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    first = {tuple(r) for r in match.match_corpus(docs, items).collect()}
    assert first == {tuple(r) for r in match.match_corpus(docs.repartition(7), items.repartition(3)).collect()}
    pair = match.match_corpus(docs.where("doc_id = 5"), items.where("item_id = 5"))
    assert {tuple(r) for r in pair.collect()} == {r for r in first if r[:2] == (5, 5)}
