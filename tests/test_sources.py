"""Files, letters, pages and sessions that the given tables don't hold."""

import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliant.operators import compose, match
from foliant.plans import inputs
from foliant.plans.oracle import ORACLE_SQL
from foliant.plans.queries import QUERIES
from foliant.sources import files, letters, postings
from foliant.sources.letters import LetterWriter


def test_a_folder_of_files_in_several_encodings(spark, tmp_path):
    held = {
        "plain.txt": ("naïve ✓\n".encode(), "text", "UTF-8", "naïve ✓\n"),
        "marked.txt": (b"\xef\xbb\xbf" + "é".encode(), "text", "UTF-8", "é"),
        "little.txt": ("é😀\n".encode("utf-16"), "text", "UTF-16", "é😀\n"),
        "big.md": (b"\xfe\xff" + "漢".encode("utf-16-be"), "text", "UTF-16", "漢"),
        "old.txt": ("café “quoted” — €".encode("cp1252"), "text", "windows-1252", "café “quoted” — €"),
        "empty": (b"", "text", "UTF-8", ""),
        "page.PDF": (b"%PDF-1.4 \x00\x01", "paged", None, None),
        "data.bin": (bytes(range(256)), "rejected", None, None),
        "zeros.txt": ("a\0b".encode(), "rejected", None, None),
        "half.txt": (b"\xff\xfea", "rejected", None, None),
        "lone.txt": (b"\xff\xfe\x00\xd8a\x00", "rejected", None, None),
    }
    for name, (content, *_) in held.items():
        (tmp_path / name).write_bytes(content)
    found = {r["name"]: r for r in files.load_files(spark, str(tmp_path)).collect()}
    del held["empty"]  # which Spark's readers pass over
    assert found.keys() == held.keys()
    for name, (content, route, charset, text) in held.items():
        r = found[name]
        assert (r["size"], r["route"], r["charset"], r["text"]) == (len(content), route, charset, text), name
        assert (r["status"], r["error"] is None) == (("error", False) if route == "rejected" else ("ok", True))
    assert {n: r["error"] for n, r in found.items() if r["error"]} == {"data.bin": "no text", "zeros.txt": "no text", "half.txt": "undecodable", "lone.txt": "undecodable"}
    assert postings.ingest_errors(files.load_files(spark, str(tmp_path)).withColumn("source", F.lit("files"))).count() == 2


def test_files_keep_other_columns(spark):
    one = spark.createDataFrame([(1, bytearray(b"a"), "x", "y"), (2, None, "x", "y")], "i int, content binary, charset_ string, text_ string")
    rows = {r["i"]: r for r in files.decode_files(one).collect()}
    assert files.decode_files(one.withColumn("content", F.lit(b""))).first()["text"] == ""
    assert (rows[1]["text"], rows[1]["charset_"], rows[1]["text_"]) == ("a", "x", "y")
    assert (rows[2]["text"], rows[2]["status"]) == (None, "error")


LETTERS = "kind string, name string, letter string"


def test_letters_are_files_of_their_own(spark, tmp_path):
    rows = [("a kind/of", f"n{i}.txt", f"text {i}\n\n") for i in range(20)]
    rows += [(None, "n.txt", None), ("b", "same.txt", "1"), ("b", "same.txt", "2"), ("b", "bare", "x"), ("b", "bare", "y")]
    letters = spark.createDataFrame(rows, LETTERS).coalesce(1)
    path = str(tmp_path / "out")
    files.save_letters(letters.repartition(3, "kind"), path)
    read = [(r["kind"], r["name"], r["text"]) for r in files.load_text(spark, path, keep=("kind",)).collect()]
    assert sorted(t for _, _, t in read) == sorted(t for _, _, t in rows if t)
    assert len([n for n in files_in(path) if not n.startswith(".")]) == len(rows)  # the empty one, too
    assert {n for k, n, _ in read if k == "b"} == {"same.txt", "same-2.txt", "bare", "bare-2"}
    assert {k for k, _, _ in read} == {"a kind/of", "b"}
    files.save_letters(letters.limit(2), path, overwrite=False)
    assert files.load_text(spark, path, keep=("kind",)).count() == len(rows) + 1
    files.save_letters(letters.limit(1), f"file://{path}")
    assert files.load_text(spark, path, keep=("kind",)).count() == 1
    assert not [n for n in os.listdir(path) if n.startswith("_writing")]


@pytest.mark.parametrize("name", [None, "", "../up", "a/b", ".hidden", "_hidden"])
def test_a_failed_task_leaves_no_letter(spark, tmp_path, name):
    rows = [("a", f"n{i}.txt", "text") for i in range(30)] + [("a", name, "text")]
    with pytest.raises(Exception, match="can't name"):
        files.save_letters(spark.createDataFrame(rows, LETTERS).repartition(3), str(tmp_path / "out"))
    assert files_in(tmp_path) == []


def files_in(folder):
    return [f for _, _, names in os.walk(folder) for f in names]


def test_attempts_that_were_given_up_are_not_moved(tmp_path, monkeypatch):
    """A task that ran twice: what the first attempt wrote goes."""
    from foliant.sources import letters

    class Task:
        partitionId = staticmethod(lambda: 4)

    monkeypatch.setattr(letters.TaskContext, "get", staticmethod(lambda: Task))
    writer = LetterWriter(str(tmp_path / "out"), True)
    rows = [{"kind": "k", "name": "a.txt", "text": "t"}]
    writer.write(iter(rows))
    writer.commit([writer.write(iter(rows)), None])
    assert files_in(tmp_path) == ["a.txt"]


def test_pages_of_any_number_in_one_exchange(spark):
    rng = random.Random(3)
    rows = [(d, p, i, rng.choice(["x", "y z", "", None])) for d in (1, 2, None) for p in range(40) for i in range(rng.randint(1, 3))]
    rows += [(9, None, None, "no page"), (9, 1, 1, "a"), (9, 1, 1, "a")]
    items = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, page int, item int, str string").withColumn("key", F.lit("k"))
    found = files.assemble_pages(items, separator="|")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x[1:3]) + ((x[3] is not None, x[3] or ""),)
    wanted = {}
    for d in (1, 2, None, 9):
        pages = {}
        for row in sorted((r for r in rows if r[0] == d), key=key):
            pages.setdefault(row[1], []).append(row[3] or "")
        wanted[d] = "".join(" ".join(p) + "|" for p in pages.values())
    assert {r["doc_id"]: r["text"] for r in found.collect()} == wanted
    bare = files.assemble_pages(items.where("doc_id = 9"), separator="|", trailing=False)
    assert bare.first()["text"] == "no page|a a"
    assert files.assemble_pages(items.where("doc_id = 7")).count() == 0


def test_a_document_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        items = spark.range(1000).select(F.lit("d").alias("doc_id"), (F.col("id") / 10).cast("int").alias("page"), F.col("id").alias("item"), F.col("id").cast("string").alias("str"))
        text = files.assemble_pages(items, separator="\n").first()["text"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert text == "".join(" ".join(str(p * 10 + i) for i in range(10)) + "\n" for p in range(100))


def test_sessions_at_a_time(spark):
    versions = [(1, 1, "old", True), (1, 3, "draft", False), (1, 5, "new", True), (1, 5, "newer", True), (2, 9, "late", True), (None, 1, "n", True), (1, None, "never", True)]
    asks = [(1, 0), (1, 1), (1, 4), (1, 5), (1, 99), (2, 8), (3, 5), (None, 2), (1, None)]
    left = spark.createDataFrame(versions, "doc_id long, ts long, text string, approved boolean")
    right = spark.createDataFrame(asks, "doc_id long, ts long").withColumns({"ask": F.lit("a"), "of": F.lit("o"), "text": F.lit("t")})
    found = {(r["doc_id"], r["ts"]): (r["saved_at"], r["text"]) for r in files.session_documents(left, right).collect()}
    none = (None, None)
    assert found == {(1, 0): none, (1, 1): (1, "old"), (1, 4): (1, "old"), (1, 5): (5, "newer"), (1, 99): (5, "newer"), (2, 8): none, (3, 5): none, (None, 2): (1, "n"), (1, None): none}


def test_columns_of_the_caller_stay(spark):
    posted = spark.createDataFrame([("u", "mine", "kept", "kept"), ("v", "mine", "kept", "kept")], "url string, html string, has string, of string")
    pages = spark.createDataFrame([("u", "<h1>b</h1>"), ("u", "<h1>a</h1>"), ("w", None)], "url string, html string")
    found = {r["url"]: r for r in postings.posting_fetch_fallback(posted, pages).collect()}
    assert found.keys() == {"u", "v"}
    assert (found["u"]["text"].strip(), found["u"]["html"], found["v"]["status"]) == ("a", "mine", "error")
    rows = spark.createDataFrame([("{}", "kept")], "json string, read string")
    assert postings.load_job_postings(rows).first()["read"] == "kept"
    several = spark.createDataFrame([(1, 1, "kept", "a"), (1, 2, "kept", "b")], "session int, pos int, rank string, name string")
    assert files.first_file(several).first().asDict() == {"session": 1, "pos": 1, "rank": "kept", "name": "a"}
    pair = spark.createDataFrame([("r text", "p text", "1", "2", "3")], "resume string, posting string, resume_words string, letter_title string, words_of string")
    letter = compose.render_letter(pair).first()
    assert (letter["resume_words"], letter["letter_title"], letter["words_of"]) == ("1", "2", "3")
    repeated = spark.createDataFrame([(1, "b words", "x"), (1, "a words", "x")], "doc_id int, resume string, posting string")
    words = match.with_keywords(repeated, resume_key="doc_id").select("resume_words").distinct().collect()
    assert [r[0] for r in words] == [["words"]]


def test_requests_without_a_key_say_why(spark):
    pair = spark.createDataFrame([("r", "p", "k"), ("r", "p", ""), ("r", "p", None)], "resume string, posting string, key string")
    found = compose.build_requests(pair, key="key")
    assert [(r["request"] is None, r["status"], r["error"]) for r in found.collect()] == [(False, "ok", None), *[(True, "error", compose.NO_KEY)] * 2]
    counts = postings.ingest_errors(found.withColumn("source", F.lit("requests")))
    assert {(r["status"], r["n"]) for r in counts.collect()} == {("ok", 1), ("error", 2)}


def test_pairs_by_the_order_of_items(spark):
    docs = spark.createDataFrame([(i, "d") for i in range(-2, 18)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "nine"), (0, "zero")], "item_id long, text string")
    found = {r["doc_id"]: r["item_id"] for r in inputs.pairs(docs, items).collect()}
    assert found == {i: 9 if i % 2 else 0 for i in range(-2, 18)}
    assert inputs.pairs(docs, items.where("item_id = 7")).count() == 0


def same_as_sql(spark, folder, name):
    duck = duckdb.connect()
    for file in os.listdir(folder):
        duck.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}/*.parquet'")
    found, wanted = QUERIES[name](spark, str(folder)), duck.sql(ORACLE_SQL[name])
    rows = Counter(tuple(r[c] for c in wanted.columns) for r in found.collect())
    assert rows == Counter(wanted.fetchall())
    return rows


@pytest.fixture
def repeated_pages(spark, tmp_path):
    """Pages that share an url, that have none, and that have no html."""
    urls = ["a", "a", "b", "c", "a", "b", "d", "c", None, None, "e", "f", "e", "f"]
    rows = [(i, url, None if url in ("d", "f") or i == 12 else f"<h1>{i}</h1><p>page {i}</p>") for i, url in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return tmp_path


def test_every_page_of_an_url_is_a_row(spark, repeated_pages):
    rows = same_as_sql(spark, repeated_pages, "posting_fetch_fallback")
    assert rows.total() > 14
    assert {(i, status) for i, _, status in rows if i in (6, 12)} == {(6, "error"), (12, "ok"), (12, "error")}


def test_every_page_of_an_url_is_counted(spark, repeated_pages):
    rows = same_as_sql(spark, repeated_pages, "ingest_errors")
    assert sum(n for source, _, n in rows if source == "pages") > 14


def test_letters_are_read_by_the_tasks(spark, tmp_path, monkeypatch):
    """All letters come back, the empty ones too, and the driver has a folder for each task instead of their files."""
    rows = [(["a kind/of", "1", None][i % 3], f"n{i}.txt", ["text\n\n", "", "é✓"][i % 3] * i) for i in range(60)]
    path = f"file://{tmp_path}/out"
    files.save_letters(spark.createDataFrame(rows, LETTERS).repartition(3), path)
    found = files.read_letters(spark, path)
    assert sorted(map(str, found.collect())) == sorted(str(Row(kind=k, name=n, text=t)) for k, n, t in rows)
    assert found.rdd.getNumPartitions() == 3
    assert found.inputFiles() == []
    monkeypatch.setattr(letters, "BATCH", 50)
    reader = letters.LetterReader(path)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) > 3
    assert sum(b.num_rows for b in batches) == len(rows)
    (tmp_path / "none").mkdir()
    assert files.read_letters(spark, str(tmp_path / "none")).count() == 0


def test_no_list_of_letters_in_the_driver(spark, tmp_path):
    docs = [(i, f"text {i}") for i in range(-3, 40)] + [(40, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, ""), (1, "posting")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert same_as_sql(spark, tmp_path, "save_letters").total() == 44
    assert QUERIES["save_letters"](spark, str(tmp_path)).inputFiles() == []
