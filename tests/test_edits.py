"""Composed edits against a fold of one edit after another."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import edits

TEXTS = {1: "ab", 2: "", 3: None, 4: "x" * 500, 5: "untouched"}


def folded(text, log):
    for offset, new in log:
        at = max(0, min(offset, len(text)))
        text = text[:at] + new + text[at:]
    return text


def random_log(rng, n, far):
    return [(rng.randint(-3, far), rng.choice(["", "x", "yz", "}}v{{"])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(30))
def test_any_cut_of_a_log_composes_to_its_fold(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
    log = random_log(rng, rng.randint(0, 60), 40)
    wanted = folded(text, log)
    assert edits.with_inserts(text, edits.composed(log, len(text))) == wanted
    cut = rng.randint(0, len(log))
    between = len(text) + sum(len(new) for _, new in log[:cut])
    runs = edits.composed(log[:cut], len(text)), edits.composed(log[cut:], between)
    assert edits.with_inserts(text, edits.merged(*runs)) == wanted


def test_merging_is_associative():
    rng = random.Random(1)
    for _ in range(50):
        runs, length = [], 5
        for _ in range(3):
            log = random_log(rng, 8, 20)
            runs.append(edits.composed(log, length))
            length += sum(len(new) for _, new in log)
        a, b, c = runs
        assert edits.merged(edits.merged(a, b), c) == edits.merged(a, edits.merged(b, c))


def test_a_composer_of_many_edits():
    rng = random.Random(2)
    log = random_log(rng, 3000, 9000)
    composer = edits.Composer(7)
    for edit in log:
        composer.add(*edit)
    assert edits.with_inserts("abcdefg", composer.whole()) == folded("abcdefg", log)
    assert edits.Composer(3).whole() == []


def docs_of(spark):
    rows = [*TEXTS.items(), (1, "abc"), (None, "a null key")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "n": F.lit("n")})


@pytest.mark.parametrize("tasks", [1, 7])
def test_logs_over_any_tasks(spark, tasks):
    """A long log, of a third of all edits and more, spans tasks; short ones share them."""
    rng = random.Random(tasks)
    rows = [(rng.choice([1, 2, 3, 4, 4, 4]), i, rng.choice([None, *range(-2, 600)]), rng.choice(["v", "", None])) for i in range(900)]
    rows += [(99, 1, 0, "no such document"), (None, 1, 0, "x")]
    drops = spark.createDataFrame(rows, "doc_id long, seq long, offset int, value string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = edits.insert_markers(docs_of(spark), drops).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    logs = {}
    for key, seq, offset, value in sorted(rows[:-2], key=lambda r: r[1]):
        if offset is not None:
            logs.setdefault(key, []).append((offset, "}}" + (value or "") + "{{"))
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in found)
    wanted = [(k, folded(t or "", logs.get(k, []))) for k, t in [*TEXTS.items(), (1, "abc")]] + [(0, "a null key")]
    assert got == sorted(wanted)
    assert found[0].asDict().keys() == {"doc_id", "text", "key", "n"}


def test_no_documents_and_no_edits(spark):
    docs = docs_of(spark)
    drops = spark.createDataFrame([], "doc_id long, seq long, offset int, value string")
    assert edits.insert_markers(docs, drops).count() == docs.count()
    assert edits.insert_markers(docs.where("doc_id < 0"), drops).count() == 0


def moved(slots, log):
    slots = list(slots)
    for start, to in log:
        if start is not None and to is not None and 0 <= start < len(slots) and 0 <= to < len(slots):
            slots.insert(to, slots.pop(start))
    return slots


@pytest.mark.parametrize("tasks", [1, 5])
def test_moves_over_any_tasks(spark, tasks):
    rng = random.Random(tasks)
    slots = {1: list("abcdefghij"), 2: list("abc"), 3: [], 4: ["a", None, "c"]}
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 9]), i, rng.choice([None, -1, *range(11)]), rng.choice([None, -1, *range(11)])) for i in range(400)]
    moves = spark.createDataFrame(rows, "session long, seq long, from int, to int").repartition(3)
    slotted = spark.createDataFrame(list(slots.items()), "session long, slots array<string>").withColumn("n", F.lit("x"))
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["session"]: r["slots"] for r in edits.move_fields(slotted, moves).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key, values in slots.items():
        assert found[key] == moved(values, [(a, b) for k, _, a, b in rows if k == key])


def test_a_million_drops_of_one_document(spark):
    """In bounded memory and time: each edit is merged log(n) times, and no task holds the whole log."""
    n = 1_000_000
    drops = spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("seq"), (F.xxhash64("id") % 5000 + 2500).alias("offset"), F.lit("v").alias("value")
    )
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        found = edits.insert_markers(docs, drops).select(F.length("text"), F.length(F.replace("text", F.lit("}"), F.lit("")))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == 3 + 5 * n
    assert found[1] == 3 + 3 * n
