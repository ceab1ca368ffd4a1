"""Inputs that the given tables don't hold as such, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import or_empty

SLOT_OF = {"click": 0, "view": 1, "purchase": 2, "signup": 3, "error": 4}
#: Offsets of events are below 1000; so many times larger, most of them lie beyond the end of a text.
FAR = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slot() -> Column:
    slot = F.lit(None)
    for kind, number in SLOT_OF.items():
        slot = F.when(F.col("event_type") == kind, number).otherwise(slot)
    return slot.cast("int")


def as_field_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("session"), _slot().alias("slot"), F.col("value").cast("string").alias("value"), "ts", "event_id"
    )


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy("ts", "event_id")))


def as_drops(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("doc_id"), F.floor("value").cast("int").alias("offset"),
        F.col("event_type").alias("value"), "ts", "event_id",
    )


def drops(events: DataFrame) -> DataFrame:
    return as_drops(events).withColumn("seq", F.struct("ts", "event_id"))


def hot_drops(events: DataFrame, n: int = 10) -> DataFrame:
    """All drops, on n documents."""
    return drops(events).withColumn("doc_id", F.col("doc_id") % n)


def as_moves(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("session"), (F.col("value").cast("int") % 10).alias("from"),
        ((F.col("value") * 7).cast("int") % 10).alias("to"), "ts", "event_id",
    )


def moves(events: DataFrame) -> DataFrame:
    return _numbered(as_moves(events), "session")


def far_moves(events: DataFrame) -> DataFrame:
    """Moves of which some are from or to places that aren't there, or to none."""
    far = as_moves(events).withColumn("seq", F.struct("ts", "event_id"))
    to = F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 14 - 2).cast("int"))
    return far.withColumns({"from": F.col("from") + (F.col("event_id") % 5 - 2).cast("int"), "to": to})


def pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each document with one of all items, in turn by the order of their ids; none without items."""
    ranked = items.withColumn("place", F.row_number().over(W.orderBy("item_id")) - 1)
    right = ranked.select("place", "item_id", F.col("text").alias("posting"))
    n_items = items.count()
    if not n_items:
        return docs.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.col("text").alias("resume"), F.lit("").alias("posting")).limit(0)
    left = docs.select("doc_id", F.pmod("doc_id", F.lit(n_items)).alias("at"), F.col("text").alias("resume"))
    return left.join(right, F.col("at") == F.col("place")).select("doc_id", "item_id", "resume", "posting")


def headed_documents(docs: DataFrame) -> DataFrame:
    head = (
        F.when(F.col("doc_id") % 4 == 0, "name: Ada Byron")
        .when(F.col("doc_id") % 4 == 1, "Ada Byron")
        .when(F.col("doc_id") % 4 == 2, "Name: Ada Byron")
        .otherwise("Led a project")
    )
    return docs.select("doc_id", F.concat(F.when(F.col("doc_id") % 8 == 3, "").otherwise(head), F.lit("\n"), "text").alias("text"))


def named_files(docs: DataFrame) -> DataFrame:
    end = F.get(F.array(*map(F.lit, (".TXT", ".md", ".pdf", ".docx"))), (F.col("doc_id") % 4).cast("int"))
    name = F.concat(F.lit("File"), F.col("doc_id").cast("string"), end)
    return docs.select("doc_id", name.alias("name"), (F.col("doc_id") % 100).alias("session"), F.col("doc_id").alias("pos"))


#: Meta tags as pages have them, and what a browser reads (in the order of page ids).
METAS = (
    ('<meta name="description" content="we\'re hiring now">', "we're hiring now"),
    ("<META content='says \"yes\" &amp; more' NAME=description>", 'says "yes" & more'),
    ('<meta name="description" data-content="no" content="yes">', "yes"),
    ('<meta property="og:description" content="of the graph &mdash; &#8217;&eacute;&#x41;">', "of the graph \u2014 \u2019\u00e9A"),
    ("<meta name=description content=bare /><meta name=description content=second>", "bare"),
    ('<meta name="Description" content="another name"><meta charset=utf-8>', ""),
    ('<meta property="og:description" content="the graph"><meta content="a > b" name="description">', "a > b"),
    ('<script>"<meta name=description content=unseen>"</script><meta name="description">', ""),
)


def described_pages(pages: DataFrame) -> DataFrame:
    tag = F.get(F.array(*[F.lit(tag) for tag, _ in METAS]), (F.col("page_id") % len(METAS)).cast("int"))
    return pages.withColumn("html", F.concat(tag, or_empty(F.col("html"))))


def looped_slots(slotted: DataFrame) -> DataFrame:
    """Slots of which every other one names the variable after it."""
    return slotted.withColumn(
        "slots", F.transform("slots", lambda v, i: F.when(i % 2 == 0, F.concat(F.lit("${var"), (i + 2).cast("string"), F.lit("}"))).otherwise(v))
    )


def templates(items: DataFrame) -> DataFrame:
    """template_id, text: benchmark texts with variables for some of their letters."""
    text = F.col("text")
    for number, letter in enumerate("etaoin", 1):
        text = F.replace(text, F.lit(f" {letter}"), F.lit(f" ${{var{number}}} "))
    return items.select(F.col("item_id").alias("template_id"), text.alias("text"))


def postings(pages: DataFrame) -> DataFrame:
    missing = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/missing")))
    return pages.select("page_id", missing.alias("url"))


def crlf_documents(docs: DataFrame) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def posting_json(pages: DataFrame) -> DataFrame:
    address = F.struct(
        F.lit(None).cast("string").alias("streetAddress"), F.concat(F.lit("City "), (F.col("page_id") % 7).cast("string")).alias("addressLocality"),
        F.lit("Region").alias("addressRegion"), F.col("page_id").cast("string").alias("postalCode"), F.lit("XX").alias("addressCountry"),
    )
    record = F.struct(
        F.col("url").alias("title"), F.lit("2024-01-02T03:04:05+01:00").alias("datePosted"), F.col("html").alias("description"),
        F.struct(F.split_part("url", F.lit("/"), F.lit(3)).alias("name")).alias("hiringOrganization"),
        F.struct(address.alias("address")).alias("jobLocation"),
    )
    good = F.to_json(record)
    return pages.select("page_id", F.when(F.col("page_id") % 5 == 4, F.left(good, F.lit(20))).otherwise(good).alias("json"))


def versions(turns: DataFrame) -> DataFrame:
    """What the assistant says are versions of a document, three of four of them approved; the turn is their time."""
    return turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("ts"), "text", (F.col("turn") % 4 != 1).alias("approved")
    )


def asks(turns: DataFrame) -> DataFrame:
    """Whatever is said asks for the document as it is by then."""
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ts"), "role")


def coded_files(docs: DataFrame) -> DataFrame:
    """doc_id, content: texts in several encodings, and what is no text."""
    text, kind = or_empty(F.col("text")), F.col("doc_id") % 6
    plain = F.translate(F.regexp_replace(text, r"[^\x00-\xFF]", "?"), "\x00", "?")
    content = (
        F.when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(kind == 3, F.concat(F.unhex(F.lit("E9")), F.encode(plain, "ISO-8859-1")))
        .when(kind == 4, F.concat(F.encode(F.lit("%PDF-1.7 "), "UTF-8"), F.encode(text, "UTF-8")))
        .when(kind == 5, F.concat(F.unhex(F.lit("0001FF")), F.encode(text, "UTF-8")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return docs.select("doc_id", content.alias("content"))


def replies(events: DataFrame) -> DataFrame:
    message = F.concat(F.lit('{"choices":[{"message":{"content":"'), "event_type", F.lit('"}}]}'))
    text = F.concat(F.lit('{"choices":[{"text":"'), "event_type", F.lit('"}]}'))
    reply = F.when(F.col("event_id") % 3 == 0, message).when(F.col("event_id") % 3 == 1, text).otherwise(F.col("props"))
    status = (F.lit(200) + (F.col("event_id") % 4) * 100).cast("int")
    return events.select("event_id", reply.alias("reply"), status.alias("status"), F.col("event_type").alias("reason"))


SQL = {
    "field_events": "SELECT user_id AS session, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLOT_OF.items())
    + " END AS slot, CAST(value AS VARCHAR) AS value, ts, event_id FROM events",
    "drops": """SELECT user_id AS doc_id, CAST(floor(value) AS INT) AS "offset", event_type AS value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events""",
    "far_drops": f"""SELECT user_id AS doc_id, CAST(floor(value) AS INT) * {FAR} AS "offset", event_type AS value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events""",
    "hot_drops": """SELECT user_id % 10 AS doc_id, CAST(floor(value) AS INT) AS "offset", event_type AS value,
        row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS seq FROM events""",
    "far_moves": """SELECT user_id AS session, CAST(trunc(value) AS INT) % 10 + event_id % 5 - 2 AS "from",
        CASE WHEN event_id % 7 <> 0 THEN event_id % 14 - 2 END AS "to",
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events""",
    "moves": """SELECT user_id AS session, CAST(trunc(value) AS INT) % 10 AS "from",
        CAST(trunc(value * 7) AS INT) % 10 AS "to",
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events""",
    "pairs": """SELECT d.doc_id, b.item_id, d.text AS resume, b.text AS posting FROM documents d JOIN (
        SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark) b
        ON b.place = ((d.doc_id % b.n) + b.n) % b.n""",
    "headed_documents": """SELECT doc_id, CASE WHEN doc_id % 8 = 3 THEN '' WHEN doc_id % 4 = 0 THEN 'name: Ada Byron'
        WHEN doc_id % 4 = 1 THEN 'Ada Byron' WHEN doc_id % 4 = 2 THEN 'Name: Ada Byron' ELSE 'Led a project' END
        || chr(10) || text AS text FROM documents""",
    "named_files": """SELECT doc_id, 'File' || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md'
        WHEN 2 THEN '.pdf' ELSE '.docx' END AS name, doc_id % 100 AS session, doc_id AS pos FROM documents""",
    "described_pages": "SELECT page_id, CASE page_id % 8 "
    + " ".join("WHEN {} THEN '{}'".format(i, tag.replace("'", "''")) for i, (tag, _) in enumerate(METAS))
    + " END || coalesce(html, '') AS html FROM pages",
    "templates": "SELECT item_id AS template_id, "
    + "replace(" * 6
    + "text"
    + "".join(f", ' {letter}', ' ${{var{number}}} ')" for number, letter in enumerate("etaoin", 1))
    + " AS text FROM benchmark",
    "postings": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/missing' END AS url FROM pages",
    "crlf_documents": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END
        AS text FROM documents""",
    "replies": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"choices":[{"message":{"content":"' || event_type || '"}}]}'
        WHEN 1 THEN '{"choices":[{"text":"' || event_type || '"}]}' ELSE props END AS reply,
        CAST(200 + (event_id % 4) * 100 AS INT) AS status, event_type AS reason FROM events""",
}
