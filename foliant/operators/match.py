"""Postings and résumés through the keywords that they share.

The overlap of two texts is that of their two lists of top words, in the order of the posting's list. For given pairs
the lists are joined to the pair; for all pairs the lists are joined on the word, so that pairs without a common word
are never formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.lineage import cut
from foliant.functions.text import or_else, unused
from foliant.operators.tokens import top_keywords, top_lists

TOP = 20
SHOWN = 8
FALLBACK = 6
#: Rows of a value that one task joins; more are cut into shares.
SPREAD_ROWS = 1_000_000
#: Frequent values are at most as many as the rows by SPREAD_ROWS; more than this are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def overlap_array(posting: Column, resume: Column, n: int = SHOWN) -> Column:
    """The first n words of the posting's list that are in the résumé's list."""
    return F.slice(F.filter(posting, lambda w: F.array_contains(resume, w)), 1, n)


def highlight_text(posting: Column, resume: Column) -> Column:
    """The shared words, or else the résumé's first words, joined by commas."""
    shared = F.array_join(overlap_array(posting, resume), ", ")
    return or_else(shared, F.array_join(F.slice(resume, 1, FALLBACK), ", "))


def with_keywords(
    pairs: DataFrame,
    *,
    resume: str = "resume",
    posting: str = "posting",
    resume_key: str | None = None,
    posting_key: str | None = None,
    resume_words: str = "resume_words",
    posting_words: str = "posting_words",
) -> DataFrame:
    """The pairs with the top words of both texts, ``resume_words`` and ``posting_words``.

    Words are counted once for each text, not for each pair. Keys tell texts apart without moving them to the pairs or
    to their words; of texts that share a key the first one counts. Texts without a key go by their digest.
    """
    sides = ((resume_key, resume, resume_words), (posting_key, posting, posting_words))
    own = {name: F.col(key) if key else F.unhex(F.sha2(F.col(text), 256)) for key, text, name in sides}
    mine = {name: unused(f"{name}_of", pairs) for name in own}
    given, pairs = pairs, pairs.withColumns({mine[name]: own[name] for name in own})
    for _, text, name in sides:
        of = unused("words_of", pairs)
        texts = given.select(own[name].alias("of"), F.col(text).alias("text")).groupBy("of").agg(F.min("text").alias("text"))
        found = top_lists(texts, key="of", n=TOP, dealt=True).select(F.col("of").alias(of), F.col("words").alias(name))
        pairs = pairs.join(found, F.col(mine[name]).eqNullSafe(F.col(of)), "left").drop(of)
        pairs = pairs.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return pairs.drop(*mine.values())
    return pairs


def spread_join(left: DataFrame, right: DataFrame, on: str, *, rows: int = SPREAD_ROWS) -> DataFrame:
    """The join of two tables on a column whose values may be very frequent, in tasks of bounded size.

    Values are counted first. One with more than ``rows`` rows on a side is cut there into as many numbered shares; the
    rows of the other side go to every share. So no task gets more than about ``rows`` of each side for a value, and
    what is dealt more than once is the side of a frequent value that is cut less, not the table. Both tables are read
    twice and should be kept.
    """
    sizes = [t.groupBy(on).agg(F.count(F.lit(1)).alias(n)) for t, n in ((left, "l"), (right, "r"))]
    shares = {n: F.ceil(F.col(n) / rows).cast("int").alias(f"{n}_shares") for n in ("l", "r")}
    frequent = sizes[0].join(sizes[1], on).where((F.col("l") > rows) | (F.col("r") > rows)).select(on, *shares.values())
    frequent = cut(frequent)
    n_frequent = frequent.count()
    if not n_frequent:
        return left.join(right, on)
    if n_frequent <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)

    def dealt(table: DataFrame, own: str, other: str) -> DataFrame:
        found = table.join(frequent, on, "left").fillna(1, ["l_shares", "r_shares"])
        share = F.floor(F.rand(7) * F.col(f"{own}_shares")).cast("int").alias(f"{own}_share")
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}_shares") - 1)).alias(f"{other}_share")
        return found.select(*table.columns, share, each)

    keys = [on, "l_share", "r_share"]
    return dealt(left, "l", "r").join(dealt(right, "r", "l"), keys).drop("l_share", "r_share")


def match_corpus(
    docs: DataFrame, postings: DataFrame, *, doc_key: str = "doc_id", posting_key: str = "item_id", text: str = "text"
) -> DataFrame:
    """doc_key, posting_key, k (shared words), highlight, for all pairs that share a word."""
    left = cut(top_keywords(docs, key=doc_key, text=text, n=TOP).select(doc_key, "word"))
    right = cut(top_keywords(postings, key=posting_key, text=text, n=TOP))
    shared = spread_join(left, right, "word").groupBy(doc_key, posting_key)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])
    return shared.agg(F.count(F.lit(1)).alias("k"), F.array_join(F.slice(ordered, 1, SHOWN), ", ").alias("highlight"))


def rare_lists(words: DataFrame, often: DataFrame, key: str) -> DataFrame:
    """key, words: those of a text's words that ``often`` (word, c) has, the rarest first."""
    listed = F.array_sort(F.collect_list(F.struct("c", "word")))
    return words.join(often, "word").groupBy(key).agg(listed["word"].alias("words"))


def _probed(texts: DataFrame, index: DataFrame, doc_key: str, posting_key: str) -> DataFrame:
    """doc_key, words, posting_key, k: pairs whose rarest shared word is asked for, and which may share ``least`` words.

    ``texts``: doc_key, words, begin and end (the places of the words that ask), least. ``index``: word, posting_key,
    posting_words, place. Words of both sides are in one order, so all that a pair shares stands at its rarest or after.
    """
    places = F.sequence(F.col("begin"), F.col("end") - 1)
    asked = texts.where("begin < end").select(doc_key, "words", "least", F.explode(places).alias("at"))
    asked = asked.withColumn("word", F.get("words", "at"))
    after = F.least(F.size("words") - F.col("at"), F.size("posting_words") - F.col("place"))
    shared = F.array_intersect("words", "posting_words")
    met = asked.join(index.withColumnRenamed("word", "of"), (F.col("word") == F.col("of")) & (after >= F.col("least")) & (F.get(shared, 0) == F.col("word")))
    return met.select(doc_key, "words", posting_key, F.size(shared).cast("long").alias("k"))


def top_postings(
    docs: DataFrame,
    postings: DataFrame,
    *,
    doc_key: str = "doc_id",
    posting_key: str = "item_id",
    text: str = "text",
    n: int = 3,
    first: int = 4,
) -> DataFrame:
    """doc_key, posting_key, k, rank: the n postings with most shared words; of equal ones, the lower key.

    All pairs aren't formed. A document asks by its rarest words first (of those that postings have): postings that it
    meets by none of its q rarest share at most the others with it. The ``first`` rarest give n postings to begin with;
    if the n-th of these shares k words, a posting comes before it only if there are k words from the rarest shared one
    on, in the document and in the posting. So the most frequent words, which most pairs have in common, are never asked
    for. Each pair is made by its rarest shared word alone. A document with fewer than n so far asks by all its words.
    """
    left = cut(top_keywords(docs, key=doc_key, text=text, n=TOP).select(doc_key, "word"))
    right = cut(top_keywords(postings, key=posting_key, text=text, n=TOP).select(posting_key, "word"))
    often = right.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    texts = cut(rare_lists(left, often, doc_key))
    lists = rare_lists(right, often, posting_key).withColumnRenamed("words", "posting_words")
    index = cut(lists.select(posting_key, "posting_words", F.posexplode("posting_words").alias("place", "word")))
    best = W.partitionBy(doc_key).orderBy(F.desc("k"), posting_key)

    def ranked(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= n)

    m = F.size("words")
    begun = texts.select(doc_key, "words", F.lit(0).alias("begin"), F.least(m, F.lit(first)).alias("end"), F.lit(1).alias("least"))
    found = cut(ranked(_probed(begun, index, doc_key, posting_key)))
    known = found.groupBy(doc_key).agg(F.when(F.count(F.lit(1)) >= n, F.min("k")).otherwise(1).cast("int").alias("least"))
    later = texts.join(known, doc_key, "left").withColumn("least", F.coalesce("least", F.lit(1)))
    later = later.withColumns({"begin": F.lit(first), "end": m - F.col("least") + 1})
    more = _probed(later, index, doc_key, posting_key)
    return ranked(found.drop("rank").unionByName(more)).select(doc_key, posting_key, "k", "rank")


def keyword_overlap(
    docs: DataFrame, postings: DataFrame, *, doc_key: str = "doc_id", posting_key: str = "item_id", text: str = "text"
) -> DataFrame:
    """doc_key, posting_key, highlight: the shared words of all pairs that share a word."""
    return match_corpus(docs, postings, doc_key=doc_key, posting_key=posting_key, text=text).drop("k")


def best_postings(matches: DataFrame, *, doc_key: str = "doc_id", posting_key: str = "item_id", n: int = 3) -> DataFrame:
    """The n postings with most shared words for each document; of equal ones, the lower key."""
    best = W.partitionBy(doc_key).orderBy(F.desc("k"), posting_key)
    ranked = matches.withColumn("rank", F.row_number().over(best).cast("long"))
    return ranked.where(F.col("rank") <= n).select(doc_key, posting_key, "k", "rank")
