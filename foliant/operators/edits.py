"""Sequences of edits: each is applied to the result of those before it.

Edits are composed before any text is touched. Insertions into a text of known length make a list of (place in that
text, what is inserted there); two such lists, one after the other, make one (``merged``, associative, in linear time).
Moves of slots make a permutation; permutations compose by indexing. So a log is cut anywhere: Spark sorts the edits of
all documents by range, so that a long log spans tasks and short ones share them; each task composes the runs of edits
that it holds; runs of one document in several tasks are composed as a tree. Each text is read and written once.

Where edits meet the end of a text matters to those after them, so a task must know how long a document is when its
first run begins. Only a log that began in an earlier task needs that, so at most one number for each task is collected.

Defined results: an edit without offset is skipped, one beyond the text goes to its end, a negative one to its start; a
null value is empty; a null text that is edited counts as empty; equal seq go by offset and text; edits of a key that no
document has are ignored; documents that repeat a key get the same edits each; a null key has none. A move that is null,
or from or to a place that isn't there, does nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from foliant.functions.lineage import cut
from foliant.functions.text import or_empty, unused
from foliant.operators.markup import marker

#: Edits that are composed one by one before runs are merged, and runs that are merged together.
RUN = 128
FAN = 8

Inserts = list[tuple[int, str]]


def composed(edits: Iterable[tuple[int, str]], length: int) -> Inserts:
    """(place, text) by place, of edits (offset, text) each on the result of those before; ``length``: of the text before."""
    found: Inserts = []
    now = length
    for offset, new in edits:
        left = max(0, min(offset, now))
        now += len(new)
        before = 0
        for i, (place, there) in enumerate(found):
            gap = place - before
            if left < gap:
                found.insert(i, (before + left, new))
                break
            left -= gap
            if left <= len(there):
                found[i] = (place, there[:left] + new + there[left:])
                break
            left -= len(there)
            before = place
        else:
            found.append((before + left, new))
    return found


def merged(first: Inserts, then: Inserts) -> Inserts:
    """``first`` and, on its result, ``then``, as one."""
    out: list[tuple[int, list[str]]] = []

    def add(place: int, text: str) -> None:
        if out and out[-1][0] == place:
            out[-1][1].append(text)
        elif text:
            out.append((place, [text]))

    i, shift = 0, 0
    for place, there in first:
        start, done = place + shift, 0
        while i < len(then) and then[i][0] <= start:
            add(then[i][0] - shift, then[i][1])
            i += 1
        while i < len(then) and then[i][0] < start + len(there):
            add(place, there[done : then[i][0] - start])
            add(place, then[i][1])
            done = then[i][0] - start
            i += 1
        add(place, there[done:])
        shift += len(there)
    for place, new in then[i:]:
        add(place - shift, new)
    return [(place, "".join(parts)) for place, parts in out]


class Composer:
    """A growing run of edits: composed by RUN, and merged like a binary counter, so that each is merged log(n) times."""

    def __init__(self, length: int):
        self.length = length
        self._held: list[tuple[int, str]] = []
        self._runs: list[tuple[int, Inserts]] = []

    def add(self, offset: int, text: str) -> None:
        self._held.append((offset, text))
        if len(self._held) >= RUN:
            self._close()

    def _close(self) -> None:
        run = composed(self._held, self.length)
        self.length += sum(len(text) for _, text in self._held)
        self._held, size = [], 1
        while self._runs and self._runs[-1][0] <= size:
            before_size, before = self._runs.pop()
            run, size = merged(before, run), size + before_size
        self._runs.append((size, run))

    def whole(self) -> Inserts:
        if self._held:
            self._close()
        out: Inserts = []
        for _, run in reversed(self._runs):
            out = merged(run, out) if out else run
        return out


def with_inserts(text: str, inserts: Iterable[tuple[int, str]]) -> str:
    parts, done = [], 0
    for place, new in inserts:
        parts += [text[done:place], new]
        done = place
    return "".join([*parts, text[done:]])


def in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows (key, n, ..) sorted by those columns over all tasks, with the number of the task (part), and kept."""
    dealt = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return cut(dealt.withColumn("part", F.spark_partition_id()))


def _parts(placed: DataFrame, added) -> DataFrame:
    """key, n, part, before (what ``added`` sums up to in earlier parts), parts: of the keys in several parts.

    A border between two tasks is in one key at most, so these are two rows for each task at most.
    """
    sums = placed.groupBy("key", "n", "part").agg(F.sum(added).alias("added"))
    earlier = W.partitionBy("key", "n").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    found = sums.select(
        "key", "n", "part", F.sum("added").over(earlier).alias("before"), F.count(F.lit(1)).over(W.partitionBy("key", "n")).alias("parts")
    )
    return found.where("parts > 1")


def _compose_parts(starts: dict[int, int]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, composer, part = None, None, None

        def row() -> pd.DataFrame:
            found = composer.whole()
            lists = [[place for place, _ in found]], [[text for _, text in found]]
            return pd.DataFrame({"key": [now[0]], "n": [now[1]], "part": [part], "places": lists[0], "texts": lists[1]})

        for batch in batches:
            for key, n, part, offset, text in batch.itertuples(index=False):
                if (key, n) != now:
                    if now is not None:
                        yield row()
                    # The first key of a task may have begun in earlier ones.
                    composer = Composer(n + (starts.get(part, 0) if now is None else 0))
                    now = key, n
                composer.add(offset, text)
        if now is not None:
            yield row()

    return run


def _merge_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    out: Inserts = []
    for places, texts in zip(rows["places"], rows["texts"]):
        out = merged(out, list(zip(map(int, places), texts)))
    first = rows.iloc[[0]][["key", "n", "part"]]
    return first.assign(places=[[place for place, _ in out]], texts=[[text for _, text in out]])


def compose_inserts(drops: DataFrame, lengths: DataFrame) -> DataFrame:
    """key, n, places, texts: what all drops of a key come to. ``drops``: key, seq, offset, text; ``lengths``: key, n."""
    lengths = cut(lengths.where("key is not null"))  # as ranges are found by a pass of their own
    rows = drops.where("offset is not null").join(lengths, "key")
    rows = rows.select("key", "n", "seq", F.col("offset").cast("long").alias("offset"), "text")
    placed = in_order(rows, "key", "n", "seq", "offset", "text")
    split = cut(_parts(placed, F.length("text")))
    starts, most = {}, 1
    for r in split.select("part", "before", "parts").collect():  # two for each task at most
        most = max(most, r["parts"])
        if r["before"] is not None:
            starts[r["part"]] = r["before"]
    schema = T.StructType(
        [
            placed.schema["key"],
            T.StructField("n", T.LongType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("places", T.ArrayType(T.LongType())),
            T.StructField("texts", T.ArrayType(T.StringType())),
        ]
    )
    runs = placed.select("key", "n", "part", "offset", "text").mapInPandas(_compose_parts(starts), schema)
    if most == 1:
        return runs.drop("part")
    runs = cut(runs)
    keys = F.broadcast(split.select("key", "n").distinct())  # one for each task at most
    several = runs.join(keys, ["key", "n"], "left_semi")
    while most > 1:
        place = F.row_number().over(W.partitionBy("key", "n").orderBy("part")) - 1
        several = several.withColumn("at", F.floor(place / FAN)).groupBy("key", "n", "at").applyInPandas(_merge_group, schema)
        most = -(-most // FAN)
    return runs.join(keys, ["key", "n"], "left_anti").unionByName(several).drop("part")


@F.pandas_udf(T.StringType())
def _with_inserts(texts: pd.Series, places: pd.Series, inserts: pd.Series) -> pd.Series:
    return pd.Series(
        [
            text if at is None else with_inserts(text or "", zip(at, new))
            for text, at, new in zip(texts, places, inserts)
        ],
        dtype=object,
    )


def insert_markers(
    docs: DataFrame, drops: DataFrame, *, key: str = "doc_id", text: str = "text", wrap: str = "none"
) -> DataFrame:
    """The documents with their drops (key, seq, offset, value) inserted in order of seq."""
    n = F.length(or_empty(F.col(text))).cast("long")
    lengths = docs.select(F.col(key).alias("key"), n.alias("n")).distinct()
    given = drops.select(F.col(key).alias("key"), "seq", "offset", marker(or_empty(F.col("value")), wrap).alias("text"))
    names = {c: unused(f"edit_{c}", docs) for c in ("key", "n", "places", "texts")}
    found = compose_inserts(given, lengths).withColumnsRenamed(names)
    same = (F.col(key) == F.col(names["key"])) & (n == F.col(names["n"]))
    new = _with_inserts(F.col(text), F.col(names["places"]), F.col(names["texts"]))
    return docs.join(found, same, "left").withColumn(text, new).drop(*names.values())


def permuted(order: list[int], moves: Iterable[tuple[int, int]]) -> list[int]:
    """``order`` after the moves (from, to); places are counted from 0."""
    for start, to in moves:
        order.insert(to, order.pop(start))
    return order


def _permute_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, order, part = None, [], None
    for batch in batches:
        for key, n, part, start, to in batch.itertuples(index=False):
            if (key, n) != now:
                if now is not None:
                    yield pd.DataFrame({"key": [now[0]], "n": [now[1]], "part": [part], "places": [order]})
                now, order = (key, n), list(range(n))
            permuted(order, [(start, to)])
    if now is not None:
        yield pd.DataFrame({"key": [now[0]], "n": [now[1]], "part": [part], "places": [order]})


def noop_move_filter(moves: DataFrame) -> DataFrame:
    return moves.where(F.col("from") != F.col("to"))


def compose_moves(moves: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, n, places: where the value of each slot comes from. ``moves``: key, seq, from, to; ``sizes``: key, n slots."""
    rows = noop_move_filter(moves).join(cut(sizes.where("key is not null")), "key")
    rows = rows.where("`from` between 0 and n - 1 and `to` between 0 and n - 1")
    placed = in_order(rows.select("key", "n", "seq", "from", "to"), "key", "n", "seq", "from", "to")
    schema = T.StructType(
        [placed.schema["key"], placed.schema["n"], T.StructField("part", T.IntegerType()), T.StructField("places", T.ArrayType(T.IntegerType()))]
    )
    runs = placed.select("key", "n", "part", "from", "to").mapInPandas(_permute_parts, schema)
    # A permutation for each task that a key is in: all of a key's together are as long as tasks are many.
    gathered = runs.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("part", "places"))).alias("runs"))
    as_it_is = F.sequence(F.lit(0), F.col("n") - 1)
    whole = F.aggregate("runs", as_it_is, lambda now, run: F.transform(run["places"], lambda i: F.get(now, i)))
    return gathered.select("key", "n", whole.alias("places"))


def move_fields(slotted: DataFrame, moves: DataFrame, *, session: str = "session") -> DataFrame:
    """session, slots after all moves (session, seq, from, to) in order of seq."""
    sizes = slotted.select(F.col(session).alias("key"), F.size("slots").alias("n")).distinct()
    given = moves.select(F.col(session).alias("key"), "seq", "from", "to")
    found = compose_moves(given, sizes).withColumnsRenamed({"key": "of", "n": "of_n"})
    slots = F.coalesce(F.transform("places", lambda i: F.get("slots", i)), "slots")
    same = (F.col(session) == F.col("of")) & (F.size("slots") == F.col("of_n"))
    return slotted.select(session, "slots").join(found, same, "left").select(session, slots.alias("slots"))
