"""Field values of sessions: the last value of each slot, the row of slots, and what is made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import or_else, or_empty, unused

SLOTS = 10
FIELD_LENGTH = 20
# A template's variables, and what is shown before any input.
VARIABLES = ("${var1}", "${var2}", "${var3}", "${var4}", "${var5}")
VARIABLE = r"\$\{var([1-5])\}"
DEFAULT_MESSAGE = "-- empty by default --"
TEMPLATE = (
    "To the team,\nI am excited to apply for the ${var1} position. My proficiency in ${var2}, ${var3} and ${var4} "
    "lets me build efficient applications.\n\nI look forward to partnering with ${var5}.\n"
)


def last_field_values(events: DataFrame, *, by: tuple[str, ...] = ("session", "slot")) -> DataFrame:
    """by, value: the value written last, by (ts, event_id)."""
    return events.groupBy(*by).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def field_slots(values: DataFrame, *, session: str = "session", n: int = SLOTS) -> DataFrame:
    """session, slots: an array of n values, empty where nothing was written."""
    written = F.map_from_entries(F.collect_list(F.struct("slot", "value")))
    slots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: or_empty(F.try_element_at("written", i)))
    return values.groupBy(session).agg(written.alias("written")).select(session, slots.alias("slots"))


def labels(slots: Column) -> Column:
    """Each value, or ``Field n`` where it is empty."""
    return F.transform(slots, lambda v, i: or_else(v, F.concat(F.lit("Field "), (i + 1).cast("string"))))


def truncated(value: Column, n: int = FIELD_LENGTH) -> Column:
    return F.left(value, F.lit(n))


def with_fields(text: Column, slots: Column) -> Column:
    """The text, an empty line and all slots on lines of their own."""
    return F.concat(text, F.lit("\n\n"), F.array_join(slots, "\n"))


def parsed(template: Column) -> Column:
    """The template as parts: a text, and the number (from 1) of the variable that follows it, null after the last text."""
    texts = F.split(template, VARIABLE)
    numbers = F.transform(F.regexp_extract_all(template, F.lit(VARIABLE), F.lit(1)), lambda n: n.cast("int"))
    return F.zip_with(texts, numbers, lambda text, variable: F.struct(text.alias("text"), variable.alias("variable")))


def fill_parts(parts: Column, slots: Column) -> Column:
    """Parts with the slots for their variables, each put once: a value that looks like a variable stays as it is."""
    return F.array_join(
        F.transform(parts, lambda p: F.concat(p["text"], or_empty(F.get(slots, p["variable"] - 1)))), ""
    )


def fill(template: Column, slots: Column) -> Column:
    """The template with the first five slots for its variables."""
    return fill_parts(parsed(template), slots)


def fill_templates(
    sessions: DataFrame, templates: DataFrame, *, template_key: str = "template_id", text: str = "text", slots: str = "slots"
) -> DataFrame:
    """The sessions (template_key, slots) with ``letter``: their template filled; null where there is no such template.

    Each template is parsed once. Templates are joined by their key; a table of them that is small is sent to all tasks by
    Spark's own measure of it, a large one is dealt by key, where Spark splits the sessions of a popular template.
    """
    parts, of = unused("parts", sessions), unused("template_of", sessions)
    known = templates.select(F.col(template_key).alias(of), parsed(F.col(text)).alias(parts))
    found = sessions.join(known, F.col(template_key) == F.col(of), "left")
    return found.withColumn("letter", fill_parts(F.col(parts), F.col(slots))).drop(parts, of)


def position_skill_fields(slotted: DataFrame, *, session: str = "session", wanted: int = 6) -> DataFrame:
    """session, var1 to var<wanted>, status: ``missing_slot`` if more are wanted than there are inputs."""
    inputs = len(VARIABLES)
    columns = [
        (or_empty(F.get("slots", F.lit(i))) if i < inputs else F.lit("")).alias(f"var{i + 1}") for i in range(wanted)
    ]
    return slotted.select(session, *columns, F.lit("missing_slot" if wanted > inputs else "ok").alias("status"))
