"""Letters and requests from a posting and a résumé, and what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import BOUNDARY, or_else, or_empty, trimmed, unused
from foliant.operators.match import highlight_text, with_keywords

# The parts of a letter and of a request.
NO_TITLE = "the role"
NO_NAME = "[Your Name]"
NO_ACHIEVEMENT = "Relevant project experience and measurable outcomes."
ACHIEVEMENT = r"(?i)\b(project|led|developed|built|created|improved)\b"
LETTER = (
    "Dear Hiring Manager,\n\nI am writing to express my interest in {title}. With proven experience in {highlight} and "
    "a track record of delivering results, I am confident I would be a strong fit for your team.\n\n"
    "In my previous roles I have demonstrated the skills and responsibilities you seek — including {highlight}. "
    "My resume (attached) outlines accomplishments such as: \n- {achievement}\n\nI am excited about the opportunity to "
    "bring my experience to this position and to contribute to your team’s goals.\n\n"
    "Thank you for considering my application. I look forward to the possibility of discussing how my background "
    "aligns with your needs.\n\nSincerely,\n{name}\n"
)
PROMPT = (
    "You are a professional resume and cover letter writer. Generate a concise, persuasive cover letter (approx. 3 "
    "short paragraphs) tailored to the following job posting and resume. Job posting:\n\n{posting}\n\nResume:\n\n"
    "{resume}\n\nProduce only the cover letter."
)
MODEL = "gpt-4o-mini"
MAX_TOKENS = 600
TEMPERATURE = 0.2
REPLY_ERROR = "OpenAI error: "


def parts_of(template: str) -> list[tuple[bool, str]]:
    """(is a field, text or name of the field) of a template with {fields}, in order."""
    out = []
    for i, piece in enumerate(template.split("{")):
        name, _, rest = piece.partition("}") if i else ("", "", piece)
        out += [(True, name)] * bool(i) + [(False, rest)] * bool(rest)
    return out


def filled(template: str, **fields: Column) -> Column:
    return F.concat(*[fields[text] if field else F.lit(text) for field, text in parts_of(template)])


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def title_of(posting: Column) -> Column:
    """The first line, or else the first capitalised run of 3 to 51 characters, or else ``the role``; then trimmed."""
    run = F.regexp_extract(posting, f"{BOUNDARY}([A-Z][a-zA-Z0-9 &\\-]{{2,50}}){BOUNDARY}", 1)
    return trimmed(or_else(first_line(posting), or_else(run, F.lit(NO_TITLE))))


def name_of(resume: Column) -> Column:
    """First and last name on a line of their own, which may begin with ``name:``; or else the empty text."""
    return F.regexp_extract(resume, r"(?m)^(?:name[:\-\s]*)?([A-Z][a-z]+\s[A-Z][a-z]+)$", 1)


def achievement_of(resume: Column, mode: str = "observed") -> Column:
    """``observed``: the first line. ``intended``: the first line with a word of achievement. Or a stock phrase."""
    if mode == "observed":
        return or_else(first_line(resume), F.lit(NO_ACHIEVEMENT))
    lines = F.filter(F.split(resume, "\n"), lambda line: line.rlike(ACHIEVEMENT))
    return or_else(F.get(lines, 0), F.lit(NO_ACHIEVEMENT))


def render_letter(
    pairs: DataFrame,
    *,
    resume: str = "resume",
    posting: str = "posting",
    resume_key: str | None = None,
    posting_key: str | None = None,
) -> DataFrame:
    """The pairs with ``letter``; empty if both texts are empty."""
    left, right = or_empty(F.col(resume)), or_empty(F.col(posting))
    # What a letter needs is taken from the texts first, so that no later step moves them unless they are kept.
    parts = {
        "title": title_of(right),
        "achievement": achievement_of(left),
        "name": or_else(name_of(left), F.lit(NO_NAME)),
        "empty": (left == "") & (right == ""),
    }
    names = {k: unused(f"letter_{k}", pairs) for k in (*parts, "highlight")}
    words = {k: unused(f"{k}_words", pairs) for k in ("resume", "posting")}
    found = pairs.withColumns({names[k]: v for k, v in parts.items()})
    found = with_keywords(
        found, resume=resume, posting=posting, resume_key=resume_key, posting_key=posting_key,
        resume_words=words["resume"], posting_words=words["posting"],
    )
    found = found.withColumn(names["highlight"], highlight_text(F.col(words["posting"]), F.col(words["resume"])))
    letter = filled(LETTER, **{k: F.col(names[k]) for k in ("title", "highlight", "achievement", "name")})
    found = found.withColumn("letter", F.when(F.col(names["empty"]), "").otherwise(letter))
    return found.drop(*words.values(), *names.values())


def build_prompts(pairs: DataFrame, *, resume: str = "resume", posting: str = "posting", key: str | None = None) -> DataFrame:
    """The pairs with ``request``, a JSON text. With ``key``, only rows whose key is not empty have one."""
    prompt = filled(PROMPT, posting=or_empty(F.col(posting)), resume=or_empty(F.col(resume)))
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    body = F.struct(
        F.lit(MODEL).alias("model"),
        F.array(message).alias("messages"),
        F.lit(MAX_TOKENS).alias("max_tokens"),
        F.lit(TEMPERATURE).alias("temperature"),
    )
    rows = pairs if key is None else pairs.where(or_empty(F.col(key)) != "")
    return rows.withColumn("request", F.to_json(body))


NO_KEY = "no credential"


def build_requests(pairs: DataFrame, *, key: str, resume: str = "resume", posting: str = "posting") -> DataFrame:
    """All pairs with ``request``, ``status`` and ``error``: those without a key have no request, and say why."""
    bad = or_empty(F.col(key)) == ""
    found = build_prompts(pairs, resume=resume, posting=posting)
    return found.withColumns(
        {"request": F.when(~bad, F.col("request")), "status": F.when(bad, "error").otherwise("ok"), "error": F.when(bad, NO_KEY)}
    )


def reply_text(reply: Column) -> Column:
    """The first of message content, text, and the whole reply that is not empty."""
    content = F.get_json_object(reply, "$.choices[0].message.content")
    return or_else(content, or_else(F.get_json_object(reply, "$.choices[0].text"), reply))


def reply_or_error(status: Column, reason: Column, body: Column, prefix: str = REPLY_ERROR) -> Column:
    failed = F.concat(F.lit(prefix), status.cast("string"), F.lit(" "), reason, F.lit(" -- "), body)
    return F.when(status.between(200, 299), reply_text(body)).otherwise(failed)
