"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from foliant.functions.text import NAMED, NO_CHARACTER, OLD_PAGE, REFERENCE, TRIM
from foliant.operators import compose, fields
from foliant.operators.markup import LINE_ENDS, SPAN, TAGS, UNSEEN
from foliant.operators.match import FALLBACK, SHOWN, TOP
from foliant.operators.pages import ATTRIBUTE, BLOCK, HEADING, META, NAME, PARAGRAPH, TITLE, VALUE
from foliant.operators.tokens import STOPWORDS
from foliant.plans.inputs import SQL
from foliant.sources.postings import UNABLE


def text(value: str) -> str:
    """A SQL literal, line breaks spelled out."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def given(**parts: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + " "


def inputs(*names: str) -> dict[str, str]:
    return {n: SQL[n] for n in names}


def _tokens(column: str) -> str:
    return rf"list_transform(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9#+\-]+'), lambda w: regexp_replace(w, '^[-#+]+|[-#+]+$', '', 'g'))"


def _content_words(column: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter({_tokens(column)}, lambda w: length(w) >= 2 AND w NOT IN ({stop}))"


def _numbered(table: str, key: str, words: str, extra: str = "") -> str:
    return f"SELECT {key}, {extra} unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT {key}, {extra} {words} AS ws FROM {table})"


def _counted(table: str, key: str) -> str:
    return f"SELECT {key}, word, count(*) AS n, min(pos) AS first_pos FROM ({_numbered(table, key, _content_words('text'))}) GROUP BY 1, 2"


def _top(table: str, key: str, n: int) -> str:
    return f"""SELECT {key}, rank, word FROM (SELECT {key}, word, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first_pos)
        AS rank FROM ({_counted(table, key)})) WHERE rank <= {n}"""


TOPS = {"dt": _top("documents", "doc_id", TOP), "bt": _top("benchmark", "item_id", TOP)}
SHARED = "SELECT dt.doc_id, bt.item_id, bt.rank, bt.word, row_number() OVER (PARTITION BY dt.doc_id, bt.item_id ORDER BY bt.rank) AS rn FROM dt JOIN bt USING (word)"
MATCHES = f"SELECT doc_id, item_id, count(*) AS k, string_agg(word, ', ' ORDER BY rn) FILTER (WHERE rn <= {SHOWN}) AS highlight FROM shared GROUP BY 1, 2"
FIRST_SIX = f"SELECT doc_id, string_agg(word, ', ' ORDER BY rank) AS words FROM dt WHERE rank <= {FALLBACK} GROUP BY 1"
HIGHLIGHTS = """SELECT p.doc_id, p.item_id, p.resume, p.posting, coalesce(m.highlight, f.words, '') AS highlight
    FROM pairs p LEFT JOIN matches m USING (doc_id, item_id) LEFT JOIN first_six f USING (doc_id)"""
PAIRED = given(**inputs("pairs"), **TOPS, shared=SHARED, matches=MATCHES, first_six=FIRST_SIX, highlights=HIGHLIGHTS)


def trim(x: str) -> str:
    return f"regexp_replace({x}, '{TRIM}', '', 'g')"


def _sql_list(values) -> str:
    return "[" + ", ".join("chr(0)" if v == "\0" else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _code(x: str) -> str:
    """The character of a number, as text of SQL."""
    return f"""CASE WHEN {x} BETWEEN 128 AND 159 THEN substr('{OLD_PAGE}', CAST({x} - 127 AS INT), 1)
        WHEN {x} BETWEEN 1 AND 1114111 AND {x} NOT BETWEEN 55296 AND 57343 THEN chr(CAST({x} AS INT)) ELSE '{NO_CHARACTER}' END"""


def let(value: str, name: str, body: str) -> str:
    """``body`` of a value under a name, computed once; unlike a subquery, it may stand in a lambda."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def unescape(x: str) -> str:
    def digits(start: int, prefix: str) -> str:
        short = f"ltrim(substr(n, {start}), '0')"
        return f"CASE WHEN length({short}) > 7 THEN 0 ELSE TRY_CAST('{prefix}' || {short} AS BIGINT) END"

    number = f"CASE WHEN lower(n[1:2]) = '#x' THEN {digits(3, '0x0')} ELSE {digits(2, '0')} END"
    named = f"{_sql_list(NAMED.values())}[list_position({_sql_list(NAMED)}, n)]"
    char = f"CASE WHEN n[1] = '#' THEN {let(number, 'c', _code('c'))} WHEN n <> '' THEN {named} END"
    part = let(f"regexp_extract(p, '{REFERENCE}', 1)", "n", f"coalesce({char} || substr(p, length(n) + 2), '&' || p)")
    return let(f"string_split({x}, '&')", "ps", f"ps[1] || array_to_string(list_transform(ps[2:], lambda p: {part}), '')")


def drop(x: str, pattern: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '', 'g')"


def first(x: str, pattern: str) -> str:
    return f"regexp_extract({x}, '{pattern}', 1)"


def or_else(x: str, y: str) -> str:
    return f"coalesce(nullif({x}, ''), {y})"


SEEN = drop("html", UNSEEN)


def plain(x: str) -> str:
    return unescape(drop(x, TAGS))


PAGE_TITLE = or_else(plain(first(SEEN, HEADING)), plain(first(SEEN, TITLE)))
FOUND_ATTRIBUTES = f"regexp_extract_all(tag, {text(ATTRIBUTE)})"
META_TAGS = f"""list_transform(string_split_regex({SEEN}, '{META}')[2:], lambda tag:
    {let(FOUND_ATTRIBUTES, 'found', "CASE WHEN list_position(found, '>') > 0 THEN found[1:list_position(found, '>') - 1] ELSE found END")})"""


def _attribute(attributes: str, name: str) -> str:
    return f"regexp_extract(list_filter({attributes}, lambda a: lower(regexp_extract(a, '{NAME}')) = '{name}')[1], {text(VALUE)}, 1)"


def _content(key: str, value: str) -> str:
    chosen = f"list_filter(tags, lambda t: {_attribute('t', key)} = '{value}')[1]"
    return f"coalesce({unescape(_attribute(chosen, 'content'))}, '')"


DESCRIPTION = let(META_TAGS, "tags", or_else(_content("name", "description"), _content("property", "og:description")))
PARAGRAPHS = f"""list_filter(list_transform(string_split_regex({SEEN}, '{PARAGRAPH}')[2:],
    lambda p: {trim(plain(drop('p', BLOCK)))}), lambda t: t <> '')"""
JOB_TEXT = f"array_to_string(list_concat([coalesce({PAGE_TITLE}, ''), coalesce({DESCRIPTION}, '')], ({PARAGRAPHS})[1:80]), chr(10) || chr(10))"


def paragraphs(n: int) -> str:
    return f"""SELECT page_id, CAST(unnest(generate_series(1, len(ps))) AS BIGINT) AS n, unnest(ps) AS paragraph
        FROM (SELECT page_id, ({PARAGRAPHS})[1:{n}] AS ps FROM pages)"""


def title(x: str) -> str:
    run = first(x, r"\b([A-Z][a-zA-Z0-9 &\-]{2,50})\b")
    return trim(or_else(f"split_part({x}, chr(10), 1)", or_else(run, text(compose.NO_TITLE))))


def name(x: str) -> str:
    return first(x, r"(?m)^(?:name[:\-\s]*)?([A-Z][a-z]+\s[A-Z][a-z]+)$")


def observed(x: str) -> str:
    return or_else(f"split_part({x}, chr(10), 1)", text(compose.NO_ACHIEVEMENT))


def filled(template: str, **values: str) -> str:
    return " || ".join(values[t] if field else text(t) for field, t in compose.parts_of(template))


LETTER = filled(
    compose.LETTER,
    title=title("posting"),
    highlight="highlight",
    achievement=observed("resume"),
    name=or_else(name("resume"), text(compose.NO_NAME)),
)
PROMPT = filled(compose.PROMPT, posting="posting", resume="resume")
REQUEST = f"""CAST(json_object('model', '{compose.MODEL}', 'messages', json_array(json_object('role', 'user', 'content', {PROMPT})),
    'max_tokens', {compose.MAX_TOKENS}, 'temperature', {compose.TEMPERATURE}) AS VARCHAR)"""
REPLY = or_else(
    "json_extract_string(reply, '$.choices[0].message.content')",
    or_else("json_extract_string(reply, '$.choices[0].text')", "reply"),
)

VALUES = "SELECT session, slot, arg_max(value, (ts, event_id)) AS value FROM field_events GROUP BY 1, 2"
SLOTS = f"""SELECT s.session, list(coalesce(v.value, '') ORDER BY i) AS slots FROM (SELECT DISTINCT session FROM vals) s
    CROSS JOIN range({fields.SLOTS}) r(i) LEFT JOIN vals v ON v.session = s.session AND v.slot = r.i GROUP BY 1"""
SLOTTED = given(**inputs("field_events"), vals=VALUES, slotted=SLOTS)


def filled_once(template: str, slots: str = "slots") -> str:
    """Variables become signs that no value has before any of them becomes a value."""
    for number, variable in enumerate(fields.VARIABLES, 1):
        template = f"replace({template}, {text(variable)}, chr(1) || '{number}' || chr(2))"
    for number in range(1, len(fields.VARIABLES) + 1):
        template = f"replace({template}, chr(1) || '{number}' || chr(2), {slots}[{number}])"
    return template


FILLED = filled_once(text(fields.TEMPLATE))
LOOPED = "SELECT session, list_transform(slots, lambda v, i: CASE WHEN i % 2 = 1 THEN '${var' || CAST(i + 1 AS VARCHAR) || '}' ELSE v END) AS slots FROM slotted"


def marked(docs: str, wrapped: bool = False, drops: str = "drops") -> str:
    """CTEs whose last, ``marked``, has doc_id and text after the drops."""
    value = "'}}' || value || '{{'"
    if wrapped:
        value = f"{text(SPAN[0])} || {value} || {text(SPAN[1])}"
    return f"""WITH RECURSIVE drops AS ({SQL[drops]}), docs AS ({docs}),
    folded AS (SELECT doc_id, 0 AS k, text FROM docs UNION ALL
        SELECT f.doc_id, f.k + 1, left(f.text, least(d."offset", length(f.text))) || {value}
            || substr(f.text, least(d."offset", length(f.text)) + 1)
        FROM folded f JOIN drops d ON d.doc_id = f.doc_id AND d.seq = f.k + 1),
    marked AS (SELECT doc_id, arg_max(text, k) AS text FROM folded GROUP BY 1) """


MARKED = marked("SELECT doc_id, text FROM documents")
TO_MARKUP = "replace(replace({x}, chr(13) || chr(10), chr(10)), chr(10), '<br>')"
STRIPPED = "replace(replace({x}, '}}}}', ''), '{{{{', '')"


def moved(moves: str = "moves") -> str:
    """Sessions with their slots after the moves; those that aren't from and to places of slots do nothing."""
    return f"""WITH RECURSIVE field_events AS ({SQL['field_events']}), vals AS ({VALUES}), slotted AS ({SLOTS}), moves AS ({SQL[moves]}),
    folded AS (SELECT session, 0 AS k, slots FROM slotted UNION ALL
        SELECT f.session, f.k + 1, CASE WHEN m."from" BETWEEN 0 AND len(f.slots) - 1 AND m."to" BETWEEN 0 AND len(f.slots) - 1
            THEN list_concat(list_concat(rest[1:m."to"], [moved]), rest[m."to" + 1:]) ELSE f.slots END FROM (
            SELECT f.session, f.k, f.slots, list_concat(f.slots[1:m."from"], f.slots[m."from" + 2:]) AS rest, f.slots[m."from" + 1] AS moved
            FROM folded f JOIN moves m ON m.session = f.session AND m.seq = f.k + 1) f
        JOIN moves m ON m.session = f.session AND m.seq = f.k + 1)
    SELECT session, array_to_string(arg_max(slots, k), '|') AS slots FROM folded GROUP BY 1"""


MOVED = moved()
ROUTE = "CASE WHEN lower(name) LIKE '%.txt' OR lower(name) LIKE '%.md' THEN 'text' WHEN lower(name) LIKE '%.pdf' THEN 'paged' ELSE 'fallback' END"
POSTED = "FROM postings LEFT JOIN (SELECT url, html FROM pages) p USING (url)"
FAILED = text(UNABLE.replace("{error}", "no page"))

ORACLE_SQL = {
    "tokenize": _numbered("documents", "doc_id", _tokens("text")),
    "content_words": f"SELECT doc_id, unnest({_content_words('text')}) AS word FROM documents",
    "word_frequencies": _counted("documents", "doc_id"),
    "corpus_frequencies": f"SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_numbered('documents', 'doc_id', _content_words('text'), 'lang,')}) GROUP BY 1, 2",
    "top_keywords": _top("documents", "doc_id", 10),
    "keyword_overlap": given(**TOPS, shared=SHARED, matches=MATCHES) + "SELECT doc_id, item_id, highlight FROM matches",
    "match_corpus": given(**TOPS, shared=SHARED) + MATCHES,
    "best_postings": given(**TOPS, shared=SHARED, matches=MATCHES)
    + "SELECT doc_id, item_id, k, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, item_id) AS rank FROM matches) WHERE rank <= 3",
    "top_postings": given(**TOPS, shared=SHARED, matches=MATCHES)
    + "SELECT doc_id, item_id, k, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, item_id) AS rank FROM matches) WHERE rank <= 3",
    "highlight": PAIRED + "SELECT doc_id, highlight FROM highlights",
    "first_k_highlight": given(**inputs("pairs"), **TOPS, shared=SHARED)
    + f"""SELECT p.doc_id, coalesce(s.shared, '') AS shared, coalesce(f.fallback, '') AS fallback FROM pairs p
        LEFT JOIN (SELECT doc_id, item_id, string_agg(word, ' ' ORDER BY rn) AS shared FROM shared WHERE rn <= 3 GROUP BY 1, 2) s USING (doc_id, item_id)
        LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY rank) AS fallback FROM dt WHERE rank <= {FALLBACK} GROUP BY 1) f USING (doc_id)""",
    "load_pages": "SELECT page_id, url, length(html) AS n_chars FROM pages",
    "page_title": f"SELECT page_id, {PAGE_TITLE} AS title FROM pages",
    "page_description": f"SELECT page_id, {DESCRIPTION} AS description FROM pages",
    "described_page_text": given(**inputs("described_pages"))
    + f"SELECT page_id, {DESCRIPTION} AS description, {JOB_TEXT} AS text FROM described_pages",
    "page_paragraphs": paragraphs(80),
    "first_paragraphs": paragraphs(5),
    "nonempty_paragraphs": f"SELECT page_id, len({PARAGRAPHS}) AS n FROM pages",
    "page_job_text": f"SELECT page_id, {JOB_TEXT} AS text FROM pages",
    "markup_to_text": f"SELECT page_id, {trim(plain(f'regexp_replace({SEEN}, {text(LINE_ENDS)}, chr(10), {text("g")})'))} AS text FROM pages",
    "posting_fetch_fallback": given(**inputs("postings"))
    + f"SELECT page_id, CASE WHEN html IS NULL THEN {FAILED} ELSE {JOB_TEXT} END AS text, CASE WHEN html IS NULL THEN 'error' ELSE 'ok' END AS status {POSTED}",
    "missing_posting": given(**inputs("postings")) + "SELECT page_id, url FROM postings WHERE url NOT IN (SELECT url FROM pages)",
    "load_job_postings": "SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN url END AS title, CASE WHEN page_id % 5 = 4 THEN 'error' ELSE 'ok' END AS status FROM pages",
    "flatten_posting": """SELECT page_id, url AS title, CAST(1704161045 AS BIGINT) AS posted_at, split_part(url, '/', 3) AS organisation,
        'City ' || CAST(page_id % 7 AS VARCHAR) AS city, 'Region' AS region, CAST(page_id AS VARCHAR) AS postal, 'XX' AS country
        FROM pages WHERE page_id % 5 <> 4""",
    "posting_description_text": f"SELECT page_id, array_to_string(({PARAGRAPHS})[1:80], chr(10) || chr(10)) AS text FROM pages WHERE page_id % 5 <> 4",
    "job_title": f"SELECT doc_id, {title('text')} AS title FROM documents",
    "candidate_name": given(**inputs("headed_documents")) + f"SELECT doc_id, {name('text')} AS name FROM headed_documents",
    "achievement_line": given(**inputs("headed_documents"))
    + f"""SELECT doc_id, {observed('text')} AS observed, coalesce(nullif(list_filter(string_split(text, chr(10)),
        lambda l: regexp_matches(l, '{compose.ACHIEVEMENT}'))[1], ''), {text(compose.NO_ACHIEVEMENT)}) AS intended FROM headed_documents""",
    "render_letter": PAIRED + f"SELECT doc_id, item_id, CASE WHEN resume = '' AND posting = '' THEN '' ELSE {LETTER} END AS letter FROM highlights",
    "generation_guard": given(**inputs("pairs"))
    + "SELECT doc_id, doc_id % 3 = 0 OR (resume = '' AND posting = '') AS empty FROM pairs",
    "build_prompts": given(**inputs("pairs")) + f"SELECT doc_id, {REQUEST} AS request FROM pairs",
    "build_request_json": given(**inputs("pairs"))
    + f"SELECT doc_id, '{compose.MODEL}' AS model, {compose.MAX_TOKENS} AS max_tokens, length({PROMPT}) AS n_chars FROM pairs",
    "key_presence_guard": given(**inputs("pairs")) + f"SELECT doc_id, length({REQUEST}) AS n_chars FROM pairs WHERE doc_id % 2 <> 0",
    "build_requests": given(**inputs("pairs"))
    + f"""SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN length({REQUEST}) END AS n_chars, CASE WHEN doc_id % 2 = 0 THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN doc_id % 2 = 0 THEN '{compose.NO_KEY}' END AS error FROM pairs""",
    "json_fallback": given(**inputs("replies")) + f"SELECT event_id, {REPLY} AS text FROM replies",
    "reply_error": given(**inputs("replies"))
    + f"""SELECT event_id, CASE WHEN status BETWEEN 200 AND 299 THEN {REPLY}
        ELSE '{compose.REPLY_ERROR}' || CAST(status AS VARCHAR) || ' ' || reason || ' -- ' || reply END AS text FROM replies""",
    "last_field_values": given(**inputs("field_events")) + VALUES,
    "field_slots": SLOTTED + "SELECT session, array_to_string(slots, '|') AS slots FROM slotted",
    "field_labels": SLOTTED
    + "SELECT session, array_to_string(list_transform(slots, lambda v, i: coalesce(nullif(v, ''), 'Field ' || CAST(i AS VARCHAR))), '|') AS labels FROM slotted",
    "truncate_fields": f"SELECT event_id, left(event_type || props || event_type, {fields.FIELD_LENGTH}) AS value FROM events",
    "append_fields": SLOTTED + "SELECT session, 'text' || chr(10) || chr(10) || array_to_string(slots, chr(10)) AS text FROM slotted",
    "position_skill_fields": SLOTTED
    + "SELECT session, " + ", ".join(f"slots[{i}] AS var{i}" for i in range(1, 6)) + ", '' AS var6, 'missing_slot' AS status FROM slotted",
    "fill_template": SLOTTED + f"SELECT session, {FILLED} AS text FROM slotted",
    "fill_template_once": SLOTTED + f"SELECT session, {FILLED} AS text FROM ({LOOPED})",
    "fill_templates": given(**inputs("field_events", "templates"), vals=VALUES, slotted=SLOTS, looped=LOOPED)
    + f"""SELECT session, session % 50 AS template_id, {filled_once('text')} AS letter FROM looped LEFT JOIN templates ON template_id = session % 50""",
    "default_message": SLOTTED
    + f"SELECT d.doc_id AS session, coalesce({FILLED}, {text(fields.DEFAULT_MESSAGE)}) AS text FROM documents d LEFT JOIN slotted s ON s.session = d.doc_id",
    "insert_markers": MARKED + "SELECT doc_id, text FROM marked",
    "highlight_inserted": marked("SELECT doc_id, text FROM documents", wrapped=True) + "SELECT doc_id, text FROM marked",
    "out_of_range_guard": marked("SELECT doc_id, text FROM documents", drops="far_drops") + "SELECT doc_id, text FROM marked",
    "insert_markers_hot_log": marked("SELECT doc_id, text FROM documents", drops="hot_drops")
    + "SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM marked",
    "clean_export": MARKED
    + f"SELECT doc_id, {STRIPPED.format(x='regexp_replace(replace(' + TO_MARKUP.format(x='text') + ', ' + text('<br>') + ', chr(10)), chr(10) || ' + text('{2,}') + ', chr(10), ' + text('g') + ')')} AS text FROM marked",
    "strip_markers": MARKED + f"SELECT doc_id, {STRIPPED.format(x='text')} AS text FROM marked",
    "text_to_markup": given(**inputs("crlf_documents")) + f"SELECT doc_id, {TO_MARKUP.format(x='text')} AS markup FROM crlf_documents",
    "collapse_breaks": given(**inputs("crlf_documents"))
    + rf"""SELECT doc_id, regexp_replace({TO_MARKUP.format(x="replace(text, '.', chr(10) || ' ' || chr(10))")}, '(<br>\s*){{2,}}', '<br>', 'g') AS markup FROM crlf_documents""",
    "noop_move_filter": given(**inputs("moves")) + 'SELECT session, CAST(seq AS INT) AS seq, "from", "to" FROM moves WHERE "from" <> "to"',
    "move_fields": MOVED,
    "move_fields_out_of_range": moved("far_moves"),
    "route_files": given(**inputs("named_files")) + f"SELECT doc_id, name, {ROUTE} AS route FROM named_files",
    "first_file": given(**inputs("named_files")) + "SELECT session, arg_min(name, pos) AS name FROM named_files GROUP BY 1",
    "assemble_pages": "SELECT conv_id AS doc_id, string_agg(text || chr(10) || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY 1",
    "approved_version": "SELECT conv_id AS doc_id, max(turn) AS version, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1",
    "session_documents": """WITH versions AS (SELECT conv_id AS doc_id, turn AS saved_at, text FROM conversations
            WHERE role = 'assistant' AND turn % 4 <> 1)
        SELECT a.conv_id AS doc_id, a.turn AS ts, a.role, v.saved_at, v.text FROM conversations a
        ASOF LEFT JOIN versions v ON a.conv_id = v.doc_id AND a.turn >= v.saved_at""",
    "decode_files": r"""SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN 'application/pdf' WHEN 5 THEN 'application/octet-stream' ELSE 'text/plain' END AS mime,
        CASE doc_id % 6 WHEN 2 THEN 'UTF-16' WHEN 3 THEN 'windows-1252' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'UTF-8' END AS charset,
        CASE doc_id % 6 WHEN 4 THEN 'paged' WHEN 5 THEN 'rejected' ELSE 'text' END AS route,
        CASE doc_id % 6 WHEN 5 THEN 'error' ELSE 'ok' END AS status, CASE doc_id % 6 WHEN 5 THEN 'no text' END AS error,
        CASE doc_id % 6 WHEN 3 THEN sha256('é' || regexp_replace(coalesce(text, ''), '[^\x{1}-\x{FF}]', '?', 'g'))
            WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE sha256(coalesce(text, '')) END AS text_sha256 FROM documents""".replace("\\\\", "\\"),
    "load_files": """SELECT 'text' AS route, 'UTF-8' AS charset, 'ok' AS status, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS n_bytes,
        CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars FROM documents""",
    "save_letters": PAIRED
    + f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'final' ELSE 'with_markers' END AS kind,
        sha256(CASE WHEN resume = '' AND posting = '' THEN '' ELSE {LETTER} END) AS text_sha256 FROM highlights""",
    "load_text": "SELECT doc_id % 8 AS part, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY 1",
    "write_letters": PAIRED
    + f"""SELECT kind, count(*) AS n, CAST(sum(length(letter) + 1) AS BIGINT) AS n_chars, CAST(sum(length(letter) + 1) AS BIGINT) AS n_chars_of_files
        FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'final.txt' ELSE 'with_markers.txt' END AS kind,
        CASE WHEN resume = '' AND posting = '' THEN '' ELSE {LETTER} END AS letter FROM highlights) GROUP BY 1""",
    "ingest_errors": given(**inputs("named_files", "postings"))
    + f"""SELECT source, status, count(*) AS n FROM (
        SELECT 'files' AS source, CASE WHEN {ROUTE} = 'fallback' THEN 'error' ELSE 'ok' END AS status FROM named_files UNION ALL
        SELECT 'pages', CASE WHEN html IS NULL THEN 'error' ELSE 'ok' END {POSTED} UNION ALL
        SELECT 'postings', CASE WHEN page_id % 5 = 4 THEN 'error' ELSE 'ok' END FROM pages) GROUP BY 1, 2""",
    "field_events_stream": given(**inputs("field_events")) + "SELECT slot, count(*) AS n FROM field_events GROUP BY 1",
    "stream_field_state": given(**inputs("field_events")) + VALUES,
    "stream_letter_preview": SLOTTED + f"SELECT session, {FILLED} AS letter FROM slotted",
    "stream_insert_markers": MARKED + "SELECT doc_id, text FROM marked WHERE doc_id IN (SELECT doc_id FROM drops)",
    "stream_insert_markers_compacted": MARKED + "SELECT doc_id, text FROM marked WHERE doc_id IN (SELECT doc_id FROM drops)",
    "stream_move_fields": MOVED,
    "stream_keyword_counts": f"SELECT word, count(*) AS n FROM ({_numbered('documents', 'doc_id', _content_words('text'))}) GROUP BY 1",
}
