"""Helpers that write the SQL twins of text operators.

The second engine has ASCII ``\\b`` and no look-around.  Where the contract means
Unicode words, every separator is doubled first, so that each match can take one
separator on either side; the doubling is undone in the result.
"""

from __future__ import annotations

from .. import lexicon as lx

SEP = r"[^\p{L}\p{N}_]"
CTRL = lx.CONTROL_CHARS
SPACES = lx.SPACES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def doubled(expr: str) -> str:
    return f"regexp_replace({expr}, '({SEP})', '\\1\\1', 'g')"


def find_unicode(expr: str, body: str, flags: str = "", end: bool = True, group: int = 1) -> str:
    """All matches of ``body`` between Unicode word boundaries; separators in it are doubled."""
    tail = f"(?:{SEP}|$)" if end else ""
    hits = f"regexp_extract_all({doubled(expr)}, {q(f'(?:^|{SEP})({body}){tail}')}, {group}, {q(flags or 'c')})"
    return f"list_transform({hits}, lambda m: regexp_replace(m, '({SEP}){SEP}', '\\1', 'g'))"


def first_unicode(expr: str, body: str, flags: str = "", end: bool = True) -> str:
    return f"list_extract({find_unicode(expr, body, flags, end)}, 1)"


def distinct_in_order(expr: str, lower: bool = False) -> str:
    f = "lower" if lower else ""
    inner = f"list_transform({expr}, lambda y: lower(y))" if lower else expr
    return f"list_filter({expr}, lambda x, i: list_position({inner}, {f}(x)) = i)"


def spaces(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace({expr}, {q(CTRL)}, ' ', 'g'), {q(SPACES)}, ' ', 'g'))"


def half_up(expr: str, digits: int) -> str:
    scale = f"{10**digits}::double"
    return f"(floor(({expr}) * {scale} + 0.5::double) / {scale})"


def joined(expr: str) -> str:
    return f"array_to_string({expr}, '|')"


# ---- canonical claim text, step by step (patterns with ASCII \b)
NUMBER = r"\b\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?\b|\b\d+\.\d+\b|\b\d+\b"
PERCENT = r"\b\d+(?:\.\d+)?\s?%|\b\d+(?:\.\d+)?\s?percent\b|\b\d+(?:\.\d+)?\s?percentage\s?points\b"
CURRENCY = (
    r"[$€£¥₹]\s?\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?"
    r"|\b(?:USD|EUR|GBP|INR|JPY|CNY)\s?\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?"
)
UNIT = (
    r"\b\d+(?:\.\d+)?\s?(?:km|cm|mm|m|mi|ft|in|kg|g|lb|lbs|mg|°c|°f|degrees?|mph|kmh|hours?|minutes?"
    r"|seconds?|days?|weeks?|months?|years?)\b"
)
DATE = (
    r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b|\b\d{4}[/\-]\d{1,2}[/\-]\d{1,2}\b"
    r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b"
)
ENTITY = (
    r"\b[A-Z][A-Z0-9]{2,}\b|\b(?:NASA|WHO|UN|EU|US|UK|ESA|OpenAI|Google|Apple|Microsoft|COVID-19"
    r"|COVID|India|China|Russia|America)\b"
)


def negation(expr: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({expr}), '\\s+'), "
        f"lambda w: regexp_replace(w, '[^A-Za-z0-9_]', '', 'g') in {in_list(lx.NEGATION_WORDS)})"
    )


def _decorative(expr: str) -> str:
    for run in lx.DECORATIVE_RUNS:
        expr = f"regexp_replace({expr}, {q(run)}, '', 'g')"
    return expr


def normalized_ctes(source: str, col: str = "claim", out: str = "norm", p: str = "") -> str:
    """CTEs from ``source`` to ``out`` with clean text, stripped text and ``normalized``."""
    run = r"\b[A-Z](?:\s[A-Z])+\b"
    return f"""
{p}n1 as (select *, {spaces(f"substring({col}, 1, {lx.MAX_NORMALIZE_CHARS})")} as s1 from {source}),
{p}n2 as (select *, regexp_replace(s1, {q(lx.EMOJI)}, ' ', 'g') as s2 from {p}n1),
{p}n3 as (select *, regexp_extract(s2, '{run}') as caps from {p}n2),
{p}n4 as (select *, {spaces(f'''case when length(replace(caps, ' ', '')) between 2 and 5
    then replace(s2, caps, replace(caps, ' ', '')) else s2 end''')} as s4 from {p}n3),
{p}n5 as (select *, {spaces(f"regexp_replace({_decorative('s4')}, {q(lx.NOT_CANONICAL)}, ' ', 'g')")} as clean from {p}n4),
{p}n6 as (select *, {spaces(f'''regexp_replace(regexp_replace(regexp_replace(clean, '(?i)https?://\\S+|www\\.\\S+', ' ', 'g'),
    '#([A-Za-z0-9_]+)', ' ', 'g'), '@([A-Za-z0-9_]+)', ' ', 'g')''')} as stripped from {p}n5),
{out} as (select *, trim(regexp_replace(lower(stripped), '[.!?]+$', '')) as normalized from {p}n6)"""


METADATA = {
    "hashtags": "regexp_extract_all(clean, '#([A-Za-z0-9_]+)', 1)",
    "mentions": "regexp_extract_all(clean, '@([A-Za-z0-9_]+)', 1)",
    "urls": "regexp_extract_all(clean, '(?i)https?://\\S+|www\\.\\S+')",
    "numbers": f"regexp_extract_all(clean, {q(NUMBER)})",
    "dates": f"regexp_extract_all(clean, {q('(?i)' + DATE)})",
    "percentages": f"regexp_extract_all(clean, {q('(?i)' + PERCENT)})",
    "units": f"regexp_extract_all(clean, {q('(?i)' + UNIT)})",
    "currency": f"regexp_extract_all(clean, {q('(?i)' + CURRENCY)})",
    "entities": f"regexp_extract_all(clean, {q(ENTITY)})",
    "negation": negation("clean"),
}


def metadata(name: str, col: str = "clean") -> str:
    return METADATA[name].replace("clean", col)
