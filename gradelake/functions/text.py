"""Cleaning of model output text: fences, JSON repair, labels, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.coords import _c, let

# Patterns of fences, page headers and question labels (English and Hindi).
FENCE = "```"
TRAILING_COMMA_RE = r",\s*([}\]])"
PAGE_HEADER_RE = r"(?im)^===\s*PAGE\s+([0-9]+)\s*===\s*$"
QUESTION_NO_RE = (
    r"(?imU)(?:\b(?:que(?:stion)?|q)\s*[:.\-]?\s*([0-9]{1,3})\b"
    r"|\bप्रश्न\s*[:.\-]?\s*([0-9]{1,3})\b"
    r"|^\s*\(([0-9]{1,3})\)\s*[:.\-])"
)
EXPECTED_RES = (
    r"(?iU)\bq(?:uestion)?\s*[:.\-]?\s*([0-9]{1,3})\b",
    r"(?iU)(?:^|\n)\s*\(?([0-9]{1,3})\)?\s*[.)\-:]\s+",
    r"(?iU)(?:प्रश्न|उ\.?\s*प्र\.?)\s*[:.\-]?\s*([0-9]{1,3})\b",
)


def strip_fence(text) -> Column:
    """Inner text of the first fenced block, or the trimmed text itself."""
    t = trim_ws(_c(text))

    def inner(parts: Column) -> Column:
        # before, inside and after the fence
        body = F.element_at(parts, 2)
        plain = F.when(body.startswith("json"), F.substr(body, F.lit(5))).otherwise(body)
        return F.when(F.size(parts) >= 3, trim_ws(plain)).otherwise(t)

    return F.when(F.contains(t, F.lit(FENCE)), let(F.split(t, FENCE, 3), inner)).otherwise(t)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def repair_json(text, fix_quotes: bool = True) -> Column:
    """Drop trailing commas, close an odd quote, then close braces and brackets."""
    t = F.regexp_replace(strip_fence(text), TRAILING_COMMA_RE, "$1")
    if fix_quotes:
        bare = F.regexp_replace(t, r"\\.", "")
        t = F.when(_count(bare, '"') % 2 != 0, F.concat(t, F.lit('"'))).otherwise(t)
    braces = F.greatest(_count(t, "{") - _count(t, "}"), F.lit(0))
    brackets = F.greatest(_count(t, "[") - _count(t, "]"), F.lit(0))
    return F.concat(t, F.repeat(F.lit("}"), braces), F.repeat(F.lit("]"), brackets))


def _count(t: Column, ch: str) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))


def question_number(text) -> Column:
    """Question number in the leading label (1..500), else null."""
    t = _c(text)
    hit = F.regexp_substr(t, F.lit(QUESTION_NO_RE))
    digits = F.regexp_extract(hit, r"([0-9]{1,3})", 1).try_cast("int")
    return F.when(digits.between(1, 500), digits)


def expected_questions(text) -> Column:
    """Largest visible question number in 1..200, or null when none is seen."""
    body = page_body(text)
    found = F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(p), 1) for p in EXPECTED_RES]))
    numbers = F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda n: n.between(1, 200))
    return F.array_max(numbers)


def page_body(block) -> Column:
    """Text after the ``=== PAGE n ===`` line, trimmed; the whole text without one."""
    t = _c(block)
    header = F.regexp_substr(t, F.lit(PAGE_HEADER_RE))
    after = F.substr(t, F.instr(t, header) + F.length(header))
    return trim_ws(F.when(header.isNull(), t).otherwise(after))


def normalize_ws(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def page_from_block_id(block) -> Column:
    return F.regexp_extract(F.trim(_c(block)), r"(?i)^p([0-9]+)-", 1).try_cast("int")


def strip_p_tags(text) -> Column:
    """Remove paragraph tags, keeping paragraph breaks as blank lines."""
    t = F.regexp_replace(_c(text), r"(?i)</p\s*>", "\n\n")
    t = F.regexp_replace(t, r"(?i)<p\b[^>]*>", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return trim_ws(t)


def diagram_list(raw: Column) -> Column:
    """Trimmed non-blank strings of an array column."""
    cleaned = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: trim_ws(x))
    return F.filter(cleaned, lambda x: x.isNotNull() & (x != ""))


def leading_int(raw) -> Column:
    """Marks rule: a number is truncated, booleans and null are 0, else the first digits."""
    t = _c(raw)
    as_number = t.try_cast("double").try_cast("int")
    digits = F.regexp_extract(t, r"([0-9]+)", 1).try_cast("int")
    return F.when(F.lower(t).isin("true", "false"), 0).otherwise(F.coalesce(as_number, digits, F.lit(0)))


def json_string_field(text, *keys: str) -> Column:
    """First of the keys found as a quoted string, unescaped (for text that is not valid JSON)."""
    t = _c(text)
    out = [
        F.when(F.regexp_like(t, F.lit(_field_re(k))), _unescape(F.regexp_extract(t, _field_re(k), 1))) for k in keys
    ]
    return F.coalesce(*out, F.lit(""))


def _field_re(key: str) -> str:
    return rf'(?s)"{key}"\s*:\s*"((?:[^"\\]|\\.)*+)"'


def _unescape(c: Column) -> Column:
    """A string as JSON reads it, all escapes included; where JSON can't, the plain ones only."""
    plain = c
    for old, new in ((r"\n", "\n"), (r"\t", "\t"), (r"\"", '"')):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\n", r"\\\\n"), "\r", r"\\\\r"), "\t", r"\\\\t")
    read = F.from_json(F.concat(F.lit('{"v":"'), bare, F.lit('"}')), "v string")["v"]
    return F.when(F.instr(c, "\\") == 0, c).otherwise(F.coalesce(read, plain))


def json_number_field(text, *keys: str) -> Column:
    t = _c(text)
    return F.coalesce(
        *[F.regexp_extract(t, rf'"{k}"\s*:\s*([-0-9.]+)', 1).try_cast("double") for k in keys]
    )


def open_string(text, key: str) -> Column:
    """The first string value of a key, which may lack its end; quotes and line feeds unescaped. Null if there is none."""
    t = _c(text)
    start = rf'(?s)"{key}"\s*:\s*"((?:[^"\\]|\\.)*+)'
    found = F.regexp_extract(t, start, 1)
    return F.when(F.regexp_like(t, F.lit(start)), F.replace(F.replace(found, F.lit('\\"'), F.lit('"')), F.lit(r"\n"), F.lit("\n")))


def number_re(key: str) -> str:
    return rf'"{key}"\s*:\s*([0-9]+(?:\.[0-9]+)?)'


def plain_number(text, key: str) -> Column:
    """The first unsigned number of a key, null if there is none."""
    return F.regexp_extract(_c(text), number_re(key), 1).try_cast("double")
