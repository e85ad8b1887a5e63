"""Text, hash and JSON functions as column expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms and their ASCII counterparts.
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def strip(text: Column) -> Column:
    """Without white space at either end: blanks, tabs and line ends alike."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def terms(text: Column) -> Column:
    """Lower-case runs of letters a-z and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def sanitised(text: Column) -> Column:
    """Trimmed text without control characters (tab and line ends stay), non-characters and C1 controls; entities decoded."""
    plain = F.regexp_replace(strip(text), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF\\uD800-\\uDFFF]", "")
    return strip(F.regexp_replace(unescaped(plain), "[\\x7F-\\x9F]", ""))


def unescaped(text: Column) -> Column:
    """HTML character references decoded, in Arrow batches: the table of names is the standard library's."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: html.unescape(x) if isinstance(x, str) else x)

    return decode(text)


def without_tags(text: Column) -> Column:
    """Tags become blanks, white space single; text without < is returned as it is."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "\\s+", " "))
    return F.when(F.contains(text, F.lit("<")), cleaned).otherwise(text)


def normalised_name(text: Column, remove_inner_quotes: bool = False) -> Column:
    """Names in one form: half width, no blanks between CJK characters, no outer quotes, empty if only a short number."""
    t = F.translate(text, _FULL, _HALF)
    t = F.regexp_replace(t, "(?<=[\\u4e00-\\u9fa5])\\s+(?=[\\u4e00-\\u9fa5])", "")
    t = F.regexp_replace(t, "(?<=[\\u4e00-\\u9fa5])\\s+(?=[a-zA-Z0-9()\\[\\]@#$%!&*\\-=+_])", "")
    t = F.regexp_replace(t, "(?<=[a-zA-Z0-9()\\[\\]@#$%!&*\\-=+_])\\s+(?=[\\u4e00-\\u9fa5])", "")
    for left, right in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("《", "》")):
        inner = F.regexp_replace(t, f"(?s)^{left}(.*){right}$", "$1")
        quoted = (F.length(t) >= 2) & t.startswith(left) & t.endswith(right)
        clean = ~F.contains(inner, F.lit(left)) & ~F.contains(inner, F.lit(right))
        t = F.when(quoted & clean, inner).otherwise(t)
    if remove_inner_quotes:
        t = F.regexp_replace(t, "[“”‘’]", "")
    t = F.trim(t)
    short = t.rlike("^[0-9]+$") & (F.length(t) < 3)
    dotted = t.rlike("^[0-9.]+$") & (F.length(t) < 6)
    return F.when(short | dotted, F.lit("")).otherwise(t)


def split_by(text: Column, markers: Sequence[str]) -> Column:
    """Parts between any of the literal markers, trimmed, empty ones dropped."""
    if not markers:
        return F.array(text)
    pattern = "|".join("".join(f"\\{c}" if not c.isalnum() else c for c in m) for m in markers)
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def is_float(text: Column) -> Column:
    return text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def without_thinking(text: Column) -> Column:
    """Without a leading think block, or all up to an orphan end of one."""
    return strip(F.regexp_replace(text, "(?s)^(<think>.*?</think>|.*</think>)", ""))


def without_think_blocks(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?s)<think[^>]*>.*?</think[^>]*>", ""))


def answer_of(text: Column) -> Column:
    """The closed answer block, else an unclosed one to the end, else the whole text."""
    closed = F.regexp_extract(text, "(?s)<answer>(.*?)</answer>", 1)
    opened = F.regexp_extract(text, "(?s)<answer>(.*)$", 1)
    return strip(F.when(text.rlike("(?s)<answer>.*?</answer>"), closed).when(F.contains(text, F.lit("<answer>")), opened).otherwise(text))


def thinking_of(text: Column) -> Column:
    """The think block if the text has an answer block, else empty."""
    return strip(F.when(F.contains(text, F.lit("<answer>")), F.regexp_extract(text, "(?s)<think>(.*?)</think>", 1)).otherwise(F.lit("")))


def without_leading_headers(md: Column) -> Column:
    """Leading heading lines and blank lines go, later headings lose their marks; an empty result gives the input."""
    lines = F.split(md, "\n")
    first = F.array_position(F.transform(lines, lambda x: ~(x.rlike(r"^\s*#{1,6}\s") | (F.trim(x) == ""))), True)
    rest = F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    out = strip(F.array_join(F.transform(rest, lambda x: F.regexp_replace(x, r"^\s*#{1,6}\s+", "")), "\n"))
    return F.when(out == "", md).otherwise(out)


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, r"://[^/@\s]*@", "://***@")


def without_fences(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def shortened(text: Column, n: int) -> Column:
    """Cut to n characters with three dots; n = 0 never cuts."""
    return F.when((F.length(text) > n) & F.lit(n > 0), F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def shortened_question(text: Column, max_tokens: int, limit: int = 2000) -> Column:
    """Long questions keep what stands before the colon and the first names of the comma list behind it."""
    keep = max(10, min(30, max_tokens // 100))
    names = F.slice(F.transform(F.split(F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1), ","), lambda x: F.trim(x)), 1, keep)
    listed = F.concat(F.regexp_extract(text, r"(?s)^([^:]*):", 1), F.lit(": "), F.array_join(names, ", "))
    return F.when(F.length(text) <= limit, text).when(text.rlike(r"(?s)^[^:]*:.*,"), listed).otherwise(F.substring(text, 1, limit))


def protected_abbreviations(text: Column) -> Column:
    """``E. coli`` is no end of a sentence."""
    return F.regexp_replace(text, r"\b([A-Z])\.\s+([a-z])", "$1\u0001$2")


def restored_abbreviations(text: Column) -> Column:
    return F.regexp_replace(text, "\u0001", ". ")


def entity_type_of(name: Column, types: dict[str, str]) -> Column:
    """The type of an entity's prefix; an unknown prefix is its own type."""
    prefix = F.split_part(name, F.lit(":"), F.lit(1))
    known = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return F.coalesce(known[prefix], prefix)


def hash_id(content: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.md5(content.cast("binary")))


def args_hash(*parts: Column) -> Column:
    return F.md5(F.concat(*[p.cast("string") for p in parts]).cast("binary"))


def first_distinct(items: Column, n: int) -> Column:
    return F.slice(F.array_distinct(items), 1, n)


def with_original(queries: Column, original: Column) -> Column:
    return F.when(F.array_contains(queries, original), queries).otherwise(F.array_prepend(queries, original))


def string_list(raw: Column, keys: Sequence[str] = ("queries", "search_queries", "expanded_queries")) -> Column:
    """The list of strings in a model's JSON: an array, or an object's value under a known key or its first list; null otherwise."""
    v = F.try_parse_json(without_fences(raw))
    found = [F.try_variant_get(v, "$", "array<string>"), *[F.try_variant_get(v, f"$.{k}", "array<string>") for k in keys]]
    objects = F.from_json(without_fences(raw), "map<string,string>", {"mode": "PERMISSIVE"})
    first = F.try_variant_get(F.try_parse_json(F.element_at(F.map_values(objects), 1)), "$", "array<string>")
    out = F.coalesce(*found, F.when(F.size(objects) > 0, first))
    return F.filter(F.transform(out, lambda x: F.trim(x)), lambda x: x != "")


def rescued_object(raw: Column) -> Column:
    """The text from the first opening to the last closing brace, if the whole is not JSON."""
    return F.when(F.try_parse_json(without_fences(raw)).isNotNull(), without_fences(raw)).otherwise(F.regexp_extract(raw, r"(\{[\s\S]*\})", 1))


def response_text(raw: Column) -> Column:
    """The first of the usual fields of an API's JSON, else the raw text."""
    return F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in ("response", "text", "content", "output", "result")], raw)


def split_grouped_handles(text: Column) -> Column:
    """``[C1, C2]`` becomes ``[C1][C2]``."""
    return F.regexp_replace(text, r"(\[\s*|\G(?!^))([Cc]\d+)\s*[,;]\s*(?=[Cc]\d+(?:\s*[,;]\s*[Cc]\d+)*\s*\])", "$1$2][")


def tool_call(text: Column) -> Column:
    """The name behind ``CALL:``, else a tool that is asked for in words, else null."""
    named = F.regexp_extract(text, r"CALL:\s*(\S+)", 1)
    worded = F.regexp_extract(F.lower(text), r"\b(?:call|use|invoke)\w*\s+(?:the\s+)?([a-z_]+_tool|query_\w+|\w+_query)", 1)
    return F.when(named != "", named).when(worded != "", worded)


def messages(parts: Column) -> Column:
    """user and assistant in turn."""
    return F.transform(parts, lambda x, i: F.struct(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), x.alias("content")))


def replace_by(pattern: str, work: Callable[[re.Match], str]) -> Callable[[Column], Column]:
    """A regular expression replaced by a function: no expression has it, so it runs on Arrow batches."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        found = re.compile(pattern)
        return s.map(lambda x: found.sub(work, x) if isinstance(x, str) else x)

    return udf
