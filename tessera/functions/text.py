"""Column functions over task, label and path texts; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: methods, word lists, weights, patterns.
METHODS = "GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS"
PATH_CHARS = r"/[A-Za-z0-9_./:{}?=&%+-]+"
ENDPOINT = rf"\b({METHODS})\s+({PATH_CHARS})"
BARE_API = r"(?<![\w/])(/api/[A-Za-z0-9_./:{}?=&%+-]+)"
FILE_PATH = (
    r"(?<!://)(?:\.{0,2}/)?(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]+"
    r"|(?<!://)\b[A-Za-z0-9_.-]+\.(?:py|ts|tsx|js|jsx|md|markdown|yaml|yml|json|toml|sql|graphql|go|rs|java|swift|rb|php)\b"
)
IDENTIFIER = r"[A-Za-z_$][\w$]*(?:[._-][A-Za-z_$][\w$]*)*"
NOT_A_STATUS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "API", "HTTP", "PDF"]
GENERIC = "api app data delete get handler item list login order page payment post put request response save screen service status submit update user users view".split()
GENERIC_IN_TASKS = [*GENERIC, "flow"]
CONFIDENCE = {"EXACT_COMPILER": 30.0, "EXACT_STATIC": 22.0, "DOC_EXACT": 16.0, "DOC_INFERRED": 8.0, "AMBIGUOUS": -18.0}
EXTRACTORS = {"scip": 24.0, "code_fast_graph": 14.0, "code_document_linker": 12.0, "markdown": 5.0, "pdf_fast_text": 5.0}
INTENTS = [
    ("why", r"\b(why|reason|rationale|explain|what caused|because)\b"),
    ("conflict", r"\b(conflict|inconsistent|mismatch|contradict|disagree|drift)\b"),
    ("impact", r"\b(impact|affected|blast radius|change|modify|rename|remove|break|migration)\b"),
    ("implementation", r"\b(implement|add|build|create|fix|wire|support|handle)\b"),
]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_of(*values: str | Column) -> Column:
    """The first value that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(col(v), F.lit("")) for v in values], F.lit(""))


def _weights(of: dict[str, float], c: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in of.items():
        out = F.when(c == name, weight).otherwise(out)
    return out


def confidence_weight(c: str | Column) -> Column:
    return _weights(CONFIDENCE, col(c))


def extractor_weight(c: str | Column) -> Column:
    return _weights(EXTRACTORS, col(c))


def tokenize(c: str | Column) -> Column:
    """Lower-cased tokens of two characters or more, in order."""
    return F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(r"[A-Za-z0-9_.$/-]+"), F.lit(0)), F.lower), lambda t: F.length(t) > 1)


def significant_tokens(c: str | Column) -> Column:
    return F.filter(tokenize(c), lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC_IN_TASKS))


def infer_intent(c: str | Column) -> Column:
    """The first intent whose words the task has: why, conflict, impact, implementation, else auto."""
    text, out = F.lower(col(c)), F.lit("auto")
    for name, words in reversed(INTENTS):
        out = F.when(text.rlike(words), name).otherwise(out)
    return out


def clean_endpoint(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(col(c)), r"[.,;:)\]}]+$", ""))


def endpoint_method(label: str | Column, ignore_case: bool = False) -> Column:
    return F.upper(F.nullif(F.regexp_extract(col(label), ("(?i)" if ignore_case else "") + ENDPOINT, 1), F.lit("")))


def endpoint_path(label: str | Column, ignore_case: bool = False, bare: bool = True) -> Column:
    """Path of an endpoint that a label names with a method, or else of a bare /api/ path."""
    named = F.nullif(F.regexp_extract(col(label), ("(?i)" if ignore_case else "") + ENDPOINT, 2), F.lit(""))
    alone = F.nullif(F.regexp_extract(col(label), BARE_API, 1), F.lit(""))
    return clean_endpoint(F.coalesce(named, alone) if bare else named)


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^[`'\"]+|[`'\"]+$", "")


def identifier_key(c: str | Column, last_part: bool = False) -> Column:
    """Comparable form of an identifier; with ``last_part`` only what follows the last dot of a dotted name counts."""
    bare = F.regexp_replace(_unquoted(F.coalesce(col(c), F.lit(""))), r"\(\)$", "")
    if last_part:
        bare = F.when(bare.contains(".") & ~bare.contains("/"), F.element_at(F.split(bare, r"\."), -1)).otherwise(bare)
    return F.lower(bare)


def normalize_path(c: str | Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(_unquoted(F.coalesce(col(c), F.lit(""))), r"^\./", ""), F.lit("\\"), F.lit("/")))


def split_terms(c: str | Column) -> Column:
    """Lower-cased terms of a text, camel case split, in order."""
    spaced = F.regexp_replace(col(c), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(spaced, F.lit(r"[A-Za-z0-9]+"), F.lit(0)), F.lower)


def meaningful_terms(c: str | Column) -> Column:
    return F.filter(F.array_distinct(split_terms(c)), lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC))


def is_generic_term(c: str | Column, words: list[str] = GENERIC) -> Column:
    """One term only, and that a generic one. Task terms count repeats, link terms don't; both are one term here."""
    return F.exists(F.array(split_terms(c)), lambda terms: (F.size(terms) == 1) & F.element_at(F.concat(terms, F.array(F.lit(""))), 1).isin(words))


def endpoint_terms(c: str | Column) -> Column:
    parts = F.filter(F.split(F.lower(col(c)), "[^a-z0-9가-힣]+"), lambda t: t != "")
    return F.array_except(F.array_distinct(parts), F.array(*[F.lit(x) for x in ("api", "v1", "v2", "v3")]))


def location(path: str | Column, start: str | Column, end: str | Column, page: str | Column) -> Column:
    path, start, end, page = map(col, (path, start, end, page))
    s, e = start.cast("string"), end.cast("string")
    lines = F.when(start == end, F.concat(path, F.lit(":"), s)).otherwise(F.concat(path, F.lit(":"), s, F.lit("-"), e))
    return F.when(page.isNotNull(), F.concat(path, F.lit(":page "), page.cast("string"))).when(start.isNotNull() & end.isNotNull(), lines).otherwise(path)


def short(c: str | Column, limit: int, compact: bool = False) -> Column:
    """The trimmed text, cut to ``limit`` characters with dots at the end; ``compact`` makes any white space one space."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")
    if compact:
        text = F.regexp_replace(text, r"\s+", " ")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit - 3), r"\s+$", ""), F.lit("...")))


def token_count(c: str | Column) -> Column:
    return F.regexp_count(col(c), F.lit(r"\S+"))


def pack_tokens(c: str | Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(c)) / 4).cast("int"))


def content_id(prefix: str, *parts: str | Column) -> Column:
    """``prefix:`` and 24 hex digits of the SHA-256 of the parts, one a line; a null part reads None."""
    lines = F.concat_ws("\n", *[F.coalesce(col(p).cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(lines, 256), 1, 24))


def _int(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("long")


def timeout_ms(c: str | Column) -> Column:
    """Milliseconds of the first number with a unit of time, else of a bare number after the word timeout."""
    text = col(c)
    unit_re = r"(?iU)(\d+(?:\.\d+)?)\s*(ms|milliseconds?|초|s|sec|seconds?)\b"
    value = F.nullif(F.regexp_extract(text, unit_re, 1), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(text, unit_re, 2))
    scaled = F.when(unit.isin("s", "sec", "second", "seconds", "초"), value * 1000).otherwise(value).cast("long")
    return F.coalesce(scaled, _int(text, r"\b(?:timeout|TIMEOUT|timeoutMs|timeout_ms)\b\D{0,20}(\d+)"))


def min_length_of_document(c: str | Column) -> Column:
    patterns = [
        r"(\d+)\s*자\s*이상",
        r"(?:at least|minimum|min(?:imum)? length)\D{0,20}(\d+)",
        r"(\d+)\s*(?:characters?|chars?)\s*(?:or more|min(?:imum)?)",
        r"must be\D{0,20}(\d+)\D{0,20}(?:characters?|chars?)",
    ]
    return F.coalesce(*[_int(col(c), "(?iu)" + p) for p in patterns])


def min_length_of_code(c: str | Column) -> Column:
    patterns = [r"\bminLength\s*\(\s*(\d+)\s*\)", r"\bminLength\b\s*[:=]\s*(\d+)", r"\bmin_length\b\s*[:=]\s*(\d+)", r"\.min\s*\(\s*(\d+)\s*\)", r"\.length\s*<\s*(\d+)"]
    return F.coalesce(*[_int(col(c), p) for p in patterns])
