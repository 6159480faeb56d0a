"""Conflicts between what documents say and what code does, as joins of facts that differ.

Facts are rows: subject, value (string), location, quote, confidence. Before they are joined, documents are reduced to the best
documented fact of each subject and value, which is all that a conflict shows of them: what a topic without subjects (retries, timeouts, roles)
brings to the join is as many rows as it has values, not as many as it has sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.lineage import checkpoint
from tessera.operators.joins import SMALL_ROWS, meet, overlaps
from tessera.operators.links import with_endpoint
from tessera.operators.search import fitting
from tessera.operators.store import first_per_key

# Aliases, methods, patterns.
FIELDS = {"password": ["password", "passwd", "pwd", "비밀번호", "암호"], "email": ["email", "이메일", "email_address", "emailaddress"]}
ROLES = {"admin": ["admin", "admins", "administrator", "관리자"], "owner": ["owner", "owners", "소유자"], "user": ["user", "users", "member", "members", "사용자", "회원"]}
SIGNUP = ["signup", "sign-up", "register", "registration", "가입", "회원가입"]
NO_STATUS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "API", "HTTP", "JSON", "PDF"]
RETRY_DOC = r"(?iu)\b(?:retry|retries|max retries|maxRetries)\D{0,20}(\d+)\b|최대\s*(\d+)\s*회"
RETRY_CODE = r"(?i)\b(?:maxRetries|retries|retryCount|max_retries|retry_count)\b\s*[:=]\s*(\d+)"
ROLES_CODE = r"(?i)\b(?:roles|allowedRoles|requiredRoles|permissions)\b\s*[:=]\s*\[([^\]]+)\]"

#: Endpoints that hold a term up to which it is looked for pair by pair.
USUAL = 100

#: What a text has that says a length, retries or a time (the last characters count as i, k or s where case is ignored), and the kinds of nodes that are looked at whatever they say.
LENGTHS = r"(?i:at least|minimum|min length|must be|[0-9][\s\x0b]*char)|자|[İıſK]"
FACT_HINTS = LENGTHS + r"|(?i:retry|timeout)|재시|최대|타임아웃|제한 시간"
LOOKED_AT = ["StatusValue", "APIReference", "PermissionRule", "Policy", "Requirement"]

FACT = ["subject", "value", "location", "quote", "confidence"]


def _first_alias(text: Column, groups: dict[str, list[str]], exact: bool = False) -> Column:
    low, out = F.lower(text), F.lit(None).cast("string")
    for name, words in reversed(groups.items()):
        hit = low.isin(words) if exact else low.rlike("|".join(words))
        out = F.when(hit, name).otherwise(out)
    return out


def field_of(text: Column) -> Column:
    """The field that a text is about: an alias in it, else a name in backticks, else the key of a length rule."""
    name = lambda c: F.coalesce(_first_alias(c, FIELDS, True), F.when(F.lower(c).rlike(r"^[a-z_][a-z0-9_.-]*$"), F.lower(c)))
    quoted = F.nullif(F.regexp_extract(text, r"`([A-Za-z_$][\w$.-]*)`", 1), F.lit(""))
    keyed = F.nullif(F.regexp_extract(text, r"\b([A-Za-z_$][\w$.-]*)\s*:\s*(?:z\.string|.*minLength|.*\.min\()", 1), F.lit(""))
    return F.coalesce(_first_alias(text, FIELDS), name(quoted), name(keyed))


def _facts(rows: DataFrame, subject: Column | str, value: Column) -> DataFrame:
    subject = F.lit(subject) if isinstance(subject, str) else subject
    out = rows.select(subject.alias("subject"), value.cast("string").alias("value"), "location", T.short("quote", 400).alias("quote"), "confidence")
    return first_per_key(out.where("subject is not null and value is not null"), ["subject", "value", "location"], F.col("quote"))


def nearby(lines: DataFrame, radius: int) -> DataFrame:
    """Lines with the text of those around them (near)."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(-radius, radius)
    return lines.withColumn("near", F.array_join(F.collect_list("line_text").over(w), "\n"))


def document_facts(nodes: DataFrame) -> dict[str, DataFrame]:
    """Facts of document nodes (NODE rows) by topic. Nodes are read once; those that may say something are written, and read for each topic."""
    docs = nodes.where("artifact_kind in ('markdown', 'pdf', 'sb') and confidence in ('DOC_EXACT', 'DOC_INFERRED')")
    docs = docs.select("kind", "label", "method", "endpoint", "subject", "confidence", "path", "start_line", "end_line", "page", T.first_of("quote", "label").alias("quote"), F.col("kind").isin(LOOKED_AT).alias("_ever"))
    docs = checkpoint(fitting(docs, "quote", FACT_HINTS, "_ever").drop("_ever")).withColumn("location", T.location("path", "start_line", "end_line", "page"))
    low = F.lower("quote")
    own = F.when(F.lower("subject").rlike(r"^[a-z_][a-z0-9_.-]*$"), F.coalesce(_first_alias(F.col("subject"), FIELDS, True), F.lower("subject")))
    lengths = fitting(docs.where("kind in ('ValidationRule', 'Requirement', 'Paragraph')"), "quote", LENGTHS)
    retry = F.coalesce(*[F.nullif(F.regexp_extract("quote", RETRY_DOC, g), F.lit("")) for g in (1, 2)])
    retries = docs.where(low.contains("retry") | F.col("quote").contains("재시") | F.col("quote").contains("최대"))
    timed = docs.where(low.contains("timeout") | F.col("quote").contains("타임아웃") | F.col("quote").contains("제한 시간"))
    only = docs.where("kind in ('PermissionRule', 'Policy', 'Requirement')").where(F.col("quote").rlike(r"(?iu)\bonly\b|만\b"))
    ends = with_endpoint(docs.where("kind = 'APIReference'"), ignore_case=True).where("ep_method is not null and ep_path is not null")
    status = F.upper(F.trim("label"))
    return {
        "validation": _facts(lengths, F.coalesce(field_of(F.col("quote")), own), T.min_length_of_document("quote")),
        "status": _facts(docs.where("kind = 'StatusValue' and confidence = 'DOC_EXACT'").where(~status.isin(NO_STATUS)), "status", status),
        "endpoint": _facts(ends, F.col("ep_method"), F.col("ep_path")),
        "retry": _facts(retries, "retry_count", retry.cast("long")),
        "timeout": _facts(timed, "timeout_ms", T.timeout_ms("quote")),
        "permission": _facts(only, "permission", _first_alias(F.col("quote"), ROLES)),
    }


def code_facts(lines: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Facts of code lines and code endpoints by topic; sets of values (statuses, roles) are comma-joined."""
    code = lines.where("kind in ('code', 'openapi', 'sql', 'config')")
    rows = code.select("*", F.trim("line_text").alias("quote"), F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("location"), F.lit("EXACT_STATIC").alias("confidence"))
    lengths = nearby(rows, 3).where(T.min_length_of_code("line_text").isNotNull())
    statuses = lambda text: F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9_]{2,})\b"), F.lit(1)), lambda v: ~v.isin(NO_STATUS))
    ahead = Window.partitionBy("path").orderBy("line").rowsBetween(1, 7)
    listed = F.transform(F.filter(F.collect_list(F.trim("line_text")).over(ahead), lambda s: s != ""), lambda s: F.regexp_extract(s, r"^-\s*['\"]?([A-Z][A-Z0-9_]{2,})['\"]?", 1))
    # the items up to the first line that is none, once there was one
    started = F.expr("slice(items, greatest(1, coalesce(array_position(transform(items, x -> x <> ''), true), 1)), 7)")
    until = F.expr("filter(slice(began, 1, cast(if(array_position(began, '') = 0, size(began), array_position(began, '') - 1) as int)), x -> x <> '')")
    enums = nearby(rows, 6).withColumn("items", listed).withColumn("began", started).where(F.lower("line_text").contains("enum") & F.lower("near").contains("status"))
    values = F.when(F.size(statuses("line_text")) > 0, statuses("line_text")).otherwise(F.filter(until, lambda v: ~v.isin(NO_STATUS)))
    enums = enums.withColumn("set", F.array_sort(F.array_distinct(values))).where(F.size("set") > 0).withColumn("quote", F.col("near"))
    words = F.regexp_extract_all(F.regexp_extract("line_text", ROLES_CODE, 1), F.lit("[A-Za-z가-힣_]+"), F.lit(0))
    roles = F.array_sort(F.array_distinct(F.array_compact(F.transform(words, lambda x: _first_alias(x, ROLES, True)))))
    ends = with_endpoint(nodes.where("kind = 'Endpoint' and artifact_kind in ('code', 'openapi', 'sql', 'config')")).where("ep_method is not null and ep_path is not null")
    ends = ends.withColumn("location", T.location("path", "start_line", "end_line", "page"))
    return {
        "validation": _facts(lengths, field_of(F.col("near")), T.min_length_of_code("line_text")),
        "status": _facts(enums, "status", F.array_join("set", ",")),
        "endpoint": _facts(ends, F.col("ep_method"), F.col("ep_path")),
        "retry": _facts(rows, "retry_count", F.nullif(F.regexp_extract("line_text", RETRY_CODE, 1), F.lit("")).cast("long")),
        "timeout": _facts(rows.where(F.col("line_text").rlike("timeout|TIMEOUT")), "timeout_ms", T.timeout_ms("line_text")),
        "permission": _facts(rows.withColumn("set", roles).where(F.size("set") > 0), "permission", F.array_join("set", ",")),
    }


def best_documented(docs: DataFrame, keys: tuple[str, ...] = ("subject",), graded: Column | None = None) -> DataFrame:
    """Of the facts that say the same of a subject the surest (where ``graded`` says so), then the one with the shortest quote, then by location."""
    sure = F.when((F.lit(True) if graded is None else graded) & (F.col("confidence") == "DOC_EXACT"), 0).otherwise(1)
    return first_per_key(docs, [*keys, "value"], sure, F.length("quote"), F.col("location"))


def _side(df: DataFrame, s: str, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in FACT[1:]])


def met(docs: DataFrame, code: DataFrame, keys: tuple[str, ...] = ("subject",), graded: Column | None = None) -> DataFrame:
    """Facts of code with the best documented fact of each value of the same subject."""
    return meet(_side(code, "code", keys), _side(best_documented(docs, keys, graded), "doc", keys), list(keys))


def differing(docs: DataFrame, code: DataFrame) -> DataFrame:
    """Pairs of facts on the same subject with other values; of documents the best of each value."""
    return met(docs, code).where("doc_value <> code_value")


def outside(docs: DataFrame, code: DataFrame) -> DataFrame:
    """Pairs in which the document's value is not in the code's set; of documents the best of each value."""
    return met(docs, code).where(~F.array_contains(F.split("code_value", ","), F.col("doc_value")))


def similar_endpoints(docs: DataFrame, code: DataFrame) -> DataFrame:
    """Endpoints that only documents have, with the code endpoint of the same method that is most alike.

    Alike: two shared terms, or both about signing up. Each endpoint counts once, on either side. Pairs with a common term that at most USUAL
    endpoints hold are all looked at. Of the others only the usual terms count, so endpoints with the same usual terms are one kind, which the first of
    its code endpoints stands for: a kind of documented ones gets the best of these, and terms that most endpoints share make no pairs of endpoints."""
    alone = best_documented(docs.join(code.select("subject", "value").distinct(), ["subject", "value"], "left_anti"))
    ends = first_per_key(code, ["subject", "value"], F.col("location"))
    words = F.array(*[F.lit(x) for x in SIGNUP])
    # terms of a method are its own
    terms = F.transform("own", lambda t: F.concat(F.col("subject"), F.lit(" "), t))
    named = lambda df: checkpoint(df.withColumn("id", F.concat_ws(" ", "subject", "value")).withColumn("own", T.endpoint_terms("value")).withColumn("signup", F.arrays_overlap("own", words)).withColumn("terms", terms))
    alone, ends = named(alone), named(ends)
    told = lambda df: df.select("id", F.explode("terms").alias("term"))
    often = checkpoint(told(alone).unionAll(told(ends)).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > USUAL).select("term"))
    often = F.broadcast(often) if often.count() <= SMALL_ROWS else often  # one in USUAL of all terms at most
    rare = lambda df, i: told(df).join(often, "term", "left_anti").withColumnRenamed("id", i)
    near = rare(alone, "l_id").join(rare(ends, "r_id"), "term").select("l_id", "r_id")

    def kinds(df):
        usual = told(df).join(often, "term", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("usual"))
        rows = df.drop("terms").join(usual, "id", "left").withColumn("terms", F.coalesce("usual", F.array().cast("array<string>")))
        return checkpoint(rows.select("id", "subject", "signup", "location", "value", "terms", F.to_json(F.struct("subject", "signup", "terms")).alias("kind")))

    said, held = kinds(alone), kinds(ends)
    said_kinds = checkpoint(said.select(F.col("kind").alias("id"), "subject", "signup", "terms").distinct())
    held_kinds = checkpoint(held.groupBy(F.col("kind").alias("id"), "subject", "signup", "terms").agg(F.min(F.struct("location", "value", F.col("id").alias("r_id"))).alias("first")))
    both = said_kinds.where("signup").select("subject", F.col("id").alias("l_id")).join(held_kinds.where("signup").select("subject", F.col("id").alias("r_id")), "subject")
    met = overlaps(said_kinds, held_kinds).select("l_id", "r_id").unionByName(both.select("l_id", "r_id")).distinct()
    met = met.join(said_kinds.select(F.col("id").alias("l_id"), F.col("signup").alias("l_signup"), F.col("terms").alias("l_terms")), "l_id").join(held_kinds.select(F.col("id").alias("r_id"), "signup", "terms", "first").withColumnRenamed("r_id", "kind"), F.col("r_id") == F.col("kind"))
    likeness = F.size(F.array_intersect("l_terms", "terms")) + F.when(F.col("l_signup") & F.col("signup"), 2).otherwise(0)
    best = met.groupBy(F.col("l_id").alias("kind")).agg(F.min(F.struct((-likeness).alias("n"), "first")).alias("b"))
    usual = said.join(best, "kind").select(F.col("id").alias("l_id"), F.col("b.first.r_id").alias("r_id"))
    pairs = near.unionByName(usual).distinct()
    side = lambda df, s, i: _side(df, s, ("id", "own", "signup", "subject")).withColumnsRenamed({"id": i, "own": f"{s}_own", "signup": f"{s}_signup"})
    full = pairs.join(side(alone, "doc", "l_id"), "l_id").join(side(ends, "code", "r_id").drop("subject"), "r_id")
    scored = full.withColumn("alike", F.size(F.array_intersect("doc_own", "code_own")) + F.when(F.col("doc_signup") & F.col("code_signup"), 2).otherwise(0))
    best = first_per_key(scored.where("alike >= 2"), ["subject", "doc_value"], F.desc("alike"), F.col("code_location"), F.col("code_value"))
    return best.select("subject", *[f"{s}_{c}" for s in ("doc", "code") for c in FACT[1:]])


# What a conflict of each topic is called and how it is put; of sets the document's value must be one.
SETS = ("status", "permission")
NAMES = {"validation": "validation_mismatch", "status": "status_value_mismatch", "retry": "retry_policy_mismatch", "timeout": "timeout_mismatch", "permission": "permission_mismatch"}
SAID = {
    "validation": "Document requires min length %s, but code enforces %s.",
    "status": "Document references status %s, but code enum contains %s.",
    "retry": "Document retry count is %s, but code uses %s.",
    "timeout": "Document timeout is %sms, but code uses %sms.",
    "permission": "Document requires role %s, but code allows %s.",
}
CONFLICT = ["type", "subject", "summary", "confidence", *[f"{s}_{c}" for s in ("doc", "code") for c in FACT[1:4]]]


def detect(doc: dict[str, DataFrame], code: dict[str, DataFrame]) -> DataFrame:
    """type, subject, summary, confidence and both sides of every conflict; of equal claims the best documented stays.

    The facts of all topics but endpoints are one table on either side and meet in one join by topic and subject."""
    whole = lambda facts: reduce(DataFrame.unionByName, [facts[t].withColumn("topic", F.lit(t)) for t in NAMES])
    graded = F.col("topic").isin("validation", "status")
    pairs = met(whole(doc), whole(code), ("topic", "subject"), graded)
    d, c = F.col("doc_value"), F.col("code_value")
    listed = F.col("topic").isin(*SETS)
    pairs = pairs.where(F.when(listed, ~F.array_contains(F.split(c, ","), d)).otherwise(d != c))
    shown = F.when(listed, F.array_join(F.split(c, ","), ", ")).otherwise(c)
    pick = lambda of: reduce(lambda out, t: F.when(F.col("topic") == t, of(t)).otherwise(out), NAMES, F.lit(None).cast("string"))
    surely = F.when(graded & (F.col("doc_confidence") == "DOC_EXACT"), "high").otherwise("medium")
    told = pairs.select(pick(lambda t: F.lit(NAMES[t])).alias("type"), "subject", pick(lambda t: F.format_string(SAID[t], d, shown)).alias("summary"), surely.alias("confidence"), *CONFLICT[4:])
    ends = similar_endpoints(doc["endpoint"], code["endpoint"])
    s = F.col("subject")
    said = F.format_string("Document names %s %s, but similar code endpoint is %s %s.", s, d, s, c)
    ends = ends.select(F.lit("endpoint_mismatch").alias("type"), F.concat(s, F.lit(" "), d).alias("subject"), said.alias("summary"), F.lit("medium").alias("confidence"), *CONFLICT[4:])
    return told.unionByName(ends).orderBy("type", "subject", "doc_location", "code_location")


def dedupe_claims(conflicts: DataFrame) -> DataFrame:
    """One conflict of each claim: the surest, then the one with the shortest quote, then by location."""
    sure = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return first_per_key(conflicts, ["type", "subject", "summary", "code_location", "doc_value", "code_value"], sure, F.length("doc_quote"), F.col("doc_location"))
