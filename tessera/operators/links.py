"""Links from document nodes to code nodes: equi-joins on identifiers, paths, endpoints and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean_endpoint, content_id, endpoint_method, endpoint_path, identifier_key, is_generic_term, meaningful_terms, normalize_path
from tessera.operators.joins import SMALL_ROWS, overlaps
from tessera.operators.lineage import checkpoint
from tessera.operators.store import first_per_key

# Kinds on either side and words of validating code.
DOC_FILES, CODE_FILES = ["markdown", "pdf", "sb"], ["code", "openapi", "sql", "config"]
DOC_NODES = "APIReference BusinessPolicy CodeReference DatabaseEntity FormField PermissionRule Policy Requirement Screen StatusValue UserAction ValidationRule".split()
VALIDATING = "assert|cannot|empty|error|invalid|must|raise|required|throw|validate|validation"
EXTRACTOR = "code_document_linker"


def with_endpoint(nodes: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Columns ep_method and ep_path of a node: what it states itself, else what its label names."""
    path = F.coalesce(clean_endpoint("endpoint"), endpoint_path("label", ignore_case))
    method = F.when(F.col("endpoint").isNotNull(), F.upper("method")).otherwise(endpoint_method("label", ignore_case))
    made = F.explode(F.array(F.struct(method.alias("ep_method"), path.alias("ep_path"))))  # a generator makes them once; filters on a column would make it again
    return nodes.withColumn("_ep", made).select("*", "_ep.ep_method", "_ep.ep_path").drop("_ep")


def _side(nodes: DataFrame, s: str, *more: str) -> DataFrame:
    return nodes.select(F.col("id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("kind", "label", "confidence", "path", "artifact_kind")], *more)


def _link(rows: DataFrame, relation: Column | str, confidence: Column | str, score: Column | float, reason: str, seq: int) -> DataFrame:
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    return rows.select(F.col("d_id").alias("src"), F.col("c_id").alias("dst"), lit(relation).alias("relation"), lit(confidence).alias("confidence"), lit(score).cast("double").alias("score"), F.lit(reason).alias("reason"), F.lit(seq).alias("seq"))


def sourcebook(path: str = "d_path", kind: str = "d_artifact_kind") -> Column:
    return (F.col(kind) == "pdf") | F.lower(path).rlike(r"\.(sb|sourcebook)$")


def endpoint_links(docs: DataFrame, code: DataFrame) -> DataFrame:
    """API references to endpoints with the same method and path, or the same path if the document gives no method."""
    d = _side(with_endpoint(docs.where("kind = 'APIReference'")), "d", "ep_method", "ep_path").where("ep_path is not null")
    c = _side(with_endpoint(code.where("kind = 'Endpoint'")), "c", "ep_method", "ep_path").where("ep_path is not null")
    exact = d.where("ep_method is not null").join(c, ["ep_method", "ep_path"])
    loose = d.where("ep_method is null").drop("ep_method").join(c.drop("ep_method"), "ep_path")
    relation = F.when(sourcebook(), "SB_REFERENCES_API").otherwise("DOC_MENTIONS")
    both = exact.select("d_id", "c_id", "d_path", "d_artifact_kind").unionByName(loose.select("d_id", "c_id", "d_path", "d_artifact_kind"))
    return _link(both, relation, "DOC_EXACT", 1.0, "exact_endpoint", 0)


def _keyed(nodes: DataFrame) -> DataFrame:
    """Nodes with the key of their label, if they have one; a generator makes it once, where filters and joins on a column would make it again."""
    return nodes.withColumn("key", F.explode(F.array(identifier_key("label", True)))).where("key <> ''")


def _by_key(nodes: DataFrame, canonical: bool) -> DataFrame:
    names = [identifier_key("label", True)] + [identifier_key("canonical_name", True)] * canonical
    return nodes.withColumn("key", F.explode(F.array_distinct(F.array(*names)))).where("key <> ''")


def identifier_links(docs: DataFrame, code: DataFrame) -> DataFrame:
    """Fields and config keys, tables and statuses by equal identifiers."""
    d = _keyed(docs)
    of = lambda kinds, canonical=False: _side(_by_key(code.where(F.col("kind").isin(kinds)), canonical), "c", "key")
    named = F.coalesce("reference_type", F.lit("")).isin("field", "form_field", "config_key", "")
    fields = _side(d.where(F.col("kind").isin("FormField", "CodeReference") & named), "d", "key")
    targets = of(["Column", "ConfigKey"]).unionByName(of(["ConfigKey"], True)).distinct()
    tables = _side(d.where("kind = 'DatabaseEntity'"), "d", "key")
    states = _side(d.where("kind = 'StatusValue'"), "d", "key")
    status = F.when(sourcebook(), "SB_REFERENCES_STATUS").otherwise("DOC_MENTIONS")
    return (
        _link(fields.join(targets, "key"), "DOC_MENTIONS", "DOC_EXACT", 0.95, "exact_field_or_config_key", 1)
        .unionByName(_link(tables.join(of(["Table"]), "key"), "DOC_MENTIONS", "DOC_EXACT", 0.95, "exact_table", 2))
        .unionByName(_link(states.join(of(["ConfigKey", "Column"]), "key"), status, "DOC_EXACT", 0.9, "exact_status_value", 3))
    )


def reference_links(docs: DataFrame, code: DataFrame) -> DataFrame:
    """File references by path; others by the name of a class, function or method (candidates are weak)."""
    refs = docs.where("kind = 'CodeReference'")
    files = code.where("kind = 'File'").withColumn("key", F.explode(F.array_distinct(F.array(normalize_path("path"), normalize_path("label"), normalize_path("canonical_name")))))
    by_path = _side(refs.where("reference_type = 'file_path'").withColumn("key", normalize_path("label")), "d", "key").join(_side(files, "c", "key"), "key")
    symbols = _side(_by_key(code.where("kind in ('Class', 'Function', 'Method')"), True), "c", "key").distinct()
    named = _keyed(refs.where("coalesce(reference_type, '') <> 'file_path'")).where(~is_generic_term("key"))
    named = _side(named, "d", "key").join(symbols, "key")
    weak = F.col("d_confidence") == "AMBIGUOUS"
    return _link(by_path, "DOC_MENTIONS", "DOC_EXACT", 1.0, "exact_file_path", 4).unionByName(
        _link(named, F.when(weak, "SEMANTIC_CANDIDATE").otherwise("DOC_MENTIONS"), F.when(weak, "AMBIGUOUS").otherwise("DOC_EXACT"), F.when(weak, 0.2).otherwise(0.9), "exact_code_reference", 5)
    )


def validation_links(docs: DataFrame, code: DataFrame) -> DataFrame:
    """Validation rules to validating code that holds the rule's field as a token."""
    rules = docs.where("kind = 'ValidationRule'").withColumn("field", F.coalesce("subject", F.nullif(F.regexp_extract("quote", r"`([A-Za-z_$][\w$.-]*)`", 1), F.lit(""))))
    rules = rules.where(F.col("field").rlike(r"^[A-Za-z_$][\w$.-]*$") & ~is_generic_term("field")).withColumn("key", identifier_key("field", True))
    text = F.concat_ws(" ", "label", "canonical_name", "quote")
    targets = code.where(F.col("kind").isin("Function", "Method", "File") & F.lower(text).rlike(VALIDATING))
    tokens = F.array_distinct(F.transform(F.regexp_extract_all("quote", F.lit(r"[A-Za-z_$][\w$.-]*"), F.lit(0)), lambda t: identifier_key(t, True)))
    held = _side(targets.withColumn("key", F.explode(tokens)), "c", "key")
    return _link(_side(rules, "d", "key").join(held, "key"), "SB_DEFINES_VALIDATION", "DOC_INFERRED", 0.85, "validation_field_in_validation_code", 6)


def handler_links(nodes: DataFrame, edges: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """OpenAPI endpoints to the handlers of code endpoints with the same path and, null-safe, the same method; with ``touched`` (paths) of links with an end there alone."""
    ends = with_endpoint(nodes.where("kind = 'Endpoint'")).where("ep_path is not null")
    routes = edges.where("relation = 'ROUTE_TO_HANDLER'").select(F.col("src").alias("id"), F.col("dst").alias("c_id"))
    handled = routes.join(ends.select("id", "path", "ep_method", "ep_path"), "id").select(F.col("ep_method").alias("m"), F.col("ep_path").alias("p"), "c_id", "path")
    declared = ends.where("artifact_kind = 'openapi'").select(F.col("id").alias("d_id"), "ep_method", "ep_path", "path")
    meet = lambda d, c: d.drop("path").join(c.drop("path"), F.col("ep_method").eqNullSafe(F.col("m")) & (F.col("ep_path") == F.col("p")))
    met = meet(declared, handled) if touched is None else meet(declared.join(touched, "path", "left_semi"), handled).unionByName(meet(declared.join(touched, "path", "left_anti"), handled.join(touched, "path", "left_semi")))
    return _link(met.join(nodes.select(F.col("id").alias("c_id")), "c_id", "left_semi"), "DOC_MENTIONS", "DOC_EXACT", 0.95, "openapi_endpoint_to_handler", 7)


def term_links(docs: DataFrame, code: DataFrame, least: int = 2) -> DataFrame:
    """Weak candidates: rules and code that share two meaningful terms, found by the seldom terms of either."""
    d = docs.where("kind in ('Requirement', 'Policy', 'BusinessPolicy', 'PermissionRule', 'UserAction', 'Screen')").withColumn("terms", meaningful_terms(F.concat_ws(" ", "label", "quote"))).where(F.size("terms") >= least)
    c = code.where("kind in ('Class', 'Function', 'Method', 'Endpoint')").withColumn("terms", meaningful_terms(F.concat_ws(" ", "label", "canonical_name")))
    shared = overlaps(d.select("id", "terms"), c.select("id", "terms"), least).select(F.col("l_id").alias("d_id"), F.col("r_id").alias("c_id"))
    return _link(shared, "SEMANTIC_CANDIDATE", "AMBIGUOUS", 0.2, "weak_lexical_overlap", 8)


#: Each sort of links with the kinds of nodes that it can have at either end.
MADE_BY = [
    (endpoint_links, ["APIReference"], ["Endpoint"]),
    (identifier_links, ["FormField", "CodeReference", "DatabaseEntity", "StatusValue"], ["Column", "ConfigKey", "Table"]),
    (reference_links, ["CodeReference"], ["File", "Class", "Function", "Method"]),
    (validation_links, ["ValidationRule"], ["Function", "Method", "File"]),
    (term_links, ["Requirement", "Policy", "BusinessPolicy", "PermissionRule", "UserAction", "Screen"], ["Class", "Function", "Method", "Endpoint"]),
]


def link(nodes: DataFrame, edges: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """All links as edges; of links with the same ends and relation the strongest stays, the first of equals.

    With ``touched`` (paths, few) only the links that have an end in one of these files: their documents meet all code, and other documents their code."""
    docs = nodes.where(F.col("artifact_kind").isin(DOC_FILES) & F.col("kind").isin(DOC_NODES))
    code = nodes.where(F.col("artifact_kind").isin(CODE_FILES))
    pairs = [(docs, code)]
    if touched is not None:
        touched = F.broadcast(touched) if touched.count() <= SMALL_ROWS else touched
        pairs = [(docs.join(touched, "path", "left_semi"), code), (docs.join(touched, "path", "left_anti"), code.join(touched, "path", "left_semi"))]
    sorts = nodes.select("artifact_kind", "kind").distinct().collect()  # a few dozen at most
    said, held = ({r["kind"] for r in sorts if r["artifact_kind"] in of} for of in (DOC_FILES, CODE_FILES))
    # kinds that only one side has bring no links, and cost no joins
    made = [f for f, some, ends in MADE_BY if said & {*some} and held & {*ends}]
    declared = any((r["artifact_kind"], r["kind"]) == ("openapi", "Endpoint") for r in sorts)
    rows = handler_links(nodes, edges, touched) if declared else handler_links(nodes, edges).where("false")
    for d, c in pairs:
        for f in made:
            rows = rows.unionByName(checkpoint(f(d, c)))
    best = first_per_key(rows.where("src <> dst"), ["src", "dst", "relation"], F.desc("score"), F.col("seq"))
    made = best.withColumn("extractor", F.lit(EXTRACTOR)).withColumn("id", content_id("link", "src", "dst", "relation"))
    return made.select("id", "src", "dst", "relation", "confidence", "score", "extractor", "reason")


def link_counts(links: DataFrame) -> DataFrame:
    return links.agg(F.count_if(F.col("relation") != "SEMANTIC_CANDIDATE").alias("strong_links"), F.count_if(F.col("relation") == "SEMANTIC_CANDIDATE").alias("weak_candidates"))
