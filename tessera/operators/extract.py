"""Nodes and edges of project files, read line by line with the JVM's regular expressions and windows.

Input are rows of ``sources.files.lines``: path, kind, line, line_text. Every node row has the columns of NODE."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import BARE_API, ENDPOINT, FILE_PATH, content_id, short
from tessera.operators.lineage import checkpoint
from tessera.operators.search import fitting
from tessera.operators.store import first_per_key
from tessera.sources.files import sentences

NODE = ["id", "kind", "label", "canonical_name", "artifact_kind", "path", "start_line", "end_line", "page", "confidence", "method", "endpoint", "reference_type", "subject", "quote"]
EDGE = ["id", "src", "dst", "relation", "confidence", "score", "extractor"]

# What a line must look like, by language.
NAME, JS_NAME = r"[A-Za-z_][\w]*", r"[A-Za-z_$][\w$]*"
SCRIPT = r"\.(ts|tsx|js|jsx)$"
DEFINITIONS = [
    (SCRIPT, "Class", rf"^\s*(?:export\s+)?(?:default\s+)?class\s+({JS_NAME})\b"),
    (SCRIPT, "Function", rf"^\s*(?:export\s+)?(?:async\s+)?function\s+({JS_NAME})\s*\("),
    (SCRIPT, "Function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({JS_NAME})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{JS_NAME})\s*=>"),
    (SCRIPT, "Method", rf"^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*(?!(?:if|for|while|switch|catch|function|return)\b)({JS_NAME})\s*\([^)]*\)\s*[{{:]"),
    (r"\.py$", "Class", rf"^\s*class\s+({NAME})\b"),
    (r"\.py$", "Function", rf"^\s*(?:async\s+)?def\s+({NAME})\s*\("),
    (r"\.java$", "Class", rf"\b(?:class|interface|enum|record)\s+({NAME})\b"),
    (r"\.java$", "Method", rf"^\s*(?:(?:public|private|protected|static|final|synchronized|abstract|native)\s+)+[A-Za-z_<>\[\], ?]+\s+({NAME})\s*\([^;]*\)\s*(?:throws\s+[^{{]+)?\{{?"),
]
IMPORTS = [
    (SCRIPT, r"""^\s*import(?:\s+[^'"]+\s+from)?\s*['"]([^'"]+)['"]"""),
    (SCRIPT, r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""),
    (r"\.py$", r"^\s*from\s+([A-Za-z_][\w.]*)\s+import\s+.+"),
    (r"\.py$", r"^\s*import\s+([A-Za-z_][\w.]*)"),
    (r"\.java$", r"^\s*import\s+(?:static\s+)?([A-Za-z_][\w.*]*);"),
]
ROUTES = [
    (SCRIPT, rf"""(?i)\b(?:app|router)\.(get|post|put|patch|delete|head|options)\s*\(\s*['"]([^'"]+)['"]\s*(?:,\s*({JS_NAME}))?"""),
    (r"\.py$", r"""^\s*@\w+(?:\.\w+)*\.(get|post|put|patch|delete|head|options)\(\s*['"]([^'"]+)['"]"""),
    (r"\.java$", r"""(?i)@(Get|Post|Put|Patch|Delete|Request)Mapping\s*(?:\(\s*(?:value\s*=\s*)?["']([^"']+)["'])?"""),
]
SQL_NAME = r"""([A-Za-z_][\w.]*|"[^"]+"|`[^`]+`)"""
SQL_CREATE = rf"(?i)\bCREATE\s+TABLE(?:\s+IF\s+NOT\s+EXISTS)?\s+{SQL_NAME}"
SQL_USE = rf"(?i)\b(?:ALTER\s+TABLE|INSERT\s+INTO|UPDATE|FROM|JOIN|DELETE\s+FROM)\s+{SQL_NAME}"
SQL_COLUMN = r"""^\s*([A-Za-z_][\w]*|"[^"]+"|`[^`]+`)\s+[A-Za-z]+\b"""
YAML_KEY = r"^(\s*)([A-Za-z0-9_./{}:-]+)\s*:"
YAML_METHOD = r"(?i)^\s{2,}(get|post|put|patch|delete|head|options)\s*:\s*$"
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
STATUS_WORD = r"\b(PAID|FAILED|PENDING|APPROVED|READY|ACTIVE|INACTIVE|SUCCESS|ERROR|CANCELLED|REJECTED)\b"
STATUS_MENTION = r"\b([A-Z][A-Z0-9_]{2,})\b"
NO_STATUS = "API CSS DELETE GET HEAD HTML HTTP HTTPS JSON OPTIONS PATCH PDF POST PUT SQL URL YAML".split()
FUNCTION = rf"\b({JS_NAME}(?:\.{JS_NAME})?)\s*\("
CONFIG_KEY = r"\b([a-z][A-Za-z0-9_-]*(?:[._-][A-Za-z0-9_-]+)+)\b"
PASCAL = r"\b([A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+)\b"
FIELD = r"(?i)(?<![A-Za-z0-9_])([a-z][a-z0-9]*(?:_[a-z0-9]+)+|[a-z]+[A-Z][A-Za-z0-9]*|status|email|password|amount|amount_cents|userId)(?![A-Za-z0-9_])"
FIELD_CONTEXT = (
    r"(?iu)(?:필드|입력값|입력 필드|파라미터|parameter|field|input|key)\s*[:=-]?\s*`?([A-Za-z][A-Za-z0-9_.-]{1,60})`?"
    r"|`([A-Za-z][A-Za-z0-9_.-]{1,60})`\s*(?:필드|입력값|파라미터|field|input|key)"
    r"|([A-Za-z][A-Za-z0-9_.-]{1,60})\s*(?:필드|입력값|파라미터|field|input|key)"
)
FIELD_HINT = r"(?iu)필드|입력값|파라미터|parameter|field|input|key|값"
VALIDATION = (
    r"(?iu)(8자\s*이상|최대\s*\d+\s*회|이메일\s*형식|required|must be|must match|must include|cannot be empty|at least|at most|minimum|"
    r"max(?:imum)?|필수|유효|형식|최소\s*\d+|\d+\s*자\s*이상|\d+\s*자\s*이하|\d+\s*회\s*이하)"
)
SENTENCES = [
    ("ErrorMessage", r"(?i)\b(error(?: message)?|throws?|raises?|returns?)\b"),
    ("ValidationRule", r"(?i)\b(must be valid|must match|must include|must contain|required field|required when|cannot be empty|must not exceed|at least|at most|minimum|max(?:imum)?|invalid if|reject(?:s|ed)? when|validate|validation)\b"),
    ("Policy", r"(?i)\b(do not|never|only|no external|must not|read-only|local-first)\b"),
    ("Requirement", r"(?i)\b(must|shall|should|required|needs? to|has to|have to)\b"),
]
RULES = [
    ("PermissionRule", r"(?iu)\b(permission|role|admin|owner|member|viewer|editor|authorized|unauthorized|forbidden|only\s+\w+\s+can)\b|권한|역할|관리자만|소유자만|인증된|허용되지|금지"),
    ("BusinessPolicy", r"(?iu)\b(policy|business rule|retention|approval|refund|settlement)\b|정책|비즈니스\s*규칙|사업\s*규칙|보관|환불|정산|승인\s*정책"),
    ("Requirement", r"(?iu)\b(must|shall|should|required|needs? to|has to|have to)\b|해야\s*한다|필요하다|필수"),
]
SCREEN = r"(?iu)(?:화면|스크린|페이지|screen|page|view)\s*[:=-]\s*([A-Za-z0-9가-힣 _/-]{2,60})|([A-Za-z0-9가-힣 _/-]{2,60})\s*(?:화면|스크린|페이지|screen|page|view)\b"
ACTION = (
    r"(?i)\b(?:user|admin|operator|customer|agent)\s+(?:can|must|should|may|will)?\s*"
    r"((?:clicks?|taps?|selects?|enters?|opens?|submits?|uploads?|downloads?|chooses?|navigates?|saves?|deletes?)\b[^.!?\n。！？]{0,80})"
)
KOREAN_ACTION = r"(?:사용자|관리자|운영자|고객|회원|게스트)가?\s*[^.!?\n。！？]{0,60}?(클릭|탭|선택|입력|등록|저장|삭제|승인|거절|조회|검색|업로드|다운로드|결제|취소)"
INTEGRATION = (
    r"(?iu)(?:external integration|integration|webhook|연동|외부\s*연동)\s*[:=-]?\s*([A-Za-z가-힣][A-Za-z0-9가-힣 _.-]{1,50})"
    r"|([A-Za-z][A-Za-z0-9_.-]{1,40})\s*(?:API\s*)?(?:연동|webhook)"
)
ERROR_HINT = r"(?iu)\b(error|warning|failure)\b|오류|에러|실패|경고"
QUOTED = r"""`([^`\n]+)`|"([^"]+)"|'([^']+)'|“([^”]+)”|‘([^’]+)’"""
NO_LABEL = ["the", "this", "a", "an", "status"]
DATABASE = r"(?iu)\b([A-Za-z][A-Za-z0-9_]{2,})\s+(?:table|entity|collection)\b|(?:테이블|엔티티|컬렉션)\s*[:=-]?\s*([A-Za-z][A-Za-z0-9_]{2,})|([A-Za-z][A-Za-z0-9_]{2,})\s*(?:테이블|엔티티|컬렉션)"

# Words of which every match of the pattern of the same name has one; sentences without any are not searched for it.
SCREEN_HINT, INTEGRATION_HINT, DATABASE_HINT = r"(?iu)화면|스크린|페이지|screen|page|view", r"(?iu)integration|webhook|연동", r"(?iu)table|entity|collection|테이블|엔티티|컬렉션"

# What a line has that some pattern of mentions fits, and a sentence that the patterns of facts of each sort fit: words (in any case), signs or characters.
# What has none is not searched. The last characters of OTHER are those that count as i, k or s where case is ignored.
DOTTED, UPPER, CAMEL, OTHER = r"[._-][A-Za-z0-9_-]", r"[A-Z][A-Z0-9_]{2}", r"[A-Za-z0-9][A-Z][A-Za-z0-9]", "[가-힣İıſK]"
NEED = "must|shall|should|required|need|has to|have to"
TOLD = {
    "ErrorMessage": "(?i:error|throw|raise|return)",
    "ValidationRule": "(?i:must|required|cannot be empty|at least|at most|minimum|max|invalid if|reject|validat)",
    "Policy": "(?i:do not|never|only|no external|must not|local-first)",
    "Requirement": f"(?i:{NEED})",
    "rule PermissionRule": f"(?i:permission|role|admin|owner|member|viewer|editor|authorized|forbidden|only)|{OTHER}",
    "rule BusinessPolicy": f"(?i:policy|business rule|retention|approval|refund|settlement)|{OTHER}",
    "rule Requirement": f"(?i:{NEED})|{OTHER}",
    "validation": f"(?i:required|must|cannot be empty|at least|at most|minimum|max)|{OTHER}",
    "status": UPPER,
    "field": f"(?i:parameter|field|input|key)|{OTHER}",
    "marked": "`",
    "screen": f"(?i:screen|page|view)|{OTHER}",
    "action": "(?i:user|admin|operator|customer|agent)",
    "korean": OTHER,
    "warned": f"(?i:error|warning|failure)|{OTHER}",
    "integration": f"(?i:integration|webhook)|{OTHER}",
    "database": f"(?i:table|entity|collection)|{OTHER}",
}
FACT_HINTS = "|".join(TOLD.values())
HINTS = f"{FACT_HINTS}|[/(]|{DOTTED}|{CAMEL}"


def telling(lines: DataFrame) -> DataFrame:
    """Lines (with sentences) with those of their sentences that any pattern of facts can fit: their text, and a bit for each of TOLD that they hold."""
    at = lines.columns.index("sentences")
    made = T.StructType([T.StructField(f.name, T.ArrayType(T.StructType().add("text", T.StringType()).add("told", T.IntegerType()))) if f.name == "sentences" else f for f in lines.schema])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts, row = pc.list_flatten(batch.column(at)), pc.list_parent_indices(batch.column(at))
            held = pc.match_substring_regex(texts, FACT_HINTS)
            texts, row = texts.filter(held), row.filter(held)
            told = np.zeros(len(texts), np.int32)
            for bit, hints in enumerate(TOLD.values()):
                told |= pc.match_substring_regex(texts, hints).to_numpy(zero_copy_only=False).astype(np.int32) << bit
            ends = np.cumsum(np.bincount(row.to_numpy(), minlength=len(batch)), dtype=np.int32)
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), pa.StructArray.from_arrays([texts, pa.array(told)], ["text", "told"]))
            yield batch.set_column(at, batch.schema.field(at).with_type(kept.type), kept)

    return lines.mapInArrow(run, made)


def tells(sentence: Column, name: str) -> Column:
    """Whether a sentence (of ``telling``) holds what the patterns of a name need."""
    return sentence["told"].bitwiseAND(F.lit(1 << [*TOLD].index(name))) != 0


def spread(rows: DataFrame) -> DataFrame:
    """Lines dealt over tasks by their files: four a core, however few tasks or bytes they came in."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "path")


def all_of(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def node_rows(rows: DataFrame, kind: Column | str, label: Column | str, prefix: str, confidence: str, **more: Column | str) -> DataFrame:
    """Rows (with path, kind, line, line_text) as nodes; ids come from what a node is and where it stands."""
    text = lambda c, t="string": (F.lit(None).cast(t) if c is None else F.lit(c) if isinstance(c, str) else c).cast(t)
    label, kind = text(label), text(kind)
    canonical, page, quote = more.get("canonical_name", label), more.get("page"), more.get("quote", F.trim("line_text"))
    start, end = more.get("start_line", F.col("line")), more.get("end_line", F.col("line"))
    out = rows.select(
        kind.alias("node_kind"), label.alias("label"), text(canonical).alias("canonical_name"), F.col("kind").alias("artifact_kind"), "path",
        start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), text(page, "int").alias("page"), F.lit(confidence).alias("confidence"),
        *[text(more.get(c)).alias(c) for c in ("method", "endpoint", "reference_type", "subject")], quote.alias("quote"),
    ).withColumnRenamed("node_kind", "kind")
    made = content_id(prefix, "path", "kind", "label", "canonical_name", "start_line", "end_line")
    return out.withColumn("id", made).select(*NODE)


def edge_rows(rows: DataFrame, src: Column, dst: Column, relation: Column | str, confidence: str = "EXACT_STATIC", extractor: str = "code_fast_graph", score: float = 1.0) -> DataFrame:
    relation = F.lit(relation) if isinstance(relation, str) else relation
    out = rows.select(src.alias("src"), dst.alias("dst"), relation.alias("relation"), F.lit(confidence).alias("confidence"), F.lit(score).alias("score"), F.lit(extractor).alias("extractor"))
    return out.where("src is not null and dst is not null").withColumn("id", content_id("edge", "src", "dst", "relation", "extractor")).select(*EDGE)


#: What a match in a line says of a node, in the order of its fields: those of its id, then those by which the first of equal nodes is told.
SPOT = ["prefix", "kind", "label", "canonical_name", "branch", "quote", "confidence", "method", "endpoint", "reference_type", "subject"]


def _spot(branch: int, kind: Column | str, label: Column, prefix: str, confidence: str, quote: Column, **more: Column | str | None) -> Column:
    """A match as a struct of SPOT; ``branch`` says which of equal nodes stays."""
    text = lambda c: (F.lit(c) if c is None or isinstance(c, str) else c).cast("string")
    given = {"prefix": prefix, "kind": kind, "label": label, "canonical_name": label, "confidence": confidence, "quote": quote} | more
    return F.struct(*[F.lit(branch).alias(c) if c == "branch" else text(given.get(c)).alias(c) for c in SPOT])


def _if(condition: Column, spot: Column) -> Column:
    return F.array_compact(F.array(F.when(condition, spot)))


def _spotted(rows: DataFrame, spots: list[Column], page: Column | None = None, once: bool = False) -> DataFrame:
    """Nodes of the matches of each row (path, kind, line), gathered in one pass: one array a row, exploded once, with their branch.

    With ``once`` of equal nodes of a row the first by branch and quote; where a line is one row, that needs no shuffle."""
    sheet = F.lit(None).cast("int") if page is None else page.cast("int")
    made = F.concat(*spots)
    if once:
        same = lambda a, b: reduce(lambda x, y: x & y, [a[c] == b[c] for c in SPOT[:4]])
        # the sorted array is the variable of a lambda, and exploded where it is made: as a column it would be made again wherever it is read
        made = F.flatten(F.transform(F.array(F.array_sort(made)), lambda a: F.filter(a, lambda s, i: (i == 0) | ~same(s, F.get(a, i - 1)))))
    found = rows.select("path", F.col("kind").alias("artifact_kind"), F.col("line").cast("int").alias("start_line"), F.col("line").cast("int").alias("end_line"), sheet.alias("page"), F.explode(made).alias("s"))
    found = found.select("path", "artifact_kind", "start_line", "end_line", "page", *[F.col(f"s.{c}").alias(c) for c in SPOT]).where("label <> ''")
    made = F.concat("prefix", content_id("", "path", "kind", "label", "canonical_name", "start_line", "end_line"))
    return found.withColumn("id", made).select(*NODE, "branch")


def _clean_name(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, "[\"`]", ""), r"\."), -1)


def _matches(rows: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """A row for each match of a pattern in a line; ``m`` is its group."""
    return rows.withColumn("m", F.explode(F.regexp_extract_all("line_text", F.lit(pattern), F.lit(group)))).where("m <> ''")


def code_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of code, SQL, OpenAPI and config files.

    Nodes: File, Module, Class, Function, Method, Endpoint, Table, Column, ConfigKey. A definition reaches to where
    its indent or its braces end, which is its quote; it is a method if the innermost one around it is a class. A
    route's handler is the one that it names, if defined above it, or else the next definition below it."""
    code = spread(lines.where("kind in ('code', 'sql', 'openapi', 'config')"))
    files = code.groupBy("path", "kind").agg(F.max("line").alias("last"), F.min_by("line_text", "line").alias("line_text")).withColumn("line", F.lit(1))
    file_nodes = node_rows(files, "File", F.col("path"), "code", "EXACT_STATIC", end_line=F.col("last"))
    scripts = files.where("kind = 'code'")
    module = F.replace(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("/"), F.lit("."))
    module_nodes = node_rows(scripts, "Module", module, "code", "EXACT_STATIC", end_line=F.col("last"))
    file_ids = file_nodes.select("path", F.col("id").alias("file_id"))
    by_path = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    braces = F.length(F.regexp_replace("line_text", r"[^{]", "")) - F.length(F.regexp_replace("line_text", r"[^}]", ""))
    known = code.withColumn("depth", F.coalesce(F.sum(braces).over(by_path), F.lit(0))).withColumn("indent", F.length(F.regexp_extract("line_text", r"^(\s*)", 1)))

    found = F.lit(None).cast("struct<kind:string,name:string>")
    for suffix, kind, pattern in reversed(DEFINITIONS):
        hit = F.regexp_extract("line_text", pattern, 1)
        found = F.when(F.col("path").rlike(suffix) & (hit != ""), F.struct(F.lit(kind).alias("kind"), hit.alias("name"))).otherwise(found)
    known = known.withColumn("def", F.when(F.col("kind") == "code", found))
    known = checkpoint(known)  # read by every branch below
    kinds = {r["kind"] for r in known.select("kind").distinct().collect()}  # four at most; sorts of files that are not there cost nothing
    nodes, edges = [file_nodes], []
    if "code" in kinds:
        _code(known, module_nodes, file_ids, nodes, edges)
    if "sql" in kinds:
        _sql(known, file_ids, nodes, edges)
    if kinds & {"openapi", "config"}:
        _keys(code, known, file_ids, nodes, edges)
    if not edges:
        edges.append(edge_rows(file_nodes.where("false"), F.col("id"), F.col("id"), "DEFINES"))
    return all_of(nodes).dropDuplicates(["id"]), all_of(edges).dropDuplicates(["id"])


def _code(known: DataFrame, module_nodes: DataFrame, file_ids: DataFrame, nodes: list[DataFrame], edges: list[DataFrame]) -> None:
    """Definitions, imports and routes of code files, added to ``nodes`` and ``edges``."""
    module_nodes = checkpoint(module_nodes)
    tops = module_nodes.select("path", F.col("id").alias("module_id"))
    defs = _scopes(known.where("kind = 'code'")).where("owner_line is not null or def_kind <> 'Method'")
    def_kind = F.when(F.col("owner_line").isNotNull(), "Method").otherwise(F.col("def_kind"))
    full = F.when(F.col("owner_line").isNotNull(), F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))
    def_nodes = node_rows(defs, def_kind, F.col("name"), "code", "EXACT_STATIC", canonical_name=full, end_line=F.col("last"), quote=F.col("body"), subject=F.col("owner_line").cast("string"))
    def_nodes = checkpoint(def_nodes)  # read by its edges and by every route
    # subject holds the line of the class for a moment
    classes = def_nodes.where("kind = 'Class'").select("path", F.col("start_line").cast("string").alias("subject"), F.col("id").alias("class_id"))
    placed = def_nodes.join(tops, "path").join(classes, ["path", "subject"], "left")
    def_nodes = def_nodes.withColumn("subject", F.lit(None).cast("string"))
    under = F.coalesce("class_id", "module_id")
    edges += [edge_rows(placed.select(under.alias("u"), "id").distinct(), F.col("u"), F.col("id"), "DEFINES"), edge_rows(module_nodes.join(file_ids, "path"), F.col("file_id"), F.col("id"), "DEFINES")]
    nodes += [module_nodes, def_nodes]

    line, trimmed = F.col("line_text"), F.trim("line_text")
    matches = lambda pattern, group=1: F.regexp_extract_all(line, F.lit(pattern), F.lit(group))
    named = [F.transform(F.when(F.col("path").rlike(suffix), matches(pattern)).otherwise(F.array().cast("array<string>")), lambda m: _spot(0, "Module", m, "code", "EXACT_STATIC", trimmed, reference_type="import")) for suffix, pattern in IMPORTS]
    routed = []
    for i, (suffix, pattern) in enumerate(ROUTES, 1):
        verb = F.upper(F.regexp_extract("line_text", pattern, 1))
        verb = F.when(verb == "REQUEST", "GET").otherwise(verb)
        route = F.coalesce(F.nullif(F.regexp_extract("line_text", pattern, 2), F.lit("")), F.lit("/"))
        handler = F.nullif(F.regexp_extract("line_text", pattern, 3), F.lit("")) if suffix == SCRIPT else None
        hit = _spot(i, "Endpoint", F.concat(verb, F.lit(" "), route), "code", "EXACT_STATIC", trimmed, canonical_name=route, method=verb, endpoint=route, subject=handler)
        routed.append(_if(F.col("path").rlike(suffix) & line.rlike(pattern), hit))
    spotted = checkpoint(_spotted(known.where("kind = 'code'"), [*named, *routed]))
    imports, hits = spotted.where("branch = 0"), spotted.where("branch > 0")
    nodes.append(spotted.drop("branch"))
    edges.append(edge_rows(imports.join(tops, "path"), F.col("module_id"), F.col("id"), "IMPORTS"))
    nearest = _handlers(hits, def_nodes.where("kind in ('Function', 'Method')"))
    edges.append(edge_rows(nearest, F.col("id"), F.col("handler_id"), "ROUTE_TO_HANDLER"))
    decorated = F.col("path").rlike(r"\.py$")  # a decorator stands at its handler
    edges.append(edge_rows(nearest.where(decorated), F.col("handler_id"), F.col("id"), "REFERENCES"))
    edges.append(edge_rows(hits.where(~decorated).join(tops, "path"), F.col("module_id"), F.col("id"), "REFERENCES"))


def _sql(known: DataFrame, file_ids: DataFrame, nodes: list[DataFrame], edges: list[DataFrame]) -> None:
    """Tables and columns of SQL files, added to ``nodes`` and ``edges``."""
    by_path = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    sql = known.where("kind = 'sql'")
    created, used = _matches(sql, SQL_CREATE), _matches(sql, SQL_USE)
    touched = created.withColumn("how", F.lit("DEFINES")).unionByName(used.withColumn("how", F.lit("QUERY_TOUCHES_TABLE"))).withColumn("name", _clean_name(F.col("m")))
    tables = first_per_key(touched, ["path", "name"], F.col("line"), F.col("how"))
    table_nodes = node_rows(tables, "Table", F.col("name"), "code", "EXACT_STATIC")
    table_ids = table_nodes.select("path", F.col("label").alias("name"), F.col("id").alias("table_id"))
    edges.append(edge_rows(touched.select("path", "name", "how").distinct().join(table_ids, ["path", "name"]).join(file_ids, "path"), F.col("file_id"), F.col("table_id"), F.col("how")))
    create = F.nullif(F.regexp_extract("line_text", SQL_CREATE, 1), F.lit(""))
    closed = F.col("line_text").contains(");") | F.trim("line_text").startswith(")")
    state = F.when(create.isNotNull(), _clean_name(create)).when(closed, F.lit(""))
    columns = sql.withColumn("table", F.last(state, ignorenulls=True).over(by_path)).where((F.col("table") != "") & create.isNull() & ~closed)
    columns = columns.withColumn("name", _clean_name(F.regexp_extract("line_text", SQL_COLUMN, 1))).where("name <> '' and upper(name) not in ('CONSTRAINT', 'PRIMARY', 'FOREIGN', 'UNIQUE', 'CHECK')")
    column_nodes = node_rows(columns, "Column", F.col("name"), "code", "EXACT_STATIC", canonical_name=F.concat("table", F.lit("."), "name"), subject=F.col("table"))
    edges.append(edge_rows(column_nodes.join(table_ids.withColumnRenamed("name", "subject"), ["path", "subject"]), F.col("table_id"), F.col("id"), "CONTAINS"))
    nodes += [table_nodes, column_nodes]


def _keys(code: DataFrame, known: DataFrame, file_ids: DataFrame, nodes: list[DataFrame], edges: list[DataFrame]) -> None:
    """Keys and endpoints of OpenAPI and config files, added to ``nodes`` and ``edges``."""
    by_path = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    whole = code.where("path like '%.json' and kind in ('openapi', 'config')").groupBy("path", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "line_text"))), lambda s: s["line_text"]), "\n").alias("doc"))
    json_keys = checkpoint(_json_keys(whole))
    keyed = known.where("kind in ('openapi', 'config')").join(json_keys.select("path").distinct(), "path", "left_anti")  # JSON that doesn't parse is read by line
    keyed = keyed.withColumn("key", F.regexp_replace(F.regexp_extract("line_text", YAML_KEY, 2), "^['\"]+|['\"]+$", ""))
    key_nodes = node_rows(keyed.where("key <> ''"), "ConfigKey", F.col("key"), "code", "EXACT_STATIC")
    route = F.last(F.when(F.col("key").startswith("/"), F.col("key")), ignorenulls=True).over(by_path)
    verb = F.upper(F.regexp_extract("line_text", YAML_METHOD, 1))
    api = keyed.where("kind = 'openapi'").withColumn("route", route).withColumn("verb", verb).where("verb <> '' and route is not null")
    api_json = json_keys.where("kind = 'openapi' and size(above) = 2 and above[0] = 'paths' and lower(key) in ('get', 'post', 'put', 'patch', 'delete', 'head', 'options')")
    api_json = api_json.select("path", "kind", F.col("above_line").alias("line"), F.col("above_text").alias("line_text"), F.expr("above[1]").alias("route"), F.upper("key").alias("verb"))
    api = api.select("path", "kind", "line", "line_text", "route", "verb").unionByName(api_json)
    api_nodes = node_rows(api, "Endpoint", F.concat("verb", F.lit(" "), "route"), "code", "EXACT_STATIC", canonical_name=F.col("route"), method=F.col("verb"), endpoint=F.col("route"))
    json_nodes = node_rows(json_keys, "ConfigKey", F.col("key"), "code", "EXACT_STATIC", canonical_name=F.col("dotted"))
    keys = key_nodes.unionByName(json_nodes)
    edges += [edge_rows(keys.join(file_ids, "path"), F.col("file_id"), F.col("id"), "CONTAINS"), edge_rows(api_nodes.join(file_ids, "path"), F.col("file_id"), F.col("id"), "DEFINES")]
    nodes += [keys, api_nodes]


def _handlers(routes: DataFrame, functions: DataFrame) -> DataFrame:
    """``routes`` with handler_id: of a script's route the last function above it of the name it gives (subject), else the next function below it.

    An as-of join: routes and functions of a file (and name) are one run of lines, over which the last or the next function is carried, so a
    file of many routes and functions makes no pairs."""
    script = F.col("path").rlike(SCRIPT)
    lines = functions.select("path", F.col("label").alias("name"), F.col("start_line").alias("at"), F.struct("start_line", F.col("id").alias("handler_id")).alias("f"), F.lit(0).alias("sort"), F.lit(None).cast("string").alias("id"))
    asks = routes.select("path", F.col("subject").alias("name"), F.col("start_line").alias("at"), F.lit(None).cast(lines.schema["f"].dataType).alias("f"), F.lit(1).alias("sort"), "id")
    above = Window.partitionBy("path", "name").orderBy("at", "sort", "f.handler_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = lines.unionByName(asks).where(script & F.col("name").isNotNull()).withColumn("f", F.last("f", ignorenulls=True).over(above)).where("sort = 1")
    # functions of a route's own line stand before it, so they are not below it; read from the end, as a frame that reaches to the end is summed anew for each row
    order = Window.partitionBy("path").orderBy(F.desc("at"), F.desc("sort"), F.desc("f.handler_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = lines.unionByName(asks).where(~script).withColumn("f", F.last("f", ignorenulls=True).over(order)).where("sort = 1")
    found = named.select("id", F.col("f.handler_id").alias("handler_id")).unionByName(following.select("id", F.col("f.handler_id").alias("handler_id"))).where("handler_id is not null")
    return routes.select("id", "path").distinct().join(found.distinct(), "id")


def _scopes(code: DataFrame) -> DataFrame:
    """A row for each definition of code lines (with def, indent, depth): path, kind, line, line_text, last (line), body, name,
    def_kind, and owner and owner_line if the innermost definition around it is a class. Files are runs of sorted lines, of which one at a time is held."""

    def placed(path: str, rows: list[tuple]) -> list[tuple]:
        """The definitions of a file, from its lines in order (line, line_text, indent, depth, def_kind, name)."""
        python, out, open_, full = path.endswith(".py"), [], [], 0  # open_: (row of out, indent or depth, whether its body has begun)

        def close(last: int) -> None:
            out[open_.pop()[0]]["last"] = max(last, 0)

        for i, (line, text, indent, depth, kind, name) in enumerate(rows):
            if not text.strip():
                continue
            if python:
                while open_ and indent <= open_[-1][1] and not text.strip().startswith(("#", ")", "]", "}")):
                    close(full)
            else:
                while open_ and depth <= open_[-1][1] and (open_[-1][2] or name is not None):
                    close(full)
                if open_ and depth > open_[-1][1]:
                    open_[-1][2] = True
            full = i
            if name is not None:
                around = out[open_[-1][0]] if open_ else None
                owned = around is not None and around["def_kind"] == "Class" and kind != "Class"
                out.append({"at": i, "last": i, "name": name, "def_kind": kind, "owner": around["name"] if owned else None, "owner_line": rows[around["at"]][0] if owned else None})
                open_.append([len(out) - 1, indent if python else depth, not python and ("{" in text or text.rstrip().endswith((";", ",")))])
        while open_:
            close(full)
        return [(path, "code", rows[d["at"]][0], rows[d["at"]][1], rows[d["last"]][0], "\n".join(r[1] for r in rows[d["at"] : d["last"] + 1]).strip(), d["name"], d["def_kind"], d["owner"], d["owner_line"]) for d in out]

    def run(batches):
        import pyarrow as pa

        def lines():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        schema = pa.schema([(c, pa.int32() if t == "int" else pa.string()) for c, t in (x.split() for x in made.split(", "))])
        rows = (d for path, held in groupby(lines(), key=lambda r: r[0]) for d in placed(path, [r[1:] for r in held]))
        while part := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    made = "path string, kind string, line int, line_text string, last int, body string, name string, def_kind string, owner string, owner_line int"
    rows = code.select("path", "line", "line_text", "indent", "depth", F.col("def.kind").alias("def_kind"), F.col("def.name").alias("name"))
    return spread(rows).sortWithinPartitions("path", "line").mapInArrow(run, made)


#: A JSON token after white space: a string, a sign, or a scalar, as Python reads it (NaN and Infinity too).
TOKEN = re.compile(
    r"""[ \t\n\r]*(?:("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")|([{}\[\],:])"""
    r"""|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])|true|false|null|NaN|-?Infinity))"""
)
#: Keys above a key that its dotted name has, at most: the nearest.
ABOVE = 100
#: Characters of a long line that a key quotes, from the key on.
LONG_LINE = 500


def json_places(doc: str) -> Iterator[tuple[str, list[str], int, int]]:
    """(key, keys above it, offset, offset of the key above it or -1) of each key of each object in a JSON object, lists included.

    Raises ValueError where the text is no JSON object (something follows it, or it is cut). One pass without recursion, so neither depth nor
    size matters."""
    stack: list[list] = []  # of open objects and lists: is it an object, its key now, that key's offset, whether the key is in ``path``, the key's offset above it
    path: list[str] = []
    at, want = 0, "value"
    while True:
        m = TOKEN.match(doc, at)
        if m is None or (not stack and (want != "value" or m[2] != "{")):
            if m is None and not stack and want != "value" and not doc[at:].strip(" \t\n\r"):
                return
            raise ValueError(f"no JSON object: {at}")
        at = m.end()
        text, sign = m[1], m[2]
        ends = sign is not None and bool(stack) and sign == ("}" if stack[-1][0] else "]")
        if want.startswith("key") and text:
            key = json.loads(text)
            yield key, path[-ABOVE:], m.start(1), stack[-1][4]
            stack[-1][1:3] = key, m.start(1)
            want = "colon"
        elif want == "colon" and sign == ":":
            want = "value"
        elif want.startswith("value") and sign in ("{", "["):
            if stack and stack[-1][0]:
                path.append(stack[-1][1])
                stack[-1][3] = True
            over = (stack[-1][2] if stack[-1][0] else stack[-1][4]) if stack else -1
            stack.append([sign == "{", None, -1, False, over])
            want = "key or end" if sign == "{" else "value or end"
        elif want.startswith("value") and (text or m[3]):
            want = "comma or end"
        elif want.endswith("or end") and ends:
            stack.pop()
            if stack and stack[-1][3]:
                path.pop()
                stack[-1][3] = False
            want = "comma or end"
        elif want == "comma or end" and sign == ",":
            want = "key" if stack[-1][0] else "value"
        else:
            raise ValueError(f"no JSON object: {at}")


def line_at(doc: str, at: int) -> str:
    """The line around an offset; of a long line what follows the offset."""
    start = doc.rfind("\n", max(0, at - LONG_LINE), at) + 1
    end = doc.find("\n", at, at + LONG_LINE)
    return doc[at if not start and at > LONG_LINE else start : end if end >= 0 else at + LONG_LINE]


def _json_keys(files: DataFrame) -> DataFrame:
    """A row for each key of each object of JSON files (path, kind, doc), at any depth: key, dotted (with the keys above), above, and the
    place where it stands first (line, line_text) and that of the key above it; 1 if there is none. Files that are no JSON object have no row.

    Objects inside lists count as those around the list. A long line is quoted from the key on."""

    def rows_of(path: str, kind: str, doc: str) -> Iterator[tuple]:
        try:
            for _ in json_places(doc):  # is it one, to its end?
                pass
        except ValueError:
            return
        ends, seen = [m.start() for m in re.finditer("\n", doc)], set()
        for key, above, at, over in json_places(doc):
            dotted = ".".join([*above, key])
            if dotted not in seen:
                seen.add(dotted)
                yield path, kind, bisect_left(ends, at) + 1, line_at(doc, at), key, dotted, above, bisect_left(ends, max(over, 0)) + 1, line_at(doc, max(over, 0))

    def keys(batches):
        import pandas as pd

        for batch in batches:
            rows = (r for path, kind, doc in batch.itertuples(index=False) for r in rows_of(path, kind, doc))
            while part := list(islice(rows, 10_000)):
                yield pd.DataFrame(part, columns=columns)

    columns = ["path", "kind", "line", "line_text", "key", "dotted", "above", "above_line", "above_text"]
    made = "path string, kind string, line int, line_text string, key string, dotted string, above array<string>, above_line int, above_text string"
    return files.select("path", "kind", "doc").mapInPandas(keys, made)


def markdown_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of Markdown: Document, Section, Paragraph, Table, CodeBlock, and CONTAINS between them.

    A section ends before the next heading; its parent is the last heading of a lower level. A block is a run of
    lines of one sort: fenced code, table rows, or text without an empty line."""
    doc = spread(lines.where("kind = 'markdown'"))
    by_path = Window.partitionBy("path").orderBy("line")
    fence = F.col("line_text").rlike(r"^\s*(```+|~~~+)")
    fences = F.sum(F.when(fence, 1).otherwise(0)).over(by_path.rowsBetween(Window.unboundedPreceding, 0))
    coded = (fences % 2 == 1) | fence
    level = F.when(~coded, F.length(F.regexp_extract("line_text", HEADING, 1))).otherwise(0)
    rows = doc.withColumn("coded", coded).withColumn("level", level)
    sort = F.when(F.col("coded"), "CodeBlock").when(F.col("level") > 0, "Section").when(F.trim("line_text") == "", "").when(F.col("line_text").rlike(r"^\s*\|.*\|\s*$"), "Table").otherwise("Paragraph")
    rows = rows.withColumn("sort", sort)
    edge = (F.col("sort") != F.lag("sort", 1, "").over(by_path)) | (F.col("sort") == "Section") | (fence & (fences % 2 == 1))
    rows = rows.withColumn("block", F.sum(F.when(edge, 1).otherwise(0)).over(by_path.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.where("sort <> ''").groupBy("path", "kind", "block", "sort").agg(
        F.min("line").alias("line"), F.max("line").alias("last"), F.max("level").alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "line_text"))), lambda s: s["line_text"]), "\n").alias("line_text"),
    )
    blocks = checkpoint(blocks)  # read by sections, by other blocks and by the ends of both
    title = F.regexp_extract("line_text", HEADING, 2)
    titles = blocks.where("sort = 'Section'").groupBy("path").agg(F.min_by(title, "line").alias("title"))
    total = checkpoint(doc.groupBy("path", "kind").agg(F.max("line").alias("last")))
    total = total.join(titles, "path", "left")
    documents = total.withColumn("line", F.lit(1)).withColumn("line_text", F.coalesce("title", F.regexp_extract("path", r"([^/]*?)(\.[^.]*)?$", 1)))
    document_nodes = node_rows(documents, "Document", F.col("line_text"), "md", "DOC_EXACT", end_line=F.col("last"))
    heads = blocks.where("sort = 'Section'").join(total.select("path", F.col("last").alias("all")), "path")
    heads = heads.withColumn("end", F.coalesce(F.lead("line").over(by_path) - 1, F.col("all")))
    section_nodes = node_rows(heads, "Section", title, "md", "DOC_EXACT", end_line=F.col("end"), subject=F.col("level").cast("string"))
    others = blocks.where("sort <> 'Section'")
    block_nodes = node_rows(others, F.col("sort"), short("line_text", 96, compact=True), "md", "DOC_EXACT", end_line=F.col("last"), quote=F.col("line_text"))
    top = document_nodes.select("path", F.col("id").alias("document_id"))
    own = F.when(F.col("kind") == "Section", F.col("subject").cast("int")).otherwise(99)
    parts = section_nodes.unionByName(block_nodes).withColumn("own", own)
    # the last heading of each level above a part, and of those with a lower level than its own the nearest
    above = Window.partitionBy("path").orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    heads = [F.last(F.when(F.col("own") == n, F.struct(F.col("start_line").alias("at"), F.col("id").alias("outer_id"))), ignorenulls=True).over(above) for n in range(1, 7)]
    nearest = F.greatest(*[F.when(F.col("own") > n, h) for n, h in enumerate(heads, 1)])
    held = parts.withColumn("outer_id", nearest["outer_id"]).join(top, "path")
    edges = edge_rows(held, F.coalesce("outer_id", "document_id"), F.col("id"), "CONTAINS", "DOC_EXACT", "markdown")
    return all_of([document_nodes, section_nodes, block_nodes]), edges


def mentions(lines: DataFrame, numbered: bool = True) -> DataFrame:
    """Nodes that document lines name: endpoints, files, functions, config keys, statuses, rules and class candidates.

    Of nodes with the same kind, label and place the first by the order of the branches stays: among those of a row, and of all rows where
    these are not ``numbered`` lines of which each is there once."""
    doc = lines.where("kind in ('markdown', 'pdf')")
    line, quote = F.col("line_text"), F.trim("line_text")
    none = F.array().cast("array<string>")

    def matches(pattern: str, group: int = 1, *signs: str, hint: str | None = None) -> Column:
        """What a pattern finds in a line, if the line has one of the signs or the hint that every match has."""
        found = F.filter(F.regexp_extract_all(line, F.lit(pattern), F.lit(group)), lambda m: m != "")
        told = [line.contains(s) for s in signs] + [line.rlike(h) for h in [hint] if h]
        return F.when(reduce(Column.__or__, told), found).otherwise(none)

    spot = lambda branch, kind, label, confidence="DOC_EXACT", **more: _spot(branch, kind, label, "md", confidence, quote, **more)
    is_key = lambda m: m.rlike(f"^{CONFIG_KEY[2:-2]}$")
    is_status = lambda m: m.rlike(r"^[A-Z][A-Z0-9_]{2,}$") & ~m.isin(NO_STATUS)
    sort = lambda m: F.when(m.rlike(f"^(?:{FILE_PATH})$"), "file_path").when(m.rlike(r"^[A-Za-z_$][\w$.]*\(\)$"), "function").when(is_key(m), "config_key").when(is_status(m), "status_value")
    marks, links = matches(r"`([^`\n]+)`", 1, "`"), matches(r"\[[^\]]+\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)", 1, "](")
    is_api = lambda m: m.rlike(r"^/api/|^/[a-z]")
    spots = [
        F.transform(matches(ENDPOINT, 0, "/"), lambda m: spot(0, "APIReference", m, method=F.regexp_extract(m, ENDPOINT, 1), endpoint=F.regexp_extract(m, ENDPOINT, 2))),
        F.transform(matches(BARE_API, 1, "/"), lambda m: spot(1, "APIReference", m, endpoint=m)),
        F.transform(F.filter(links, is_api), lambda m: spot(2, "APIReference", m)),
        F.transform(F.filter(links, lambda m: ~is_api(m)), lambda m: spot(3, "CodeReference", m, reference_type=F.when(m.rlike(f"^(?:{FILE_PATH})$"), "file_path").otherwise("link"))),
        F.transform(F.filter(marks, lambda m: sort(m) != "status_value"), lambda m: spot(4, "CodeReference", m, reference_type=sort(m))),
        F.transform(F.filter(marks, lambda m: sort(m) == "status_value"), lambda m: spot(5, "StatusValue", m, reference_type="status_value")),
        F.transform(F.filter(matches(FILE_PATH, 0, "/", hint=r"\.[a-z]"), lambda m: ~m.contains("://")), lambda m: spot(6, "CodeReference", m, reference_type="file_path")),
        F.transform(matches(FUNCTION, 1, "("), lambda m: spot(7, "CodeReference", F.concat(m, F.lit("()")), reference_type="function")),
        F.transform(matches(CONFIG_KEY, hint=DOTTED), lambda m: spot(8, "CodeReference", m, reference_type="config_key")),
        F.transform(F.filter(matches(STATUS_MENTION, hint=UPPER), lambda m: ~m.isin(NO_STATUS)), lambda m: spot(9, "StatusValue", m, reference_type="status_value")),
        F.transform(F.filter(matches(PASCAL, hint=CAMEL), lambda m: ~m.isin("HTTP", "JSON", "YAML", "SQL")), lambda m: spot(11, "CodeReference", m, "AMBIGUOUS", reference_type="class_candidate")),
    ]

    def of_sentence(said: Column) -> Column:
        text, rule = said["text"], F.lit(None).cast("string")
        for kind, pattern in reversed(SENTENCES):
            rule = F.when(tells(said, kind) & text.rlike(pattern), kind).otherwise(rule)
        sentence = _if(rule.isNotNull(), _spot(10, rule, short(text, 96, compact=True), "md", "DOC_INFERRED", text))
        return F.concat(sentence, *_fact_spots(12, said))

    found = _spotted(_with_sentences(doc), [*spots, F.flatten(F.transform("sentences", of_sentence))], once=True)
    return (found if numbered else first_per_key(found, ["id"], F.col("branch"), F.col("quote"))).select(*NODE)


def _with_sentences(lines: DataFrame) -> DataFrame:
    """Lines in which something may be found, with the list of those sentences in which facts may be, dealt evenly over tasks."""
    return telling(spread(fitting(lines.where("trim(line_text) <> ''"), "line_text", HINTS)).withColumn("sentences", sentences("line_text")))


def _first_field(text: Column) -> Column:
    """The field that a sentence is about: the first in backticks that looks like one, else the first beside a word for field, else the first that looks like one."""
    marked = F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), F.lit(1)), looks_like_field), F.lit(1))
    beside = [F.nullif(F.regexp_extract(text, FIELD_CONTEXT, g), F.lit("")) for g in (1, 2, 3)]
    return F.coalesce(marked, *beside, F.nullif(F.regexp_extract(text, FIELD, 1), F.lit("")), F.lit("input"))


def looks_like_field(c: Column) -> Column:
    return c.rlike(f"^(?:{FIELD})$") & (F.length(c) <= 80)


def _fact_spots(branch: int, said: Column) -> list[Column]:
    """The facts of a sentence (of ``telling``), every match of it; branches from ``branch`` on."""
    text, none = said["text"], F.array().cast("array<string>")
    nth = iter(range(branch, branch + 20))
    spot = lambda kind, label, confidence, **more: _spot(next(nth), kind, label, "sb", confidence, text, **more)
    matches = lambda pattern, group=1: F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: m != "")

    def each(pattern: str, groups: int) -> Column:
        """Of every match the first of its groups that is set; the text is searched once, and of each match its groups."""
        of_match = lambda m: F.coalesce(*[F.nullif(F.regexp_extract(m, pattern, g), F.lit("")) for g in range(1, groups + 1)], F.lit(""))
        return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_match), lambda m: m != "")

    def labels(found: Column) -> Column:
        bare = F.transform(found, lambda m: F.regexp_replace(m, r"^[ :-]+|[ :-]+$", ""))
        return F.transform(F.filter(bare, lambda e: (F.length(e) > 1) & (F.length(e) <= 80) & ~F.lower(e).isin(NO_LABEL)), lambda e: short(e, 96, compact=True))

    rule = F.lit(None).cast("string")
    for kind, pattern in reversed(RULES):
        rule = F.when(tells(said, f"rule {kind}") & text.rlike(pattern), kind).otherwise(rule)
    valid = F.when(tells(said, "validation"), F.regexp_extract(text, VALIDATION, 1)).otherwise("")
    warned = tells(said, "warned") & text.rlike(ERROR_HINT)
    given = lambda name, hint, found: F.when(tells(said, name) & (text.rlike(hint) if hint else F.lit(True)), found).otherwise(none)
    whole = short(text, 96, compact=True)
    fields = lambda found: F.transform(F.filter(found, looks_like_field), lambda m: spot("FormField", m, "DOC_EXACT", reference_type="form_field", subject=m))
    return [
        F.transform(given("status", None, matches(STATUS_WORD)), lambda m: spot("StatusValue", m, "DOC_EXACT", reference_type="status_value")),
        fields(given("field", FIELD_HINT, matches(FIELD))),
        fields(given("marked", None, matches(r"`([^`\n]+)`"))),
        fields(given("field", FIELD_HINT, each(FIELD_CONTEXT, 3))),
        _if(valid != "", spot("ValidationRule", valid, "DOC_INFERRED", subject=_first_field(text))),
        _if(rule.isNotNull(), spot(rule, whole, "DOC_INFERRED")),
        F.transform(labels(given("screen", SCREEN_HINT, each(SCREEN, 2))), lambda m: spot("Screen", m, "DOC_INFERRED")),
        F.transform(given("action", None, matches(ACTION)), lambda m: spot("UserAction", short(m, 96, compact=True), "DOC_INFERRED")),
        F.transform(given("korean", None, matches(KOREAN_ACTION)), lambda m: spot("UserAction", m, "DOC_INFERRED")),
        F.transform(F.when(warned, each(QUOTED, 5)).otherwise(none), lambda m: spot("ErrorMessage", m, "DOC_EXACT")),
        _if(warned & ~text.rlike(QUOTED), spot("ErrorMessage", whole, "DOC_INFERRED")),
        F.transform(labels(given("integration", INTEGRATION_HINT, each(INTEGRATION, 2))), lambda m: spot("ExternalIntegration", m, "DOC_EXACT")),
        F.transform(given("database", DATABASE_HINT, each(DATABASE, 3)), lambda m: spot("DatabaseEntity", m, "DOC_EXACT", reference_type="database_entity", subject=m)),
    ]


def facts(lines: DataFrame, page: Column | None = None, numbered: bool = True) -> DataFrame:
    """Fact nodes of sentences: statuses, fields, screens, actions, validation rules, error messages, permissions,
    policies, requirements, database entities and integrations; every match of a sentence is one.

    A page number, where the lines come from pages, goes along. Equal nodes are one as in ``mentions``."""
    found = _spotted(_with_sentences(lines), [F.flatten(F.transform("sentences", lambda said: F.concat(*_fact_spots(0, said))))], page, once=True)
    return (found if numbered else first_per_key(found, ["id"], F.col("branch"), F.col("quote"))).select(*NODE)
