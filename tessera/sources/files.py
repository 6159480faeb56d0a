"""Project files as a corpus table: discovery, ignore rules, kinds, hashes, text, lines and sentences."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import checkpoint

CORPUS = "path string, content binary"

# Kinds by suffix, folders and names that are never read.
CODE = ".c .cc .clj .cpp .cs .dart .ex .exs .fish .go .h .hpp .java .js .jsx .kt .lua .m .mm .pl .php .py .r .rb .rs .scala .sh .swift .ts .tsx .vue .zsh".split()
CONFIG = ".cfg .conf .env .gql .graphql .ini .json .toml .xml .yaml .yml".split()
MARKDOWN = ".md .markdown .mdx .sb .sourcebook".split()
IGNORED_FOLDERS = ".git .hg .next .pytest_cache .svn .venv __pycache__ build coverage dist node_modules target vendor venv".split()
IGNORED_NAMES = ".DS_Store *.gif *.generated.* *.jpeg *.jpg *.lock *.min.js *.mov *.mp3 *.mp4 *.png *.snapshot *.wav *.webp".split()


def file_system(root: str):
    """(pyarrow's file system, path in it) of a folder: a URI of a store that tasks can reach, or a local path (``file:/x`` as Hadoop writes it too)."""
    from pyarrow import fs

    local = re.match(r"file:/*(/.*)", root)
    if local or "://" not in root:
        return fs.LocalFileSystem(), local[1] if local else root
    return fs.FileSystem.from_uri(root)


def _children(root: str, folders: DataFrame) -> DataFrame:
    """path, folder and size of what lies in ``folders`` (paths below ``root``), listed by tasks; linked folders are not entered, a folder that can't be read has an error."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, top = file_system(root)
        schema = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("error", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                at = f"{top.rstrip('/')}/{path}".rstrip("/") or "/"
                try:
                    found = system.get_file_info(fs.FileSelector(at))
                except OSError as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "folder": True, "error": str(e)}], schema=schema)
                    continue
                rows = []
                for x in found:
                    is_folder = x.type == fs.FileType.Directory
                    if not (is_folder and system.type_name == "local" and os.path.islink(x.path)):
                        rows.append({"path": f"{path}/{x.base_name}" if path else x.base_name, "folder": is_folder, "size": None if is_folder else x.size})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return folders.select("path").repartition("path").mapInArrow(run, "path string, folder boolean, size long, error string")


def discover(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """path, folder, size, kind and state of all below ``root``, hidden names included: ignored, unsupported (of no known kind), unreadable, or to be indexed.

    Folders are listed level by level in tasks, through a file system that they reach; ignored folders have a row and are not entered. No file is read."""
    level, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        seen = checkpoint(_children(root, level))
        seen = seen.withColumn("kind", F.when(~F.col("folder"), classify("path"))).withColumn("_ignored", ignored("path", rules or []))
        state = F.when(F.col("error").isNotNull(), "unreadable").when(F.col("_ignored"), "ignored").when(F.col("folder"), "folder").when(F.col("kind").isNull(), "unsupported").otherwise("indexed")
        seen = seen.withColumn("state", state).drop("_ignored", "error")
        found = seen if found is None else found.unionByName(seen)
        level = seen.where("state = 'folder'").select("path")
        if level.isEmpty():
            return found.where("state <> 'folder'")


def discovery_counts(found: DataFrame) -> DataFrame:
    """total (files), ignored (files, and folders that were not entered), unsupported, unreadable and indexed of what was discovered."""
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    return found.agg(F.count_if(~F.col("folder")).alias("total"), *map(of, ("ignored", "unsupported", "unreadable", "indexed")))


def read_listed(root: str, paths: DataFrame) -> DataFrame:
    """path, content and error of files below ``root``, read by tasks; what can't be read has an error and no content."""

    def run(batches):
        import pyarrow as pa

        system, top = file_system(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with system.open_input_file(f"{top.rstrip('/')}/{path}") as f:
                        content, error = f.read(), None
                except OSError as e:
                    content, error = None, str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    return paths.select("path").repartition("path").mapInArrow(run, CORPUS + ", error string")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below ``root`` that can be read, hidden names included; ignored folders are not entered."""
    paths = discover(spark, root).where("not folder")
    return read_listed(root, paths).where("error is null").select("path", "content")


def read_project(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """The artifacts below ``root``; files that are ignored or of no known kind are not read."""
    rules = load_ignore_rules(root) if rules is None else rules
    listed = discover(spark, root, rules).where("state = 'indexed'")
    return artifacts(read_listed(root, listed).where("error is null"), rules)


def classify(path: str | Column) -> Column:
    """openapi, markdown, pdf, sql, code, config or null, from the name alone; the first that fits."""
    name = F.lower(F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1))
    suffix = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    openapi = name.rlike(r"^(openapi|swagger)\.(json|ya?ml)$|\.openapi\.(json|ya?ml)$")
    suffix = F.when(name.rlike(r"^\.[^.]*$"), "").otherwise(suffix)
    return F.when(openapi, "openapi").when(suffix.isin(MARKDOWN), "markdown").when(suffix == ".pdf", "pdf").when(suffix == ".sql", "sql").when(suffix.isin(CODE), "code").when(suffix.isin(CONFIG), "config")


def glob_pattern(glob: str) -> str:
    """Java regex of a glob whose ``*`` also crosses slashes."""
    out = ""
    for c in glob:
        out += ".*" if c == "*" else "." if c == "?" else "\\" + c if c in r"\.^$+{}[]()|" else c
    return out


def ignored(path: str, rules: list[str]) -> Column:
    """Whether the last of the ignore rules that fits a path ignores it (``!`` takes a path back).

    A rule with a slash at its end is a folder; one with a slash at its start fits the whole path; another with a
    slash fits the whole path or a folder of it; one without fits the name or the whole path. The folders that are
    never read are ignored whatever the rules say."""
    p = F.col(path)
    name, parts = F.element_at(F.split(p, "/"), -1), F.split(p, "/")
    verdict = F.lit(False)
    for rule in (r.strip() for r in [*IGNORED_NAMES, *rules]):
        if not rule or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        glob = rule[1:].strip() if negated else rule
        body = glob.strip("/")
        if not body:
            continue
        whole = f"^(?s:{glob_pattern(body)})$"
        if glob.endswith("/"):
            fits = p.startswith(body + "/") | (p == body) if "/" in body else F.array_contains(parts, body)
        elif glob.startswith("/"):
            fits = p.rlike(whole)
        elif "/" in body:
            fits = p.rlike(whole) | p.startswith(body + "/")
        else:
            fits = name.rlike(whole) | p.rlike(whole)
        verdict = F.when(fits, F.lit(not negated)).otherwise(verdict)
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED_FOLDERS])) | verdict


def load_ignore_rules(root: str, names: tuple[str, ...] = (".gitignore", ".tesseraignore")) -> list[str]:
    """The rules of the ignore files of a project, in the order of ``names``; a file that isn't there has none."""
    system, top = file_system(root)
    rules: list[str] = []
    for name in names:
        try:
            with system.open_input_file(f"{top.rstrip('/')}/{name}") as f:
                rules += f.read().decode("utf-8", "replace").splitlines()
        except OSError:  # there is none
            continue
    return rules


def artifacts(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """path, kind, content_hash and text of the files that are indexed: of a known kind and not ignored.

    Bytes that are no UTF-8 become replacement characters; a PDF has no text here (its pages come as a table)."""
    known = files.withColumn("kind", classify("path")).where("kind is not null")
    known = known.where(~ignored("path", rules or []))
    text = F.when(F.col("kind") != "pdf", F.make_valid_utf8(F.col("content").cast("string")))
    return known.select("path", "kind", F.sha2("content", 256).alias("content_hash"), text.alias("text"))


def lines(corpus: DataFrame) -> DataFrame:
    """path, kind, line (from 1) and its text; a break at the end of a text makes no further line."""
    split = F.split("text", r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085  ]")
    # the array is the variable of a lambda, so it is made once
    split = F.flatten(F.transform(F.array(split), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a)))
    rows = corpus.where("text is not null and text <> ''").select("path", "kind", F.posexplode(split).alias("at", "line_text"))
    return rows.select("path", "kind", (F.col("at") + 1).alias("line"), "line_text")


SENTENCE_END, MARKS = r"(?<=[.!?。！？])\s+", r"^[ \-•\t]+|[ \-•\t]+$"


def sentences(text: Column | str) -> Column:
    """The sentences of a line, bare of marks at the ends; empty ones are left out."""
    return F.filter(F.transform(F.split(F.trim(text), SENTENCE_END), lambda s: F.regexp_replace(s, MARKS, "")), lambda s: s != "")


def segments(line_rows: DataFrame) -> DataFrame:
    """Sentences of each line with their place in it, bare of marks at the ends."""
    rows = line_rows.select("*", F.posexplode(F.split(F.trim("line_text"), SENTENCE_END)).alias("nth", "raw"))
    return rows.withColumn("segment", F.regexp_replace("raw", MARKS, "")).where("segment <> ''").drop("raw")


def snippet(line_rows: DataFrame, path: str, start: int, end: int, max_lines: int = 80, max_chars: int = 8000) -> DataFrame:
    """The lines from ``start`` to ``end`` of a file, at most ``max_lines`` and ``max_chars`` (the last line is cut there); paths out of the project raise."""
    if path.startswith(("/", "\\")) or ".." in Path(path).parts:
        raise ValueError(f"not a path of the project: {path}")
    rows = line_rows.where((F.col("path") == path) & F.col("line").between(start, min(end, start + max_lines - 1)))
    before = F.sum(F.length("line_text") + 1).over(Window.partitionBy("path").orderBy("line")) - F.length("line_text") - 1
    rows = rows.withColumn("_before", before).where(F.col("_before") < max_chars)
    return rows.withColumn("line_text", F.expr(f"left(line_text, int({max_chars} - _before))")).drop("_before")


def chunks(line_rows: DataFrame, size: int = 120) -> DataFrame:
    """Texts of ``size`` lines each: path, start_line, end_line, text."""
    part = F.floor((F.col("line") - 1) / size)
    ordered = F.array_sort(F.collect_list(F.struct("line", "line_text")))
    rows = line_rows.groupBy("path", part.alias("part")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.array_join(F.transform(ordered, lambda s: s["line_text"]), "\n").alias("text"))
    return rows.drop("part")


def marked_sections(line_rows: DataFrame) -> DataFrame:
    """Sections that begin at ``::heading::`` lines: path, heading, start_line, end_line; what stands before has none."""
    heading = F.nullif(F.regexp_extract("line_text", r"^\s*::(.+?)::\s*$", 1), F.lit(""))
    line = Window.partitionBy("path").orderBy("line")
    rows = line_rows.withColumn("_head", heading).withColumn("_nth", F.count("_head").over(line))
    return rows.groupBy("path", "_nth").agg(F.max("_head").alias("heading"), F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("_nth")


SYMBOLS = "documents array<struct<relative_path:string,occurrences:array<struct<symbol:string,range:array<int>,symbol_roles:array<string>,syntax_kind:string>>>>"


def read_symbols(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(status, documents) of a compiler-symbol index in JSON: ``ok``, or ``unsupported_binary`` or
    ``unsupported_format`` with no documents. Roles that are numbers are bits: 1 is a definition."""
    none = spark.createDataFrame([], "relative_path string, occurrences array<struct<symbol:string,range:array<int>,symbol_roles:array<string>>>")
    raw = spark.read.format("binaryFile").load(path).select("content")
    kind = raw.select(F.is_valid_utf8(F.col("content").cast("string")).alias("text"), F.try_parse_json(F.make_valid_utf8(F.col("content").cast("string"))).isNotNull().alias("json")).first()
    if not kind["text"]:
        return "unsupported_binary", none
    if not kind["json"]:
        return "unsupported_format", none
    listed = raw.select(F.from_json(F.col("content").cast("string"), SYMBOLS, {"primitivesAsString": "false"}).alias("j")).select(F.explode("j.documents").alias("d"))
    role = lambda r: F.when(r.rlike(r"^\d+$"), F.when(r.try_cast("int").bitwiseAND(F.lit(1)) != 0, "Definition").otherwise("Reference")).otherwise(r)
    one = lambda o: F.struct(o["symbol"].alias("symbol"), o["range"].alias("range"), F.transform(F.coalesce(o["symbol_roles"], F.array().cast("array<string>")), role).alias("symbol_roles"))
    return "ok", listed.select(F.col("d.relative_path").alias("relative_path"), F.transform("d.occurrences", one).alias("occurrences"))
