"""Index runs: what changed, the graph of the corpus, links, and a status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import content_id
from tessera.operators import conflicts, links, retrieve, store
from tessera.operators.extract import EDGE, NODE, all_of, code_graph, edge_rows, facts, markdown_graph, mentions, node_rows
from tessera.operators.joins import small
from tessera.operators.lineage import checkpoint, written
from tessera.operators.nearest import closest_scope, covering
from tessera.operators.postings import postings
from tessera.sources.files import chunks, lines


@dataclass
class Index:
    """Tables of an index: nodes (with indexed_at), edges with links, lines of the corpus, and the stored postings of the nodes' quotes where it is loaded."""

    nodes: DataFrame
    edges: DataFrame
    lines: DataFrame
    postings: DataFrame | None = None

    def ask(self, task: str, **more) -> dict:
        return retrieve.retrieve(self.nodes, self.edges, task, postings=self.postings, **more)

    def search(self, words: str, limit: int = 8) -> DataFrame:
        """Evidence for a query: id, kind, label, quote, location, score and why."""
        found = self.ask(words, limit=limit)["evidence"]
        return found.select("id", "kind", "label", "quote", "location", "score", F.array_join("reasons", "+").alias("reason"))

    def conflicts(self) -> DataFrame:
        return conflicts.detect(conflicts.document_facts(self.nodes), conflicts.code_facts(self.lines, self.nodes))

    def status(self) -> DataFrame:
        return store.kind_counts(self.nodes)


def plan(artifacts: DataFrame, before: DataFrame) -> DataFrame:
    """path, kind and change of every file; unchanged files need no extraction."""
    return store.snapshot_diff(artifacts, before).join(artifacts.select("path", "kind"), "path", "left")


def page_nodes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of page texts (path, page, text): a Page for each, AMBIGUOUS if it has no text, and its facts."""
    rows = pages.select("path", F.lit("pdf").alias("kind"), F.lit(None).cast("int").alias("line"), "page", F.coalesce("text", F.lit("")).alias("line_text"))
    name = F.concat(F.lit("Page "), F.col("page").cast("string"))
    full, empty = rows.where("trim(line_text) <> ''"), rows.where("trim(line_text) = ''")
    page = lambda df, c: node_rows(df, "Page", name, "pdf", c, page=F.col("page"))
    sheets = page(full, "DOC_EXACT").unionByName(page(empty, "AMBIGUOUS"))
    split = full.select("path", "kind", "page", F.posexplode(F.split("line_text", "\n")).alias("at", "line_text")).withColumn("line", F.lit(None).cast("int"))
    found = checkpoint(facts(split, page=F.col("page"), numbered=False))
    relation = F.when(F.col("kind") == "ValidationRule", "SB_DEFINES_VALIDATION").when(F.col("kind") == "StatusValue", "SB_REFERENCES_STATUS").when(F.col("kind").isin("Requirement", "BusinessPolicy", "PermissionRule"), "SB_DEFINES_REQUIREMENT").otherwise("CONTAINS")
    held = found.join(sheets.select("path", "page", F.col("id").alias("page_id")), ["path", "page"])
    api = mentions(split, numbered=False).where("kind = 'APIReference'")
    whole = rows.groupBy("path", "kind").agg(F.min("page").alias("page"), F.lit(None).cast("int").alias("line"), F.min_by("line_text", "page").alias("line_text"))
    documents = node_rows(whole, "Document", F.regexp_extract("path", r"([^/]*?)(\.[^.]*)?$", 1), "pdf", "DOC_EXACT", quote=F.col("path"))
    inside = sheets.join(documents.select("path", F.col("id").alias("document_id")), "path")
    edges = edge_rows(held, F.col("page_id"), F.col("id"), relation, "DOC_EXACT", "pdf_fast_text").unionByName(edge_rows(inside, F.col("document_id"), F.col("id"), "CONTAINS", "DOC_EXACT", "pdf_fast_text"))
    return all_of([documents, sheets, found, api]), edges


def page_status(pages: DataFrame) -> DataFrame:
    """path and status of each page document: indexed, or text_unavailable if no page has text."""
    full = F.max(F.trim(F.coalesce("text", F.lit(""))) != "")
    return pages.groupBy("path").agg(F.when(full, "indexed").otherwise("text_unavailable").alias("status"))


def extract(rows: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that the files themselves give, without links between documents and code; sorts of files that are not there cost nothing.

    Edges are only planned, and one may be there twice."""
    kinds = {r["kind"] for r in rows.select("kind").distinct().collect()}  # six at most
    documents = kinds & {"markdown", "pdf"}
    parts, part_edges = [], []
    if kinds - {"markdown", "pdf"} or not documents:
        code, code_edges = code_graph(rows)
        parts.append(code)
        part_edges.append(code_edges)
    if documents:
        doc, doc_edges = markdown_graph(rows)
        doc = written(doc)
        named = written(mentions(rows), plain=("quote",))
        last = F.when(F.col("kind") == "Section", F.col("start_line")).otherwise(F.col("end_line"))  # of a section its heading alone
        blocks = doc.where("kind in ('Paragraph', 'Table', 'CodeBlock', 'Section')").select("path", F.col("id").alias("block"), F.col("start_line").alias("a"), last.alias("b"))
        held = covering(named, blocks, "path", "start_line", "a", "b")
        says = F.when(F.col("confidence") == "AMBIGUOUS", "SEMANTIC_CANDIDATE").when(F.lower("quote").rlike(r"\b(is|are|means|refers to|defines|describes|explains|represents)\b"), "DOC_EXPLAINS").otherwise("DOC_MENTIONS")
        parts += [doc, named]
        part_edges += [doc_edges, edge_rows(held, F.col("block"), F.col("id"), says, "DOC_EXACT", "markdown")]
    if pages is not None:
        sheets, sheet_edges = page_nodes(pages)
        parts.append(sheets)
        part_edges.append(sheet_edges)
    return one_each(all_of(parts)), all_of(part_edges)


def one_each(rows: DataFrame) -> DataFrame:
    """One row of each id. Ids alone are grouped; of the rows, which are wide, those alone are whose id is there more than once."""
    twice = checkpoint(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    few = small(twice)
    return rows.join(few(twice), "id", "left_anti").select(*rows.columns).unionByName(rows.join(few(twice), "id", "left_semi").select(*rows.columns).dropDuplicates(["id"]))


def begin(artifacts: DataFrame, pages: DataFrame | None = None, indexed_at: str = "2000-01-01 00:00:00") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, nodes, edges) of a corpus, without links; lines and nodes are written, edges are only planned."""
    rows = written(lines(artifacts))
    nodes, edges = extract(rows, pages)
    return rows, written(nodes.withColumn("indexed_at", F.lit(indexed_at).cast("timestamp_ntz")), plain=("quote",)), edges


def finish(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> Index:
    """The index of what ``begin`` gives: edges are written, and documents linked to code."""
    edges = one_each(written(edges))
    linked = links.link(nodes, edges).drop("reason")
    return Index(nodes, written(edges.unionByName(linked)), rows)


def build(artifacts: DataFrame, pages: DataFrame | None = None, indexed_at: str = "2000-01-01 00:00:00") -> Index:
    """Extract and link a corpus (path, kind, content_hash, text), and page texts (path, page, text) if there are."""
    return finish(*begin(artifacts, pages, indexed_at))


#: What a stored node holds beside its own columns, as JSON.
DETAILS = ["artifact_kind", "method", "endpoint", "reference_type", "subject", "quote"]
DETAIL_SCHEMA = ", ".join(f"{c} string" for c in DETAILS)


def artifact_id(path: str = "path"):
    return content_id("artifact", path)


def stored_rows(artifacts: DataFrame, indexed_at: str) -> dict[str, DataFrame]:
    """The rows of the stored tables for some files: artifacts, nodes, edges, chunks of 120 lines, and a piece of evidence for each node with a
    quote, which the edges to that node name. Files without text have an artifact alone."""
    rows = checkpoint(lines(artifacts))
    nodes, edges = extract(rows)
    nodes, edges = checkpoint(nodes), checkpoint(edges.dropDuplicates(["id"]))
    at, none = F.lit(indexed_at).cast("timestamp_ntz"), F.lit(None).cast("string")
    proof = F.when(F.coalesce("quote", F.lit("")) != "", content_id("evidence", "path", "id"))
    chunk = chunks(rows).join(artifacts.select("path", "kind"), "path")
    found = edges.join(nodes.select(F.col("id").alias("dst"), proof.alias("evidence_id")), "dst", "left")
    made = {
        "artifacts": artifacts.select(artifact_id().alias("id"), F.col("path").alias("uri"), "path", "kind", F.element_at(F.split("path", "/"), -1).alias("title"), "content_hash", at.alias("indexed_at"), none.alias("metadata")),
        "nodes": nodes.select("*", artifact_id().alias("artifact_id"), none.alias("bbox"), F.to_json(F.struct(*DETAILS)).alias("metadata")),
        "edges": found.withColumn("metadata", none),
        "chunks": chunk.select(
            content_id("chunk", "path", "start_line", "end_line").alias("id"), artifact_id().alias("artifact_id"), "kind", "text", none.alias("summary"), F.lit(None).cast("int").alias("page"),
            "start_line", "end_line", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int").alias("token_count"), none.alias("metadata"),
        ),
        "evidence": nodes.withColumn("proof", proof).where("proof is not null").select(
            F.col("proof").alias("id"), artifact_id().alias("artifact_id"), F.col("path").alias("source_uri"), "quote", "start_line", "end_line", "page", none.alias("bbox"), F.lit("fast_graph").alias("extractor"), "confidence",
        ),
    }
    columns = {t: [c.split()[0] for c in store.TABLES[t].split(", ")] for t in made}
    return {t: df.select(*columns[t]) for t, df in made.items()}


def graph_nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """Stored nodes with their details as columns again, and the time at which their file was indexed."""
    times = tables["artifacts"].select(F.col("id").alias("artifact_id"), "indexed_at")
    wide = tables["nodes"].join(times, "artifact_id").withColumn("_", F.from_json("metadata", DETAIL_SCHEMA))
    return wide.select(*[F.col(f"_.{c}").alias(c) if c in DETAILS else F.col(c) for c in NODE], "indexed_at")


def load(spark: SparkSession, folder: str) -> Index:
    """The newest stored index of a folder."""
    tables = store.load_tables(spark, folder)
    kinds = tables["artifacts"].select(F.col("id").alias("artifact_id"), "path")
    texts = tables["chunks"].join(kinds, "artifact_id").select("path", "kind", "start_line", F.posexplode(F.split("text", "\n", -1)).alias("at", "line_text"))
    stored = store.Stored(spark, folder).table("postings").withColumnRenamed("bucket", "block")
    return Index(graph_nodes(tables), tables["edges"].select(*EDGE), texts.select("path", "kind", (F.col("start_line") + F.col("at")).alias("line"), "line_text"), stored)


def run(artifacts: DataFrame, folder: str, indexed_at: str = "2000-01-01 00:00:00", buckets: int = store.BUCKETS) -> DataFrame:
    """Bring the stored index of a folder up to a corpus (path, kind, content_hash, text); path, kind and change of each file.

    Only new and modified files are extracted. Of the tables only the buckets of paths that changed are read whole and written anew, and only links with an
    end in a changed file are made anew; the rest stays where it is, so what a run writes follows the change. A run without changes writes nothing.
    The result is a new version, which readers see once it is complete; one writer at a time."""
    spark = artifacts.sparkSession
    state = store.Stored(spark, folder, buckets)
    place = lambda df, path="path": df.withColumn("bucket", store.bucket_of(path, state.buckets))
    changes = checkpoint(plan(artifacts, state.table("artifacts")))
    touched = checkpoint(changes.where("change <> 'unchanged'").select("path", "change"))
    if touched.isEmpty():
        return changes
    marked = place(touched).groupBy("bucket").agg(F.count_if(F.col("change") != "new").alias("was")).collect()  # ``buckets`` at most
    among, was = sorted(r["bucket"] for r in marked), any(r["was"] for r in marked)
    fresh = artifacts.join(touched.where("change <> 'deleted'").select("path"), "path", "left_semi").select(*artifacts.columns)
    filed = [t for t in store.FILED if t not in ("links", "postings")]
    old = {t: state.table(t, among) for t in filed}
    kept = store.cascade_delete(old, touched.where("change <> 'new'").select("path")) if was else old
    made = stored_rows(fresh, indexed_at)
    paths = made["artifacts"].select(F.col("id").alias("artifact_id"), "path")
    of_node = made["nodes"].select(F.col("id").alias("src"), "path")
    own = {"artifacts": place(made["artifacts"]), "nodes": place(made["nodes"]), "evidence": place(made["evidence"], "source_uri"), "chunks": place(made["chunks"].join(paths, "artifact_id")), "edges": place(made["edges"].join(of_node, "src"))}
    tables = {t: kept[t].unionByName(own[t].select(*kept[t].columns)) for t in filed}
    tables["nodes"], tables["edges"] = checkpoint(tables["nodes"]), checkpoint(tables["edges"])

    others = {t: state.table(t).where(~F.col("bucket").isin(among)).unionByName(tables[t]) for t in ("artifacts", "nodes", "edges")}
    nodes = checkpoint(graph_nodes(others))  # read by every sort of link
    linked = links.link(nodes, others["edges"].select(*EDGE), touched.select("path"))
    linked = linked.select("*", F.lit(None).cast("string").alias("evidence_id"), F.to_json(F.struct("reason")).alias("metadata"))
    linked = checkpoint(place(linked.join(nodes.select(F.col("id").alias("src"), "path"), "src")).select(*store.names_of("links"), "bucket"))
    gone = checkpoint(old["nodes"].join(touched, "path", "left_semi").select("id"))
    before = state.table("links")
    stale = before.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").select("bucket").union(before.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select("bucket"))
    among_links = sorted(r[0] for r in stale.union(linked.select("bucket")).distinct().collect())  # ``buckets`` at most
    left = state.table("links", among_links)
    for end in ("src", "dst"):
        left = left.join(gone.withColumnRenamed("id", end), end, "left_anti")
    tables["links"] = left.unionByName(linked)
    quotes = tables["nodes"].select("id", F.get_json_object("metadata", "$.quote").alias("text"), F.col("bucket").alias("block"))
    tables["postings"] = postings(quotes).withColumnRenamed("block", "bucket")  # a block is a bucket of paths
    state.write(tables, dict.fromkeys([*filed, "postings"], among) | {"links": among_links})
    return changes


def symbol_overlay(documents: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of compiler symbols: documents (relative_path, occurrences: symbol, range, symbol_roles).

    A symbol is a node at its last occurrence; an occurrence links the nearest node of its file to it, DEFINES for
    a definition, else REFERENCES."""
    occ = documents.select(F.col("relative_path").alias("path"), F.posexplode("occurrences").alias("nth", "o")).select("path", "nth", "o.symbol", (F.element_at("o.range", 1) + 1).alias("line"), F.col("o.symbol_roles").alias("roles"))
    occ = occ.withColumn("defines", F.exists("roles", lambda r: F.lower(r) == "definition"))
    symbol_id = content_id("scip", F.lit("symbol"), "symbol")
    name = F.regexp_extract("symbol", r"([A-Za-z_$][\w$]*)[^A-Za-z0-9_$]*$", 1)
    last = store.first_per_key(occ, ["symbol"], F.desc("path"), F.desc("nth"))
    values = {"id": symbol_id, "kind": F.lit("Symbol"), "label": name, "canonical_name": F.col("symbol"), "artifact_kind": F.lit("code"), "path": F.col("path"), "start_line": F.col("line"), "end_line": F.col("line"), "confidence": F.lit("EXACT_COMPILER")}
    symbols = last.select(*[(values.get(c, F.lit(None).cast("int" if c == "page" else "string"))).alias(c) for c in NODE])
    occ = checkpoint(occ.withColumn("point", F.monotonically_increasing_id()))
    scopes = nodes.where("kind in ('Class', 'Function', 'Method', 'Endpoint')").select("path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("id").alias("span"))
    close = closest_scope(occ.select("path", F.col("line").alias("at"), "point"), scopes, "path")
    whole = occ.join(nodes.where("kind = 'File'").groupBy("path").agg(F.min("id").alias("span")), "path").select("point", F.lit(900).cast("long").alias("apart"), "span")
    best = close.unionByName(whole).groupBy("point").agg(F.min(F.struct("apart", "span")).alias("b"))
    best = occ.join(best, "point").withColumn("symbol_id", symbol_id).withColumn("id", F.col("b.span"))
    return symbols, edge_rows(best, F.col("id"), F.col("symbol_id"), F.when(F.col("defines"), "DEFINES").otherwise("REFERENCES"), "EXACT_COMPILER", "scip")
