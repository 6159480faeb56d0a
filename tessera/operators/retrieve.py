"""Ranked evidence for a task: exact seeds, text candidates, traversal, scores, distinct evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.graph import traverse
from tessera.operators.joins import meet, present, small
from tessera.operators.lineage import checkpoint
from tessera.operators.links import with_endpoint
from tessera.operators.postings import topk
from tessera.operators.search import bm25_topk, like_search, quote_nodes
from tessera.operators.store import first_per_key

# What candidates from text search (and the most that a search score adds), from quotes and from the graph start with.
TEXT_BASE, TEXT_MOST, QUOTE_BASE, GRAPH_BASE = 38.0, 10.0, 34.0, 62.0
# What the newest time of indexing adds and how much less each older one; what nearness in the graph adds and loses an edge; what exact seeds start with and a named method adds.
FRESH, FRESH_STEP, NEAR_BASE, NEAR_STEP, SEED_BASE, METHOD_ADDS = 4.0, 0.25, 24.0, 5.0, 100.0, 8.0

DOCUMENTS = ("markdown", "pdf", "sb")


def query_terms(tasks: DataFrame) -> DataFrame:
    """Of each task (task_id, task): what it names, as arrays: endpoints ("METHOD path" or " path"), paths, statuses,
    tables, fields, config_keys, symbols."""
    task = F.col("task")
    all_of = lambda pattern, group=1: F.regexp_extract_all(task, F.lit(pattern), F.lit(group))
    key = lambda c: T.identifier_key(c)
    clean = lambda a: F.filter(F.array_distinct(a), lambda x: x != "")
    named = F.transform(all_of("(?i)" + T.ENDPOINT, 0), lambda x: F.concat(F.upper(F.regexp_extract(x, r"^(\w+)", 1)), F.lit(" "), T.clean_endpoint(F.regexp_extract(x, r"\s(/.*)$", 1))))
    bare = F.transform(all_of(T.BARE_API), lambda x: F.concat(F.lit(" "), T.clean_endpoint(x)))
    statuses = F.filter(all_of(r"\b([A-Z][A-Z0-9_]{2,})\b"), lambda x: ~x.isin(T.NOT_A_STATUS))
    tables = F.concat(all_of(r"(?i)\b([A-Za-z_$][\w$]*)\s+table\b"), all_of(r"(?i)\btable\s+([A-Za-z_$][\w$]*)"))
    quoted = all_of(r"`([^`\n]+)`")
    fields = F.concat(quoted, all_of(r"(?i)(?:field|column)\s+([A-Za-z_$][\w$.-]*)"), all_of(r"(?i)([A-Za-z_$][\w$.-]*)\s+(?:field|column)"))
    config = F.concat(quoted, all_of(r"([A-Za-z_$][\w$]*(?:[._-][A-Za-z_$][\w$]*)+)"))
    symbols = F.filter(all_of(T.IDENTIFIER, 0), lambda x: ~T.is_generic_term(x, T.GENERIC_IN_TASKS))
    keys = lambda a: clean(F.transform(a, key))
    return tasks.select(
        "task_id", "task",
        F.array_distinct(F.concat(named, bare)).alias("endpoints"),
        clean(F.transform(all_of(T.FILE_PATH, 0), T.normalize_path)).alias("paths"),
        keys(statuses).alias("statuses"), keys(tables).alias("tables"),
        F.array_union(keys(fields), keys(config)).alias("fields"), keys(config).alias("config_keys"), keys(symbols).alias("symbols"),
    )


#: Kinds of nodes that have endpoints.
ENDS = ["Endpoint", "APIReference"]
#: Kinds of nodes that a task names by their labels, by which of its terms, and what that is called.
NAMED = [
    (["Class", "Function", "Method", "Symbol"], "symbols", "exact_symbol"), (["Column", "FormField"], "fields", "exact_field"), (["Table"], "tables", "exact_table"),
    (["ConfigKey"], "config_keys", "exact_config_key"), (["StatusValue", "ConfigKey", "Column"], "statuses", "exact_status_value"),
]


def find_seeds(nodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """task_id, id, score and reasons of the nodes that a task names exactly.

    Every rule is an equi-join of what tasks name with what nodes are called, so tasks can be many; nodes are read once for all rules."""
    terms = query_terms(tasks)
    asked = lambda sort, c, what, kinds=None: terms.select("task_id", F.lit(sort).alias("sort"), F.explode(c).alias("term"), F.array(*[F.lit(w) for w in what]).alias("why"), (F.array(*map(F.lit, kinds)) if kinds else F.lit(None).cast("array<string>")).alias("kinds"))
    asks = [
        asked("end", F.filter("endpoints", lambda e: e.startswith(" ")), ["exact_endpoint"]), asked("end", F.filter("endpoints", lambda e: ~e.startswith(" ")), ["exact_endpoint", "exact_endpoint_method"]),
        asked("path", "paths", ["exact_path"]),
    ]
    asks += [asked("name", c, [why], kinds) for kinds, c, why in NAMED]
    asks = checkpoint(reduce(DataFrame.unionByName, asks))
    sorts = {r["sort"] for r in asks.select("sort").distinct().collect()}  # three at most; what no task asks for is not made
    # all that a node is called, in one pass over nodes
    offer = lambda sort, term: F.struct(F.lit(sort).alias("sort"), term.alias("term"))
    of = lambda kinds, offers: F.when(F.col("kind").isin(kinds), offers).otherwise(F.array().cast("array<struct<sort:string,term:string>>"))
    names = F.array_distinct(F.array(T.identifier_key("label"), T.identifier_key(T.first_of("canonical_name", "label"))))
    calls = {
        "end": of(ENDS, F.array(offer("end", F.concat(F.lit(" "), "ep_path")), offer("end", F.concat("ep_method", F.lit(" "), "ep_path")))),
        "path": F.array(offer("path", T.normalize_path(T.first_of("path", "label")))),
        "name": of(sorted({k for kinds, *_ in NAMED for k in kinds}), F.transform(names, lambda t: offer("name", t))),
    }
    few = small(asks)
    kinds = {k for s, held in (("end", ENDS), ("name", [k for held, *_ in NAMED for k in held])) if s in sorts for k in held}
    rows = nodes if "path" in sorts else nodes.where(F.col("kind").isin(sorted(kinds)))
    rows = with_endpoint(rows, ignore_case=True) if "end" in sorts else rows
    offers = rows.select("id", "kind", "confidence", F.explode(F.concat(*[calls[s] for s in sorted(sorts) or ["path"]])).alias("_")).select("id", "kind", "confidence", "_.*")
    hits = offers.join(few(asks), ["sort", "term"]).where("kinds is null or array_contains(kinds, kind)")
    scored = hits.groupBy("task_id", "id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("why")))).alias("reasons"), F.max("confidence").alias("confidence"))
    score = F.lit(SEED_BASE) + F.greatest(T.confidence_weight("confidence"), F.lit(0.0)) + F.when(F.array_contains("reasons", "exact_endpoint_method"), METHOD_ADDS).otherwise(0.0)
    return scored.select("task_id", "id", score.alias("score"), "reasons")


def freshness(candidates: DataFrame) -> DataFrame:
    """id and 4 less a quarter for each later time of indexing among the candidates, 0 at least; null times get 0.

    From the seventeenth time on it is 0, so only the newest sixteen are ranked and joined."""
    steps = int(FRESH / FRESH_STEP)
    times = candidates.where("indexed_at is not null").select("indexed_at").distinct().orderBy(F.desc("indexed_at")).limit(steps)
    newest = times.agg(F.sort_array(F.collect_list("indexed_at"), asc=False).alias("newest")).select(F.posexplode("newest").alias("nth", "indexed_at"))
    rank = candidates.join(F.broadcast(newest), "indexed_at", "left")
    return rank.select("id", F.coalesce(FRESH - F.col("nth") * FRESH_STEP, F.lit(0.0)).alias("fresh"))


def rank(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates (id, base, reasons, distance, weight, relations) with their final score, in order of rank."""
    rows = checkpoint(meet(nodes, candidates, ["id"]).select("id", *[c for c in candidates.columns if c != "id"], *[c for c in nodes.columns if c != "id"]))  # nodes are not sorted for some candidates
    rows = rows.join(freshness(rows.select("id", "indexed_at")), "id")
    near = F.when(F.col("distance").isNotNull(), F.greatest(F.lit(0.0), NEAR_BASE - F.col("distance") * NEAR_STEP) + F.col("weight")).otherwise(0.0)
    weak = F.when(F.array_contains(F.coalesce("relations", F.array().cast("array<string>")), "SEMANTIC_CANDIDATE"), -30.0).otherwise(0.0)
    return rows.withColumn("score", F.col("base") + T.confidence_weight("confidence") + F.col("fresh") + near + weak)


def order_of_rank() -> list:
    path = T.first_of("path")
    return [F.desc("score"), F.coalesce("distance", F.lit(99)), path, F.coalesce("start_line", F.lit(0)), F.coalesce("page", F.lit(0)), F.col("kind"), F.col("label"), F.col("id")]


def evidence(ranked: DataFrame, limit: int = 8) -> DataFrame:
    """The first ``limit`` distinct pieces of evidence of the best 3 x ``limit`` candidates."""
    top = ranked.orderBy(*order_of_rank()).limit(3 * limit)
    quoted = top.withColumn("quote", T.short(T.first_of("quote", "label"), 900)).where("quote <> ''")
    place = ["path", "start_line", "end_line", "page", "quote"]
    one = first_per_key(quoted, place, *order_of_rank())
    return one.orderBy(*order_of_rank()).limit(limit).select("id", "kind", "label", "path", "quote", T.location("path", "start_line", "end_line", "page").alias("location"), "confidence", "score", "reasons", "relations")


def retrieve(nodes: DataFrame, edges: DataFrame, task: str, limit: int = 8, max_depth: int = 3, include_weak: bool = False, postings: DataFrame | None = None) -> dict:
    """intent, seeds, candidates (ranked) and evidence (DataFrames) for one task.

    ``nodes`` are NODE rows with indexed_at; ``postings`` of their quotes, where they are stored, spare the scan of these. Text candidates come from BM25 (LIKE where it finds none) and from quotes of document nodes."""
    spark = nodes.sparkSession
    tasks = spark.createDataFrame([(0, task)], "task_id int, task string")
    said = tasks.select(T.infer_intent("task").alias("intent"), T.tokenize("task").alias("tokens"), T.significant_tokens("task").alias("significant")).first()
    seeds = checkpoint(find_seeds(nodes, tasks).select("id", F.col("score").alias("base"), "reasons"))
    documents = nodes.where(F.col("artifact_kind").isin(*DOCUMENTS))
    texts = nodes.select("id", F.col("quote").alias("text"))
    asked = spark.createDataFrame([(0, t) for t in dict.fromkeys(said["tokens"])], "query_id int, term string")
    best = checkpoint(bm25_topk(texts, said["tokens"], 20) if postings is None else topk(postings, asked, 20).select("id", "score"))
    found = best if not best.isEmpty() else like_search(texts, task, said["tokens"], 20)
    method = "text_search:bm25" if found is best else "text_search:like"
    liked = present(checkpoint(found), documents).select("id", (TEXT_BASE + F.least("score", F.lit(TEXT_MOST))).alias("base"), F.array(F.lit(method)).alias("reasons"))
    held = documents.select("id", F.col("path").alias("artifact_id"), "start_line", "end_line", "page", "quote")
    own = documents.select(F.col("path").alias("id"), "path", F.col("artifact_kind").alias("kind")).distinct()
    quotes = quote_nodes(held, own, held, said["significant"], 20).select("id", F.lit(QUOTE_BASE).alias("base"), F.array(F.lit("evidence_quote")).alias("reasons"))
    texts = checkpoint(first_per_key(liked.unionByName(quotes), ["id"], F.desc("base")))  # 40 rows at most; read by the start and the states
    start = seeds.select("id").unionAll(nodes.select("id", "path", "start_line", "label").join(F.broadcast(texts), "id").orderBy(F.desc("base"), T.first_of("path"), F.coalesce("start_line", F.lit(0)), "label", "id").limit(10).select("id"))
    walked = traverse(nodes, edges, start, max_depth, include_weak)
    base = F.greatest(F.lit(0.0), GRAPH_BASE - F.col("distance") * 10.0)
    base = F.when(F.element_at(F.concat(F.array(F.lit("")), "path"), -1) == "SEMANTIC_CANDIDATE", F.least(base, F.lit(8.0))).otherwise(base)
    reached = walked.select("id", base.alias("base"), F.array(F.lit("graph_traversal")).alias("reasons"), "distance", "weight", F.col("path").alias("relations"))
    none = lambda df: df.select("*", F.lit(None).cast("int").alias("distance"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("array<string>").alias("relations"))
    states = none(seeds).unionByName(none(texts)).unionByName(reached)
    merged = states.groupBy("id").agg(F.max("base").alias("base"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.min("distance").alias("distance"), F.max("weight").alias("weight"), F.max("relations").alias("relations"))
    ranked = rank(merged, nodes)
    return {"intent": said["intent"], "seeds": seeds, "candidates": ranked, "evidence": evidence(ranked, limit)}
