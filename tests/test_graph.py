"""Scenarios over small literal corpora: extraction, links, retrieval, conflicts, packs, files, stores."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import conflicts, store
from tessera.plans import index, pack
from tessera.sources import files

API = """# API Guide

The client calls `POST /api/users` with a new user.

| field | type |
|---|---|
| email | text |

## Rules

The `email` field is required and must be valid.
Only admin can delete users.
Status READY means open. See src/app.ts for details.
"""
APP = """import { db } from "./db";

export class UserService {
  createAll(rows) {
    return rows;
  }
}

export function createUser(req, res) {
  if (!req.body.email) throw new Error("email required");
}

app.post("/api/users", createUser);
"""
OPENAPI = """paths:
  /api/users:
    post:
      summary: create
"""
SQL = """CREATE TABLE users (
  id INT,
  email TEXT,
  status TEXT,
  PRIMARY KEY (id)
);
SELECT * FROM users JOIN orders ON 1 = 1;
"""
PY = """from os import path
import json

class Payment:
    def charge(self):
        pass

@app.get("/health")
def health():
    return 1
"""
CORPUS = {"README.md": API, "src/app.ts": APP, "openapi.yaml": OPENAPI, "db/schema.sql": SQL, "svc/pay.py": PY}


def corpus(spark, texts):
    rows = spark.createDataFrame([(p, t.encode()) for p, t in texts.items()], files.CORPUS)
    return files.artifacts(rows)


@pytest.fixture(scope="module")
def project(spark):
    return index.build(corpus(spark, CORPUS))


def names(df, *where):
    return {(r["kind"], r["label"]) for r in df.where(" and ".join(where) if where else "true").collect()}


def test_code_graph(project):
    got = names(project.nodes, "artifact_kind in ('code', 'openapi', 'sql')")
    want = {
        ("Class", "UserService"), ("Method", "createAll"), ("Function", "createUser"), ("Endpoint", "POST /api/users"), ("Module", "./db"), ("Class", "Payment"), ("Method", "charge"),
        ("Function", "health"), ("Endpoint", "GET /health"), ("Module", "os"), ("Module", "json"), ("Table", "users"), ("Table", "orders"), ("Column", "email"), ("Column", "status"), ("ConfigKey", "/api/users"),
    }
    assert want <= got and ("Column", "PRIMARY") not in got
    edges = project.edges.join(project.nodes.select(F.col("id").alias("src"), F.col("label").alias("from")), "src").join(project.nodes.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst")
    pairs = {(r["relation"], r["from"], r["to"]) for r in edges.collect()}
    assert {("ROUTE_TO_HANDLER", "POST /api/users", "createUser"), ("ROUTE_TO_HANDLER", "GET /health", "health"), ("CONTAINS", "users", "email"), ("DEFINES", "db/schema.sql", "users"), ("QUERY_TOUCHES_TABLE", "db/schema.sql", "orders"), ("DEFINES", "UserService", "createAll")} <= pairs


NESTED = """class Repo:
    def save(self):
        def inner():
            return 1

        return inner()

    class Row_x:
        def read(self):
            return 2


def outer(email):
    # not the end
    if not email:
        raise ValueError("email is required")

    def helper():
        return 3

    return helper
"""
SCRIPT = """class A {
  run() {
    return 1;
  }
}

function f(
  a,
) {
  const g = (x) => x;
  return g;
}
"""


def test_definitions_reach_and_nest(spark):
    got = index.build(corpus(spark, {"a.py": NESTED, "b.ts": SCRIPT})).nodes.where("kind in ('Class', 'Function', 'Method')")
    spans = {(r["path"], r["kind"], r["canonical_name"]): (r["start_line"], r["end_line"]) for r in got.collect()}
    assert spans == {
        ("a.py", "Class", "Repo"): (1, 10), ("a.py", "Method", "Repo.save"): (2, 6), ("a.py", "Function", "inner"): (3, 4), ("a.py", "Class", "Row_x"): (8, 10), ("a.py", "Method", "Row_x.read"): (9, 10),
        ("a.py", "Function", "outer"): (13, 21), ("a.py", "Function", "helper"): (18, 19), ("b.ts", "Class", "A"): (1, 5), ("b.ts", "Method", "A.run"): (2, 4), ("b.ts", "Function", "f"): (7, 12), ("b.ts", "Function", "g"): (10, 10),
    }
    assert got.where("label = 'outer'").first()["quote"].endswith("return helper")


def test_validating_function_is_linked_by_its_body(spark):
    rules = "# Rules\n\nThe `email` field is required and cannot be empty.\n"
    code = "def validate_email(email):\n    if not email:\n        raise ValueError('required')\n"
    both = index.build(corpus(spark, {"rules.md": rules, "validators.py": code}))
    ends = both.edges.where("extractor = 'code_document_linker' and relation = 'SB_DEFINES_VALIDATION'").join(both.nodes.select(F.col("id").alias("dst"), "label"), "dst")
    assert {r["label"] for r in ends.collect()} >= {"validate_email"}


def test_decorated_handler_refers_to_its_endpoint(project):
    named = project.nodes.select("id", "label")
    got = project.edges.where("relation = 'REFERENCES'").join(named.select(F.col("id").alias("src"), F.col("label").alias("from")), "src").join(named.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst")
    assert ("health", "GET /health") in {(r["from"], r["to"]) for r in got.collect()}


def test_json_keys_of_any_depth(spark):
    import json

    api = json.dumps({"openapi": "3.0.0", "paths": {"/orders": {"post": {"responses": {"200": {"content": {"deep": {"deeper": 1}}}}}}}}, indent=1)
    nodes = index.build(corpus(spark, {"openapi.json": api, "a.json": '{"x": [{"y": 1}]}', "bad.json": '{\nkey: 1\n', "list.json": "[1]"})).nodes
    keys = {(r["path"], r["canonical_name"]): r["start_line"] for r in nodes.where("kind = 'ConfigKey'").collect()}
    assert keys["openapi.json", "paths./orders.post.responses.200.content.deep.deeper"] == 10
    assert {("a.json", "x"), ("a.json", "x.y"), ("bad.json", "key")} <= {*keys} and not any(p == "list.json" for p, _ in keys)
    assert [(r["label"], r["start_line"]) for r in nodes.where("kind = 'Endpoint'").collect()] == [("POST /orders", 4)]


def test_ignore_files_of_a_project(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("# note\n*.md\n")
    (tmp_path / ".tesseraignore").write_text("!keep.md\n")
    for name in ("a.md", "keep.md", "b.py"):
        (tmp_path / name).write_text("x = 1\n")
    kept = files.artifacts(files.read_files(spark, str(tmp_path)), files.load_ignore_rules(str(tmp_path)))
    assert {r["path"] for r in kept.collect()} == {"keep.md", "b.py"}
    assert files.load_ignore_rules(str(tmp_path / "none")) == []


def test_discovery_lists_and_reads_what_is_indexed(spark, tmp_path):
    import os

    for name in ("README.md", "a.png", "src/.hidden.py", "src/deep/er/b.ts", "src/deep/er/notes.xyz", "node_modules/x.js", "tmp/c.md", "drop.log", "_under.py", "src/p.lock"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("tmp/\n*.log\n")
    os.symlink(tmp_path, tmp_path / "src/loop")
    os.symlink(tmp_path / "gone.py", tmp_path / "broken.py")
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        rules = files.load_ignore_rules(root)
        found = {r["path"]: r["state"] for r in files.discover(spark, root, rules).collect()}
        broken = found.pop("broken.py", None)
        assert found == {
            "README.md": "indexed", "a.png": "ignored", "src/.hidden.py": "indexed", "src/deep/er/b.ts": "indexed", "src/deep/er/notes.xyz": "unsupported", "node_modules": "ignored", "tmp": "ignored", "drop.log": "ignored",
            "_under.py": "indexed", "src/p.lock": "ignored", ".gitignore": "unsupported",
        }
        counts = files.discovery_counts(files.discover(spark, root, rules).where("path <> 'broken.py'")).first()
        assert tuple(counts) == (9, 5, 2, 0, 4)
        read = {r["path"]: r["text"] for r in files.read_project(spark, root).collect()}
        assert read == dict.fromkeys(["README.md", "src/.hidden.py", "src/deep/er/b.ts", "_under.py"], "x = 1\n") and broken in (None, "indexed")


def test_markdown_graph(project):
    doc = project.nodes.where("path = 'README.md'")
    got = {(r["kind"], r["label"]): (r["start_line"], r["end_line"]) for r in doc.where("kind in ('Document', 'Section', 'Table')").collect()}
    assert got["Document", "API Guide"] == (1, 13) and got["Section", "API Guide"] == (1, 8) and got["Section", "Rules"] == (9, 13)
    assert [v for (k, _), v in got.items() if k == "Table"] == [(5, 7)]
    said = names(doc)
    assert {("APIReference", "POST /api/users"), ("StatusValue", "READY"), ("FormField", "email"), ("CodeReference", "src/app.ts"), ("ValidationRule", "required")} <= said
    assert any(k == "PermissionRule" for k, _ in said)


def test_links(project):
    edges = project.edges.where("extractor = 'code_document_linker'").join(project.nodes.select(F.col("id").alias("src"), F.col("label").alias("from"), F.col("kind").alias("a")), "src").join(project.nodes.select(F.col("id").alias("dst"), F.col("label").alias("to"), F.col("kind").alias("b"), F.col("path").alias("at")), "dst")
    got = {(r["relation"], r["from"], r["to"], r["at"]) for r in edges.collect()}
    assert ("DOC_MENTIONS", "POST /api/users", "POST /api/users", "src/app.ts") in got
    assert ("DOC_MENTIONS", "POST /api/users", "POST /api/users", "openapi.yaml") in got
    assert ("DOC_MENTIONS", "POST /api/users", "createUser", "src/app.ts") in got  # from the OpenAPI endpoint
    assert ("DOC_MENTIONS", "email", "email", "db/schema.sql") in got
    assert ("DOC_MENTIONS", "src/app.ts", "src/app.ts", "src/app.ts") in got


def test_retrieval_ranks_the_endpoint_first(project):
    found = project.ask("Change POST /api/users to require email", limit=6)
    rows = found["evidence"].collect()
    assert found["intent"] == "impact" and len(rows) <= 6
    assert (rows[0]["kind"], rows[0]["label"]) in {("Endpoint", "POST /api/users")} and "exact_endpoint_method" in rows[0]["reasons"]
    assert {"APIReference", "Endpoint"} <= {r["kind"] for r in rows} and all(len(r["quote"]) <= 900 for r in rows)
    reached = {r["label"] for r in found["candidates"].collect()}
    assert "createUser" in reached


def test_vague_task_has_no_seeds(spark):
    vague = index.build(corpus(spark, {"app.py": "def login():\n    pass\n\nclass PaymentService:\n    pass\n"}))
    found = vague.ask("user login payment flow")
    assert found["intent"] == "auto" and found["seeds"].count() == 0
    assert vague.conflicts().count() == 0


def test_conflicts(spark):
    doc = "# Sign up\n\nThe password must be at least 8 characters.\n\nCall POST /users/signup first.\n\nStatus PAID is final.\n\nThe retry limit: retry at most 3 times.\n\nThe timeout is 30 seconds.\n\nOnly admin can refund.\n"
    code = 'const schema = z.object({\n  password: z.string().min(6),\n});\napp.post("/api/users/register", handler);\nconst maxRetries = 5;\nconst timeoutMs = 10000;\nroute({ roles: ["user", "owner"] });\n'
    api = "components:\n  status:\n    type: string\n    enum:\n      - CAPTURED\n      - FAILED\n    other: 1\n"
    got = {r["type"]: r for r in index.build(corpus(spark, {"signup.md": doc, "schema.ts": code, "openapi.yaml": api})).conflicts().collect()}
    assert got["validation_mismatch"]["summary"] == "Document requires min length 8, but code enforces 6."
    assert (got["validation_mismatch"]["doc_location"], got["validation_mismatch"]["code_location"]) == ("signup.md:3", "schema.ts:2")
    assert got["endpoint_mismatch"]["summary"] == "Document names POST /users/signup, but similar code endpoint is POST /api/users/register."
    assert got["status_value_mismatch"]["summary"] == "Document references status PAID, but code enum contains CAPTURED, FAILED."
    assert got["retry_policy_mismatch"]["summary"] == "Document retry count is 3, but code uses 5."
    assert got["timeout_mismatch"]["summary"] == "Document timeout is 30000ms, but code uses 10000ms."
    assert got["permission_mismatch"]["summary"] == "Document requires role admin, but code allows owner, user."


def test_korean_length_rule(spark):
    got = index.build(corpus(spark, {"signup.md": "# 가입\n\n비밀번호는 8자 이상이어야 한다.\n", "schema.ts": "const s = {\n  password: z.string().min(6),\n}\n"})).conflicts().collect()
    assert [(r["type"], r["doc_location"], r["code_location"]) for r in got] == [("validation_mismatch", "signup.md:3", "schema.ts:2")]


def test_pages_and_symbols(spark, project):
    pages = spark.createDataFrame([("plan.pdf", 1, "Call POST /api/users.\nStatus PAID. The `email` field is required."), ("plan.pdf", 2, " "), ("plan.pdf", 3, None)], "path string, page int, text string")
    both = index.build(corpus(spark, {"src/app.ts": APP}), pages)
    got = {(r["label"], r["confidence"]) for r in both.nodes.where("kind = 'Page'").collect()}
    assert got == {("Page 1", "DOC_EXACT"), ("Page 2", "AMBIGUOUS"), ("Page 3", "AMBIGUOUS")}
    assert {r["relation"] for r in both.edges.where("extractor = 'code_document_linker'").collect()} >= {"SB_REFERENCES_API"}
    documents = spark.createDataFrame(
        [("src/app.ts", [("npm app createUser().", [8, 0], ["Definition"]), ("npm app createUser().", [12, 0], ["Reference"])])],
        "relative_path string, occurrences array<struct<symbol:string,range:array<int>,symbol_roles:array<string>>>",
    )
    symbols, edges = index.symbol_overlay(documents, project.nodes)
    assert [r["label"] for r in symbols.collect()] == ["createUser"]
    assert {r["relation"] for r in edges.collect()} == {"DEFINES", "REFERENCES"}


def test_pack_keeps_its_budget(project):
    made = pack.build(project, "Change POST /api/users to require email", budget=500)
    assert made["mode"] == "impact" and made["evidence_paths"] and pack.tokens(pack.render(made)) <= 500 or all(len(made[s]) <= 2 for s in pack.TRIMMED)
    assert pack.limits(1800) == (8, 10) and pack.limits(300) == (3, 5)


def test_fit_drops_as_one_by_one_would():
    import random

    random.seed(3)
    for _ in range(300):
        payload = {s: [{"id": i, "quote": "x" * random.randrange(120)} for i in range(random.randrange(9))] for s in pack.TRIMMED} | {"excluded": [{"reason": "whole_files"}]}
        budget = random.randrange(40, 900)
        got = pack.fit(payload, budget)
        want, gone = {k: list(v) for k, v in payload.items()}, {}
        while pack.tokens(pack.render(want)) > budget:
            s = next((s for s in pack.TRIMMED if len(want[s]) > 2), None)
            if s is None:
                break
            want[s].pop()
            gone[s] = gone.get(s, 0) + 1
            want["excluded"] = [payload["excluded"][0], *[{"reason": f"token_budget_trimmed_{pack.TRIMMED[t]}", "count": n} for t, n in gone.items()]]
        sizes = lambda p: [len(p[s]) for s in pack.TRIMMED]
        assert sum(sizes(want)) - sum(sizes(got)) in (0, 1), (sizes(got), sizes(want))  # a count may be a digit shorter than allowed for
        assert pack.tokens(pack.render(got)) <= budget or all(n <= 2 for n in sizes(got))


def test_pack_holds_all_conflicts_and_is_saved(spark, tmp_path):
    rules = "# Rules\n\n" + "".join(f"The `pin_{i}` must be at least 8 characters.\n\n" for i in range(14))
    code = "const s = {\n" + "".join(f"  pin_{i}: z.string().min({6 + i % 2}),\n\n\n\n\n\n\n" for i in range(14)) + "};\n"
    both = index.build(corpus(spark, {"rules.md": rules, "s.ts": code}))
    made = pack.build(both, "Change pin_3")
    assert len(made["conflicts"]) == 14 and {*made} == {"task", "mode", "budget_tokens", "primary_nodes", "evidence_paths", "affected_code", "related_documents", "risks", "conflicts", "unknowns", "excluded"}
    assert all(e["path"] == "s.ts" for e in made["affected_code"]) and all(e["path"] == "rules.md" for e in made["related_documents"])
    folder = str(tmp_path / "index")
    assert pack.saved(spark, folder).count() == 0
    path = pack.save(spark, folder, made, "2024-01-02 03:04:05")
    pack.save(spark, folder, made, "2024-01-02 03:04:05")
    (row,) = pack.saved(spark, folder).collect()
    assert row["task"] == "Change pin_3" and pack.read(spark, folder, row["id"]) == made and open(path).read() == pack.render(made)
    assert pack.read(spark, folder, "none") is None
    said = pack.summary(made, path)
    assert [x for x in said.split("\n") if x and not x.startswith("-")] == ["Conclusion", "High-confidence findings", "Affected code", "Related documents", "Risks", "Conflicts", "Unknowns", "Saved pack"]
    store.put_manifest(spark, folder, {"a": "1", "b": "2"}, "2024-01-01 00:00:00")
    store.put_manifest(spark, folder, {"a": "3"}, "2024-01-02 00:00:00")
    assert {r["key"]: r["value"] for r in store.manifest(spark, folder).collect()} == {"a": "3", "b": "2"}


def test_classify_and_ignore(spark):
    names = ["README.md", "a.markdown", "b.pdf", "c.py", "openapi.yaml", "x/Swagger.JSON", "d.sql", "e.toml", "f.sb", "g.bin", "api.openapi.yml", "__init__.py", "Makefile"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r[0] for r in df.select(files.classify("path")).collect()]
    assert got == ["markdown", "markdown", "pdf", "code", "openapi", "openapi", "sql", "config", "markdown", None, "openapi", "code", None]
    paths = ["a.md", "b.py", "node_modules/x.js", "tmp/c.md", "keep.log", "drop.log", "deep/gen/z.py", "root.txt", "sub/root.txt", "x.lock"]
    rules = ["# note", "tmp/", "*.log", "!keep.log", "deep/gen", "/root.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = {r["path"] for r in df.where(~files.ignored("path", rules)).collect()}
    assert kept == {"a.md", "b.py", "keep.log", "sub/root.txt"}


def test_read_files_and_lines(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg/__init__.py").write_bytes(b"x = 1\r\ny = '\xff'\n")
    (tmp_path / ".env").write_text("KEY=1")
    (tmp_path / "node_modules/a.js").write_text("no")
    read = files.read_files(spark, str(tmp_path))
    assert {r["path"] for r in read.collect()} == {"pkg/__init__.py", ".env"}
    got = [(r["line"], r["line_text"]) for r in files.lines(files.artifacts(read).where("path like '%.py'")).orderBy("line").collect()]
    assert got == [(1, "x = 1"), (2, "y = '�'")]
    split = files.segments(spark.createDataFrame([("p", "markdown", 1, "  - One. Two!  다섯。 끝 -")], "path string, kind string, line int, line_text string"))
    assert [r["segment"] for r in split.orderBy("nth").collect()] == ["One.", "Two!", "다섯。", "끝"]


def test_store(spark):
    a = spark.createDataFrame([("a1", "p"), ("a2", "q")], "id string, path string")
    part = spark.createDataFrame([("n1", "a1"), ("n2", "a2")], "id string, artifact_id string")
    edges = spark.createDataFrame([("e1", "n1", "n2", None), ("e2", "n2", "n2", "v1"), ("e3", "n2", "x", None)], "id string, src string, dst string, evidence_id string")
    evidence = spark.createDataFrame([("v1", "a1"), ("v2", "a2")], "id string, artifact_id string")
    tables = {"artifacts": a, "nodes": part, "chunks": part, "evidence": evidence, "edges": edges}
    left = store.cascade_delete(tables, spark.createDataFrame([("p",)], "path string"))
    ids = {t: sorted(r["id"] for r in df.collect()) for t, df in left.items()}
    assert ids == {"artifacts": ["a2"], "nodes": ["n2"], "chunks": ["n2"], "evidence": ["v2"], "edges": ["e3"]}
    again = store.cascade_delete(left, spark.createDataFrame([("p",)], "path string"))
    assert sorted(r["id"] for r in again["edges"].collect()) == ["e3"]
    assert sorted(r["id"] for r in store.remove_missing(tables, spark.createDataFrame([("q",)], "path string"))["nodes"].collect()) == ["n2"]
    put = {"artifacts": spark.createDataFrame([("a1", "p")], "id string, path string"), "nodes": spark.createDataFrame([("n9", "a1")], "id string, artifact_id string")}
    assert sorted(r["id"] for r in store.replace_files(tables, put)["nodes"].collect()) == ["n2", "n9"]
    delta = spark.createDataFrame([("a1", "new", 1), ("a1", "newest", 2), ("a3", "r", 1)], "id string, path string, seq int")
    assert {tuple(r) for r in store.upsert(a, delta, ["id"], "seq").collect()} == {("a1", "newest"), ("a2", "q"), ("a3", "r")}
    now = spark.createDataFrame([("p", "1"), ("q", "2"), ("s", "3")], "path string, content_hash string")
    before = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1")], "path string, content_hash string")
    assert {r["path"]: r["change"] for r in store.snapshot_diff(now, before).collect()} == {"p": "unchanged", "q": "modified", "s": "new", "r": "deleted"}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.tokenize(F.lit("A get /api/x, user_id"))) == ["get", "/api/x", "user_id"]
    assert [one(T.infer_intent(F.lit(t))) for t in ("Why change it", "rename x", "Add y", "look", "Find the mismatch")] == ["why", "impact", "implementation", "auto", "conflict"]
    assert one(T.clean_endpoint(F.lit(" /API/Users/). "))) == "/api/users/"
    assert one(T.identifier_key(F.lit("`Foo.bar()`"))) == "foo.bar" and one(T.identifier_key(F.lit("Foo.bar()"), True)) == "bar"
    assert one(T.normalize_path(F.lit("./Src\\App.ts"))) == "src/app.ts"
    assert [one(T.timeout_ms(F.lit(t))) for t in ("timeout: 1.5s", "wait 20 ms", "timeoutMs = 300", "no")] == [1500, 20, 300, None]
    assert [one(T.min_length_of_document(F.lit(t))) for t in ("8자 이상", "at least 10", "12 characters or more", "x")] == [8, 10, 12, None]
    assert one(T.location(F.lit("a"), F.lit(1), F.lit(3), F.lit(None).cast("int"))) == "a:1-3" and one(T.location(F.lit("a"), F.lit(1), F.lit(1), F.lit(2))) == "a:page 2"
    assert one(T.short(F.lit("  abc def  "), 6)) == "abc..." and one(T.meaningful_terms(F.lit("createUserProfile api id"))) == ["create", "profile"]


def test_ids_are_stable_and_order_free(spark):
    a = index.build(corpus(spark, CORPUS)).nodes.select("id")
    b = index.build(corpus(spark, dict(reversed(CORPUS.items())))).nodes.select("id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_takes_each_content_once(spark, tmp_path):
    from tessera.streaming.index import arrivals, write_new

    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = [("a.md", "one two"), ("b.py", "x")]
    spark.createDataFrame(rows, "path string, text string").coalesce(1).write.parquet(source)
    write_new(arrivals(spark, source), out, mark).awaitTermination()
    spark.createDataFrame([*rows, ("a.md", "one two three")], "path string, text string").coalesce(1).write.mode("append").parquet(source)
    write_new(arrivals(spark, source), out, mark).awaitTermination()
    got = sorted((r["path"], r["kind"], r["tokens"]) for r in spark.read.parquet(out).collect())
    assert got == [("a.md", "markdown", 2), ("a.md", "markdown", 3), ("b.py", "code", 1)]


def test_registered_queries_run(spark, data):
    from tessera.plans.queries import ORACLE_SQL, QUERIES

    assert {*ORACLE_SQL} <= {*QUERIES} and conflicts


def test_facts_of_each_family(spark):
    text = "The Login screen opens. The user can click the save button now.\nShow error \"Invalid token\" then.\n오류가 발생한다.\nThe orders table keeps rows.\nwebhook: Stripe events\n사용자가 결제 버튼을 클릭한다.\nRefund policy applies.\n"
    rows = files.lines(spark.createDataFrame([("a.md", "markdown", text)], "path string, kind string, text string"))
    from tessera.operators.extract import facts

    got = {(r["kind"], r["label"]) for r in facts(rows).collect()}
    assert {("ErrorMessage", "Invalid token"), ("ErrorMessage", "오류가 발생한다."), ("DatabaseEntity", "orders"), ("ExternalIntegration", "Stripe events"), ("BusinessPolicy", "Refund policy applies."), ("UserAction", "결제")} <= got
    assert any(k == "Screen" and "Login" in x for k, x in got) and any(k == "UserAction" and x.startswith("click") for k, x in got)


def test_snippets_chunks_and_sections(spark):
    text = "\n".join(["intro", "::Part One::", *[f"line {i}" for i in range(200)], " ::Two:: ", "end"])
    rows = files.lines(spark.createDataFrame([("a.sb", "markdown", text)], "path string, kind string, text string"))
    assert [r["line"] for r in files.snippet(rows, "a.sb", 10, 200).orderBy("line").collect()] == list(range(10, 90))
    assert [r["line_text"] for r in files.snippet(rows, "a.sb", 1, 80, max_chars=30).orderBy("line").collect()] == ["intro", "::Part One::", "line 0", "line"]
    for bad in ("../x", "/etc/passwd", "a/../../b"):
        with pytest.raises(ValueError):
            files.snippet(rows, bad, 1, 2)
    assert sorted((r["start_line"], r["end_line"]) for r in files.chunks(rows).collect()) == [(1, 120), (121, 204)]
    got = sorted((r["start_line"], r["end_line"], r["heading"]) for r in files.marked_sections(rows).collect())
    assert got == [(1, 1, None), (2, 202, "Part One"), (203, 204, "Two")]


def test_symbol_files(spark, tmp_path):
    import json

    good, binary, broken = (tmp_path / n for n in ("a.json", "b.scip", "c.json"))
    good.write_text(json.dumps({"documents": [{"relative_path": "src/app.ts", "occurrences": [{"symbol": "f().", "range": [0, 1, 2], "symbol_roles": ["1"]}, {"symbol": "f().", "range": [3, 1, 2], "symbol_roles": ["Definition"]}]}]}))
    binary.write_bytes(b"\xff\xfe\x00\x9f")
    broken.write_text("{oops")
    status, documents = files.read_symbols(spark, str(good))
    assert status == "ok" and [o["symbol_roles"] for o in documents.first()["occurrences"]] == [["Definition"], ["Definition"]]
    assert files.read_symbols(spark, str(binary))[0] == "unsupported_binary" and files.read_symbols(spark, str(broken))[0] == "unsupported_format"


def rows_in(tables):
    """What a stored index holds, as sets of rows."""
    return {t: {tuple(r[c] for c in store.names_of(t)) for r in df.collect()} for t, df in tables.items() if t in store.FILED}


def test_stored_runs_equal_a_build_and_write_what_changed(spark, tmp_path):
    import os

    folder, whole = str(tmp_path / "index"), str(tmp_path / "whole")
    assert {t: df.count() for t, df in store.load_tables(spark, folder).items()} == dict.fromkeys(store.TABLES, 0)
    index.run(corpus(spark, CORPUS), folder, buckets=16)
    changed = {p: x for p, x in CORPUS.items() if p != "db/schema.sql"} | {"src/app.ts": APP.replace("/api/users", "/api/members"), "docs/new.md": "# New\n\nSee `POST /api/members` and src/app.ts.\n"}
    got = {r["path"]: r["change"] for r in index.run(corpus(spark, changed), folder).collect()}
    assert got == {"README.md": "unchanged", "src/app.ts": "modified", "openapi.yaml": "unchanged", "db/schema.sql": "deleted", "svc/pay.py": "unchanged", "docs/new.md": "new"}
    index.run(corpus(spark, changed), whole, buckets=16)
    stored, again = rows_in(store.load_tables(spark, folder)), rows_in(store.load_tables(spark, whole))
    assert stored == again and any(r[6] == "code_document_linker" for r in stored["edges"])
    built, loaded = index.build(corpus(spark, changed)), index.load(spark, folder)
    for of in ("nodes", "edges"):
        a, b = (getattr(x, of).drop("indexed_at") for x in (built, loaded))
        columns = sorted(a.columns)
        assert {tuple(r[c] for c in columns) for r in a.collect()} == {tuple(r[c] for c in columns) for r in b.collect()}
    buckets = {r["path"]: r["b"] for r in spark.createDataFrame([(p,) for p in {**CORPUS, **changed}], "path string").withColumn("b", store.bucket_of("path", 16)).collect()}
    want = {buckets[p] for p in ("src/app.ts", "db/schema.sql", "docs/new.md")}
    found = lambda t: {int(x.split("=")[1]) for x in os.listdir(f"{folder}/{t}/version=2") if "=" in x}
    assert found("nodes") <= want and found("artifacts") <= want and buckets["src/app.ts"] in found("nodes")
    index.run(corpus(spark, changed), folder)
    assert store.Stored(spark, folder).version == 2  # no changes, no version
    ask = "Change POST /api/members to require email"
    assert [r["id"] for r in loaded.ask(ask)["evidence"].collect()] == [r["id"] for r in built.ask(ask)["evidence"].collect()]


def test_stored_postings_give_the_same_as_a_scan(spark):
    import random

    from tessera.operators import postings, search

    rng = random.Random(2)
    words = ["aa", "bb", "cc", "dd", "ee", "often", "often", "often"]
    rows = [(f"t{i}", " ".join(rng.choices(words, k=rng.randrange(0, 40))) if i % 9 else None) for i in range(400)] + [("rare1", "zz aa"), ("rare2", "zz zz " + "often " * 50)]
    texts = spark.createDataFrame(rows, "id string, text string")
    stored = postings.postings(texts.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(37)).cast("int")))
    asks = {0: ["zz"], 1: ["aa", "often"], 2: ["none"], 3: ["aa", "bb", "cc", "dd", "ee", "often"]}
    queries = spark.createDataFrame([(q, t) for q, ts in asks.items() for t in ts], "query_id int, term string")
    scans = {q: sorted((-round(r["score"], 9), r["id"]) for r in search.bm25_topk(texts, ts, 1000).collect()) for q, ts in asks.items()}
    for k in (1, 7, 1000):
        got = {}
        for r in postings.topk(stored, queries, k, first=2).collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
        for q, ts in asks.items():
            scan, found = scans[q][:k], sorted(got.get(q, []))
            assert [i for _, i in found] == [i for _, i in scan] and all(abs(a - b) < 1e-8 for (a, _), (b, _) in zip(found, scan))
    assert postings.topk(stored.limit(0), queries, 3).count() == 0


def test_many_tasks_in_one_traversal_equal_one_each(spark):
    import random

    from tessera.operators import graph

    rng = random.Random(7)
    ends = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice(["CONTAINS", "IMPORTS", "SEMANTIC_CANDIDATE"])) for _ in range(50)] + [("hub", f"n{i}", "DEFINES") for i in range(0, 30, 2)]
    edges = spark.createDataFrame([(a, b, r, "DOC_EXACT", 1.0, "none") for a, b, r in ends], "src string, dst string, relation string, confidence string, score double, extractor string")
    nodes = spark.createDataFrame([("hub",), *[(f"n{i}",) for i in range(29)]], "id string")
    tasks = {0: ["n1"], 1: ["n2", "hub"], 2: ["n29"], 3: ["n3"]}
    seeds = spark.createDataFrame([(t, i) for t, ids in tasks.items() for i in ids], "task_id int, id string")
    got = {tuple(r) for r in graph.traverse(nodes, edges, seeds, 3).select("task_id", "id", "distance", "weight", F.array_join("path", ">")).collect()}
    want = {(t, *r) for t in tasks for r in graph.traverse(nodes, edges, seeds.where(F.col("task_id") == t).select("id"), 3).select("id", "distance", "weight", F.array_join("path", ">")).collect()}
    assert got == want and not any(t == 2 for t, *_ in got)


def test_counts_of_a_plan(spark):
    rows = [("a", "code", "new"), ("b", "code", "new"), ("c", "sql", "new"), ("d", None, "deleted")]
    got = {(r["kind"], r["change"], r["all_kinds"], r["all_changes"]): r["n"] for r in store.plan_counts(spark.createDataFrame(rows, "path string, kind string, change string")).collect()}
    assert got[None, None, 1, 1] == 4 and got["code", None, 0, 1] == 2 and got[None, "new", 1, 0] == 3 and got["code", "new", 0, 0] == 2 and got[None, "deleted", 0, 0] == 1


def test_summary_and_search(project):
    made = pack.build(project, "Change POST /api/users to require email")
    said = pack.summary(made)
    assert said.startswith("Conclusion") and "src/app.ts:13" in said
    assert project.search("Change POST /api/users").first()["reason"].startswith("exact_endpoint")


def test_every_match_of_a_sentence_is_a_fact(spark):
    from tessera.operators.extract import facts

    text = "Join the orders table with the users table.\nOpen the Login screen, then the Cart screen.\nThe user clicks save, the admin deletes rows.\nwebhook: Stripe, webhook: Slack\nThe field userName and key `order_id` are input.\n"
    rows = files.lines(spark.createDataFrame([("a.md", "markdown", text)], "path string, kind string, text string"))
    got = {(r["kind"], r["label"]) for r in facts(rows).collect()}
    assert {("DatabaseEntity", "orders"), ("DatabaseEntity", "users"), ("Screen", "Open the Login"), ("Screen", "then the Cart"), ("ExternalIntegration", "Stripe"), ("ExternalIntegration", "Slack"), ("FormField", "userName"), ("FormField", "order_id")} <= got
    assert {x for k, x in got if k == "UserAction"} == {"clicks save, the admin deletes rows"} or {x for k, x in got if k == "UserAction"} >= {"clicks save, the admin deletes rows"}


def test_odd_json_files_are_read_on(spark):
    texts = {
        "trail.json": '{"a": 1} xx', "nan.json": '{\n "x": NaN,\n "y": -Infinity}', "deep.json": '{"a":' * 5000 + "1" + "}" * 5000, "cut.json": '{"a": {"b": ',
        "near.json": '{\n "identifier": 1,\n "id": 2,\n "o": {\n  "id": 3\n }\n}', "empty.json": "", "text.json": '"a"', "twice.json": '{"k": [{"z": 1}, {"z": 2}]}',
    }
    nodes = index.build(corpus(spark, texts)).nodes.where("kind = 'ConfigKey'")
    got = {(r["path"], r["canonical_name"]): r["start_line"] for r in nodes.where("path <> 'deep.json'").collect()}
    assert got == {("nan.json", "x"): 2, ("nan.json", "y"): 3, ("near.json", "identifier"): 2, ("near.json", "id"): 3, ("near.json", "o"): 4, ("near.json", "o.id"): 5, ("twice.json", "k"): 1, ("twice.json", "k.z"): 1}
    assert nodes.where("path = 'deep.json'").count() >= 100


def test_overlaps_equal_all_pairs(spark):
    import random

    from tessera.operators import joins

    random.seed(5)
    make = lambda p: [(f"{p}{i}", sorted({"common", *random.choices("abcdefghijklmnop", k=random.randrange(5))} | ({"often"} if i % 2 else set()))) for i in range(60)]
    left, right = make("l"), make("r")
    frame = lambda rows: spark.createDataFrame(rows, "id string, terms array<string>")
    for least in (1, 2, 3):
        want = {(a, b, len({*s} & {*t})) for a, s in left for b, t in right if len({*s} & {*t}) >= least}
        for hot in (10_000, 3):
            assert {tuple(r) for r in joins.overlaps(frame(left), frame(right), least, hot).collect()} == want
    alone = [(f"x{i}", ["common", f"own{i}"]) for i in range(50)]
    assert joins.overlaps(frame(alone), frame([(i, [t.replace("own", "other") for t in s]) for i, s in alone])).count() == 0
    many = spark.range(1000).selectExpr("id % 3 as k", "id as a")
    few = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z"), (9, "n")], "k long, b string")
    want = sorted((i % 3, i, b) for i in range(1000) for k, b in [(0, "x"), (0, "y"), (1, "z")] if i % 3 == k)
    assert sorted(tuple(r) for r in joins.meet(many, few, ["k"], limit=0, hot=50).collect()) == want


def test_conflicts_of_a_topic_without_subjects_need_no_pairs(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("timeout_ms").alias("subject"), ((F.col("id") % 10) * 1000).cast("string").alias("value"), F.concat(F.lit("a.md:"), F.col("id").cast("string")).alias("location"), F.lit("q").alias("quote"), F.lit("DOC_EXACT").alias("confidence"))
    assert conflicts.differing(rows, rows).count() == 9 * n
    none = rows.limit(0)
    doc = {t: none for t in ("validation", "status", "endpoint", "retry", "permission")} | {"timeout": rows}
    assert conflicts.detect(doc, dict(doc)).count() == 9 * n


LITERAL = {
    "README.md": "# Users\n\nThe client calls `POST /api/users`.\n\nThe password must be at least 8 characters.\n\nStatus PAID ends it. Only admin can refund.\n",
    "src/app.ts": 'export function createUser(req, res) {\n  if (!req.body.email) throw new Error("required");\n}\napp.post("/api/users", createUser);\nconst schema = {\n  password: z.string().min(6),\n};\n',
    "openapi.yaml": "paths:\n  /api/users:\n    post:\n      summary: create\ncomponents:\n  status:\n    enum:\n      - CAPTURED\n      - FAILED\n",
    "schema.sql": "CREATE TABLE users (\n  id INT,\n  email TEXT\n);\nSELECT * FROM orders;\n",
}


def corpus(spark, texts):
    return files.artifacts(spark.createDataFrame([(p, x.encode()) for p, x in texts.items()], files.CORPUS))


def test_conflicts_of_a_small_project(spark):
    got = {(r["type"], r["summary"]) for r in index.build(corpus(spark, LITERAL)).conflicts().collect()}
    assert got == {
        ("validation_mismatch", "Document requires min length 8, but code enforces 6."),
        ("status_value_mismatch", "Document references status PAID, but code enum contains CAPTURED, FAILED."),
    }


def test_as_of_sweep_finds_the_span_around(spark):
    from tessera.operators.nearest import covering

    spans = spark.createDataFrame([("p", 1, 3, "a"), ("p", 4, 4, "b"), ("p", 8, 9, "c"), ("q", 2, 2, "d")], "k string, s int, e int, name string")
    points = spark.range(0, 24).selectExpr("if(id % 2 = 0, 'p', 'q') as k", "cast(id div 2 as int) as at")
    want = {("p", x, n) for a, b, n in [(1, 3, "a"), (4, 4, "b"), (8, 9, "c")] for x in range(a, b + 1)} | {("q", 2, "d")}
    assert {(r["k"], r["at"], r["name"]) for r in covering(points, spans, "k", "at", "s", "e").collect()} == want


def test_closest_scopes_equal_all_pairs(spark):
    import random

    from tessera.operators.nearest import closest_scope

    rng = random.Random(12)
    spans = [(f"f{i % 3}", a := rng.randrange(1, 300), a + rng.choice([0, 1, 3, 10, 40, 200]), f"s{i:03}") for i in range(80)]
    points = [(f"f{i % 4}", rng.randrange(1, 900), i) for i in range(200)]

    def apart(at, a, b):
        return b - a if a <= at <= b else abs(at - a) + 100

    want = {}
    for k, at, p in points:
        # of spans that are not around a point only the last started of the ended and the first to start can be closest
        options = sorted((apart(at, a, b), s) for kk, a, b, s in spans if kk == k)
        if options:
            want[p] = options[0]
    got = {r["point"]: (r["apart"], r["span"]) for r in closest_scope(spark.createDataFrame(points, "k string, at int, point long"), spark.createDataFrame(spans, "k string, start int, end int, span string"), "k").collect()}
    assert got == want


def test_routes_meet_the_last_function_of_their_name_above(spark):
    code = "function f() {}\napp.get('/a', f);\nfunction f() {}\napp.get('/b', f);\napp.get('/c', g);\nfunction g() {}\n"
    py = "@app.get('/x')\n@app.post('/y')\ndef one():\n    pass\n\n@app.get('/z')\ndef two():\n    pass\n\n@app.get('/w')\nx = 1\n"
    both = index.build(corpus(spark, {"a.ts": code, "b.py": py}))
    at = both.nodes.select("id", "label", "start_line")
    got = both.edges.where("relation = 'ROUTE_TO_HANDLER'").join(at.select(F.col("id").alias("src"), F.col("label").alias("route")), "src").join(at.select(F.col("id").alias("dst"), F.col("start_line").alias("line")), "dst")
    assert {(r["route"], r["line"]) for r in got.collect()} == {("GET /a", 1), ("GET /b", 3), ("GET /x", 3), ("POST /y", 3), ("GET /z", 7)}


def test_facts_of_a_line_are_told_apart_in_its_row(spark):
    from tessera.operators.extract import facts

    lines = spark.createDataFrame([("a.md", "markdown", 1, "From PAID to PAID. It is PAID! Then FAILED"), ("b.md", "markdown", 1, "PAID"), ("a.md", "markdown", 2, "PAID")], "path string, kind string, line int, line_text string")
    found = facts(lines)
    got = sorted((r["path"], r["start_line"], r["label"], r["quote"]) for r in found.where("kind = 'StatusValue'").collect())
    assert got == [("a.md", 1, "FAILED", "Then FAILED"), ("a.md", 1, "PAID", "From PAID to PAID."), ("a.md", 2, "PAID", "PAID"), ("b.md", 1, "PAID", "PAID")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Repartition") == 1  # lines are dealt once, their facts not at all


def test_following_handler_is_carried_not_summed(spark):
    from tessera.operators.extract import _handlers

    routes = spark.createDataFrame([("r1", "a.py", None, 1), ("r2", "a.py", None, 4), ("r3", "a.py", None, 9)], "id string, path string, subject string, start_line int")
    functions = spark.createDataFrame([("f1", "a.py", "f", 2), ("f2", "a.py", "g", 4), ("f3", "a.py", "h", 6)], "id string, path string, label string, start_line int")
    found = _handlers(routes, functions)
    assert {(r["id"], r["handler_id"]) for r in found.collect()} == {("r1", "f1"), ("r2", "f3")}
    assert "unboundedfollowing" not in found._jdf.queryExecution().analyzed().toString().lower()


def test_tables_without_rows_and_kinds_without_partners_cost_no_joins(spark, tmp_path):
    from tessera.operators import links
    from tessera.operators.extract import NODE
    from tessera.operators.store import Stored

    none = Stored(spark, str(tmp_path / "none")).table("nodes")
    assert "Join" not in none.join(spark.range(3).selectExpr("cast(id as string) as id"), "id")._jdf.queryExecution().optimizedPlan().toString()
    row = {c: None for c in NODE} | {"id": "f", "kind": "Function", "label": "f", "artifact_kind": "code", "path": "f.py", "confidence": "EXACT_STATIC"}
    schema = ", ".join(f"{c} {'int' if c in ('start_line', 'end_line', 'page') else 'string'}" for c in NODE)
    nodes = spark.createDataFrame([tuple(row[c] for c in NODE)], schema)
    edges = spark.createDataFrame([], "src string, dst string, relation string")
    found = links.link(nodes, edges)
    assert found.count() == 0 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_postings_are_not_shuffled(spark):
    from tessera.operators.postings import postings

    texts = spark.createDataFrame([(1, "alpha beta alpha", 0), (2, "beta", 0), (3, None, 1), (4, "x", 1), (5, "gamma", 1)], "id long, text string, block int")
    found = postings(texts)
    rows = {(r["block"], r["term"]): r for r in found.collect()}
    assert {*rows} == {(0, ""), (0, "alpha"), (0, "beta"), (1, ""), (1, "gamma")}
    assert (rows[0, ""]["n"], rows[0, ""]["total_length"], rows[0, ""]["entries"], rows[0, ""]["most_tf"]) == (2, 4, None, None)
    assert [tuple(e) for e in rows[0, "beta"]["entries"]] == [("1", 1, 3), ("2", 1, 1)] and rows[0, "alpha"]["most_tf"] == 2 and rows[0, "beta"]["least_length"] == 1
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1  # texts alone, by block


def test_traversal_joins_no_edges_with_nodes_and_leaves_unknown_ones_out(spark, monkeypatch):
    from tessera.operators import graph

    plans, cut = [], graph.checkpoint

    def noted(df):
        if "pull" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "checkpoint", noted)
    edges = spark.createDataFrame([(a, b, "CONTAINS", "EXACT_STATIC", 1.0, "none") for a, b in ["ab", "bc", "ax", "xd", "cd"]], "src string, dst string, relation string, confidence string, score double, extractor string")
    nodes = spark.createDataFrame([(i,) for i in "abcd"], "id string")  # x is none of them
    found = graph.traverse(nodes, edges, nodes.where("id = 'a'"))
    assert {(r["id"], r["distance"]) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert plans and not any("Join" in p for p in plans)


@pytest.mark.parametrize("usual", [100, 3])
def test_similar_endpoints_with_usual_terms(spark, monkeypatch, usual):
    import random

    from tessera.operators import conflicts

    monkeypatch.setattr(conflicts, "USUAL", usual, raising=False)
    made, first = [], conflicts.first_per_key

    def noted(df, *more):
        if "alike" in df.columns:
            made.append(df.count())
        return first(df, *more)

    monkeypatch.setattr(conflicts, "first_per_key", noted)
    rng = random.Random(3)
    path = lambda side, i: f"/en/pages/{side}{i}" + "".join(f"/{w}" for w in ("html", "signup", "members", "orders") if rng.random() < 0.3) + f"/t{rng.randrange(60)}"
    rows = {s: [(rng.choice(["GET", "GET", "PUT"]), path(s, i) if i % 9 else f"/{rng.choice(['signup', 'register', 'list'])}/{s}{i}/t{i}", f"{s}{rng.randrange(40)}", "q", "DOC_EXACT") for i in range(300)] for s in "dc"}
    docs, code = (spark.createDataFrame(rows[s], "subject string, value string, location string, quote string, confidence string") for s in "dc")
    got = {(r["subject"], r["doc_value"]): r["code_value"] for r in conflicts.similar_endpoints(docs, code).collect()}
    terms = lambda v: {w for w in v.lower().split("/") if w}
    expected = {}
    for m, v, *_ in rows["d"]:
        alike = [(-len(terms(v) & terms(w)) - 2 * all(terms(x) & {*conflicts.SIGNUP} != set() for x in (v, w)), loc, w) for n, w, loc, *_ in rows["c"] if n == m]
        if alike and min(alike)[0] <= -2:
            expected[m, v] = min(alike)[2]
    assert got == expected and len(got) > 200
    assert max(made) < 300 * 30


def test_quote_nodes_make_no_pairs_of_a_document(spark):
    import random

    from tessera.operators.search import quote_nodes

    rng = random.Random(5)
    some = lambda n: rng.choice([None, *range(n)])
    rows = [(f"n{i:03}", f"d{rng.randrange(4)}", some(3), some(3), some(2), rng.choice(["a pin", "other"])) for i in range(60)]
    nodes = spark.createDataFrame(rows, "id string, artifact_id string, start_line int, end_line int, page int, quote string")
    own = spark.createDataFrame([(f"d{i}", f"p{3 - i}", k) for i in range(4) for k in (["markdown", "pdf"] if i == 1 else ["markdown"])], "id string, path string, kind string")
    last = lambda x: (x is None, x)
    same = lambda x, y: x is not None and x == y
    met = [(n, f"p{3 - int(n[1][1])}") for e in rows for n in rows for _ in range(1 + (n[1] == "d1")) if e[5] == "a pin" and e[1] == n[1] and (same(e[2], n[2]) and same(e[3], n[3]) or same(e[4], n[4]))]
    met.sort(key=lambda m: (m[1], last(m[0][2]), last(m[0][4]), m[0][0]))
    for limit in (5, 20, 200):
        found = quote_nodes(nodes, own, nodes, ["pin"], limit)
        assert {r["id"] for r in found.collect()} == {n[0] for n, _ in met[:limit]}
    many = spark.createDataFrame([(f"n{i}", "d", i, i, None, "a pin") for i in range(1000)], "id string, artifact_id string, start_line int, end_line int, page int, quote string")
    one = spark.createDataFrame([("d", "p", "markdown")], "id string, path string, kind string")
    plan = quote_nodes(many, one, many, ["pin"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and not any(" OR " in x or "||" in x for x in joins)


def test_hints_let_no_match_pass_by(spark):
    """Mentions and facts of lines that are searched by their hints are those of all lines."""
    import random

    from tessera.operators import extract

    rng = random.Random(11)
    pieces = """the thonly as only Admin can ADMIN must MUST be valid at least 8자 이상 8 min max MAXimum required field `userId` `PAID` PAID status: READY is error "bad" ERROR returns raise throws shall needs to has to have to
    read-only local-first no external do not never validation reject when policy approval refund business rule 정책 보관 필수 관리자만 사용자가 버튼을 클릭 화면: 홈 screen: Home page - list view page key: a.b input field_name user clicks Save
    webhook: Slack users table Order entity 테이블: orders GET /api/users /api/x.y see [a](/api/z) [b](src/a.ts) src/app.ts readme.md call() obj.run (x) a_b max-retries PascalCase UserCard HTTPServer warning 'w' failure 오류 viewer editor
    forbidden unauthorized permission role retention settlement parameter entity collection integration lorem ipsum. Dolor! sit? amet。 mİnimum mınimum muſt Keyword ﬁeld - • customer agent operator""".split()
    plain = "lorem ipsum dolor sit amet an the of.".split()
    texts = [" ".join(rng.choice(pieces if rng.random() < share else plain) for _ in range(rng.randrange(1, 14))) for share in (0.1, 0.3, 1.0) for _ in range(400)] + pieces
    rows = spark.createDataFrame([(f"d{i % 7}.md", "markdown", i, x) for i, x in enumerate(texts)], "path string, kind string, line int, line_text string")
    of = lambda f: sorted(map(repr, f(rows).collect()))
    got = {f: of(f) for f in (extract.mentions, extract.facts)}
    every = "(?s:.?)"
    with pytest.MonkeyPatch.context() as m:
        for hints in ("HINTS", "FACT_HINTS", "DOTTED", "UPPER", "CAMEL"):
            m.setattr(extract, hints, every, raising=False)
        m.setattr(extract, "TOLD", dict.fromkeys(extract.TOLD, every))
        want = {f: of(f) for f in got}
    assert got == want and all(len(found) > 1000 for found in got.values())
    kept = extract.fitting(spark.createDataFrame([("d.md", "markdown", 1, "Lorem ipsum the of."), ("d.md", "markdown", 2, "Lorem only."), ("d.md", "markdown", 3, None)], rows.schema), "line_text", extract.HINTS)
    assert [r["line"] for r in kept.collect()] == [2]


def test_facts_of_documents_are_those_of_all_nodes(spark):
    """Facts of nodes that are read by their hints are those of all nodes."""
    import random

    rng = random.Random(4)
    pieces = "must be|at least|minimum|min length|max|8|12 characters|20chars|10 characters or more|12 자 이상|muſt be|at leaſt|mınimum 9|retry 3|retries: 5|최대 4 회|timeout 30 s|타임아웃 5초|제한 시간 10 초|only admins|Only|관리자만|owner|`email`|password|lorem|ipsum.|dolor".split("|")
    kinds = ["Paragraph", "Requirement", "ValidationRule", "Policy", "PermissionRule", "StatusValue", "APIReference", "Section"]
    rows = []
    for i in range(1500):
        kind = rng.choice(kinds)
        label = "PAID" if kind == "StatusValue" else "GET /api/x%d" % i if kind == "APIReference" else "label"
        rows.append((f"n{i}", kind, label, label, "markdown", f"d{i % 9}.md", i, i, None, rng.choice(["DOC_EXACT", "DOC_INFERRED", "AMBIGUOUS"]), None, None, None, rng.choice([None, "email", "input"]), rng.choice([None, " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))])))
    nodes = spark.createDataFrame(rows, "id string, kind string, label string, canonical_name string, artifact_kind string, path string, start_line int, end_line int, page int, confidence string, method string, endpoint string, reference_type string, subject string, quote string")
    of = lambda: {t: sorted(map(repr, df.collect())) for t, df in conflicts.document_facts(nodes).items()}
    got = of()
    with pytest.MonkeyPatch.context() as m:
        read = []
        m.setattr(conflicts, "fitting", lambda rows, *_: read.append(rows) or rows)
        want = of()
    assert read and got == want and all(got.values())


def test_counted_terms_are_those_of_tokenize(spark):
    import random

    from tessera.functions import text as T
    from tessera.operators import search

    rng = random.Random(3)
    words = ["to", "To", "GET", "/pages/7", "pin_7", "pın_7", "a", "é", "to", "x.y", "$z", "—", "\n", ",", "", "toé", "\u0000to"]
    rows = [(i, rng.choice([None, "", "a", "to"]) if i % 5 == 0 else "".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(12)))) for i in range(600)]
    texts = spark.createDataFrame(rows, "id long, text string")
    tokens = ["to", "get", "/pages/7", "pin_7", "a", "x.y", "é", "absent", "$z"]
    terms = texts.select("id", T.tokenize("text").alias("terms")).withColumn("length", F.size("terms"))
    want = sorted((r["term"], r["id"], r["length"], r["tf"]) for r in search.matching_postings(terms, tokens).collect())
    size = terms.where("length > 0").agg(F.count("*"), F.sum("length")).first()
    for most in (search.SLICE_BYTES, 7):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(search, "SLICE_BYTES", most)
            made = search.counted_terms(texts, tokens).collect()
        assert sorted((r["term"], r["id"], r["length"], r["tf"]) for r in made if r["term"]) == want
        assert tuple(size) == tuple(sum(r[c] for r in made if not r["term"]) for c in ("tf", "length"))


def test_one_node_of_each_id_stays_without_sorting_nodes(spark):
    rows = [(f"n{i}", i) for i in range(500)] + [("n3", 3), ("n3", 3), ("n7", 7)]
    nodes = spark.createDataFrame(rows, "id string, line int").checkpoint()
    for limit in (1_000_000, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(index, "small", lambda df, limit=limit: (F.broadcast if limit else lambda rows: rows))
            assert sorted(map(tuple, index.one_each(nodes).collect())) == sorted({*rows})
    assert "SortAggregate" not in index.one_each(nodes.where("id <> 'n3'"))._jdf.queryExecution().executedPlan().toString().split("Union")[0]


def test_line_ends_are_not_lines(spark):
    texts = ["a", "a\n", "a\n\n", "\n", "\r\n", "a\r\nb\r\n", "a\r\n\r", "\u2028a\u2029", " ", "a\u0085\n", "\n\n", "a\vb\f"]
    rows = spark.createDataFrame([(f"f{i}", "markdown", x) for i, x in enumerate(texts)], "path string, kind string, text string")
    got = {}
    for r in sorted(files.lines(rows).collect(), key=lambda r: r["line"]):
        got.setdefault(r["path"], []).append(r["line_text"])
    assert got == {f"f{i}": x.splitlines() for i, x in enumerate(texts)}


def test_links_make_keys_and_endpoints_once(spark):
    """Filters and joins on keys and endpoints read them; none makes them again."""
    from tessera.operators import links

    rows = [("d1", "APIReference", "GET /api/a", "markdown", "GET", "/api/a"), ("d2", "FormField", "email", "markdown", None, None), ("c1", "Endpoint", "GET /api/a", "code", "GET", "/api/a"), ("c2", "Column", "Email", "sql", None, None)]
    nodes = spark.createDataFrame(rows, "id string, kind string, label string, artifact_kind string, method string, endpoint string").selectExpr("*", "label as canonical_name", "'p' as path", "'DOC_EXACT' as confidence", "cast(null as string) as reference_type").checkpoint()
    docs, code = nodes.where("artifact_kind = 'markdown'"), nodes.where("artifact_kind <> 'markdown'")
    for made, want in ((links.endpoint_links, ("d1", "c1")), (links.identifier_links, ("d2", "c2"))):
        found = made(docs, code)
        assert [(r["src"], r["dst"]) for r in found.collect()] == [want]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.split("\n") if "Filter" in x and "regexp" in x]


def test_evidence_shuffles_no_nodes(spark):
    """A question about many nodes reads them; no texts or ids of all of them are sorted or sent."""
    from tessera.operators import joins, retrieve

    nodes = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("Paragraph").alias("kind"))
    nodes = nodes.checkpoint()
    few = spark.createDataFrame([("n1", 1), ("n5", 2), ("x", 3), ("n1", 4)], "id string, v int").checkpoint()
    held = joins.present(few, nodes)
    assert sorted(r["v"] for r in held.collect()) == [1, 2, 4]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(joins, "SMALL_ROWS", 1)
        assert sorted(r["v"] for r in joins.present(few, nodes).collect()) == [1, 2, 4]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    wide = nodes.select("id", "kind", F.lit("a label").alias("label"), F.lit("a label").alias("canonical_name"), F.lit("p").alias("path"), F.lit("DOC_EXACT").alias("confidence"), *[F.lit(None).cast("string").alias(c) for c in ("method", "endpoint")])
    tasks = spark.createDataFrame([(0, "Change `a.label` in src/p.ts for GET /x")], "task_id int, task string")
    plan = retrieve.find_seeds(wide, tasks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1  # one pass over nodes for all rules
