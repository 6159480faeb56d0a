"""The queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import remove_folder, scratch, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan, summary

    return summary(scan(table(spark, sf_dir, "documents")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import fit, scan

    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _remainder(n: int):
    """crc32 of doc_id as text (null: empty) modulo ``n``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.where(_remainder(3) != 1)))
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(_remainder(5) != 0)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import judge

    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(table(spark, sf_dir, "documents")).select(*columns)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.urls import judge, rule_table

    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.merkle import audit

    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return audit(table(spark, sf_dir, "documents")).select(*columns)


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.interaction import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages go once what was read back from them has been written."""
    import uuid

    from tessera.llm.warc import round_trip

    folder = f"{scratch(spark)}/packages-{uuid.uuid4().hex}"
    try:
        found = round_trip(table(spark, sf_dir, "pages"), folder)
    finally:
        remove_folder(spark, folder)
    return found


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_license_scan": op2_license_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_host_quality": op9_host_quality,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_interaction": op12_filter_interaction,
    "op13_warc_packages": op13_warc_packages,
}



def _merkle_sql(levels: int = 7) -> str:
    """The trees of op11 in SQL, level by level (16 ** 7 rows a source); nodes above a group's root are passed on as they are."""

    def tree(t: str, source: str) -> list[str]:
        """t0: grp, pos, node, n; then a run and a level for each; tp: what each of t0's nodes meets on its way up."""
        out = [f"{t}0 as ({source})"]
        for i in range(levels):
            out.append(f"{t}r{i} as (select grp, pos // 16 as run, n, string_agg(node, '' order by pos) as joined from {t}{i} where n > {16**i} group by grp, pos // 16, n)")
            out.append(f"{t}{i + 1} as (select grp, run as pos, sha256(joined) as node, n from {t}r{i} union all select grp, pos, node, n from {t}{i} where n <= {16**i})")
        steps = [f"left join {t}r{i} as r{i} on r{i}.grp = a.grp and r{i}.run = a.pos // {16 ** (i + 1)}" for i in range(levels)]
        path = ", ".join(f"case when r{i}.joined is not null then {{'j': r{i}.joined, 'at': a.pos // {16**i} % 16}} end" for i in range(levels))
        out.append(f"{t}p as (select a.grp, a.pos, list_filter([{path}], lambda x: x is not null) as path from {t}0 a {' '.join(steps)})")
        return out

    value = lambda c: f"case when {c} is null then '-' else cast(octet_length(encode(cast({c} as varchar))) as varchar) || ':' || cast({c} as varchar) end"
    leaf = lambda text: "sha256(" + " || ".join([*map(value, ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = _crc32_sql("doc_id")
    docs = f"""d as (select doc_id, coalesce('=' || source, '') as grp, {leaf('text')} as leaf, case when {crc} % 5 = 0 then {leaf(low)} else {leaf('text')} end as held from documents),
    p as (select *, row_number() over (partition by grp order by doc_id, leaf) - 1 as pos, count(*) over (partition by grp) as n from d)"""
    rows = tree("a", "select grp, pos, leaf as node, n from p")
    tops = tree("b", f"select '' as grp, row_number() over (order by grp) - 1 as pos, node, count(*) over () as n, grp as name from a{levels}")
    cut = "substr(x.j, 1, 64 * x.at)"
    rest = "substr(x.j, 64 * x.at + 65)"
    fold = "held"
    steps = []
    for i in range(2 * levels):
        steps.append(f"f{i + 1} as (select * exclude (fold), case when len(path) > {i} then sha256(substr(path[{i + 1}].j, 1, 64 * path[{i + 1}].at) || fold || substr(path[{i + 1}].j, 64 * path[{i + 1}].at + 65)) else fold end as fold from f{i})")
    return f"""with {docs}, {', '.join([*rows, *tops])}, w as (select node as root from b{levels}),
    s as (select b0.name as grp, b0.node as subroot, bp.path as top from b0 join bp on bp.pos = b0.pos),
    f0 as (select p.doc_id, p.leaf, s.subroot, ap.path || s.top as path, p.held as fold from p join ap on ap.grp = p.grp and ap.pos = p.pos join s on s.grp = p.grp), {', '.join(steps)}
    select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: {cut} || {rest}), ''), '')) as proof_sha256, fold as folded_root, fold = root as verified from f{2 * levels}, w"""


def _crc32_sql(column: str) -> str:
    """Unsigned CRC-32 of a whole number's decimal text, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, d), range(8)), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)"
    digits = f"list_transform(regexp_extract_all(cast({column} as varchar), '.'), lambda x: cast(ascii(x) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {digits}), lambda c, d: {step}), 4294967295)"


#: Each document's flags, then every order of the filters as a row of five steps.
_INTERACTION_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as w from documents
), flagged as (
  select d.part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by text), false) as e,
    doc_id in (select doc_id from labels where quality = 1) as good, doc_id in (select doc_id from labels where toxic = 1) as toxic from d
), x(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')
), orders as (
  select p.f || q.f || r.f || s.f || t.f as filter_order from x p, x q, x r, x s, x t where len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5
), failed as (
  select part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda l, i: [a, b, c, d, e][i]) as fails, count(*) as n from flagged group by all
), met as (
  select *, coalesce(list_min(list_transform(fails, lambda l: strpos(filter_order, l))), 6) as first from failed, orders
), steps as (
  select *, unnest([1, 2, 3, 4, 5]) as step from met
), counted as (
  select part, filter_order, step, substr(filter_order, step, 1) as letter, cast(coalesce(sum(n) filter (where first > step), 0) as bigint) as kept, cast(coalesce(sum(n) filter (where first = step), 0) as bigint) as removed,
    cast(coalesce(sum(n) filter (where first < step and list_contains(fails, substr(filter_order, step, 1))), 0) as bigint) as redundant,
    cast(coalesce(sum(n) filter (where fails = [substr(filter_order, step, 1)]), 0) as bigint) as unique_fails,
    cast(coalesce(sum(n) filter (where first = step and good), 0) as bigint) as good_lost, cast(coalesce(sum(n) filter (where first = step and toxic), 0) as bigint) as toxic_lost
  from steps group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from counted
"""

#: DuckDB SQL for the rows of a query; the others are tested against brute force or on held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op12_filter_interaction": _INTERACTION_SQL,
    "op13_warc_packages": """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest, coalesce(html, '') as html from pages
), g as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by html) end as first_id from p
)
select page_id, payload_bytes, payload_digest, case when first_id is distinct from page_id and first_id is not null then 'revisit' else 'response' end as record_type,
  case when first_id is distinct from page_id then first_id end as refers_to from g
""",
    "op10_url_filter": r"""
with parts as (
  select page_id, url,
    case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest
  from pages
), split as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from parts
), rules(rule, rhost, rpath, rverdict) as (
  values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
         ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), fits as (
  select page_id, host, path, rule, rverdict,
    row_number() over (partition by page_id, host, path order by length(rhost) desc nulls last, length(rpath) desc) as nth
  from split left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from fits where nth = 1
""",
    "op9_host_quality": r"""
with d as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents
), words as (
  select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d
), word as (
  select doc_id, generate_subscripts(ws, 1) as i, unnest(ws) as w from words
), gram as (
  select doc_id, i, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o as g
  from word window o as (partition by doc_id order by i)
), twice as (
  select doc_id, i, g is not null and count(g) over (partition by doc_id, g) > 1 as again from gram
), covered as (
  select doc_id, max(case when again then 1 else 0 end) over (partition by doc_id order by i rows between 4 preceding and current row) as hit from twice
), repeated as (
  select doc_id, cast(sum(hit) as bigint) as n from covered group by doc_id
), line as (
  select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from d
), full_line as (
  select doc_id, row_number() over (partition by doc_id, x order by i) as nth from line where regexp_matches(x, '[^\x20\x09-\x0D]')
), lines as (
  select doc_id, count(*) as n, count(*) filter (where nth > 1) as again from full_line group by doc_id
), f as (
  select doc_id, host, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    coalesce(lines.again, 0) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words, coalesce(lines.n, 0) as n_lines
  from d join words using (doc_id) left join lines using (doc_id) left join repeated using (doc_id)
), j as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f
), k as (
  select *, base_failed or 100 * n_symbols > 50 * n_words or 100 * n_dup_lines > 50 * n_lines as failed from j
), hosts as (
  select host, count(*) as n, sum(case when failed then 1 else 0 end) as bad from k group by host
), a as (
  select sum(n) as docs, sum(bad) / sum(n) as mean, sum(n * (bad / n) * (bad / n)) as squares, count(*) as hosts from hosts
), prior as (
  select mean, least(1000.0, greatest(2.0, mean * (1 - mean) / greatest(1e-6, squares / docs - mean * mean - mean * (1 - mean) * hosts / docs) - 1)) as strength from a
), verdict as (
  select host, (bad + strength * mean) / (n + strength) >= 0.6 as bad_host from hosts, prior
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad_host as kept
from k join verdict using (host)
""",
}
