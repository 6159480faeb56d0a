"""URL filters by a sorted sweep over reversed-host keys; DataFrame functions only.

A rule (host, path) fits its host and all subdomains where the path starts with the rule's. The key of a host and
a path is the host's labels in reverse order and then the path, so what a rule fits, for one host suffix, is an
interval of keys, and intervals of rules are nested or apart. Rules and URLs of a host suffix are sorted by key
together; the last rule met carries the stack of the rules that it is nested in, from which those that have ended are popped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, checkpoint, join_small

#: URLs of one host suffix that are swept together.
PART_ROWS = 200_000

#: The rules of the registered query as (verdict, rule).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for v, r in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.rule", "r.verdict")


def host_of(url: str) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(labels: Column) -> Column:
    """Canonical key of a host: labels in reverse order, then a sign that sorts before any other."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("\u0000"))


def sweep(urls: DataFrame, rules: DataFrame, default: str = "allow", rows: int = PART_ROWS) -> DataFrame:
    """The columns of ``urls`` (with host, path) and rule, verdict: the longest host's longest path that fits, else null and ``default``.

    ``rules``: rule (host and path), verdict. Repeated rules count once (the smallest verdict); null rules, hosts
    and paths fit nothing. Equal URLs are swept once, with a row for each of their host suffixes that some rule
    has. Each suffix is swept on its own, so rules go only where their own host is; a suffix of more than ``rows``
    URLs is dealt over several parts, and the rules of that suffix alone are copied to these."""
    columns = urls.columns
    split = rules.where("rule is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    split = split.withColumn("_host", F.regexp_extract("rule", r"(?s)\A[^/]*", 0)).withColumn("_path", F.expr("substr(rule, length(_host) + 1)"))
    split = split.withColumn("_labels", F.split("_host", r"\.")).withColumn("_suffix", reversed_host(F.col("_labels"))).withColumn("_key", F.concat("_suffix", "_path"))
    # the stack of a rule: the rules of the same host whose path its own starts with, the shortest first
    prefixes = split.select("_suffix", "_key", F.explode(F.transform(F.sequence(F.lit(0), F.length("_path")), lambda n: F.concat("_suffix", F.substring("_path", F.lit(1), n)))).alias("_outer"))
    entry = F.struct(F.length("_key").alias("size"), F.col("_key").alias("key"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    outer = split.select(F.col("_key").alias("_outer"), entry.alias("entry"))
    stacks = prefixes.join(outer, "_outer").groupBy("_suffix", "_key").agg(F.array_sort(F.collect_list("entry")).alias("stack"))
    depths = sorted(r[0] for r in split.select(F.size("_labels")).distinct().collect())  # few: label counts of hosts
    apart = urls.select("host", "path").where("host <> '' or path <> ''").distinct().withColumn("_l", F.split("host", r"\."))
    suffixes = [F.when(F.size("_l") >= n, F.struct(F.lit(n).alias("depth"), reversed_host(F.slice("_l", -n, n)).alias("suffix"))) for n in depths]
    asked = apart.select("host", "path", F.explode(F.array_compact(F.array(*suffixes))).alias("_s")) if depths else apart.select("host", "path", F.lit(None).cast("struct<depth:int,suffix:string>").alias("_s")).where("false")
    asked = asked.select("host", "path", F.col("_s.depth").alias("depth"), F.col("_s.suffix").alias("_suffix"))
    asked = checkpoint(join_small(asked, split.select("_suffix").distinct(), ["_suffix"], "left_semi"))
    parts = checkpoint(asked.groupBy("_suffix").agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts")))  # a row for each host of a rule
    nth = F.pmod(F.xxhash64("host", "path"), F.col("_parts")).cast("int")
    kind = dict(stacks.dtypes)["stack"]
    points = join_small(asked, parts, ["_suffix"]).select("_suffix", nth.alias("_part"), F.concat("_suffix", "path").alias("key"), F.lit(1).alias("kind"), "host", "path", "depth", F.lit(None).cast(kind).alias("stack"))
    starts = join_small(stacks, parts, ["_suffix"]).select("_suffix", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("_key").alias("key"), F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("host", "string"), ("path", "string"), ("depth", "int"))], "stack")
    line = Window.partitionBy("_suffix", "_part").orderBy("key", "kind")
    met = points.unionByName(starts).withColumn("stack", F.last("stack", ignorenulls=True).over(line)).where("kind = 1")
    held = met.withColumn("top", F.expr("try_element_at(filter(stack, r -> startswith(key, r.key)), -1)")).where("top is not null")
    best = held.groupBy("host", "path").agg(F.max(F.struct("depth", "top")).alias("best"))
    best = best.select("host", "path", F.col("best.top.rule").alias("rule"), F.col("best.top.verdict").alias("verdict"))
    return urls.join(best, ["host", "path"], "left").select(*columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    A url that is null or has no ``://`` has an empty host and path and fits no rule. Repeated rows are judged
    each; an empty table gives no rows; other columns are left out."""
    urls = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    return sweep(urls, rules, default)
