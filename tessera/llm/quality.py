"""Quality rules of documents, and verdicts on hosts from how often their documents fail.

The failure rate of a host is shrunk to the rate of all by a beta prior fitted to the hosts themselves, so a
host with few documents is not condemned by them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, join_small, map_texts

#: A document fails with fewer words, with more of its words (per cent) in repeated windows, with more signs for a
#: hundred words, or with more of its lines (per cent) repeated.
LEAST_WORDS, REPEATED, SIGNS, SAME_LINES = 10, 20, 50, 50
#: Words of a window; shrunk rate from which a host is bad.
WINDOW, BAD_HOST = 5, 0.6

_SIGNS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == len(words):
        return 0
    key, size = x[:n], len(ids)
    for k in range(1, window):
        # kept dense, so that no product overflows
        key = key * len(ids) + x[k : k + n]
        size *= len(ids)
        if size * len(ids) >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def figures(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    full = again = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            full += 1
            if line in seen:
                again += 1
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SIGNS)), again, repeated_words(words), full


def document_figures(docs: DataFrame, keep: list[str]) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

    def make():
        def call(texts):
            return None, dict(zip(names, zip(*[figures(t or "") for t in texts])))

        return call

    return map_texts(docs, keep, make, ", ".join(f"{n} long" for n in names))


def host_verdicts(judged: DataFrame, bad_host: float = BAD_HOST) -> DataFrame:
    """host, documents, failures, shrunk rate and verdict, from rows (host, failed).

    The prior has the mean of all documents and the strength that the spread of the hosts' rates calls for (by
    moments, hosts weighed by their documents), between 2 and 1000 documents."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("documents"), F.sum(F.col("failed").cast("long")).alias("failures"))
    n, rate = F.col("documents"), F.col("failures") / F.col("documents")
    hosts = checkpoint(hosts)
    whole = hosts.agg(F.sum("documents").alias("docs"), F.sum("failures").alias("failures"), F.sum(n * rate * rate).alias("squares"), F.count("*").alias("hosts")).first()
    if not whole["docs"]:
        return hosts.select("host", "documents", "failures", F.lit(0.0).alias("rate"), F.lit(False).alias("bad_host"))
    mean = whole["failures"] / whole["docs"]
    noise = mean * (1 - mean)
    spread = max(1e-6, whole["squares"] / whole["docs"] - mean * mean - noise * whole["hosts"] / whole["docs"])
    strength = min(1000.0, max(2.0, noise / spread - 1))
    shrunk = (F.col("failures") + strength * mean) / (n + strength)
    return hosts.select("host", "documents", "failures", shrunk.alias("rate"), (shrunk >= bad_host).alias("bad_host"))


def judge(docs: DataFrame, bad_host: float = BAD_HOST) -> DataFrame:
    """doc_id, the figures, base_failed, host, rate, kept for every row; the host is the column ``source``.

    Null texts count as empty and fail; a null source is a host of its own; an empty table gives no rows;
    repeated rows count each; other columns are no input."""
    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), "text")
    rows = document_figures(own, ["doc_id", "host"])
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    more = (100 * F.col("n_symbols") > SIGNS * F.col("n_words")) | (100 * F.col("n_dup_lines") > SAME_LINES * F.col("n_lines"))
    rows = checkpoint(rows.withColumn("base_failed", base).withColumn("failed", base | more))
    verdicts = checkpoint(host_verdicts(rows, bad_host)).select("host", "rate", "bad_host")
    return join_small(rows, verdicts, ["host"]).withColumn("kept", ~F.col("base_failed") & ~F.col("bad_host"))
