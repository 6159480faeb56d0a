"""Text search over chunks: LIKE with its wildcards, BM25 over postings, and quotes of evidence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import SMALL_ROWS, small
from tessera.operators.lineage import checkpoint

#: What tokens are made of, as ``tokenize`` has it, and bytes of texts that are searched at a time.
TOKEN_BYTES, SLICE_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.$/-", 4_000_000


def like_any(text: str, query: str, tokens: list[str]) -> Column:
    """Whether the lower-cased text is LIKE the whole query or one of its tokens; ``_`` and ``%`` in them are wildcards."""
    low = F.lower(F.col(text))
    out = F.lit(False)
    for p in dict.fromkeys([query.lower(), *tokens]):
        out = out | low.like(f"%{p}%".replace("\\", "\\\\"))  # no sign escapes in a pattern
    return out


def like_search(chunks: DataFrame, query: str, tokens: list[str], limit: int = 20) -> DataFrame:
    """id and score 1.0 of the first ``limit`` chunks, by id, that hold the query or a token of it."""
    return chunks.where(like_any("text", query, tokens)).select("id", F.lit(1.0).alias("score")).orderBy("id").limit(limit)


def bm25(index: DataFrame, n_docs: int, mean_length: float, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id and score of every chunk that shares a term with a query; ``queries``: query_id, term.

    The terms of queries, which are few, are broadcast once they are counted to be."""
    wanted = queries.distinct()
    small = F.broadcast if wanted.count() <= SMALL_ROWS else (lambda df: df)
    met = index.join(small(wanted.select("term").distinct()), "term", "left_semi")
    df = met.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean_length))
    scored = met.join(small(wanted.join(df, "term").withColumn("idf", idf)), "term").withColumn("score", F.col("idf") * tf)
    return scored.groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def fitting(rows: DataFrame, column: str, hints: str, ever: str | None = None) -> DataFrame:
    """The rows whose text ``hints`` fits anywhere, and those that are ``ever`` wanted (a boolean column); null texts fit nothing.

    For rows that few patterns can fit: all hints are one expression of Arrow's automaton (RE2), which reads a text once however many they are."""
    at, wanted = rows.columns.index(column), rows.columns.index(ever) if ever else None

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            found = pc.match_substring_regex(batch.column(at), hints)
            yield batch.filter(found if wanted is None else pc.or_kleene(found, batch.column(wanted)))

    return rows.mapInArrow(run, rows.schema)


def bm25_topk(chunks: DataFrame, tokens: list[str], limit: int = 20) -> DataFrame:
    """id and score of the ``limit`` chunks (id, text) with the highest BM25 for one query; ties by id.

    Without a stored index the texts are read once; of their tokens the query's alone become rows, which are written."""
    index = checkpoint(counted_terms(chunks, tokens))
    size = index.where("term = ''").agg(F.sum("tf").alias("n"), F.sum("length").alias("total")).first()
    n, total = size["n"] or 0, size["total"] or 0
    queries = chunks.sparkSession.createDataFrame([(0, t) for t in dict.fromkeys(tokens)], "query_id int, term string")
    return bm25(index.where("term <> ''"), n, total / n if n else 1.0, queries).select("id", "score").orderBy(F.desc("score"), "id").limit(limit)


def counted_terms(texts: DataFrame, tokens: list[str]) -> DataFrame:
    """term, id, length and tf of the given tokens alone, from texts (id, text), in one pass over their bytes that makes no lists of tokens.

    Tokens are those of ``tokenize``. Rows of the empty term, without an id, sum up the texts that have tokens: how many there are (tf) and their length."""
    texts = texts.select("id", "text")
    schema = f"term string, id {texts.schema['id'].dataType.simpleString()}, length long, tf long"
    wanted = [t for t in (t.encode() for t in dict.fromkeys(tokens)) if len(t) > 1 and not {*t} - {*TOKEN_BYTES}]
    part, most = [*TOKEN_BYTES], SLICE_BYTES

    def run(batches):
        import numpy as np
        import pyarrow as pa

        inside, lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
        inside[part] = True
        lower[65:91] += 32  # A to Z

        def counted(data, offsets, ids):
            """Rows of some texts, given as their bytes, the places where they begin and the last ends, and their ids."""
            token = inside[data]
            first, last = token.copy(), token.copy()
            first[1:] &= ~token[:-1]
            last[:-1] &= ~token[1:]
            begin, end = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
            first[begin], last[end] = token[begin], token[end]  # a token ends with its text
            at = np.flatnonzero(first)
            size = np.flatnonzero(last) + 1 - at
            at, size = at[size > 1], size[size > 1]
            count = lambda places: np.bincount(np.searchsorted(offsets, places, side="right") - 1, minlength=len(ids))
            length = count(at)
            yield [""], pa.nulls(1, ids.type), [int(length.sum())], [int((length > 0).sum())]
            for term in wanted:
                same = at[size == len(term)]
                for i, byte in enumerate(term):
                    same = same[lower[data[same + i]] == byte]
                tf = count(same)
                held = np.flatnonzero(tf)
                if len(held):
                    yield [term.decode()] * len(held), ids.take(pa.array(held)), length[held], tf[held]

        for batch in batches:
            ids, column = batch.column(0), batch.column(1).fill_null("").cast(pa.large_string())
            if not len(column):
                continue
            places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            begin = 0
            while begin < len(column):
                end = max(begin + 1, int(np.searchsorted(places, places[begin] + most, side="right")) - 1)
                for columns in counted(data[places[begin] : places[end]], places[begin : end + 1] - places[begin], ids.slice(begin, end - begin)):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, (pa.string(), None, pa.int64(), pa.int64()))], ["term", "id", "length", "tf"])
                begin = end

    return texts.mapInArrow(run, schema)


def matching_postings(terms: DataFrame, tokens: list[str]) -> DataFrame:
    """term, id, length and tf of the given tokens alone, from rows (id, terms, length)."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(tokens)]).cast("array<string>")
    held = F.filter("terms", lambda t: F.array_contains(wanted, t))
    return terms.select("id", "length", F.explode(held).alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def quote_nodes(evidence: DataFrame, artifacts: DataFrame, nodes: DataFrame, task_tokens: list[str], limit: int = 20) -> DataFrame:
    """Ids of document nodes whose evidence quotes one of the task's first six significant tokens."""
    if not task_tokens:
        return nodes.select("id").limit(0)
    # lower-cased once for all tokens; what stands between wildcards is looked for first, as that needs no pattern
    pieces = lambda s, t: [s.contains(p) for p in re.split("[%_]", t) if p and "\\" not in t]
    held = lambda s, t: reduce(Column.__and__, [*pieces(s, t), s.like(f"%{t}%")])
    fits = F.exists(F.array(F.lower("quote")), lambda s: reduce(Column.__or__, [held(s, t) for t in task_tokens[:6]]))
    found = checkpoint(evidence.where(fits).select("artifact_id", "start_line", "end_line", "page"))  # read for each sort of place
    a = artifacts.where("kind in ('markdown', 'pdf', 'sb')").select(F.col("id").alias("artifact_id"), F.col("path").alias("a_path"))
    few = small(found)
    said = a.join(few(found), "artifact_id")
    # evidence at the lines of a node or on its page, counted: what is at both counts once
    lines, page = ["artifact_id", "start_line", "end_line"], ["artifact_id", "page"]
    met = None
    for place, sign in ((lines, 1), (page, 1), ([*lines, "page"], -1)):
        held = said.groupBy(*place, "a_path").agg((sign * F.count("*")).alias("times"))
        some = nodes.join(few(held), place).select(nodes["id"], "a_path", nodes["start_line"], nodes["page"], "times")
        met = some if met is None else met.unionAll(some)
    met = met.groupBy("id", "a_path", "start_line", "page").agg(F.sum("times").alias("times"))
    met = met.select("id", "a_path", "start_line", "page", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(limit)).cast("int"))))
    order = [F.col("a_path").asc_nulls_last(), F.col("start_line").asc_nulls_last(), F.col("page").asc_nulls_last(), F.col("id")]
    return met.orderBy(*order).limit(limit).select("id").distinct()
