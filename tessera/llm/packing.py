"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

Lengths are integers up to the sequence size, so the packing is planned on histograms of lengths (at most
``max_tokens`` rows), one for each group of tasks, and carried out in the tasks: a piece finds its place from its
length and its rank among the group's pieces of that length. Tokens are written once and never shuffled."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, map_texts, scratch, worker_cache
from tessera.llm.warc import file_system

#: Entries of each word cache of a Python worker; a full one keeps what it has, which are the words met most.
CACHE_WORDS = 750_000
#: Tasks whose pieces are packed together. More groups leave a few more sequences part-filled, one or two each.
GROUP_TASKS = 256

_LETTERS = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f"  # not U+0130, whose lower case is a letter and a mark
_MARKS = r"!-&(-@\[-`{-~"
_plain = re.compile(f"(?:[{_LETTERS}]+|[{_MARKS}]+)+").fullmatch
_parts = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+").findall
_letters = re.compile(f"[{_LETTERS}]+").fullmatch


class CachedTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit integers, with a cache of words.

    A pre-token of the word vocabulary never crosses white space, nor a border between a letter and an ASCII
    mark other than the apostrophe, so words and such parts of words can be encoded apart."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache_words = cache_words
        self.by_word: dict[str, bytes] = {}
        self.by_part: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        runs = [p for p in parts if _letters(p)]
        for i in range(0, len(runs), 200):
            some = runs[i : i + 200]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(some):
                raw, a = ids.tobytes(), 0
                for part, b in zip(some, cuts):
                    out[part] = raw[4 * a : 4 * b]
                    a = b
        rest = [p for p in parts if p not in out]
        for part, one in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[part] = np.array(one.ids, "<u4").tobytes()
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        new = [w for w in words if w not in self.by_word]
        # special tokens, which start with "<|", are found before a text is split
        parts = {w: [w] if "<|" in w or not _plain(w) else [p.lower() if p.isascii() else p for p in _parts(w)] for w in new}
        known = self.by_part
        fresh = self._encode(list({p for ps in parts.values() for p in ps if p not in known}))
        if len(known) < self.cache_words:
            known.update(fresh)
            fresh = known
        made = {w: b"".join([known[p] if p in known else fresh[p] for p in ps]) for w, ps in parts.items()}
        if len(self.by_word) < self.cache_words:
            self.by_word.update(made)
        kept = self.by_word
        return [kept[w] if w in kept else made[w] for w in words]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each, and where each text ends. Null counts as empty.

        Words are split and numbered by Arrow, so only the different words of a group come to Python."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = [*self._words(words), np.array([end_id], "<u4").tobytes()]
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        at = np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(counts), len(words))
        long = size[at]
        stop = np.cumsum(long)
        flat = ids[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start[at] - stop + long, long)]
        return flat, stop[np.cumsum(counts + 1) - 1]


def worker_tokenizer(path: str, cache_words: int) -> CachedTokenizer:
    """The tokenizer of this Python worker, with the words it has met in earlier tasks."""
    import gc

    gc.set_threshold(500_000, 50, 100)  # the caches are large and have no cycles
    return worker_cache(f"packing {path} {cache_words}", lambda: CachedTokenizer(path, cache_words))


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Token ids of each document and an end token, cut into pieces of at most ``max_tokens``.

    Returns doc_id, piece, start, length, tokens (little-endian unsigned 32-bit ids) and the task and rank that
    number the pieces of each length. A null or empty text is one piece with the end token alone."""

    def make():
        from pyspark import TaskContext

        encode = worker_tokenizer(tokenizer_path, cache_words).encode
        task, seen = TaskContext.get().partitionId(), [0] * (max_tokens + 1)

        def call(texts):
            rows, out = [], {k: [] for k in ("piece", "start", "length", "tokens", "task", "nth")}
            flat, stops = encode(texts, end_id)
            a = 0
            for i, b in enumerate(stops.tolist()):
                for piece, at in enumerate(range(a, b, max_tokens)):
                    n = min(max_tokens, b - at)
                    rows.append(i)
                    for k, v in zip(out, (piece, at - a, n, flat[at : at + n].tobytes(), task, seen[n])):
                        out[k].append(v)
                    seen[n] += 1
                a = b
            return rows, out

        return call

    return map_texts(docs, ["doc_id"], make, "piece int, start long, length long, tokens binary, task int, nth long", arrow_text=True, group=2_000_000, cache=f"packing {tokenizer_path} {cache_words}")


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Plan bins of ``size`` for ``counts[length]`` items of each length.

    A bin is filled greedily with the longest items that fit; then its smallest item gives way to two that fill
    the gap, widened by it, more tightly, as long as there are such. Equal bins are planned at once.
    Returns runs (length, first rank, number of ranks, first bin, offset in the bin, items a bin)."""
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    index = np.arange(size + 1)
    placed = np.zeros(size + 1, np.int64)
    runs, bins = [], 0
    while True:
        longest = np.maximum.accumulate(np.where(left > 0, index, 0))
        seed = int(longest[size])
        if not seed:
            return runs
        free = left.copy()
        used: dict[int, int] = {}

        def take(n: int, k: int = 1, used=used, free=free) -> None:
            used[n] = used.get(n, 0) + k
            free[n] -= k

        take(seed)
        gap = size - seed
        n = int(longest[gap])
        while n:
            k = min(gap // n, int(free[n]))
            if k:
                take(n, k)
                gap -= n * k
            n = int(longest[min(gap, n - 1)])
        while gap and len(used) + max(used.values()) > 2:
            small = min(used)
            wide = gap + small
            now = np.maximum.accumulate(np.where(free > 0, index, 0))
            a = index[1 : wide + 1][free[1 : wide + 1] > 0]
            b = now[np.minimum(a, wide - a)]
            twin = (b == a) & (free[a] < 2)
            b[twin] = now[a[twin] - 1]
            total = np.where(b > 0, a + b, 0)
            if not len(total) or total.max() <= small:
                break
            best = len(total) - 1 - int(np.argmax(total[::-1]))
            take(small, -1)
            if not used[small]:
                del used[small]
            take(int(a[best]))
            take(int(b[best]))
            gap = wide - int(total[best])
        many = min(int(left[n]) // k for n, k in used.items())
        offset = 0
        for n, k in used.items():
            runs.append((n, int(placed[n]), k * many, bins, offset, k))
            placed[n] += k * many
            left[n] -= k * many
            offset += n * k
        bins += many


def _planned(by_task: DataFrame, max_tokens: int, group_tasks: int, folder: str) -> None:
    """Write to ``folder`` what tasks need for placing: the first rank of each task's pieces of a length, and each group's plan.

    ``by_task`` has the number of pieces n of each task and length. Both tables have a folder for each group."""
    of_group = by_task.withColumn("group", F.floor(F.col("task") / group_tasks).cast("int"))
    before = Window.partitionBy("group", "length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = of_group.select("group", "task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases.repartition("group").sortWithinPartitions("group", "task").write.partitionBy("group").parquet(f"{folder}/bases")

    def plan(rows):
        import pandas as pd

        runs = sorted(best_two_fit(dict(zip(rows["length"].tolist(), rows["n"].tolist())), max_tokens))
        return pd.DataFrame(runs, columns=["length", "first", "number", "bin", "place", "each"]).assign(group=rows["group"].iloc[0])

    counts = of_group.groupBy("group", "length").agg(F.sum("n").alias("n"))
    plans = counts.groupBy("group").applyInPandas(plan, "length long, first long, number long, bin long, place long, each long, group int")
    plans.write.partitionBy("group").parquet(f"{folder}/plans")


class _Places:
    """Sequence and offset of the pieces of one task, from the written plan of its group."""

    def __init__(self, folder: str, task: int, group_tasks: int, max_tokens: int):
        import pyarrow.dataset as ds

        self.group = task // group_tasks
        system, path = file_system(folder)

        def rows(name, only=None):
            part = ds.dataset(f"{path}/{name}/group={self.group}", format="parquet", filesystem=system).to_table(filter=only)
            return {c: part.column(c).to_numpy() for c in part.column_names}

        mine = rows("bases", ds.field("task") == task)
        self.base = np.zeros(max_tokens + 1, np.int64)
        self.base[mine["length"]] = mine["base"]
        runs = rows("plans")
        order = np.lexsort((runs["first"], runs["length"]))
        self.first, self.bin, self.place, self.each = (runs[c][order] for c in ("first", "bin", "place", "each"))
        self.wide = int((runs["first"] + runs["number"]).max()) + 1  # above every rank
        self.starts = runs["length"][order] * self.wide + self.first

    def of(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self.base[length] + nth
        at = np.searchsorted(self.starts, length * self.wide + rank, "right") - 1
        inside = rank - self.first[at]
        return (self.group << 40) + self.bin[at] + inside // self.each[at], self.place[at] + length * (inside % self.each[at])


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0, cache_words: int = CACHE_WORDS, group_tasks: int = GROUP_TASKS) -> DataFrame:
    """Pack all documents into as few sequences of ``max_tokens`` as best-two-fit finds for each ``group_tasks`` tasks.

    Returns doc_id, piece, start, length, tokens (binary), sequence_id and offset. Null texts count as empty;
    an empty text is the end token alone; repeated rows, and rows without a doc_id, are packed one by one;
    no rows give no rows; other columns are left out. Plans and ranks are written to the shared folder and read
    from there by the tasks that place pieces, so no token row meets a join."""
    pieces = checkpoint(token_pieces(docs, tokenizer_path, max_tokens, end_id, cache_words))
    folder = f"{scratch(docs.sparkSession)}/packing-{uuid.uuid4().hex}"
    _planned(checkpoint(pieces.groupBy("task", "length").agg(F.count("*").alias("n"))), max_tokens, group_tasks, folder)

    def place(batches):
        known: dict[int, _Places] = {}
        for b in batches:
            length, nth, tasks = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "nth", "task"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for task in np.unique(tasks).tolist():
                if task not in known:
                    known = {task: _Places(folder, task, group_tasks, max_tokens)}
                at = tasks == task
                sequence[at], offset[at] = known[task].of(length[at], nth[at])
            yield pa.RecordBatch.from_arrays(b.columns[:5] + [pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "tokens", "sequence_id", "offset"])

    rows = pieces.select("doc_id", "piece", "start", "length", "tokens", "task", "nth")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, tokens binary, sequence_id long, offset long")
