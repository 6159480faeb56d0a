"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question with other values keeps its template. Windows
of template tokens are joined by hash; a match counts if the values in its placeholders stand for those of the
benchmark item one way throughout."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, free_names, join_small, map_texts, worker_cache

#: Template tokens of a window, and of the shortest item that has a template; shorter ones are looked for word by word.
WINDOW, SHORTEST = 8, 4
#: Share of an item's windows that a contaminated document holds; or so many of them in one place (13 words in a row).
COVERAGE, RUN = 0.5, 6
#: Bits of the filter that documents' windows pass before they are joined.
FILTER_BITS = 1 << 23
#: Parts of texts between spaces that a Python worker keeps; a full table keeps what it has, which are those met most.
VOCABULARY = 200_000
#: Bytes of text in a group.
GROUP = 1_000_000

#: Number words and units of measure.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = "mm cm m km mg g kg t ml l s sec seconds second min minutes minute h hours hour days day weeks week months month years year inch inches feet foot miles mile lb pounds pound ounces dollars dollar euros euro cents cent percent degrees degree meters meter kilometers kilometer grams gram kilograms kilogram liters liter".split()

_tokens = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?:\n]").findall
_NUMBER, _UNIT, _CAPITAL, _STOP = 1, 2, 4, 8
#: Scripts without spaces between words; each of their letters is a token.
_UNSPACED = "\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_unspaced = re.compile(f"[{_UNSPACED}]").search
_pieces = re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}]+").findall
_ODD = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 1)], np.uint64)


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 1)


_LISTED = {**dict.fromkeys(UNITS, _UNIT), **dict.fromkeys(NUMBER_WORDS, _NUMBER), **dict.fromkeys(".!?:\n", _STOP)}
_PLACE = {f: np.uint64(_hash(name)) for f, name in ((_NUMBER, "<number>"), (_UNIT, "<unit>"), (_CAPITAL, "<name>"))}


def _split(part: str) -> list[str]:
    """Tokens of a text; none holds a space."""
    found = _tokens(part)
    if part.isascii() or not _unspaced(part):
        return found
    return [p for t in found for p in (_pieces(t) if len(t) > 1 and _unspaced(t) else (t,))]


def _kinds(tokens: list[str], lows: list[str]) -> list[int]:
    """What each token (and it in lower case) may be: a listed word, a number, a capitalised word."""
    known = _LISTED.get
    return [known(low, 0) | (_CAPITAL if t[0].isupper() else _NUMBER if t[0].isdigit() else 0) for t, low in zip(tokens, lows)]


class Vocabulary:
    """What a Python worker has met between spaces, the numbers of the tokens in it, and their hashes and kinds."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.tokens: list[str] = []
        self.hashes, self.kinds = np.zeros(0, np.uint64), np.zeros(0, np.int8)
        self.parts = pa.array([], pa.string())
        self.start, self.size, self.flat = (np.zeros(0, np.int64) for _ in range(3))

    def look_up(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The table of tokens, and of all texts in a row the tokens' numbers, hashes, kinds, and how many each text has.

        Texts are split at spaces and numbered by Arrow, so only the different parts of a group come to Python."""
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = lists.flatten().dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.parts)
        unmet = coded.dictionary.filter(pc.is_null(known))
        split = [_split(p) for p in unmet.to_numpy(zero_copy_only=False).tolist()]
        number = self.number
        new = list(set(chain.from_iterable(split)).difference(number))
        lows = [t.lower() for t in new]
        tokens = self.tokens + new
        hashes = np.append(self.hashes, np.array([_hash(t) for t in lows], np.uint64))
        kinds = np.append(self.kinds, np.array(_kinds(new, lows), np.int8))
        number.update(zip(new, range(len(number), len(tokens))))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.append(self.flat, np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum())))
        start, size = np.append(self.start, len(self.flat) + np.cumsum(sizes) - sizes), np.append(self.size, sizes)
        row = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row[row < 0] = len(self.parts) + np.arange(len(split))
        of = row[coded.indices.to_numpy()]
        if len(size) <= VOCABULARY and unmet.nbytes <= 4 * GROUP:
            self.parts = pa.concat_arrays([self.parts, unmet])
            self.tokens, self.hashes, self.kinds, self.start, self.size, self.flat = tokens, hashes, kinds, start, size, flat
        else:
            for t in new:
                del number[t]
        n = size[of]
        stop = np.append(0, np.cumsum(n))
        ids = flat[np.arange(stop[-1]) - np.repeat(stop[:-1] - start[of], n)]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return tokens, ids, hashes[ids], kinds[ids], np.diff(stop[ends], prepend=0)


def templates(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The table of tokens, the words of all texts as numbers in it, their hashes, these with placeholders put in, which are placeholders,
    which may be, and the words of each text.

    A number is digits or a number word; a unit follows a number; a name is capitalised. A capitalised word that is
    first in its sentence may be a name or not: it has both readings."""
    tokens, ids, hashes, kinds, counts = worker_cache("vocabulary", Vocabulary).look_up(texts)
    text_of = np.repeat(np.arange(len(counts)), counts)
    words = np.flatnonzero(kinds != _STOP)
    first = np.ones(len(kinds), bool)
    first[1:] = (kinds[:-1] == _STOP) | (text_of[1:] != text_of[:-1])
    hashes, kinds, first, text_of = hashes[words], kinds[words], first[words], text_of[words]
    number = (kinds & _NUMBER) > 0
    after = np.zeros(len(words), bool)
    after[1:] = number[:-1] & (text_of[1:] == text_of[:-1])
    unit = ((kinds & _UNIT) > 0) & after & ~number
    capital = ((kinds & _CAPITAL) > 0) & ~number & ~unit
    name = capital & ~first
    exact = hashes.copy()
    for mark, flag in ((number, _NUMBER), (unit, _UNIT), (name, _CAPITAL)):
        hashes[mark] = _PLACE[flag]
    return tokens, ids[words], exact, hashes, number | unit | name, capital & first, np.bincount(text_of, minlength=len(counts))


def _mixed(total: np.ndarray) -> np.ndarray:
    total = total ^ (total >> np.uint64(29))
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def _sums(hashes: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _ODD[k]
    return total


def _held(marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many marks stand before each window of ``size`` words, and how many in it."""
    before = np.append(0, np.cumsum(marks, dtype=np.int64))
    n = max(0, len(marks) - size + 1)
    return before[:n], before[size : size + n] - before[:n]


def window_readings(hashes: np.ndarray, slots: np.ndarray, maybe: np.ndarray, good: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts of the ``good`` windows of ``size`` words, their hashes and the places (n, k) of the words read as names,
    for each choice of the words that may be names. Readings have no more placeholders than words."""
    total, filled = _sums(hashes, size), _held(slots, size)[1]
    before, open_ = _held(maybe, size)
    good = good & (2 * filled <= size)
    starts = np.flatnonzero(good)
    yield starts, _mixed(total[starts]), np.zeros((len(starts), 0), np.int64)
    places = np.flatnonzero(maybe)
    for k in range(1, size + 1):
        group = np.flatnonzero(good & (open_ == k))
        if not len(group):
            continue
        at = places[before[group][:, None] + np.arange(k)]
        change = (_PLACE[_CAPITAL] - hashes[at]) * _ODD[at - group[:, None]]
        for m in range(1, min(k, size // 2) + 1):
            fits = 2 * (filled[group] + m) <= size
            starts, some, by = group[fits], at[fits], change[fits]
            for chosen in map(list, combinations(range(k), m)) if len(starts) else ():
                yield starts, _mixed(total[starts] + by[:, chosen].sum(1, dtype=np.uint64)), some[:, chosen]


def _windows(df: DataFrame, keep: list[str], sizes: list[int] | None, bits: np.ndarray | None) -> DataFrame:
    """Windows (pos, hash, values, leading: which values begin a sentence, template: has a reading as a template,
    windows and templates: how many the text has of both), a row for each reading; ``bits`` lets through only what it has.

    Windows with more placeholders than words, or with fewer than SHORTEST words, are read as their very words.
    Without ``sizes`` (benchmark items) the text's own size is taken: WINDOW, or all of a shorter text. With them every
    window is also read as its very words."""

    def make():
        known = None if bits is None else np.unpackbits(bits).view(bool)

        def call(texts):
            rows, out = [], {k: [] for k in ("pos", "hash", "values", "leading", "template", "windows", "templates")}
            tokens, words, exact, hashes, slots, maybe, counts = templates(texts)
            text_of = np.repeat(np.arange(len(counts)), counts)
            starts = np.cumsum(counts) - counts
            for size in sizes or range(1, WINDOW + 1):
                of = text_of[: max(0, len(words) - size + 1)]
                good = text_of[size - 1 :] == of
                if sizes is None:
                    good &= np.minimum(counts, WINDOW)[of] == size
                filled = _held(slots, size)[1]
                template = good & (2 * filled <= size) & (size >= SHORTEST)
                many, some = np.bincount(of[good], minlength=len(counts)), np.bincount(of[template], minlength=len(counts))
                verbatim = np.flatnonzero(good & ~template if sizes is None else good & ((filled > 0) | ~template))
                plain = (verbatim, _mixed(_sums(exact, size)[verbatim]), None)
                seen = set()
                for at, h, names in chain([plain], window_readings(hashes, slots, maybe, template, size)):
                    if known is not None:
                        passed = np.flatnonzero(known[h & np.uint64(len(known) - 1)])
                        passed = passed[known[(h[passed] >> np.uint64(32)) & np.uint64(len(known) - 1)]]
                        at, h, names = at[passed], h[passed], names if names is None else names[passed]
                    for p, i, x, led in zip(at.tolist(), of[at].tolist(), h.view(np.int64).tolist(), repeat(None) if names is None else names.tolist()):
                        if led is None:
                            if known is not None and size < WINDOW:  # an item of this size has one window: any place will do
                                if (i, x) in seen:
                                    continue
                                seen.add((i, x))
                            marked, led = [], []
                        else:
                            marked = sorted([*(p + np.flatnonzero(slots[p : p + size])).tolist(), *led])
                        rows.append(i)
                        out["pos"].append(p - int(starts[i]))
                        out["hash"].append(x)
                        out["values"].append([tokens[words[k]].lower() for k in marked])
                        out["leading"].append([k in led for k in marked])
                        out["template"].append(bool(template[p]))
                        out["windows"].append(int(many[i]))
                        out["templates"].append(int(some[i]))
            return rows, out

        return call

    return map_texts(df, keep, make, "pos long, hash long, values array<string>, leading array<boolean>, template boolean, windows long, templates long", arrow_text=True, group=GROUP, cache="vocabulary")


def _filter_bits(windows: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with two places for each hash; gathered as bytes, so its size is bounded."""
    low = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    high = F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(FILTER_BITS - 1))
    places = windows.select(F.explode(F.array(low, high)).alias("bit"))
    parts = places.groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, int(7 - bit % 8)))").alias("value"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():  # FILTER_BITS / 8 rows at most
        out[r["byte"]] = r["value"]
    return out


def longest_run(places: list[int]) -> int:
    """The most neighbours in a row among sorted places."""
    best = run = 0
    for p, before in zip(places, [None, *places]):
        run = run + 1 if before is not None and p == before + 1 else 1
        best = max(best, run)
    return best


def sound_places(found: list[dict]) -> tuple[list[int], bool]:
    """Places of the windows of a line that count, and whether one with other values is among them.

    Windows with the item's own values count whatever else the line holds. Those with other values count if they replace each of the item's values as
    most windows of the line do; two values may become the same one, as numbers do. So a value that stands in two places and has become two things costs
    the windows of the fewer, and no others. What words that begin a sentence have become is settled after the rest, as they need not be names."""
    changed = [w for w in found if w["item_values"] != w["values"]]
    places = {w["item_pos"] for w in found if w["item_values"] == w["values"]}
    pairs = [[*zip(w["item_values"], w["values"], (x or y for x, y in zip(w["item_leading"], w["leading"])))] for w in changed]
    stands: dict[str, str] = {}
    for leading in (False, True):
        votes = Counter(pair for p in pairs for pair in {(a, b) for a, b, led in p if led == leading})
        for (a, b), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            stands.setdefault(a, b)
    fit = {w["item_pos"] for w, p in zip(changed, pairs) if all(stands[a] == b for a, b, _ in p)}
    return sorted(places | fit), bool(fit)


def _sound(lines: DataFrame) -> DataFrame:
    """``lines`` with places and changed, as ``sound_places`` has them, those of templates, and the longest run of places, instead of the windows found."""
    from pyspark.sql.types import StructType

    kept = [c for c in lines.columns if c != "found"]
    schema = StructType([lines.schema[c] for c in kept] + list(StructType.fromDDL("places array<long>, templates array<long>, changed boolean, run int").fields))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                found = row.pop("found")
                row["places"], row["changed"] = sound_places(found)
                row["run"] = longest_run(row["places"])
                row["templates"] = sorted({w["item_pos"] for w in found if w["template"]}.intersection(row["places"]))
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    return lines.mapInArrow(run, schema)


def key_windows(windows: DataFrame, coverage: float) -> DataFrame:
    """item_id and hash of windows of which a contaminated text holds at least one of each item that it holds.

    Who holds ``coverage`` of n windows holds one of any n - ceil(coverage * n) + 1; taken are those that the fewest
    items share, among all windows and among the template windows. Who holds RUN windows in a row holds the rarest
    of these, so of each RUN neighbours the rarest is taken too. Windows that many items share are seldom among
    them: texts that hold nothing but such are never paired with all these items."""
    shared = windows.groupBy("hash").agg(F.count_distinct("item_id").alias("items"))
    of = F.struct("windows", "templates")
    places = windows.join(shared, "hash").groupBy("item_id", "pos", "template").agg(F.max("items").alias("items"), F.first(of).alias("of"))
    item = Window.partitionBy("item_id")
    nth = F.row_number().over(item.orderBy("items", "pos"))
    nth_template = F.sum(F.col("template").cast("int")).over(item.orderBy("items", "pos"))
    enough = lambda nth, n: nth <= n - F.ceil(n * coverage) + 1
    rarest = F.min(F.struct("items", "pos")).over(item.orderBy("pos").rowsBetween(0, RUN - 1))
    follow = F.count("*").over(item.orderBy("pos").rowsBetween(0, RUN - 1)) == RUN
    chosen = places.select("item_id", "pos", enough(nth, F.col("of.windows")).alias("a"), (F.col("template") & enough(nth_template, F.col("of.templates"))).alias("b"), F.when(follow, rarest["pos"]).alias("c"))
    keys = chosen.where("a or b").select("item_id", "pos").unionAll(chosen.where("c is not null").select("item_id", F.col("c").alias("pos"))).distinct()
    return windows.join(keys, ["item_id", "pos"]).select("item_id", "hash").distinct()


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Texts of ``docs`` that hold an item of ``benchmark`` or a passage of one: text_hash, text_crc, item_id (the best, then the smallest),
    n_items, coverage (share of that item's windows, or of its template windows if that is more), reparameterised (other values in its placeholders).

    Equal texts are judged once, so copies multiply nothing. A text meets the items that it shares a key window
    with, and is then joined with all windows of these by text, not by hash: a window that many texts and many
    items hold brings no pairs of its own."""
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    # items are numbered, as their ids may be null
    numbered = checkpoint(items.withColumn("item", F.monotonically_increasing_id()))
    windows = checkpoint(_windows(numbered, ["item"], None, None)).withColumnRenamed("item", "item_id")
    short = [r[0] for r in benchmark_sizes(numbered).collect()]  # WINDOW rows at most
    key = ["text_hash", "text_crc"]
    keyed = docs.where("text is not null").select("text", F.xxhash64("text").alias(key[0]), F.crc32("text").alias(key[1]))
    hits = _windows(keyed, key, sorted({WINDOW, *short}), _filter_bits(windows)).drop("template", "windows", "templates").distinct()
    hits = checkpoint(hits)
    pairs = checkpoint(join_small(hits.select(*key, "hash").distinct(), checkpoint(key_windows(windows, coverage)), ["hash"]).select(*key, "item_id").distinct())
    n = windows.select("item_id", "hash", F.col("values").alias("item_values"), F.col("leading").alias("item_leading"), "template", F.struct("windows", "templates").alias("of"), F.col("pos").alias("item_pos"))
    met = join_small(pairs, n, ["item_id"]).join(hits, [*key, "hash"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    window = F.struct("item_pos", "template", "item_values", "values", "item_leading", "leading")
    lines = _sound(met.groupBy(*key, "item_id", "shift").agg(F.first("of").alias("of"), F.collect_set(window).alias("found")).drop("shift"))
    count = lambda places: F.size(F.array_distinct(F.flatten(F.collect_list(places))))
    held = lines.groupBy(*key, "item_id").agg(count("places").alias("n"), count("templates").alias("n_templates"), F.first("of").alias("of"), F.max("changed").alias("changed"), F.max("run").alias("run"))
    share = F.greatest(F.col("n") / F.col("of.windows"), F.when(F.col("of.templates") > 0, F.col("n_templates") / F.col("of.templates")))
    held = held.withColumn("coverage", share).where((F.col("coverage") >= coverage) | (F.col("run") >= RUN))
    named = held.withColumnRenamed("item_id", "item").join(numbered.select("item", "item_id"), "item")
    best = F.min(F.struct((-F.col("coverage")).alias("less"), "item_id", "changed"))
    found = named.groupBy(*key).agg(best.alias("b"), F.count("*").alias("n_items"))
    return found.select(*key, F.col("b.item_id").alias("item_id"), "n_items", (-F.col("b.less")).alias("coverage"), F.col("b.changed").alias("reparameterised"))


def benchmark_sizes(items: DataFrame) -> DataFrame:
    """Window sizes of the items that are shorter than WINDOW."""

    def make():
        return lambda texts: (None, {"size": templates(texts)[-1].tolist()})

    return map_texts(items, [], make, "size int", arrow_text=True).where(f"size < {WINDOW} and size > 0").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row for each row of ``docs`` whose text holds a benchmark item: doc_id and the columns of ``contaminated_texts``.

    Null, empty and clean texts have no row, nor has any text where the benchmark is empty; benchmark items
    with fewer than SHORTEST tokens are found by their very words, those without a letter or digit not at all. Repeated rows each have one;
    a null doc_id stays null, and so does a null item_id, which comes before others; ids may be of any type that can be ordered."""
    found = checkpoint(contaminated_texts(docs, benchmark, coverage))
    keyed = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.crc32("text").alias("text_crc"))
    return join_small(keyed, found, ["text_hash", "text_crc"]).drop("text_hash", "text_crc")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` whose texts hold no benchmark item, with all columns, whatever their names.

    Null and empty texts stay, as all rows do where the benchmark is empty; repeated rows stay or go together."""
    key = free_names(docs, "hash_key", "crc_key")
    found = checkpoint(contaminated_texts(docs, benchmark, coverage)).select(F.col("text_hash").alias(key[0]), F.col("text_crc").alias(key[1]))
    keyed = docs.withColumn(key[0], F.xxhash64("text")).withColumn(key[1], F.crc32("text"))
    return join_small(keyed, found, key, "left_anti").select(*docs.columns)
