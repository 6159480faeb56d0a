"""SimHash fingerprints and a Gray-order hierarchical index that links those with few differing bits.

The index has upper levels of masked patterns: with ``radius`` + 1 blocks of bits, fingerprints that differ in
at most ``radius`` bits agree in one block, so each block's value is a node (mask, value) and a pair of linked
fingerprints meets in one of them at least. A node with more fingerprints than a task should hold is divided the
same way by the bits that its mask leaves open, down to LEVELS levels. Below a node, fingerprints stand in Gray order in runs of bounded
length, and runs in a tree whose nodes hold the bits that all of theirs share. Two tree nodes whose shared
bits differ in more than ``radius`` places are pruned with all that is below them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, free_names, hash_below, join_by_key, join_small, map_texts, small_or_not
from tessera.llm.components import components

#: Fingerprints of a node that one task holds at a time; larger nodes are cut into runs of this length.
RUN = 4096
#: Children of a node of the tree; levels of masked patterns above the trees.
FAN, LEVELS = 8, 3
#: Of a set of shingles alike pairs share one leading shingle and one more for each so many of it.
SHOWN = 20
#: Vertices at a leading shingle up to which their pairs are written out; vertices on a side of a tile beyond that.
CROWD, TILE = 64, 1024
#: Texts of the sample that orders shingles, about; its count of a shingle from which that is a crowd's. Parts of such a shingle when its entries are counted.
SAMPLE, HOT, SPREAD = 8192, 64, 4096


def _mixed(hashes: np.ndarray, families: int) -> np.ndarray:
    """A row of hashes for each family: the first are the hashes themselves, the others are mixed from them (splitmix64)."""
    step = np.arange(families, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    z = hashes[None, :] + step
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z[0] = hashes
    return z


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each row of hashes how many have each of the 64 bits set; 255 at a time fit a byte."""
    rows, n = hashes.shape
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8), axis=1, bitorder="little").reshape(rows, n, 64)
    full = n // 255 * 255
    counts = bits[:, full:].sum(1, dtype=np.uint8).astype(np.int64)
    if full:
        counts += bits[:, :full].reshape(rows, -1, 255, 64).sum(2, dtype=np.uint8).sum(1, dtype=np.int64)
    return counts


def family_fingerprints(text: str | None, width: int = 3, seed: int = 42, families: int = 1) -> list[int]:
    """For each family 64 majority bits over the hashes of the ``width``-word shingles, repeats included, as a signed number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * families
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(width, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros((families, 64), np.int64)
    for i in range(0, len(starts), 8160):  # bounded memory
        some = zip(starts[i : i + 8160], stops[i : i + 8160])
        votes += _bit_counts(_mixed(np.array([digest(joined[a:b], seed) for a, b in some], "<u8"), families))
    return np.packbits(2 * votes > len(starts), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of the first family."""
    return family_fingerprints(text, width, seed)[0]


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (long) of every row; texts without a word, and null, have fingerprint 0."""

    def make():
        return lambda texts: (None, {"fingerprint": [fingerprint(t, width, seed) for t in texts]})

    return map_texts(docs, ["doc_id"], make, "fingerprint long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Places of codes in the reflected Gray order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def _pairs_within(codes: np.ndarray, cuts: np.ndarray, radius: int, only_across: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of codes in the same segment that differ in at most ``radius`` bits.

    ``codes`` is sorted in Gray order within the segments that begin at ``cuts``. With ``only_across`` pairs are
    taken between the first so many codes and the rest alone."""
    n = len(codes)
    leaf = np.zeros(n, np.int64)  # a tree node never spans two segments
    leaf[cuts[1:]] = 1
    segment = np.cumsum(leaf)
    inside = np.arange(n) - cuts[segment]
    levels = []
    low, high, owner, first = codes, codes, segment, np.arange(n)
    pos = inside
    while len(low) > len(cuts):
        group = np.flatnonzero((pos % FAN == 0))
        low, high = np.bitwise_and.reduceat(low, group), np.bitwise_or.reduceat(high, group)
        owner, pos = owner[group], pos[group] // FAN
        levels.append((low, high, owner, np.append(group, len(first))))
        first = group
    # from the roots down: pairs of nodes whose shared bits differ in at most radius places
    a = b = np.arange(len(low))
    out_a, out_b = [], []
    for depth in range(len(levels) - 1, -1, -1):
        _, _, _, child = levels[depth]
        below = levels[depth - 1] if depth else None
        lo, hi = (below[0], below[1]) if below else (codes, codes)
        next_a, next_b = [], []
        for i in range(0, len(a), 1 << 13):  # bounded memory
            x, y = a[i : i + (1 << 13)], b[i : i + (1 << 13)]
            na, nb = child[x + 1] - child[x], child[y + 1] - child[y]
            count = na * nb
            at = np.repeat(np.arange(len(x)), count)
            k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            ca, cb = child[x][at] + k // nb[at], child[y][at] + k % nb[at]
            keep = ca <= cb
            ca, cb = ca[keep], cb[keep]
            apart = (lo[ca] & ~hi[cb]) | (lo[cb] & ~hi[ca])
            keep = np.bitwise_count(apart) <= radius
            if not below:
                keep &= ca < cb
                if only_across:
                    keep &= (ca < only_across) & (cb >= only_across)
            next_a.append(ca[keep])
            next_b.append(cb[keep])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (next_a, next_b))
    if levels:
        return a, b
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that span what all of them connect: fewer than ``n``, none of them made up.

    In each round every tree that has a pair with a tree of a smaller root is hung below it."""
    root, taken = np.arange(n), []
    while True:
        x, y = root[a], root[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            break
        high, first = np.unique(np.maximum(x, y)[open_], return_index=True)
        at = open_[first]
        taken.append(at)
        root[high] = np.minimum(x, y)[at]
        while (root[root] != root).any():
            root = root[root]
    at = np.concatenate(taken) if taken else np.zeros(0, np.int64)
    return a[at], b[at]


def _closest(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of ``codes`` a spanning forest, each code's nearest partner and the partner that has most partners of its own.

    The last one is the source of a group of copies, which are nearer to it than to most of each other. At most three pairs a code."""
    n = len(codes)
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    nearest, central = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for i in range(0, len(a), 1 << 18):  # bounded memory
        x, y = a[i : i + (1 << 18)], b[i : i + (1 << 18)]
        near = (64 - np.bitwise_count(codes[x] ^ codes[y]).astype(np.int64)) << 24
        for one, other in ((x, y), (y, x)):  # the best partner stands in the low bits
            np.maximum.at(nearest, one, near | other)
            np.maximum.at(central, one, degree[other] << 31 | near | other)
    x, y = _forest(n, a, b)
    ends = np.flatnonzero(nearest >= 0)
    low = (1 << 24) - 1
    return np.concatenate([x, ends, ends]), np.concatenate([y, nearest[ends] & low, central[ends] & low])


def _joined(batches: Iterator, keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows in pieces that end where ``keys`` change, with as few rows as a batch and one group have."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        n = len(now[keys[0]])
        if not n:
            continue
        same = np.ones(n, bool)
        for c in keys:
            same &= now[c] == now[c][-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield {c: v[:cut] for c, v in now.items()}
        held = {c: v[cut:] for c, v in now.items()}
    if held is not None and len(held[keys[0]]):
        yield held


def _starts(rows: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows[keys[0]]), bool)
    new[0] = True
    for c in keys:
        new[1:] |= rows[c][1:] != rows[c][:-1]
    return np.flatnonzero(new)


def block_masks(blocks: int, of: int = (1 << 64) - 1) -> list[int]:
    """Masks of ``blocks`` runs of bits that together are all bits of the mask ``of``."""
    bits = [b for b in range(64) if of >> b & 1]
    edges = [len(bits) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[a:e]) for a, e in zip(edges, edges[1:]) if e > a]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _children(masks: list[int], radius: int) -> dict[int, list[int]]:
    """For each mask those of its children: one more block of the bits that it leaves open."""
    return {m: [m | b for b in block_masks(radius + 1, ((1 << 64) - 1) & ~m)] for m in masks}


def _divided(entries: DataFrame, children: dict[int, list[int]], by: list[str]) -> DataFrame:
    """A row (mask, value) for each child of each entry's mask."""
    known = F.create_map(*[x for m, some in children.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in some]))])
    rows = entries.select(*by, "fingerprint", F.explode(known[F.col("mask")]).alias("mask"))
    return rows.select(*by, "mask", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("value"), "fingerprint")


def _signed_gray() -> Column:
    """The place of ``fingerprint`` in Gray order; the sign bit is turned over, so signed order is that of unsigned places."""
    rank = F.col("fingerprint")
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    return rank.bitwiseXOR(F.lit(-(1 << 63))).alias("gray")


def _upper_levels(codes: DataFrame, radius: int, run: int, levels: int, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(entries of the nodes with at most ``run`` fingerprints, entries of larger nodes of the last level or None)."""
    node = [*by, "mask", "value"]
    entries = codes.select(*by, F.lit(0).cast("long").alias("mask"), "fingerprint")
    masks, usual, large = [0], None, None
    for level in range(levels):
        children = _children(masks, radius)
        entries = _divided(entries, children, by)
        large = checkpoint(entries.groupBy(*node).agg(F.count("*").alias("n")).where(F.col("n") > run).select(*node))
        none = large.isEmpty()
        few = entries if none else join_small(entries, large, node, "left_anti")
        usual = few if usual is None else usual.unionByName(few)
        if none:
            return usual, None
        entries = join_small(entries, large, node, "left_semi")
        masks = sorted({c for some in children.values() for c in some})
        if level + 1 < levels:
            entries = checkpoint(entries)
    return usual, entries


def near_links(codes: DataFrame, radius: int = 3, run: int = RUN, levels: int = LEVELS, by: list[str] | None = None, closest: bool = False) -> DataFrame:
    """Links (a, b) that connect what pairs of ``codes`` (column fingerprint, distinct) within ``radius`` bits connect.

    Of the pairs found in one task those of a spanning forest are given, so there are no more links than fingerprints
    in its nodes; with ``closest`` each fingerprint's nearest partner, and the one with most partners, are there too.
    ``by``: integer columns that both ends of a link have alike; links carry them in front."""
    by = by or []
    node = [*by, "mask", "value"]
    kind = "".join(f"{c} int, " for c in by) + "a long, b long"
    usual, in_large = _upper_levels(codes, radius, run, levels, by)

    def few(codes, a, b):
        return _closest(codes, a, b) if closest else _forest(len(codes), a, b)

    def batch_of(rows, a, b):
        import pyarrow as pa

        raw = rows["fingerprint"]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (*(rows[c][a] for c in by), raw[a], raw[b])], names=[*by, "a", "b"])

    def of_nodes(batches):
        for rows in _joined(batches, node):
            codes = rows["fingerprint"].view("<u8")
            cuts = _starts(rows, node)
            yield batch_of(rows, *few(codes, *_pairs_within(codes, cuts, radius)))

    # what follows from a fingerprint and its mask is not shuffled
    value = F.col("fingerprint").bitwiseAND(F.col("mask")).alias("value")
    dealt = usual.select(*by, "mask", "fingerprint").repartition(*by, "mask", value)
    dealt = dealt.select(*by, "mask", value, "fingerprint", _signed_gray()).sortWithinPartitions(*node, "gray")
    links = dealt.select(*node, "fingerprint").mapInArrow(of_nodes, kind)

    if in_large is None:
        return links.distinct()
    # nodes that are too large for a task: runs of the Gray order meet in pairs, but for those that are pruned
    runs = _gray_runs(in_large, run, by)
    bits = runs.groupBy(*node, "run").agg(F.bit_and("fingerprint").alias("low"), F.bit_or("fingerprint").alias("high"))
    left, right = (bits.select(*node, *[F.col(c).alias(c + s) for c in ("run", "low", "high")]) for s in ("_a", "_b"))
    apart = F.expr("bit_count((low_a & ~high_b) | (low_b & ~high_a))")
    met = left.join(right, node).where((F.col("run_a") <= F.col("run_b")) & (apart <= radius))
    met = met.select(*node, "run_a", "run_b")
    tiles = runs.join(met.withColumn("run", F.explode(F.array_distinct(F.array("run_a", "run_b")))), [*node, "run"])
    tile = [*node, "run_a", "run_b"]

    def of_tiles(batches):
        for rows in _joined(batches, tile):
            starts = [*_starts(rows, tile).tolist(), len(rows["mask"])]
            for s, e in zip(starts, starts[1:]):
                first = int((rows["run"][s:e] == rows["run_a"][s]).sum())
                across = first if first < e - s else 0
                cuts = np.array([0])
                codes = rows["fingerprint"][s:e].view("<u8")
                a, b = few(codes, *_pairs_within(codes, cuts, radius, across))
                yield batch_of(rows, a + s, b + s)

    dealt = tiles.repartition(*tile).sortWithinPartitions(*tile, "run", "gray")
    return links.unionAll(dealt.select(*tile, "run", "fingerprint").mapInArrow(of_tiles, kind)).distinct()


def _gray_runs(entries: DataFrame, run: int, by: list[str]) -> DataFrame:
    """Number runs of at most ``run`` neighbours in Gray order within each node.

    The sort is one of ranges over all nodes, so no task needs a whole node; a run never spans two tasks."""

    keys = [*by, "mask", "value"]

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        node, seen = None, 0
        for batch in batches:
            rows = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            n = len(rows["mask"])
            if not n:
                continue
            starts = _starts(rows, keys)
            if node != [rows[c][0] for c in keys]:
                seen = 0
            inside = np.arange(n) - np.repeat(starts, np.diff([*starts, n]))
            inside[: starts[1] if len(starts) > 1 else n] += seen
            node, seen = [rows[c][-1] for c in keys], int(inside[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(task + inside // run)], names=[*batch.schema.names, "run"])

    dealt = entries.select(*keys, _signed_gray(), "fingerprint").repartitionByRange(*keys, "gray")
    dealt = dealt.sortWithinPartitions(*keys, "gray")
    return checkpoint(dealt.mapInArrow(number, "".join(f"{c} int, " for c in by) + "mask long, value long, gray long, fingerprint long, run long"))


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """fingerprint, least doc_id with it, root of its component."""
    codes = checkpoint(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(codes.select("fingerprint"), radius))
    found = codes.join(roots, codes.fingerprint == roots.vertex, "left")
    return found.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """64-bit hashes of the different ``width``-word shingles, ascending; fewer words are one shingle, none give none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(width, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def set_fingerprints(text: str | None, width: int = 2, seed: int = 42, families: int = 1) -> list[int]:
    """For each family 64 majority bits over the hashes of the different ``width``-word shingles, as a signed number."""
    hashes = shingle_hashes(text, width, seed)
    votes = np.zeros((families, 64), np.int64)
    for i in range(0, len(hashes), 8160):  # bounded memory
        votes += _bit_counts(_mixed(hashes[i : i + 8160], families))
    return np.packbits(2 * votes > len(hashes), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def words_digest(text: str | None) -> bytes:
    """A 128-bit hash of a text's words; letter case of A-Z and white space between words don't count."""
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))


def _candidates(classes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of vertices of ``classes`` (vertex, prints) to be held against their texts.

    Two are linked where their fingerprints of one family are alike, or within ``radius`` bits and near by the others of their node. Links
    whose ends differ in over a sixth of the bits of all families are left out: alike in eight five-word shingles of ten, they differ in about a tenth."""
    one = classes.select("vertex", F.posexplode("prints").alias("family", "fingerprint"))
    # alike fingerprints hang on one vertex, another one in each family
    codes = checkpoint(one.groupBy("family", "fingerprint").agg(F.min_by("vertex", F.xxhash64("vertex", "family")).alias("hub")))
    near = near_links(codes.select("family", "fingerprint"), radius, by=["family"], closest=True)
    for end in ("a", "b"):
        near = near.join(codes.select("family", F.col("fingerprint").alias(end), F.col("hub").alias(f"hub_{end}")), ["family", end])
    same = one.join(codes, ["family", "fingerprint"]).where("vertex <> hub").select("vertex", "hub")
    links = near.select("hub_a", "hub_b").union(same).toDF("a", "b").where("a <> b")
    links = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    ends = links
    for end in ("a", "b"):
        ends = ends.join(classes.select(F.col("vertex").alias(end), F.col("prints").alias(f"prints_{end}")), end)
    apart = F.expr("aggregate(zip_with(prints_a, prints_b, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n)")
    return ends.where(6 * apart <= 64 * F.size("prints_a")).select("a", "b")


def _parities(grams: np.ndarray) -> np.ndarray:
    """Bits (two for each of ``grams`` at least, 64 times a power of two) that say whether an odd number of them falls on each place.

    Two sets differ in as many elements, at least, as their bits do."""
    bits = 64
    while bits < 2 * len(grams):
        bits *= 2
    odd = np.bincount(grams.astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _alike(links: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Those of ``links`` (a, b) whose sets of ``shingles`` (vertex, size, parities, grams) have a Jaccard similarity of at least ``similarity``.

    Where the parities already differ in too many bits, the sets are not looked at: they do not meet the link."""

    def with_ends(links, *columns):
        for end in ("a", "b"):
            links = links.join(shingles.select(F.col("vertex").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
        return links

    def enough(shared):
        return shared * (1 + similarity) >= similarity * (F.col("size_a") + F.col("size_b")) - 1e-6

    def as_wide(one, other):  # the wider of two is folded once; alike sets need no more
        half = f"zip_with(slice({one}, 1, size({one}) div 2), slice({one}, size({one}) div 2 + 1, size({one}) div 2), (x, y) -> x ^ y)"
        return f"if(size({one}) > size({other}), {half}, {one})"

    a, b = as_wide("parities_a", "parities_b"), as_wide("parities_b", "parities_a")
    apart = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n)")
    may_be = F.coalesce(enough((F.col("size_a") + F.col("size_b") - apart) / 2), F.lit(True))
    links = with_ends(links, "size", "parities").where(may_be).select("a", "b", "size_a", "size_b")
    return with_ends(links, "grams").where(enough(F.size(F.array_intersect("grams_a", "grams_b")))).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint and component_id (smallest doc_id reachable by links of at most ``radius`` bits).

    One row for each row of ``docs``. Equal texts have equal fingerprints and are one class from the start.
    Texts without words (null, empty, white space) have fingerprint 0, linked like any other. A null doc_id gets a
    row too; its component_id is null only if no row of its component has an id. Other columns are left out."""
    prints = checkpoint(fingerprints(docs, width, seed))
    found = checkpoint(_classes(prints, radius))
    named = found.groupBy("root").agg(F.min("least").alias("component_id"))
    by_code = found.select("fingerprint", "root").join(named, "root").select("fingerprint", "component_id")
    return prints.join(by_code, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _common_shingles(docs: DataFrame, width: int, seed: int, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of the shingles that most texts of a sample hold, three at least; ``most`` at most.

    The sample is one text in 16, about SAMPLE texts at most. They only order shingles, so that seldom ones are looked for first: any order finds the same links."""

    def make():
        return lambda texts: (None, {"digest": [words_digest(t) for t in texts], "grams": [shingle_hashes(t, width, seed).view(np.int64) for t in texts]})

    share = min(1 / 16, SAMPLE / max(1, docs.count()))
    some = map_texts(docs.where(hash_below(F.xxhash64("text"), share)), [], make, "digest binary, grams array<long>").dropDuplicates(["digest"])
    counts = some.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 3")
    found = counts.orderBy(F.desc("n"), "gram").limit(most).toPandas()
    hashes = found["gram"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(hashes)
    return hashes[at], found["n"].to_numpy(np.int64)[at]


def _needed(size, similarity: float) -> tuple:
    """How many shingles a set of ``size`` shares at least with one that is alike, and how many of these are to be among the leading ones of both."""
    return np.ceil(similarity * size - 1e-6).astype(int), 1 + size // SHOWN


def _leading(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float, hot: int) -> tuple[np.ndarray, int]:
    """The first of a text's shingles, seldom ones first, so many that two alike texts share as many of them as the smaller one needs to.

    And how many of them come before those that ``hot`` texts of the sample hold."""
    n = len(hashes)
    shared, shown = _needed(n, similarity)
    first = n - shared + shown
    if not len(common):
        return hashes[:first].view(np.int64), min(first, n)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    held = np.where(common[at] == hashes, counts[at], 0)
    order = np.argsort(held, kind="stable")[:first]
    return hashes[order].view(np.int64), int((held[order] < hot).sum())


def _pairs_of_shingles(entries: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of vertices of other roots with as many leading shingles in common as alike ones need to have, whose sizes allow them to be alike.

    A shingle has few of ``entries``. Alike pairs that share a shingle of a crowd too may be left out: they are found there."""
    least = similarity - 1e-6

    def run(batches):
        import pyarrow as pa

        for rows in _joined(batches, ["gram"]):
            starts = [*_starts(rows, ["gram"]).tolist(), len(rows["gram"])]
            found = [np.zeros((0, 3), np.int64)]
            for s, e in zip(starts, starts[1:]):
                x, y = np.triu_indices(e - s, 1)
                root, size, vertex = (rows[c][s:e] for c in ("root", "size", "vertex"))
                keep = (root[x] != root[y]) & (np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y]))
                need = _needed(np.minimum(size[x], size[y])[keep].astype(np.int64), similarity)[1]
                x, y = vertex[x[keep]], vertex[y[keep]]
                found.append(np.stack([np.maximum(x, y), np.minimum(x, y), need], 1))
            pairs, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(pairs[:, k]) for k in range(3)), pa.array(n.astype(np.int64))], names=["a", "b", "need", "n"])

    dealt = entries.select("gram", "vertex", "root", "size").repartition("gram").sortWithinPartitions("gram")
    shared = dealt.mapInArrow(run, "a long, b long, need long, n long").groupBy("a", "b", "need").agg(F.sum("n").alias("n"))
    return shared.where("n >= need").select("a", "b")


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``, by products of bounded blocks of columns."""
    (a, b) = (np.concatenate(x) for x in (left, right))
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for flat, sets in ((a, left), (b, right)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        held = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], owner[held][order], len(sets)))
    for start in range(0, len(both), columns):
        blocks = []
        for at, owner, n in sides:
            i, j = np.searchsorted(at, [start, start + columns])
            block = np.zeros((n, columns), np.float32)
            block[owner[i:j], at[i:j] - start] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def _links_of_crowds(entries: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect what the alike pairs of other roots connect within each leading shingle of many ``entries``.

    The root with most entries of a shingle is at home there: its vertices meet the others only. All are dealt over tiles of about TILE a
    side, whose sets of shingles are compared there; of the alike pairs of a tile those of a spanning forest are given."""
    counts = entries.groupBy("gram", "root").agg(F.count("*").alias("n"))
    home = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most"))
    home = home.where(F.col("all") > F.col("most.n"))  # a shingle of one root links nothing
    home = checkpoint(home.select("gram", F.col("most.root").alias("home"), F.ceil(F.col("all") / TILE).alias("p_parts"), F.ceil((F.col("all") - F.col("most.n")) / TILE).alias("q_parts")))
    full = join_small(entries.select("gram", "vertex", "root"), home, ["gram"]).join(shingles.select("vertex", "grams"), "vertex")
    p, q = (F.pmod(F.xxhash64("vertex"), F.col(c)).cast("int") for c in ("p_parts", "q_parts"))
    parts = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    held = ["vertex", "root", (F.col("root") == F.col("home")).alias("at_home"), "grams"]
    dealt = full.select("gram", p.alias("p"), parts("q_parts").alias("q"), F.lit(0).alias("side"), *held)
    copied = full.where("root <> home").select("gram", parts("p_parts").alias("p"), q.alias("q"), F.lit(1).alias("side"), *held)
    key = ["gram", "p", "q"]

    def run(batches):
        import pyarrow as pa

        for rows in _joined(batches, key):
            starts = [*_starts(rows, key).tolist(), len(rows["gram"])]
            found = [np.zeros((0, 2), np.int64)]
            for s, e in zip(starts, starts[1:]):
                m = s + int((rows["side"][s:e] == 0).sum())
                if m == s or m == e:
                    continue
                vertex, root, sets = rows["vertex"], rows["root"], rows["grams"]
                n = np.array([len(x) for x in sets[s:e]])
                enough = _shared_counts([*sets[s:m]], [*sets[m:e]]) * (1 + similarity) >= similarity * (n[: m - s, None] + n[None, m - s :]) - 1e-6
                x, y = np.nonzero(enough & (root[s:m, None] != root[None, m:e]))
                keep = rows["at_home"][s:m][x] | (vertex[s:m][x] > vertex[m:e][y])  # of two that are both copied one order is enough
                x, y = x[keep] + s, y[keep] + m
                names, at = np.unique(root[s:e], return_inverse=True)
                first = {}
                for i, (v, w) in enumerate(zip(at[x - s].tolist(), at[y - s].tolist())):
                    first.setdefault((v, w), i)
                if first:
                    ends = np.array([*first])
                    a, b = _forest(len(names), ends[:, 0], ends[:, 1])
                    at = [first[v, w] for v, w in zip(a.tolist(), b.tolist())]
                    found.append(np.stack([vertex[x[at]], vertex[y[at]]], 1))
            links = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(links.max(1)), pa.array(links.min(1))], names=["a", "b"])

    dealt = dealt.unionByName(copied).repartition(*key).sortWithinPartitions(*key, "side")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _crowds_and_rest(leads: DataFrame, similarity: float) -> DataFrame:
    """(gram, vertex, root, size, n) of the leading shingles by which a vertex can be alike with one of another root; n: vertices at a shingle, at least.

    ``leads``: vertex, root (null: the vertex itself), size, lead, usual (how many of ``lead`` are no crowd's by the sample).
    Shingles of one root alone go, and then vertices that have fewer left than an alike pair shares; twice, as either leaves fewer of the other.
    All entries are shuffled once, and what is left of them again; a crowd's shingle is dealt over tasks and stays."""
    own = F.coalesce("root", "vertex")
    spread = F.when(F.col("at") < F.col("usual"), 0).otherwise(1 + F.pmod(F.xxhash64("vertex"), F.lit(SPREAD)).cast("int"))
    entries = leads.select("vertex", "root", "size", "usual", F.posexplode("lead").alias("at", "gram"))
    entries = entries.select("gram", "vertex", "size", "root", spread.alias("spread"))
    least = F.floor(F.ceil(similarity * F.col("size") - 1e-6) / SHOWN) + 1
    of_gram, of_vertex = Window.partitionBy("gram", "spread"), Window.partitionBy("vertex")
    row = ["gram", "vertex", "size", "root", "spread"]
    for _ in range(2):
        entries = entries.select(*row, F.count("*").over(of_gram).alias("n"), F.min(own).over(of_gram).alias("low"), F.max(own).over(of_gram).alias("high"))
        entries = entries.where("spread > 0 or low < high").select(*row, "n", F.count("*").over(of_vertex).alias("m")).where(F.col("m") >= least)
    crowd = F.when(F.col("spread") > 0, F.lit(CROWD + 1)).otherwise(F.col("n"))
    return checkpoint(entries.select("gram", "vertex", own.alias("root"), "size", crowd.alias("n")))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 4, families: int = 8, print_width: int = 2, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id stays.

    Texts are linked if the sets of their ``width``-word shingles have a Jaccard similarity of at least ``similarity``, all of them. Most links are
    found by fingerprints over shingles of ``print_width`` words, as one changed word changes few of these: in one of the ``families``
    two differ in at most ``radius`` bits. What these miss is found by leading shingles: with all shingles in one order, seldom ones first, two alike texts
    share some of their first ones, so pairs of texts that are not yet connected and share enough of these are held against each other. No link is made that the texts
    don't bear out (shingles are compared by 32 bits of a hash). Texts of the same words, and texts without words, are one vertex each.
    Rows that are repeated with all their columns count once. Where no row of a component has a doc_id, one of its
    rows stays. All columns are kept, whatever their names. What is joined with texts are the keys (doc_id, hash of the row) of the rows that
    go, or that stand for a vertex with links, so texts are not shuffled while these are few."""
    key = free_names(docs, "doc_key", "row_key", "vertex_key", "root_key")
    ids, vertex, root = key[:2], key[2], key[3]
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]  # what can be hashed
    keyed = docs.withColumn(key[0], F.col("doc_id")).withColumn(key[1], F.xxhash64(*plain))

    def make_prints():
        return lambda texts: (None, {"digest": [words_digest(t) for t in texts], "prints": [set_fingerprints(t, print_width, seed, families) for t in texts]})

    def make_grams():
        def of(texts):
            sets = [np.unique(shingle_hashes(t, width, seed).astype(np.uint32)) for t in texts]
            return None, {"size": [len(s) for s in sets], "parities": [_parities(s) for s in sets], "grams": [s.view(np.int32) for s in sets]}

        return of

    common, counts = _common_shingles(docs, width, seed)
    hot = HOT

    def make_leads():
        def of(texts):
            sets = [shingle_hashes(t, width, seed) for t in texts]
            leads = [_leading(s, common, counts, similarity, hot) for s in sets]
            return None, {"size": [len(s) for s in sets], "lead": [x for x, _ in leads], "usual": [n for _, n in leads]}

        return of

    def of_key(other: DataFrame, of: DataFrame = keyed) -> list:
        return [of[key[0]].eqNullSafe(other[key[0]]), of[key[1]] == other[key[1]]]

    prints = map_texts(keyed, ids, make_prints, "digest binary, prints array<long>")
    prints = prints.select("digest", F.col(key[0]).alias("doc_id"), F.col(key[1]).alias("row"), "prints")
    rows = checkpoint(prints.groupBy("digest", "doc_id", "row").agg(F.count("*").alias("n"), F.first("prints").alias("prints")))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = rows.groupBy("digest").agg(F.min(rank).alias("least"), F.min_by("n", rank).alias("times"), F.first("prints").alias("prints"))
    classes = checkpoint(classes.withColumn("vertex", F.monotonically_increasing_id()))

    links = checkpoint(_candidates(classes.select("vertex", "prints"), radius))
    def shingles_of(vertices: DataFrame) -> DataFrame:
        known = classes.join(vertices.distinct(), "vertex", "left_semi")
        stand = checkpoint(known.select(F.col("least.doc_id").alias(key[0]), F.col("least.row").alias(key[1]), F.col("vertex").alias(vertex)))
        texts = keyed.join(small_or_not(stand), of_key(stand)).select(stand[vertex].alias("vertex"), keyed["text"])
        return checkpoint(map_texts(texts, ["vertex"], make_grams, "size int, parities array<long>, grams array<int>").dropDuplicates(["vertex"]))

    ends = F.explode(F.array("a", "b")).alias("vertex")
    alike = checkpoint(_alike(links, shingles_of(links.select(ends)), similarity))

    stand = classes.join(components(alike).where("vertex <> root"), "vertex", "left")
    stand = checkpoint(stand.select(F.col("least.doc_id").alias(key[0]), F.col("least.row").alias(key[1]), F.col("vertex").alias(vertex), F.col("root").alias(root), "times"))
    made = "size int, lead array<long>, usual int"
    once, again = stand.where("times = 1"), stand.where("times > 1")
    leads = map_texts(keyed, ids, make_leads, made)
    leads = leads.join(small_or_not(once), of_key(once, leads)).select(vertex, root, "size", "lead", "usual")
    if not again.isEmpty():  # rows that are repeated with all their columns
        one = keyed.join(small_or_not(again), of_key(again)).select(again[vertex], again[root], keyed["text"]).dropDuplicates([vertex])
        leads = leads.unionByName(map_texts(one, [vertex, root], make_leads, made))
    entries = _crowds_and_rest(leads.withColumnsRenamed({vertex: "vertex", root: "root"}), similarity)
    few, many = entries.where(F.col("n") <= CROWD), entries.where(F.col("n") > CROWD)
    pairs = checkpoint(_pairs_of_shingles(few, similarity))
    shingles = shingles_of(pairs.select(ends).unionAll(many.select("vertex")))
    rest = _alike(pairs, shingles, similarity).unionAll(_links_of_crowds(many, shingles, similarity))
    roots = components(alike.unionAll(rest))

    found = checkpoint(classes.join(roots, "vertex", "left").select("digest", "least", F.coalesce("root", "vertex").alias("root")))
    best = checkpoint(found.groupBy("root").agg(F.min("least").alias("best")))
    best = checkpoint(join_by_key(found, best, ["root"]).select("digest", "best"))
    marked = join_by_key(rows.drop("prints"), best, ["digest"]).withColumn("stays", rank == F.col("best"))
    named = [F.col("doc_id").alias(key[0]), F.col("row").alias(key[1])]
    goes = checkpoint(marked.where("not stays or n > 1").select(*named, "stays"))
    kept = keyed.join(small_or_not(goes), of_key(goes), "left_anti")
    again = goes.where("stays")  # repeated rows of which one stays
    if not again.isEmpty():
        one = keyed.join(small_or_not(again), of_key(again), "left_semi")
        kept = kept.unionByName(one.dropDuplicates(ids))
    return kept.select(*docs.columns)


def hex_fingerprint(column: str = "fingerprint"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")
