"""Near-duplicate join on word shingles: a MinHash LSH forest with exact verification.

Every distinct shingle set gets one label per tree, a string of MinHash slots. A tree is the trie of its
labels, held as the counts of its nodes. Matching starts with whole labels; each set then shortens its prefixes,
one slot at a time and first where the shorter node has the fewest members, until the chance that a pair at the
threshold meets in some tree reaches the target recall. A node that one of its sets asks for is a leaf for all
sets below it, so leaves of a tree do not overlap and their depths follow the data: dense parts of a tree keep
long prefixes, sparse ones short ones. Sets of one leaf are candidates. Each candidate pair is judged once, in
the first tree in which it meets, by its exact Jaccard similarity.

Large nodes are cut into blocks and every pair of blocks is a unit of work of its own, so no task holds a
whole node; units emit counts and a spanning star instead of pairs. Copies of a set stand behind one
representative throughout. Links then join into classes by star contraction over tables.

Defined results: words are runs without the six ASCII blanks, a text of fewer words than a shingle is one
shingle, and a text without words (or null) links to nothing; the class id is the least document id of
the class; repeated rows are copies of each other; other columns are not read by ``link``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored, tidy

WORDS = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 6
SLOT_BITS = 10
TARGET_RECALL = 0.9999
BLOCK = 512
WORD_CACHE = 400_000
PART_BYTES = 4 << 20  # text that a task holds at once
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty if it has no word."""
    found = text.encode("utf-8", "surrogatepass").split()
    code = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(code))
    if not width:
        return code
    n = len(code) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = mixed(total ^ code[i : i + n]) * MULTIPLIERS[i % len(MULTIPLIERS)]
    return np.unique(total)


def permutations(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    a = rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)


def labels(own: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """One label per tree: ``depth`` MinHash slots, the first in the highest bits."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 256):
        low = np.minimum(low, (own[i : i + 256, None] * a + b).min(axis=0))
    slot = (mixed(low) >> np.uint64(64 - SLOT_BITS)).astype(np.int64).reshape(-1, depth)
    out = np.zeros(len(slot), np.int64)
    for d in range(depth):
        out = (out << SLOT_BITS) | slot[:, d]
    return out


def depth_for(threshold: float, trees: int, deepest: int, target: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def gain(threshold: float, depth: int) -> float:
    """What a tree with prefixes of ``depth`` adds to minus the logarithm of the chance that a pair never meets."""
    return -math.log1p(-(threshold**depth))


def shorten(deepest: int, shortest: int, trees: int, threshold: float, target: float):
    """Adds ``depths``, one for each entry of ``shared(tree, label, sizes)``: the prefix the set asks for in that tree.

    ``sizes`` counts the members of the nodes above the label, the deepest first. Trees that are not listed hold the
    set alone even at the shortest prefix, which then costs nothing.
    """
    steps = np.array([gain(threshold, d) - gain(threshold, d + 1) for d in range(deepest - 1, shortest - 1, -1)])
    need = -math.log1p(-target) - trees * gain(threshold, deepest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(1)
            entries, count = shared.flatten(), shared.value_lengths().to_numpy()
            sizes = entries.field("sizes").flatten().to_numpy().reshape(-1, len(steps))
            row = np.repeat(np.arange(len(count)), count)
            level = np.tile(np.arange(len(steps)), len(row))
            owner, entry = np.repeat(row, len(steps)), np.repeat(np.arange(len(row)), len(steps))
            order = np.lexsort((entry, level, sizes.ravel(), owner))
            total = np.cumsum(steps[level[order]])
            first = np.concatenate(([0], np.cumsum(count)[:-1])) * len(steps)
            before = total - steps[level[order]]
            before -= before[np.minimum(first, len(before) - 1)][owner]
            lacking = need - (trees - count) * steps.sum()
            taken = order[before < lacking[owner]]
            depth = deepest - np.bincount(entry[taken], minlength=len(row))
            made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(depth, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), shared, made], names=["rep", "shared", "depths"])

    return run


def forest(reps: DataFrame, threshold: float, trees: int, deepest: int, target: float) -> DataFrame:
    """``rep, leaves``: the leaf of each tree for every set of ``reps(rep, labels)`` that has company in some tree.

    A leaf is its prefix in the high bits and its depth in the lowest three. A set alone at the shortest prefix has a
    leaf of its own.
    """
    shortest = max(1, depth_for(threshold, trees, deepest, target) - 1)
    above = range(deepest - 1, shortest - 1, -1)
    node = lambda d: f"shiftright(label, {SLOT_BITS * (deepest - d)})"
    known = reps.select("rep", F.posexplode("labels").alias("tree", "label"))
    for d in reversed(above):  # the shortest first: sets alone there need no more counts
        known = known.withColumn("node", F.expr(node(d)))
        counts = known.groupBy("tree", "node").agg(F.count("*").alias(f"n{d}"))
        counts = counts.where(f"n{d} > 1") if d == shortest else counts
        known = known.join(counts, ["tree", "node"]).drop("node")
    sizes = F.array(*[F.col(f"n{d}") for d in above])
    shared = known.groupBy("rep").agg(F.collect_list(F.struct("tree", "label", sizes.alias("sizes"))).alias("shared"))
    kind = shared.schema["shared"].dataType.simpleString()
    run = shorten(deepest, shortest, trees, threshold, target)
    asked = stored(shared.mapInArrow(run, f"rep binary, shared {kind}, depths array<int>"))
    rows = asked.select("rep", F.explode(F.arrays_zip("shared", "depths")).alias("_")).selectExpr("rep", "_.shared.tree AS tree", "_.shared.label AS label", "_.depths AS depth")
    placed = rows.drop("depth").withColumn("leaf", F.lit(None).cast("long"))
    for d in reversed(above):  # a shorter leaf holds all below it
        asks = rows.where(f"depth = {d}").selectExpr("tree", f"{node(d)} AS node").distinct().withColumn("_asked", F.lit(True))
        placed = placed.withColumn("node", F.expr(node(d))).join(asks, ["tree", "node"], "left")
        placed = placed.selectExpr("rep", "tree", "label", f"coalesce(leaf, IF(_asked, shiftleft(node, 3) | {d}L, NULL)) AS leaf")
    placed = placed.selectExpr("rep", "tree", f"coalesce(leaf, shiftleft(label, 3) | {deepest}L) AS leaf")
    own = placed.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tree", "leaf"))).alias("_own"))
    alone = f"transform(labels, (label, tree) -> coalesce(try_element_at(_own, tree), shiftleft({node(shortest)}, 3) | {shortest}L))"
    return reps.select("rep", "labels").join(own, "rep").selectExpr("rep", f"{alone} AS leaves")


def sketches(docs: DataFrame, key: str, text: str, words: int, trees: int, depth: int) -> DataFrame:
    """``id, t`` (hash of the text), ``rep`` (digest of the shingle set, null without words) and ``labels``."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), permutations(trees, depth)
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                rep, found = [], []
                for t in part.column(2).to_pylist():
                    own = shingles(t or "", hashes, words)
                    rep.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    found.append(labels(own, a, b, depth) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(rep, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["id", "t", "rep", "labels"]
                )

    rows = docs.selectExpr(f"`{key}` AS id", f"xxhash64(`{text}`) AS t", f"`{text}`")
    return rows.mapInArrow(tidy(run), f"id {id_type}, t long, rep binary, labels array<long>")


def grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Whole groups of rows that agree in the first ``by`` columns, many groups to a table; rows come sorted."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        keys = np.stack([table.column(i).to_numpy() for i in range(by)], axis=1)
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        last = int(change[-1]) if len(change) else 0
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def bounds(table: pa.Table, by: int) -> np.ndarray:
    keys = np.stack([table.column(i).to_numpy() for i in range(by)], axis=1)
    return np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [table.num_rows]))


UNIT = ("tree", "node", "low", "high")


def new_pairs(leaf: np.ndarray, block: np.ndarray, tree: int, low: int, high: int) -> np.ndarray:
    """Which pairs of a unit are its own: of its two blocks, and met in no earlier tree. Upper triangle."""
    n = len(leaf)
    if low == high:
        own = np.triu(np.ones((n, n), bool), 1)
    else:
        own = np.triu((block[:, None] != block[None, :]), 1)
    for t in range(tree):
        own &= leaf[:, None, t] != leaf[None, :, t]
    return own


def leaf_matrix(table: pa.Table, trees: int) -> np.ndarray:
    return table.column("leaves").combine_chunks().flatten().to_numpy().reshape(-1, trees)


def needed_members(trees: int):
    """Keeps the members of each unit that have a pair to judge there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 4):
            edge = bounds(table, 4)
            leaf = leaf_matrix(table, trees)
            tree, low, high, block = (table.column(c).to_numpy() for c in ("tree", "low", "high", "block"))
            keep = np.zeros(table.num_rows, bool)
            size = np.diff(edge)
            two = edge[:-1][size == 2]  # most units; judged together
            if len(two):
                same = leaf[two] == leaf[two + 1]
                first = np.where(same.any(axis=1), same.argmax(axis=1), trees) == tree[two]
                first &= (low[two] == high[two]) | (block[two] != block[two + 1])
                keep[two] = keep[two + 1] = first
            for i in np.flatnonzero(size > 2):
                a, b = edge[i], edge[i + 1]
                own = new_pairs(leaf[a:b], block[a:b], int(tree[a]), int(low[a]), int(high[a]))
                keep[a:b] = own.any(axis=0) | own.any(axis=1)
            kept = table.filter(pa.array(keep)).drop_columns(["leaves"])
            yield from kept.combine_chunks().to_batches()

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of membership blocks."""
    size = [len(s) for s in sets]
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(code, minlength=len(values))
    shared = counts > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), size)
    use = shared[code]
    row, code = row[use], column[code[use]]
    total = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(code, (start, start + 4096))
        member = np.zeros((len(sets), 4096), np.float32)
        member[row[a:b], code[a:b] - start] = 1
        total += member @ member.T
    return total


def judge(trees: int, threshold: float):
    """Per member with a link in a unit: the copies it links to there, and the least member of its local class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 4):
            edge = bounds(table, 4)
            leaf = leaf_matrix(table, trees)
            tree, low, high, block, copies = (table.column(c).to_numpy() for c in ("tree", "low", "high", "block", "copies"))
            reps = table.column("rep").to_pylist()
            column = table.column("shingles").combine_chunks()
            flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a < 2:
                    continue
                own = new_pairs(leaf[a:b], block[a:b], int(tree[a]), int(low[a]), int(high[a]))
                sets = [flat[at[i] : at[i + 1]] for i in range(a, b)]
                size = np.array([len(s) for s in sets], float)
                common = overlaps(sets)
                linked = own & (common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9)
                if linked.any():
                    linked |= linked.T
                    root = np.arange(b - a)
                    rank = np.argsort(np.argsort(np.array(reps[a:b], dtype="S16")))
                    root = rank.copy()
                    while True:  # least rank spreads along links
                        spread = np.where(linked, root[None, :], len(root)).min(axis=1)
                        lower = np.minimum(root, spread)
                        if (lower == root).all():
                            break
                        root = lower
                    by_rank = np.argsort(rank)
                    links = linked @ copies[a:b]
                    for i in np.flatnonzero(linked.any(axis=1)):
                        out[0].append(reps[a + i])
                        out[1].append(int(links[i]))
                        out[2].append(reps[a + by_rank[root[i]]])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["rep", "links", "root"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``: the least node it is connected to.

    Alternates large and small stars until the edges no longer change; each round is written once.
    """
    edges = stored(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.selectExpr("u AS node", "v AS root").union(edges.selectExpr("v AS node", "v AS root").distinct())
        seen = state
        both = edges.union(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS c", "least(u, m) AS m")
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        joined = large.join(least, F.col("u") == F.col("c"))
        small = joined.selectExpr("v AS u", "m AS v").union(least.selectExpr("c AS u", "m AS v")).where("u <> v")
        edges = stored(small.distinct())


def link(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    deepest: int = DEPTH,
    target: float = TARGET_RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """``id, t, class_root, class_id, n_links`` for every document; ``n_links`` counts linked documents."""
    own = stored(sketches(docs, key, text, words, trees, deepest))
    reps = own.where("rep IS NOT NULL").groupBy("rep").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.first("labels").alias("labels"))
    reps = stored(reps)
    leaves = stored(forest(reps, threshold, trees, deepest, target))
    placed = leaves.select("rep", F.posexplode("leaves").alias("tree", "node"))
    nodes = placed.groupBy("tree", "node").agg(F.count("*").alias("members")).where("members > 1")
    members = (
        placed.join(nodes, ["tree", "node"])
        .selectExpr("*", f"int(ceil(members / {block})) AS _blocks")
        .selectExpr("*", "int(pmod(xxhash64(rep), _blocks)) AS block")
        .selectExpr("rep", "tree", "node", "block", "explode(sequence(0, _blocks - 1)) AS _other")
        .selectExpr("tree", "node", "least(block, _other) AS low", "greatest(block, _other) AS high", "block", "rep")
    )
    described = members.join(leaves, "rep").select(*UNIT, "block", "rep", "leaves")
    needed = stored(
        described.repartition(*UNIT)
        .sortWithinPartitions(*UNIT)
        .mapInArrow(needed_members(trees), "tree int, node long, low int, high int, block int, rep binary")
    )
    wanted = needed.select("rep").distinct().join(reps.select("rep", "copies", "id"), "rep").join(leaves, "rep")
    texts = docs.selectExpr(f"`{key}` AS id2", f"`{text}` AS text")
    fetched = texts.join(wanted.hint("shuffle_hash"), F.expr("id2 <=> id")).select("rep", "copies", "leaves", "text")

    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                found = [shingles(t or "", hashes, words) for t in part.column(3).to_pylist()]
                same = [xxhash.xxh3_128_digest(s.tobytes()) == r for s, r in zip(found, part.column(0).to_pylist(), strict=True)]
                column = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
                made = pa.RecordBatch.from_arrays([*part.columns[:3], column], names=["rep", "copies", "leaves", "shingles"])
                yield made.filter(pa.array(same))

    sets = fetched.mapInArrow(tidy(reread), "rep binary, copies long, leaves array<long>, shingles array<long>").dropDuplicates(["rep"])
    judged = (
        needed.join(sets, "rep")
        .select(*UNIT, "block", "rep", "copies", "leaves", "shingles")
        .repartition(*UNIT)
        .sortWithinPartitions(*UNIT)
        .mapInArrow(tidy(judge(trees, threshold)), "rep binary, links long, root binary")
    )
    judged = stored(judged)
    roots = components(judged.selectExpr("hex(rep) AS u", "hex(root) AS v")).selectExpr("unhex(node) AS rep", "unhex(root) AS root")
    linked = judged.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("rep", "copies", "id").join(linked, "rep", "left").join(roots, "rep", "left")
    known = known.selectExpr("rep", "copies - 1 + coalesce(links, 0) AS n_links", "coalesce(root, rep) AS class_root", "id")
    least = known.groupBy("class_root").agg(F.min("id").alias("class_id"))
    known = known.drop("id").join(least, "class_root")
    return (
        own.select("id", "t", "rep")
        .join(known, "rep", "left")
        .selectExpr("id", "t", "class_root", "IF(class_root IS NULL, id, class_id) AS class_id", "coalesce(n_links, 0) AS n_links")
    )


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without near-duplicates: of each class the one with the least id stays, of repeated rows one.

    Documents without words are no copies of each other and stay.
    """
    found = stored(link(docs, key, text, **options))
    best = found.where("class_root IS NOT NULL").groupBy("class_root").agg(F.min(F.struct(F.col("id").isNull(), "id", "t")).alias("_b"))
    kept = best.selectExpr("coalesce(CAST(_b.id AS STRING), '') AS _i", "_b.t AS _t")
    marked = docs.selectExpr("*", f"coalesce(CAST(`{key}` AS STRING), '') AS _i", f"xxhash64(`{text}`) AS _t")
    worded = f"coalesce(`{text}`, '') RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'"
    chosen = marked.where(worded).join(kept.hint("shuffle_hash"), ["_i", "_t"]).dropDuplicates(["_i", "_t"])
    return chosen.select(*docs.columns).unionByName(docs.where(f"NOT ({worded})"))
