"""The LSH forest: leaves by density, prefixes shortened until the target recall, leaves that do not overlap."""

from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import near_join

TREES, DEPTH = near_join.TREES, near_join.DEPTH


def forest(spark, labels):
    table = spark.createDataFrame([(bytes([i // 256, i % 256]), row) for i, row in enumerate(labels.tolist())], "rep binary, labels array<long>")
    found = near_join.forest(table, near_join.THRESHOLD, TREES, DEPTH, near_join.TARGET_RECALL).collect()
    return {r.rep[0] * 256 + r.rep[1]: np.array(r.leaves) for r in found}


def dense_and_sparse():
    """100 sets that share three or four slots of every tree, 60 in pairs that share all but the last, 40 alone."""
    rng = np.random.default_rng(41)
    slots = rng.integers(0, 1 << near_join.SLOT_BITS, (200, TREES, DEPTH))
    slots[:100, :, :3] = slots[0, :, :3]
    slots[:100, :, 3] = np.where(rng.random((100, TREES)) < 0.9, slots[0, :, 3], slots[:100, :, 3])
    slots[100:160:2, :, :5] = slots[101:160:2, :, :5]
    labels = np.zeros((200, TREES), np.int64)
    for d in range(DEPTH):
        labels = labels << near_join.SLOT_BITS | slots[:, :, d]
    return labels


def test_leaves_follow_the_density_and_reach_the_target(spark):
    labels = dense_and_sparse()
    found = forest(spark, labels)
    assert set(found) == set(range(160))
    need = -np.log1p(-near_join.TARGET_RECALL)
    gains = {d: near_join.gain(near_join.THRESHOLD, d) for d in range(1, DEPTH + 1)}
    depth = {i: leaves & 7 for i, leaves in found.items()}
    assert all(sum(gains[d] for d in own.tolist()) >= need - 1e-9 for own in depth.values())
    assert len({d for own in depth.values() for d in own.tolist()}) > 1
    assert np.mean([depth[i].mean() for i in range(100)]) > np.mean([depth[i].mean() for i in range(100, 160)])


def test_sets_of_one_leaf_are_all_sets_below_it(spark):
    labels = dense_and_sparse()
    found = forest(spark, labels)
    for i, own in found.items():
        for t, leaf in enumerate(own.tolist()):
            prefix, shift = leaf >> 3, near_join.SLOT_BITS * (DEPTH - (leaf & 7))
            assert labels[i, t] >> shift == prefix
            below = {j for j in range(200) if labels[j, t] >> shift == prefix}
            assert below == {i} | {j for j, other in found.items() if other[t] == leaf}


def test_prefixes_are_shortened_where_it_costs_least():
    shortest = near_join.depth_for(near_join.THRESHOLD, TREES, DEPTH, near_join.TARGET_RECALL) - 1
    rng = np.random.default_rng(42)
    sizes = np.sort(rng.integers(2, 5000, (3, TREES, DEPTH - shortest)), axis=2)
    rows = [[{"tree": t, "label": t, "sizes": row[t].tolist()} for t in range(n)] for row, n in zip(sizes, (TREES, 10, 1), strict=True)]
    kind = pa.list_(pa.struct([("tree", pa.int32()), ("label", pa.int64()), ("sizes", pa.list_(pa.int64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([b"a", b"b", b"c"]), pa.array(rows, kind)], names=["rep", "shared"])
    (out,) = near_join.shorten(DEPTH, shortest, TREES, near_join.THRESHOLD, near_join.TARGET_RECALL)([batch])
    need = -np.log1p(-near_join.TARGET_RECALL)
    g = {d: near_join.gain(near_join.THRESHOLD, d) for d in range(1, DEPTH + 1)}
    for row, found in zip(rows, out.column(2).to_pylist(), strict=True):
        depth = [DEPTH] * len(row)
        steps = sorted((e["sizes"][k], k, t) for t, e in enumerate(row) for k in range(DEPTH - shortest))
        for _, _, t in steps:
            if sum(g[d] for d in depth) + (TREES - len(row)) * g[shortest] >= need:
                break
            depth[t] -= 1
        assert found == depth
    assert Counter(out.column(2).to_pylist()[2]) == Counter([DEPTH])  # the other trees reach the target at no cost
