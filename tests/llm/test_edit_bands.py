"""Band keys of edit fingerprints: work per print as tables grow, and checks that let near prints through."""

import hashlib

import numpy as np

from tidemark.llm import edit_prints


def random_prints(rng, n):
    sampler = edit_prints.Sampler()
    return [f"{length:x}:{np.packbits(rng.integers(0, 2, len(sampler.upto(length)), dtype=np.uint8)).tobytes().hex()}" for length in rng.integers(200, 4000, n).tolist()]


def mates(rng, n):
    """Members of bands that pass the check, by print."""
    count, width = edit_prints.banding(edit_prints.LIKE, rows=n)
    _, keys, check = edit_prints.Sampler().bands(random_prints(rng, n), count, width)
    order = np.argsort(keys, kind="stable")
    differ = edit_prints.most_differing(edit_prints.LIKE, edit_prints.KEY_BITS - width)
    return edit_prints.with_mates(keys[order], check[order], differ).sum() / n


def test_chance_members_do_not_grow_with_the_table():
    rng = np.random.default_rng(31)
    assert mates(rng, 4096) < 0.3 and mates(rng, 16_384) < 0.3


def test_members_of_a_band_are_compared_with_all_others():
    band = np.array([1, 1, 1, 2, 2, 3])
    check = np.array([0b0000, 0b1111, 0b0001, 0b0, 0b1111, 0b0])
    assert edit_prints.with_mates(band, check, 1).tolist() == [True, False, True, False, False, False]


def test_one_random_order_serves_all_lengths():
    sampler = edit_prints.Sampler()
    long = random_prints(np.random.default_rng(32), 1)[0].split(":")
    length = int(long[0], 16)
    short = f"{int(length * 0.9):x}:{long[1]}"
    _, keys, _ = sampler.bands([":".join(long), short], 200, 1)
    same = (keys[:200] == keys[200:]).mean()
    assert 0.85 < same <= 1  # nine tenths share the place, half of the others agree by chance
    assert not len(sampler.bands(["0:"], 3, 12)[0])


def ring(spark, ids, texts, kind):
    table = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string").repartition(3)
    return edit_prints.fingerprints(table).select("doc_id", "n_chars", "edited_sha256").collect()


def plain_ring(spark, ids, texts):
    """Every row with the next one in the order of id and hash of the text, null ids first."""
    hashes = [r.h for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").selectExpr("i", "xxhash64(t) AS h").orderBy("i").collect()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or "", hashes[i]))
    out = []
    for at, i in enumerate(order):
        own, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(own) // 2
        out.append((ids[i], len(own), hashlib.sha256((own[: len(own) - half] + following[:half]).encode()).hexdigest()))
    return out


def test_text_ids_and_one_hot_id_fall_into_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(edit_prints, "ROWS_PER_RANGE", 10)
    rng = np.random.default_rng(33)
    texts = [" ".join(rng.choice(["é", "ant", "bee", "cow", "𝄞"], rng.integers(0, 30))) for _ in range(240)]
    ids = [f"id-{i:03}" for i in range(80)] + ["hot"] * 80 + [None] * 80
    key = lambda r: (r[0] is not None, *r[0:1], *r[1:]) if r[0] is not None else (False, "", *r[1:])
    got = sorted((tuple(r) for r in ring(spark, ids, texts, "string")), key=key)
    assert got == sorted(plain_ring(spark, ids, texts), key=key)
    table = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string")
    sizes = [r["count"] for r in edit_prints.with_ranges(table, "doc_id", "text").groupBy("bucket").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 60


def test_repeated_rows_send_one_head(spark, monkeypatch):
    monkeypatch.setattr(edit_prints, "ROWS_PER_RANGE", 5)
    got = ring(spark, [1] * 30 + [2] * 30, ["same words here"] * 60, "long")
    assert len(got) == 60 and len({r.edited_sha256 for r in got}) == 1
