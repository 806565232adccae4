"""Phrase collocations against plain counting, with fingerprints made to collide and texts cut into blocks."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_text_operators import docs
from tidemark.llm import phrases, queries
from tidemark.llm.common import documents

FEW = dict(filter_bits=1 << 12)


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [[w for w in re.split(r"[\x20\x09]+", piece) if w] for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def plain_counts(rows):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for words in words_of(text):
            own = counts["und" if lang is None else lang]
            own[()] += len(words)
            for n in range(1, 5):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return counts


def plain(rows, least):
    out = []
    for lang, f in plain_counts(rows).items():
        kept = []
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in many.items():
            if any(100 * b >= 80 * a for q, b in many.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:2000], 1):
            out.append((lang, rank, p.decode(), -a, l, r, f[()], -score))
    return sorted(out)


def texts(seed=0, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["of", "the", "New", "york", "a" * 19 + "x", "a" * 19 + "y", "über", "in", "z z"])
    weight = np.array([5, 5, 3, 3, 1, 1, 1, 3, 1]) / 23
    rows = []
    for i in range(n):
        parts = [w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for w in rng.choice(vocabulary, 60, p=weight)]
        parts[10:10] = ["New York City council "] * (i % 3)
        rows.append(("".join(parts), ["en", "de", None][i % 3]))
    return rows + [(None, "en"), ("", "xx"), (" ,. ", "yy"), ("one", "zz")] + rows[:3] * 5


def got(spark, rows, least=8, **how):
    table = docs(spark, [t for t, _ in rows], [g for _, g in rows])
    return sorted(tuple(r) for r in phrases.collocations(table, least=least, **FEW, **how).collect())


def test_matches_plain_counting(spark):
    assert got(spark, texts()) == plain(texts(), 8)


@pytest.mark.parametrize("bits", [4, 7])
def test_colliding_fingerprints_change_nothing(spark, bits):
    rows = texts(1, 30)
    assert got(spark, rows, print_bits=bits) == plain(rows, 8)


def test_blocks_cut_long_texts_between_words(spark):
    rows = texts(2, 12)
    rows.append((" ".join(t for t, _ in rows if t), "en"))
    assert got(spark, rows, block=64) == got(spark, rows) == plain(rows, 8)


def test_blocks_of_long_words_go_on():
    raw = [b"a" * 50 + b" " + b"b" * 50 + b" c " + b"d" * 90 + b" e f", b"", b"x y"]
    found = []
    for data, which, offset, known in phrases.blocks(raw, 16):
        block = phrases.Block(data, phrases.FULL)
        for n in (1, 2, 3, 4):
            found += [(int(which[np.searchsorted(offset, block.place[i], "right") - 1]), n, bytes(block.canon[block.start[i] : block.end[i + n - 1]])) for i in block.inside(n, known)]
    want = []
    for i, t in enumerate(raw):
        w = t.split()
        want += [(i, n, b" ".join(w[j : j + n])) for n in (1, 2, 3, 4) for j in range(len(w) - n + 1)]
    assert sorted(found) == sorted(want)


def test_same_bytes_looks_past_eight():
    data = np.frombuffer(b"abcdefghij abcdefghiK abcdefghij" + bytes(8), np.uint8)
    at, first = np.array([11, 22]), np.array([0, 0])
    assert phrases.same_bytes(data, at, first, np.array([10, 10])).tolist() == [False, True]


def test_empty_table_and_clashing_columns(spark):
    table = docs(spark, ["big deal now"] * 3, ["en"] * 3).selectExpr("*", "1 AS fp", "2 AS phrase", "3 AS a", "'k' AS doc")
    assert [r.phrase for r in phrases.collocations(table, least=3, **FEW).orderBy("rank").collect()] == ["big deal now"]
    assert phrases.collocations(table.limit(0), **FEW).collect() == []


def test_query_over_the_written_table(spark, tmp_path):
    rows = texts(3, 90)
    docs(spark, [t for t, _ in rows], [g for _, g in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    result = queries.op13_phrases(spark, str(tmp_path))
    assert result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in result.dtypes} == {"string", "bigint"}
    assert sorted(tuple(r) for r in result.collect()) == plain([(r.text, r.lang) for r in documents(spark, str(tmp_path)).collect()], 30)
