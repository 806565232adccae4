"""Text operators on small tables: defined results of odd rows, and brute-force comparisons."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import boosting, common, edit_prints, html_text, language, mixing, near_join, packing, pii, quality_knn, quality_rules, token_counts, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
EN = "the quick brown fox jumps over the lazy dog and then it sleeps near the old river bank while birds sing "
DE = "der schnelle braune fuchs springt über den faulen hund und dann schläft er am alten flussufer während vögel singen "


def docs(spark, texts, langs=None, sources=None, ids=None):
    n = len(texts)
    rows = [((ids or range(n))[i], texts[i], (langs or [None] * n)[i], (sources or [None] * n)[i], len(texts[i] or "")) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


ODD = [None, "", "   \n\t ", "a", "12 34 !!", "word " * 3000, EN, EN, "x" * 40_000, "日本語 テキスト", "tie tie tie"]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD, ids=[*range(len(ODD) - 1), None])


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# Language mixtures


@pytest.fixture(scope="module")
def two_languages(spark):
    rng = np.random.default_rng(0)
    mixed = [(" ".join(rng.permutation(t.split())), name) for t, name in ((EN, "en"), (DE, "de")) for _ in range(20)]
    return language.fit(docs(spark, [t for t, _ in mixed], [n for _, n in mixed]))


def test_language_of_plain_and_mixed_texts(spark, two_languages):
    got = by_id(language.identify(docs(spark, [EN, DE, EN + DE, "42 ?!", None]), two_languages))
    assert [got[i].lang_pred for i in (0, 1, 3, 4)] == ["en", "de", "und", "und"]
    assert got[0].score == pytest.approx(1) and got[3].score == 0
    assert set(got[2].lang_mix) == {"en", "de"} and abs(got[2].score - 0.5) < 0.15


def test_language_odd_rows(odd, empty, two_languages):
    got = language.identify(odd.withColumn("score", F.lit("clash")), two_languages).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert dict(language.identify(odd, two_languages).dtypes)["score"] == "double"
    assert language.identify(empty, two_languages).count() == 0
    none = language.fit(empty)
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}


def test_mixture_shares_match_plain_expectation():
    rng = np.random.default_rng(3)
    score = rng.normal(0, 4, (30, 3)).astype(np.float32)
    share = language.mixtures(score, np.ones(30, np.float32), np.array([10, 20]))
    assert share.shape == (2, 3) and np.allclose(share.sum(axis=1), 1, atol=1e-5)


# Personal data


def plain_base(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return found


def test_base_spans_match_the_formats():
    rng = np.random.default_rng(5)
    letters = list("ab1.2@-+ 3(5)%é4")
    for _ in range(5000):
        text = "".join(rng.choice(letters, rng.integers(0, 50)))
        assert pii.base_spans(text) == plain_base(text), text
    for text in ("1.2.3.4.5.6.7.8.9", "a@b.c@d.e", "1.2.3.0000255", "4111 1111-11111111"):
        assert pii.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def detector(spark):
    rng = np.random.default_rng(1)
    texts = []
    for i in range(400):
        number = "".join(map(str, rng.integers(0, 10, 15)))
        card = next(number + c for c in "0123456789" if pii.luhn(number + c))
        words = EN.split()
        rng.shuffle(words)
        item = [f"u{i}.n@mail{i % 7}.example.com", f"{rng.integers(1, 255)}.{rng.integers(255)}.{rng.integers(255)}.9", card, f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"][i % 4]
        texts.append(" ".join([*words[:6], item, *words[6:]]))
    return pii.fit(docs(spark, texts))


def test_added_spans(detector):
    def added(text):
        return [(k, text[a:b]) for k, a, b in sorted(pii.added_spans(text, pii.base_spans(text), detector), key=lambda s: s[1])]

    assert added("to +1 (269) 555-3296 4524132264652876 and") == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]
    assert added("call 415-555-2671 now") == [("phone", "415-555-2671")]
    assert added("on 2021-03-04 at 12:30:45, page 12 345 678; look at noon. The end") == []
    assert added(EN) == []


def test_corpus_with_many_rewritten_spans(spark):
    rng = np.random.default_rng(2)
    texts, want = [], []
    for i in range(400):
        words = EN.split()
        rng.shuffle(words)
        name, n = f"u{i}.n", rng.integers(200, 999, 3)
        fixed = [f"{name}@mail{i % 7}.example.com", f"+1 ({n[0]}) 555-{n[1]}0"][i % 2]
        other = [f"{name} [at] mail{i % 5} [dot] example [dot] com", f"{n[0]}-{n[1]}-{n[2]}4"][i % 2]
        texts.append(" ".join([*words[:5], fixed, *words[5:12], "call", other, *words[12:17], "call", other, *words[17:]]))
        want.append(other)
    detector = pii.fit(docs(spark, texts))
    found = [[t[a:b] for _, a, b in pii.added_spans(t, pii.base_spans(t), detector)].count(w) for t, w in zip(texts, want, strict=True)]
    assert np.mean(found[::2]) > 1.8 and np.mean(found[1::2]) > 1.8
    assert pii.harmless("on 2021-03-04 it", ("phone", 3, 13)) and not pii.harmless("tel 2021-03-04", ("phone", 4, 14))
    assert not pii.harmless("no 612 345 678", ("phone", 3, 14)) and pii.harmless("12:30:45", ("ip", 0, 8))


def test_every_pair_of_at_and_dot_is_proposed_alone():
    for at in ("[at]", " [ at ] ", " (at) ", "{at}", "<at>", " at ", " At ", " AT ", " (At) ", " @ ", " @", "[@]"):
        for dot in (".", " dot ", " Dot ", " DOT ", "[dot]", " (dot) ", " [ Dot ] ", "{dot}", "[.]"):
            text = f"jane{at}example{dot}org"
            assert ("email", 0, len(text)) in pii.proposals(text, []), text
            assert ("email", 3, 3 + len(text)) in pii.proposals(f"so {text}; and", []), text


def test_find_and_redact(spark, odd, empty, detector):
    text = "mail é a.b@c.de, 10.0.0.1 and +1 (415) 555-2671"
    row = pii.find(docs(spark, [text]), detector).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 0, 1)
    expected = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(text))
    assert row.spans == expected and row.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
    clean = pii.redact(docs(spark, [text, None]), detector).orderBy("doc_id").collect()
    assert clean[0].text == "mail é <EMAIL>, <IP> and <PHONE>" and clean[0].n_chars == len(clean[0].text)
    assert clean[1].text is None
    assert pii.find(odd, None).count() == len(ODD) and pii.find(odd, detector).where("spans <> ''").count() == 0
    assert pii.fit(empty) is None and pii.redact(empty, None).count() == 0


# Token counts and packing

TOKEN_TEXTS = [*ODD, "a<|endoftext|>b  <|startoftext|>", "don't stop'll  \n\n x \t y", "Ünïcode İ ſ ²³ ¼ ½", "Σας ΣΑΣ", "é é", "a b\u0085c \x1c d", "😀 x"]


def test_token_counts_match_the_library(spark):
    table = docs(spark, TOKEN_TEXTS + TOKEN_TEXTS, ids=[*range(len(TOKEN_TEXTS))] * 2)
    tokenizer = tokens.load(BYTE)
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in TOKEN_TEXTS]
    for frequent in (0, 1000):
        got = token_counts.count_tokens(table, BYTE, frequent=frequent).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted((i, len((t or "").encode()), want[i]) for i, t in enumerate(TOKEN_TEXTS) for _ in (0, 1))


def test_token_counts_of_shared_and_null_ids(spark, empty):
    got = token_counts.count_tokens(docs(spark, ["a b", "a b c", "a b c"], ids=[7, 7, None]), BYTE).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 3), (7, 2), (7, 3)]
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_packing_places_every_token_once(spark, empty):
    tokenizer = tokens.load(WORD)
    texts = TOKEN_TEXTS + [EN * n for n in range(1, 60)] + ["same words here"] * 40
    table = docs(spark, texts)
    got = packing.pack_documents(table, WORD).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    used = {}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32 and r.start == 4096 * r.piece
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) == -(-sum(map(len, ids.values())) // 4096)
    assert packing.pack_documents(empty, WORD).count() == 0


def test_packing_ids_equal_the_library(monkeypatch):
    tokenizer = tokens.load(WORD)
    common = [chr(c) for c in range(0x250) if not tokens.UNCOMMON.search(chr(c))]
    draw = random.Random(5)
    pool = common + list(" .,!?'\n") * 20 + list("abcdest") * 20 + ["'s", "...", "\u65e5", "\u00a0", "<|endoftext|>"]
    texts = ["", " ", ".", " a ", "a.,b", "a\u0181b", "\u023a", *("".join(draw.choices(pool, k=draw.randrange(60))) for _ in range(2_000))]
    texts += [w + "." for w in common]  # a letter may have its small form outside the common ones
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "CACHE", 300)
    for size in (len(texts), 50):
        packing.encoder.cache_clear()
        encode = packing.encoder(WORD)
        assert [raw for i in range(0, len(texts), size) for raw in encode(texts[i : i + size])] == want
    packing.encoder.cache_clear()


def test_packing_looks_up_a_repeated_run_once(monkeypatch):
    looked = []
    of = packing.WordIds.of
    monkeypatch.setattr(packing.WordIds, "of", lambda self, runs: looked.extend(runs) or of(self, runs))
    packing.encoder.cache_clear()
    packing.encoder(WORD)(["same words, here. "] * 1_000)
    packing.encoder.cache_clear()
    assert sorted(w for w in looked if w) == [",", ".", "here", "same", "words"]


def test_two_replace_the_smallest_where_they_fit_better():
    counts = np.zeros(11, np.int64)
    counts[[7, 2, 1]] = 1
    counts[2] = 2
    used, gap = packing.fill(counts, [1, 2, 7], 10)
    assert gap == 0 and used == {7: 1, 2: 1, 1: 1}
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert packing.fill(counts, [2, 3, 6], 10) == ({6: 1, 2: 2}, 0)


def test_plan_covers_counts_without_overflow():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, 101)
    counts[0] = 0
    rows = packing.plan(counts, 100)
    seen = np.zeros(101, np.int64)
    for length in range(1, 101):
        own = rows[rows[:, 0] == length]
        if not len(own):
            continue
        ends = [*own[1:, 1], counts[length]]
        assert own[0, 1] == 0 and all(e > s for e, s in zip(ends, own[:, 1], strict=True))
        seen[length] = sum(e - s for e, s in zip(ends, own[:, 1], strict=True))
    assert (seen == counts).all()


# Quality


def test_rule_counts():
    text = "a b c a b c\nx # x\n\na b c a b c\nx # x"
    (n_words, chars, symbols, dups, repeats), _ = quality_rules.statistics(text)
    words = text.split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    assert (n_words, chars, symbols, dups, repeats) == (len(words), sum(map(len, words)), 2, 2, len(covered))
    assert quality_rules.statistics("a\xa0b\x1cc é")[0][:2] == [2, 6]


def quality_corpus(spark, n=300):
    rng = np.random.default_rng(4)
    texts, labels = [], []
    for i in range(n):
        words = [f"{w}{rng.integers(99)}" for w in rng.choice(EN.split(), 80)]
        good = bool(rng.integers(2))
        texts.append(" ".join(words if good else [w.upper() + "###" for w in words]))
        labels.append((i, int(good), 0))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_rules_learn_and_keep(spark, odd, empty):
    table, labels = quality_corpus(spark)
    rules = quality_rules.fit(table, labels)
    got = by_id(quality_rules.apply(table, rules).join(labels, "doc_id"))
    assert all(r.kept == bool(r.quality) for r in got.values())
    short = by_id(quality_rules.apply(odd.where("doc_id IS NOT NULL"), None))
    assert all(r.base_failed and not r.kept for r in short.values())
    assert quality_rules.fit(empty, labels) is None and quality_rules.apply(empty, rules).count() == 0


def test_neighbours_vote(spark, odd, empty):
    table, labels = quality_corpus(spark)
    voters = quality_knn.fit(table, labels.where("doc_id % 3 <> 0"))
    got = by_id(quality_knn.classify(table, voters).join(labels, "doc_id"))
    assert np.mean([r.predicted == r.quality for r in got.values()]) > 0.97
    scores = quality_knn.classify(odd, voters).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert all(r.score == 0 for r in scores if not (r.text or "").strip())
    assert quality_knn.fit(empty, labels) is None and quality_knn.classify(empty, None).count() == 0


def test_earlier_neighbours_win_ties():
    near = np.array([[1, 2, 2, 2, 3], [5, 5, 5, 5, 5], [1, 2, 3, 4, 5]], np.float32)
    assert [sorted(row) for row in quality_knn.nearest(near, 3).tolist()] == [[1, 2, 4], [0, 1, 2], [2, 3, 4]]


def test_copies_of_voters_vote_in_order():
    texts = [EN] * 40 + [DE] * 5
    labels = np.array([1.0] * quality_knn.NEIGHBOURS + [0.0] * (45 - quality_knn.NEIGHBOURS))
    voters = quality_knn.fit_vectors(quality_knn.vectorise(texts), labels)
    assert quality_knn.vote(quality_knn.vectorise([EN, EN]), voters).tolist() == [1.0, 1.0]


def test_blocked_votes_match_plain_cosines():
    rng = np.random.default_rng(6)
    x = quality_knn.vectorise([" ".join(rng.choice(EN.split(), 30)) for _ in range(60)])
    y = rng.integers(0, 2, 60)
    voters = quality_knn.fit_vectors(x[:50], y[:50])
    z = (x - voters.centre) @ voters.basis
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for row, score in zip(z[50:], quality_knn.vote(x[50:], voters), strict=True):
        near = voters.vectors @ row
        top = np.argsort(-near)[: quality_knn.NEIGHBOURS]
        weight = np.clip(near[top], 1e-6, 1) ** quality_knn.SHARPNESS
        assert score == pytest.approx((weight * voters.labels[top]).sum() / weight.sum(), rel=1e-4)


def test_boosted_trees_are_monotone_where_asked():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(0, 0.5, 2000) > 0).astype(float)
    trees = boosting.fit(x, y, {0: 1, 2: -1})
    assert np.mean((trees.score(x) > 0.5) == y) > 0.8
    for f, sign in ((0, 1), (2, -1)):
        probe = np.repeat(rng.normal(size=(40, 3)), 50, axis=0)
        probe[:, f] = np.tile(np.linspace(-3, 3, 50), 40)
        assert (sign * np.diff(trees.score(probe).reshape(40, 50), axis=1) >= -1e-12).all()


# Near-duplicate join


def plain_links(texts, threshold=0.8, width=5):
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        n = min(width, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    links, root = [0] * len(texts), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return links, [top(i) for i in range(len(texts))]


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [*ODD]
    for _ in range(12):
        base = [f"w{rng.integers(3000)}" for _ in range(rng.integers(6, 300))]
        for _ in range(rng.integers(1, 14)):
            copy = list(base)
            for _ in range(rng.integers(0, 1 + len(base) // 25)):
                copy[rng.integers(len(copy))] = f"n{rng.integers(9999)}"
            texts.append(" ".join(copy))
    table = docs(spark, texts)
    links, root = plain_links(texts)
    for block in (4, 512):  # small blocks spread one group over many units
        got = by_id(near_join.link(table, block=block), "id")
        assert [got[i].n_links for i in range(len(texts))] == links
        assert [got[i].class_id for i in range(len(texts))] == root
    kept = {r.doc_id for r in near_join.first_of_each(table).collect()}
    assert kept == {i for i, r in enumerate(root) if r == i}


def test_join_of_repeated_rows_and_no_rows(spark, empty):
    table = docs(spark, [EN, EN, EN, DE], ids=[3, 3, None, 5]).withColumn("rep", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted((r.id is None, r.id or 0, r.class_id, r.n_links) for r in near_join.link(table).collect())
    assert got == [(False, 3, 3, 2), (False, 3, 3, 2), (False, 5, 5, 0), (True, 0, 3, 2)]
    kept = near_join.first_of_each(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5]
    assert near_join.link(empty).count() == 0 and near_join.first_of_each(empty).count() == 0


def test_prefix_depth_reaches_the_target():
    depth = near_join.depth_for(0.8, near_join.TREES, near_join.DEPTH, near_join.TARGET_RECALL)
    recall = lambda d: 1 - (1 - 0.8**d) ** near_join.TREES
    assert recall(depth) >= near_join.TARGET_RECALL > recall(depth + 1)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("900", "901")], "u string, v string")
    got = {r.node: r.root for r in near_join.components(edges).collect()}
    assert got == {f"{i:03}": "000" for i in range(41)} | {"900": "900", "901": "900"}


# Edit fingerprints


def test_fingerprints_follow_ids(spark, empty, monkeypatch):
    monkeypatch.setattr(edit_prints, "ROWS_PER_RANGE", 7)
    rng = np.random.default_rng(9)
    texts = [*ODD, *(" ".join(rng.choice(EN.split(), rng.integers(1, 90))) for _ in range(60))]
    order = rng.permutation(len(texts))
    got = by_id(edit_prints.fingerprints(docs(spark, [texts[i] for i in order], ids=[int(i) for i in order])))
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1
    assert got[6].fingerprint == got[7].fingerprint and got[6].near_next == 1
    assert got[0].fingerprint == got[1].fingerprint
    assert np.mean([got[i].near_edited for i in range(20, 60)]) > np.mean([got[i].near_next for i in range(20, 60)]) + 0.2
    assert edit_prints.fingerprints(empty).count() == 0


def test_walk_matches_one_character_at_a_time():
    walker = edit_prints.Walker()
    texts = [edit_prints.points(t) for t in ("", "é", EN, "x" * 500)]
    for text, places in zip(texts, walker.walk(texts, [0, 3, 5, 0]), strict=True):
        at = int(places[0])
        for char, place in zip(text, places[1:], strict=True):
            row = ((int(char) * 0x9E3779B1) & 0xFFFFFFFF) >> 24
            at += int(walker.table[row * edit_prints.PERIOD + at % edit_prints.PERIOD])
            assert at == place


def test_bands_bring_near_texts_together(spark):
    rng = np.random.default_rng(10)
    base = " ".join(f"w{rng.integers(500)}" for _ in range(300))
    texts = [base, base[:700] + "?" + base[700:], " ".join(f"v{rng.integers(500)}" for _ in range(300)), base]
    prints = edit_prints.fingerprints(docs(spark, texts))
    got = by_id(edit_prints.near_leaders(prints))
    assert got[3].leader == 0 and 2 not in got


def test_near_classes_match_brute_force(spark, empty, monkeypatch):
    monkeypatch.setattr(edit_prints, "BLOCK", 5)
    rng = np.random.default_rng(21)
    sampler, walker = edit_prints.Sampler(), edit_prints.Walker()
    texts = [None, "", "a"]
    for size in (40, 256, 512, 1030, 2090):  # walked lengths on both sides of powers of two
        for _ in range(8):
            base = "".join(rng.choice(list("abcdefgh "), size + rng.integers(0, 12)))
            texts += [base, base]
            for edits in (1, 1, 1, 1, 2, 3):
                t = base
                for _ in range(edits):
                    at = int(rng.integers(len(t)))
                    t = t[:at] + "?!"[: int(rng.integers(0, 3))] + t[at + int(rng.integers(0, 3)) :]
                texts.append(t)
    points = [edit_prints.points(t or "") for t in texts]
    prints = [sampler.fingerprint(c, w) for c, w in zip(points, walker.walk(points, [0] * len(points)), strict=True)]
    alike = np.array([[sampler.likeness(a, b) for b in prints] for a in prints])
    assert np.allclose(np.where(alike == 1, 1, sampler.all_likeness(prints)), alike)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike[i, j] >= edit_prints.LIKE]
    spans = {(len(bin(int(prints[i].split(":")[0], 16))), len(bin(int(prints[j].split(":")[0], 16)))) for i, j in pairs}
    assert any(a != b for a, b in spans)  # some pairs lie on two sides of a power of two
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    got = by_id(edit_prints.near_classes(edit_prints.fingerprints(docs(spark, texts))))
    assert np.mean([got[i].near_class == got[j].near_class for i, j in pairs]) >= edit_prints.RECALL
    assert all(root[i] == root[r.near_class] for i, r in got.items()) and len(got) == len(texts)
    assert edit_prints.near_classes(edit_prints.fingerprints(empty)).count() == 0


def test_bands_reach_their_recall_on_pairs_at_the_threshold():
    rng = np.random.default_rng(22)
    sampler = edit_prints.Sampler()
    count, reach = edit_prints.banding(edit_prints.LIKE)
    met = []
    for length in rng.integers(150, 20_000, 400).tolist():
        bits = rng.integers(0, 2, len(sampler.upto(length)), dtype=np.uint8)
        other = np.where(rng.random(len(bits)) < 0.1, 1 - bits, bits)  # a likeness of 0.8
        keys = [set(sampler.bands([f"{n:x}:{np.packbits(b).tobytes().hex()}"], count, reach)[1].tolist()) for n, b in ((length, bits), (int(length * 0.98), other))]
        met.append(bool(keys[0] & keys[1]))
    assert np.mean(met) >= edit_prints.RECALL


# Mixing


def test_mixing_follows_targets(spark, empty):
    rng = np.random.default_rng(11)
    texts = [" ".join(["w"] * int(rng.integers(0, 40))) for _ in range(400)]
    sources = [["a", "b", "c", "d", None][int(i)] for i in rng.choice(5, 400, p=[0.6, 0.2, 0.05, 0.1, 0.05])]
    table = docs(spark, [*texts, None, "x y"], sources=[*sources, "a", "tiny"], ids=[*range(401), None])
    got = mixing.mix(table, rows_per_range=20).collect()
    total = sum(r.size for r in got)
    assert sum(r.taken for r in got) <= total and all(r.taken in [k * r.size for k in range(4)] for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert own[0].source_size == sum(r.size for r in own) and own[0].target <= 3 * own[0].source_size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= 40 + 1e-6
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    again = mixing.mix(table.repartition(7), rows_per_range=20).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0


def test_targets_match_capping_round_by_round(spark):
    rng = np.random.default_rng(13)
    for _ in range(3):
        sizes = {f"s{i:02}": int(rng.integers(0, 10 ** rng.integers(1, 5))) for i in range(9)}
        weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
        free, want, left = set(sizes), {}, sum(sizes.values())
        while True:
            level = left / max(sum(weight[s] for s in free), 1)
            over = {s for s in free if weight[s] * level > 3 * sizes[s]}
            if not over:
                break
            want |= {s: 3.0 * sizes[s] for s in over}
            left -= sum(3 * sizes[s] for s in over)
            free -= over
        want |= {s: weight[s] * level for s in free}
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: r.target for r in got} == pytest.approx(want)


def test_mixing_keeps_clashing_columns_apart(spark):
    table = docs(spark, ["a b", "c"], sources=["s", "t"]).withColumn("size", F.lit("x")).withColumn("_h", F.lit(1))
    got = mixing.mix(table)
    assert dict(got.dtypes)["size"] == "bigint" and "_h" in got.columns


# Main text

PAGE = "<html><body><nav><a>m</a></nav><article><h1>T</h1><p>{}</p><div>Read more at our site</div></article><footer>f</footer></body></html>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>one<p>two <b>three</b>four<script>if(a<b){}</script>five", "one\ntwo threefour\nfive"),
        ("<article><p>a<article class='comment'>no</article><p>b", "a\nb"),
        ("<div title='a>b'>x</div><p", "x"),
        ("<body><header>H</header><main><h1>T</h1><p>a &lt;b&gt; &nbsp; c<br>d<ul><li>x<li>y</ul><aside>z</aside></main>", "T\na <b> c d\nx\ny"),
        ("<article><p>3<4 &amp; x</p><!-- <p>no</p> --></article>", "3<4 & x"),
        ("<article><div><div><p>deep</div></article><p>out", "deep"),
    ],
)
def test_main_text_of_a_page(page, text):
    assert html_text.main_text(html_text.read(page), frozenset()) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='layout no-sidebar'><article><p>text</p></article></div>", "text"),
        ("<div id='page-with-header'><article><section class='related-work'><p>text</p></section></article></div>", "text"),
        ("<div class='sidebar'><article><p>text</p></article></div>", "text"),
        ("<form><div class='banner'><main><p>text</p></main></div><div class='related-posts'>x</div></form>", "text"),
        ("<article><p>text</p><div class='left-sidebar'>x</div><div class='comment-list'>y</div><div class='ad'>z</div></article>", "text"),
        ("<article><p>text</p></article><div class='comments'><article><p>a longer comment than the text</p></article></div>", "text"),
        (f"<main><div>{'long text ' * 20}</div><article class='card'>teaser</article></main>", "long text " * 19 + "long text\nteaser"),
        (f"<body><div>{'long text ' * 20}</div><article class='card'>teaser</article></body>", "long text " * 19 + "long text\nteaser"),
    ],
)
def test_whole_names_and_sizes_choose_the_article(page, text):
    assert html_text.main_text(html_text.read(page), frozenset()) == text


def test_templates_recur_across_pages_of_a_host(spark):
    long = "words of this page only, enough to be most of it "
    rows = [(i, f"http://h.example/{i}", PAGE.format(long + str(i))) for i in range(30)]
    rows += [(100 + i, f"http://copy.example/{i}", PAGE.format(long)) for i in range(30)]  # copies are one page
    rows += [(200, None, None), (201, "http://h.example/x", ""), (202, "HTTP://H.example/y", PAGE.format(long + "y"))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = by_id(html_text.extract(table, keep=["page_id", "url"]), "page_id")
    assert got[3].text == f"T\n{long}3" and got[202].text == f"T\n{long}y"
    assert got[100].text == f"T\n{long.strip()}\nRead more at our site"
    assert got[200].text == "" and got[201].n_chars == 0
    assert html_text.extract(table.limit(0)).count() == 0


def test_templates_count_pages_whatever_the_host_holds(spark):
    long = "words of this page only, enough to be most of it "
    rare = "<article><p>{}</p><div>Section notice</div></article>"
    rows = [(i, "http://big.example/", rare.format(long + str(i)) if i < 5 else f"<article><p>{long}{i}</p></article>") for i in range(200)]
    rows += [(300 + i, "http://few.example/", rare.format(long + str(i))) for i in range(4)]
    rows += [(400, "http://big.example/", rare.format("short"))]  # the notice is more than half of this page
    got = by_id(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[2].text == f"{long}2" and got[150].text == f"{long}150"
    assert got[301].text == f"{long}1\nSection notice" and got[400].text == "short\nSection notice"


def test_repeated_paragraphs_stay_in_the_article(spark):
    rows = [(i, "http://h.example/", f"<article><p>line {i}</p><p>Said on every page.</p></article>") for i in range(20)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.where("text LIKE '%Said on every page.'").count() == 20


# Shared helpers


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10] * 10 + [None, ""]})
    parts = list(common.slices(batch, "text", 25))
    assert sum(p.num_rows for p in parts) == 12 and max(p.num_rows for p in parts[:-1]) <= 3


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    texts, langs, sources = [], [], []
    for i in range(120):
        words = rng.choice((EN if i % 3 else DE).split(), 60)
        texts.append(" ".join(words) + (f" write to user{i}@mail.example.com" if i % 5 == 0 else ""))
        langs.append("en" if i % 3 else "de")
        sources.append(f"s{i % 3}")
    texts += [texts[1], texts[2] + " end", "12 34", None]
    langs += ["en", "en", None, None]
    sources += ["s0"] * 4
    docs(spark, texts, langs, sources).write.parquet(str(tmp_path / "documents.parquet"))
    frames = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(common.stored(stage(spark, frames[-1], str(tmp_path))))
    kept, unique, clean, mixed, packed = frames[1:]
    assert {r.doc_id for r in kept.collect()} == set(range(122))
    links, root = plain_links(texts[:122])
    assert {r.doc_id for r in unique.collect()} == {i for i, r in enumerate(root) if r == i}
    assert clean.where("text LIKE '%@%'").count() == 0 and clean.where("text LIKE '%<EMAIL>%'").count() == 24
    sizes = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 3 and abs(sum(sizes[i] * n for i, n in counts.items()) - sum(sizes.values())) <= 70
    assert all(f.columns == frames[0].columns for f in frames[1:5])
    tokenizer = tokens.load(WORD)
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert packed.agg(F.sum("length")).first()[0] == want
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_trees_and_threshold_come_from_all_rows(spark):
    rng = np.random.default_rng(11)
    x = rng.random((30_000, len(quality_rules.FEATURES)))
    y = (x[:, 4] + rng.normal(0, 0.1, len(x)) > 0.5).astype(int)
    held = np.arange(len(x)) % 4 == 3
    rows = [(f.tolist(), int(v), bool(h)) for f, v, h in zip(x, y, held, strict=True)]
    table = spark.createDataFrame(rows, "features array<double>, y int, held boolean").repartition(5)
    rules = quality_rules.fit_table(table)
    score = rules.trees.score(x)
    assert rules.threshold == min(0.5, np.quantile(score[held & (y == 1)], 1 - quality_rules.GOOD_KEPT, method="lower"))
    monotone = {i: s for i, s in enumerate(quality_rules.FEATURES.values()) if s}
    plain = boosting.fit(x[~held], y[~held].astype(float), monotone)
    loss = lambda p: -np.mean(np.log(np.where(y[held] == 1, p[held], 1 - p[held])))
    assert loss(score) == pytest.approx(loss(plain.score(x)), rel=0.05)
    probe = np.repeat(x[:40], 50, axis=0)
    probe[:, 2] = np.tile(np.linspace(0, 1, 50), 40)
    assert (np.diff(rules.trees.score(probe).reshape(40, 50), axis=1) <= 1e-12).all()
    assert quality_rules.fit_table(table.repartition(2)).threshold == rules.threshold


def test_labels_meet_statistics_and_no_text_is_shuffled(spark, empty, monkeypatch):
    table, labels = quality_corpus(spark)
    plans = []
    kept = quality_rules.stored
    monkeypatch.setattr(quality_rules, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    rules = quality_rules.fit(table, labels)
    assert 0 <= plans[0].index("Join ") < plans[0].index("MapInArrow")
    plans.clear()
    once = quality_rules.fit_apply(table, labels, keep=["doc_id"])
    assert ["text#" in p for p in plans] == [True, False] and "Join " not in plans[0]
    twice = quality_rules.apply(table, rules, keep=["doc_id"])
    assert once.schema == twice.schema and by_id(once) == by_id(twice)
    assert quality_rules.fit_apply(empty, labels, keep=["lang"]).columns == quality_rules.apply(empty, None, keep=["lang"]).columns


def test_text_tasks_give_freed_memory_back_and_packing_takes_short_batches(spark, monkeypatch):
    freed, rows = [], []
    monkeypatch.setattr(common, "give_back", lambda: freed.append(len(rows)))
    task = common.tidy(iter)
    for batch in task([1, 2, 3]):
        rows.append(batch)
    assert rows == [1, 2, 3] and freed == [3]
    monkeypatch.undo()
    common.give_back()

    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.stored
    before = spark.conf.get(name)
    monkeypatch.setattr(packing, "stored", lambda df: (seen.append(int(df.sparkSession.conf.get(name))), write(df))[1])
    docs = spark.createDataFrame([(i, "one two three " * (i % 7)) for i in range(3 * common.BATCH_ROWS // 2)], "doc_id long, text string")
    found = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert found.count() == docs.count() and found.agg({"offset": "max"}).first()[0] < packing.CAPACITY
    assert seen == [common.BATCH_ROWS] and spark.conf.get(name) == before
    with pytest.raises(ZeroDivisionError), common.short_batches(spark):
        1 / 0  # noqa: B018
    assert spark.conf.get(name) == before
