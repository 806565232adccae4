"""Language identification by multilingual mixture inference.

A document is a bag of words, each drawn from one of the learned languages. The likelihood of a word
under a language comes from its character trigrams; expectation-maximisation estimates the document's
language proportions; languages leave the set while the penalised likelihood does not fall.

Defined results: a null text, a text without a letter and an empty training set give ``und`` and score
0; rows are never merged, so repeated rows repeat their result; a tie between languages goes to the
first by name; a clashing input column is replaced. Long texts are used whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, slices, tidy, with_text_columns

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
TRAIN_DOCS = 20_000  # bound of the labelled sample the trigram tables are learned from
SMOOTHING = 0.05
TEMPER = 1 / 3  # each character stands in three trigrams
PENALTY = 2.0  # nats for each language beyond the first, times log(1 + words)
STEPS = 8
PART_BYTES = 2 << 20  # text whose words a task holds at once
MAX_LANGUAGES = 1024  # the tables are sent to every task: 256 KB a language


@dataclass
class LanguageModel:
    """Trigram log probabilities, one row per hash bucket and one column per language."""

    languages: list[str]
    table: np.ndarray


def trigram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the trigrams of space-padded words, and where each word's trigrams start."""
    chars = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    inside = chars[1:-1] != 32
    mixed = chars[:-2] * np.uint64(0x9E3779B1) + chars[1:-1] * np.uint64(0x85EBCA77C2B2) + chars[2:] * np.uint64(0x27D4EB2F165667C5)
    mixed = mixed[inside]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words])[:-1])).astype(np.int64)
    return (mixed >> np.uint64(48)).astype(np.int64), starts


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", bound: int = TRAIN_DOCS) -> LanguageModel:
    """Learns trigram tables from the labelled rows of ``docs``, ``bound`` of them at most."""
    labelled = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = bounded_sample(labelled.select(key, text, lang), key, bound, "language")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                by: dict[str, Counter] = {}
                for t, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(name, Counter()).update(WORD.findall(t.lower()))
                for name, words in by.items():
                    if words:
                        at, _ = trigram_buckets(list(words))
                        times = np.repeat(np.fromiter(words.values(), float), [len(w) for w in words])
                        seen[name] = seen.get(name, 0) + np.bincount(at, times, BUCKETS)
        for name, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counted = rows.select(text, lang).mapInArrow(tidy(count), "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the tables sent to tasks are bounded to {MAX_LANGUAGES}")
    table = np.zeros((BUCKETS, len(languages)))
    place = {name: i for i, name in enumerate(languages)}
    table[found.column("bucket").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    table = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    return LanguageModel(languages, table)


def _expect(like: np.ndarray, times: np.ndarray, starts: np.ndarray, spread: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``steps`` rounds over all documents at once; returns proportions and the last sum of logs."""
    total = np.add.reduceat(times, starts)[:, None]
    for _ in range(steps):
        joint = like * share[spread]
        mass = joint.sum(axis=1)
        joint *= (times / mass)[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total
    mass = (like * share[spread]).sum(axis=1)
    return share, np.add.reduceat(times * np.log(mass), starts)


def mixtures(score: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Proportions per document. ``score``: log likelihoods of its distinct words, ``sizes``: words per document (1 at least).

    All languages start with equal shares. The least used language of a document is dropped while the
    log likelihood of the smaller set loses no more than the penalty of one language.
    """
    n_docs, n_langs = len(sizes), score.shape[1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    like = np.exp(score - score.max(axis=1, keepdims=True)) + np.float32(1e-30)
    share, fit_now = _expect(like, times, starts, np.repeat(np.arange(n_docs), sizes), np.full((n_docs, n_langs), 1 / n_langs, np.float32), STEPS)
    cost = PENALTY * np.log1p(np.add.reduceat(times, starts))
    busy = np.flatnonzero((share > 0).sum(axis=1) > 1)
    while len(busy):
        least = np.where(share[busy] > 0, share[busy], np.inf).argmin(axis=1)
        trial = share[busy]
        trial[np.arange(len(busy)), least] = 0
        trial /= trial.sum(axis=1, keepdims=True)
        rows = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in busy])
        first = np.concatenate(([0], np.cumsum(sizes[busy])[:-1])).astype(np.int64)
        trial, fit_then = _expect(like[rows], times[rows], first, np.repeat(np.arange(len(busy)), sizes[busy]), trial, STEPS // 2)
        better = fit_then + cost[busy] >= fit_now[busy]
        share[busy[better]], fit_now[busy[better]] = trial[better], fit_then[better]
        busy = busy[better]
        busy = busy[(share[busy] > 0).sum(axis=1) > 1]
    return share


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (its proportion) and ``lang_mix`` (all chosen languages with proportions)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        languages, table = sent.value.languages, sent.value.table

        def predict(texts: list[str]) -> dict:
            names, scores, mixes = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            ids: dict[str, int] = {}
            owner, sizes, at, times = [], [], [], []
            for d, t in enumerate(texts):
                words = Counter(WORD.findall(t.lower()))
                known = [w for w in words if w.isalpha() or any(map(str.isalpha, w))] if languages else []
                if known:
                    owner.append(d)
                    sizes.append(len(known))
                    at += [ids.setdefault(w, len(ids)) for w in known]
                    times += [words[w] for w in known]
            if owner:
                hit, starts = trigram_buckets(list(ids))
                score = np.add.reduceat(table[hit], starts, axis=0) * np.float32(TEMPER)
                share = mixtures(score[np.asarray(at)], np.asarray(times, np.float32), np.asarray(sizes))
                for d, row in zip(owner, share.tolist(), strict=True):
                    best = max(range(len(languages)), key=lambda i: (row[i], -i))
                    names[d], scores[d] = languages[best], min(1.0, row[best])
                    mixes[d] = [(languages[i], x) for i, x in enumerate(row) if x > 0]
            return {"lang_pred": names, "score": scores, "lang_mix": mixes}

        return predict

    return with_text_columns(docs, make, "lang_pred string, score double, lang_mix map<string,double>", text, keep, PART_BYTES)
