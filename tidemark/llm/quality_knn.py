"""Quality scores by nearest-neighbour voting in a latent space.

A text becomes a vector of byte-pair counts and a few document statistics; a truncated eigenbasis of a
bounded labelled sample turns it into a short latent vector. Every document is compared with all labelled
vectors, in blocks of exact cosine products, and its nearest neighbours vote with their similarity.

Defined results: a null text is empty; a text without a word scores 0, as does everything if no label is
given; of equally similar neighbours the earlier in key order counts; repeated rows repeat their score;
input columns with a result's name are replaced. Whole texts are used, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, with_text_columns

BUCKETS = 1024
STATISTICS = 6
WIDTH = 64
LABELLED = 8192  # bound of the labelled vectors, 2 MB to every task
NEIGHBOURS = 15
SHARPNESS = 8
BLOCK = 512
THRESHOLD = 0.3
UPPER = bytes(range(65, 91))
SYMBOLS = b"#*$%&|<>!@^~={}[]\\/"


@dataclass
class Voters:
    """Centre, spread and basis of the latent space, and the unit vectors and labels of the voters."""

    centre: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def vectorise(texts: list[str]) -> np.ndarray:
    """One row per text: log counts of hashed byte pairs, scaled to unit length, then document statistics."""
    out = np.zeros((len(texts), BUCKETS + STATISTICS), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        if not words:
            continue
        code = np.frombuffer(raw, np.uint8).astype(np.uint32)
        pairs = (code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)) >> np.uint32(22)
        counts = np.log1p(np.bincount(pairs, minlength=BUCKETS))
        row[:BUCKETS] = counts / max(float(np.sqrt(counts @ counts)), 1.0)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        having = lambda kinds: (len(raw) - len(raw.translate(None, kinds))) / len(raw)
        row[BUCKETS:] = (
            len(set(words)) / len(words),
            1 - len(set(lines)) / len(lines),
            having(UPPER),
            having(SYMBOLS),
            having(b"0123456789"),
            min(np.log1p(len(words)) / 12, 1),
        )
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", bound: int = LABELLED) -> Voters | None:
    """The latent space and its voters from labelled documents, ``bound`` of them at most; None without labels."""
    picked = bounded_sample(labels.where(F.col(label).isin(0, 1)).select(key, label), key, bound, "voters")

    def make():
        return lambda texts: {"vector": [row.tobytes() for row in vectorise(texts)]}

    table = with_text_columns(docs.select(key, text).join(picked, key), make, "vector binary", text, [key, label]).toArrow()
    x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(-1, BUCKETS + STATISTICS)
    order = np.argsort(table.column(key).to_numpy(), kind="stable")
    return fit_vectors(x[order], table.column(label).to_numpy()[order])


def fit_vectors(x: np.ndarray, labels: np.ndarray) -> Voters | None:
    known = x.any(axis=1)
    x, labels = x[known], labels[known]
    if not len(x):
        return None
    centre = x.mean(axis=0)
    spread = x - centre  # statistics lie between 0 and 1, as the length of the byte-pair part does
    _, basis = np.linalg.eigh(spread.T @ spread)
    basis = basis[:, ::-1][:, :WIDTH]
    return Voters(centre, basis.astype(np.float32), _unit(spread @ basis).astype(np.float32), labels.astype(np.float32))


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's ``k`` greatest values; of equal values the earlier places."""
    top = np.argpartition(near, -k, axis=1)[:, -k:]
    least = np.take_along_axis(near, top, axis=1).min(axis=1)
    for i in np.flatnonzero((near >= least[:, None]).sum(axis=1) > k):  # ties at the edge
        above, equal = np.flatnonzero(near[i] > least[i]), np.flatnonzero(near[i] == least[i])
        top[i] = np.concatenate([above, equal[: k - len(above)]])
    return top


def vote(x: np.ndarray, voters: Voters | None) -> np.ndarray:
    """Similarity-weighted mean label of each row's nearest voters; 0 for a row without words."""
    score = np.zeros(len(x))
    if voters is None:
        return score
    k = min(NEIGHBOURS, len(voters.labels))
    for i in range(0, len(x), BLOCK):
        block = x[i : i + BLOCK]
        # Rounded, so that copies of a voter tie in every block.
        near = np.round(_unit((block - voters.centre) @ voters.basis) @ voters.vectors.T, 5)
        top = nearest(near, k)
        weight = np.clip(np.take_along_axis(near, top, axis=1), 1e-6, 1).astype(float) ** SHARPNESS
        score[i : i + BLOCK] = (weight * voters.labels[top]).sum(axis=1) / weight.sum(axis=1)
    return np.where(x.any(axis=1), np.clip(score, 0, 1), 0.0)


def classify(docs: DataFrame, voters: Voters | None, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` and ``predicted`` (1 if the score reaches the threshold)."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def make():
        voters = sent.value

        def judge(texts: list[str]) -> dict:
            score = np.concatenate([vote(vectorise(texts[i : i + BLOCK]), voters) for i in range(0, len(texts), BLOCK)])
            return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

        return judge

    return with_text_columns(docs, make, "score double, predicted int", text, keep)
