"""Quality rules: boosted trees over document statistics, with monotonic constraints.

Fixed rules come first (too few words, too much repetition); documents that pass them are kept unless the
trees, fitted on all labelled documents but a held-back quarter, score them below a threshold chosen on that
quarter so that nearly all good documents stay.

Defined results: a null text has no words and fails the fixed rules, as an empty one does; repeated rows
repeat their result; without labels of both kinds the fixed rules decide alone; input columns with a
result's name are replaced. Whole texts are counted, however long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import boosting
from tidemark.llm.common import arrow_types, fold, stored, with_text_columns

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5))  # of other letters the first byte counts
MIN_WORDS = 50
HELD_BACK = 4  # one labelled document of so many, by a hash of its key, chooses the threshold
SCORE_CELLS = 1 << 16
GOOD_KEPT = 0.995  # share of held-back good documents that the threshold keeps

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, and the direction in which each may move the score (0: either).
FEATURES = {
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "distinct_word_share": 0,
    "mean_word_chars": 0,
    "log_words": 0,
    "end_mark_share": 0,
    "alpha_word_share": 1,
    "bang_share": -1,
    "letter_share": 0,
}
FIELDS = ", ".join(f"{c} long" for c in COUNTS)
VERDICTS = "base_failed boolean, score double, kept boolean"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows of ``window`` words that are found twice or more."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    hit = np.fromiter((seen[g] > 1 for g in grams), bool, len(grams))
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i : i + len(hit)] |= hit
    return int(covered.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts of one text, and the features derived from it."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six blanks
    n = len(words)
    having = lambda kinds: len(raw) - len(raw.translate(None, kinds))
    chars = len(text) - having(BLANKS.encode())
    symbols = having(SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper, letters, digits = having(UPPER), having(LETTERS), having(b"0123456789")
    share = 1 / max(n, 1)
    features = [
        symbols * share,
        dups / max(len(lines), 1),
        repeats * share,
        upper / max(letters, 1),
        digits / max(chars, 1),
        len(set(words)) * share,
        chars * share,
        float(np.log1p(n)),
        having(b".!?") * share,
        sum(map(bytes.isalpha, words)) * share,
        having(b"!") * share,
        letters / max(chars, 1),
    ]
    return [n, chars, symbols, dups, repeats], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


@dataclass
class Rules:
    trees: boosting.Trees
    threshold: float


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the counts and ``features`` (an array in the order of ``FEATURES``)."""

    def make():
        def count(texts: list[str]) -> dict:
            rows = [statistics(t) for t in texts]
            out = {c: [r[0][i] for r in rows] for i, c in enumerate(COUNTS)}
            return out | {"features": [r[1] for r in rows]}

        return count

    return with_text_columns(docs, make, f"{FIELDS}, features array<double>", text, keep)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Rules | None:
    """Trees from all labelled documents that pass the fixed rules; None unless both labels occur."""
    return fit_counted(with_statistics(docs, text, [key]), labels, key, label)


def fit_counted(counted: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Rules | None:
    """``fit`` from rows of ``with_statistics``: labels meet these, so no text is shuffled to them."""
    passing = counted.where(f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= 50 * n_words").select(key, "features")
    labelled = passing.join(labels.where(F.col(label).isin(0, 1)).select(key, label), key)
    held = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit("rules")), F.lit(HELD_BACK)) == HELD_BACK - 1
    return fit_table(stored(labelled.select("features", F.col(label).cast("int").alias("y"), held.alias("held"))))


def fit_table(table: DataFrame) -> Rules | None:
    """Rules from rows of ``features``, ``y`` (0 or 1) and ``held``."""
    n = {(r.held, r.y): r["count"] for r in table.groupBy("held", "y").count().collect()}
    if len({y for _, y in n}) < 2:
        return None
    good, bad = n.get((False, 1), 0), n.get((False, 0), 0)
    if not good + bad:
        return None
    monotone = {i: sign for i, sign in enumerate(FEATURES.values()) if sign}
    trees = boosting.fit_rows(table.where("NOT held"), "features", "y", good + bad, good, monotone, len(FEATURES))
    rank = int((1 - GOOD_KEPT) * (n.get((True, 1), 0) - 1))
    threshold = nth_score(table.where("held AND y = 1").select("features"), trees, rank) if (True, 1) in n else 0.0
    return Rules(trees, min(threshold, 0.5))


def nth_score(rows: DataFrame, trees: boosting.Trees, rank: int) -> float:
    """The score with ``rank`` others before it: its cell from the counts of all cells, then the scores of that cell."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(trees.score(x))], names=["score"])

    scores = rows.mapInArrow(score, "score double").selectExpr("score", f"CAST(score * {SCORE_CELLS} AS INT) AS cell")

    def place(counts: DataFrame, by: str) -> float:
        nonlocal rank
        for r in counts.groupBy(by).count().orderBy(by).collect():
            if rank < r["count"]:
                return r[by]
            rank -= r["count"]
        raise ValueError("fewer scores than the rank")

    return float(place(scores.where(F.col("cell") == place(scores, "cell")), "score"))


def verdicts(rules: Rules | None, n_words: list[int], n_repeat_words: list[int], features: np.ndarray) -> dict:
    """``base_failed``, ``score`` and ``kept`` of rows of statistics."""
    failed = list(map(base_failed, n_words, n_repeat_words))
    scores = rules.trees.score(features).tolist() if rules else [None] * len(failed)
    kept = [not f and (not rules or s >= rules.threshold) for f, s in zip(failed, scores, strict=True)]
    return {"base_failed": failed, "score": scores, "kept": kept}


def apply(docs: DataFrame, rules: Rules | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the counts, ``base_failed``, ``score`` (null without trees) and ``kept``."""
    sent = docs.sparkSession.sparkContext.broadcast(rules)

    def make():
        rules = sent.value

        def judge(texts: list[str]) -> dict:
            rows = [statistics(t) for t in texts]
            out = {c: [r[0][i] for r in rows] for i, c in enumerate(COUNTS)}
            return out | verdicts(rules, out["n_words"], out["n_repeat_words"], np.array([r[1] for r in rows]))

        return judge

    return with_text_columns(docs, make, f"{FIELDS}, {VERDICTS}", text, keep)


def apply_counted(counted: DataFrame, rules: Rules | None) -> DataFrame:
    """``apply`` to rows of ``with_statistics``, whose ``features`` are left out."""
    sent = counted.sparkSession.sparkContext.broadcast(rules)
    kept = [c for c in counted.columns if c != "features"]
    added = StructType.fromDDL(VERDICTS)
    kinds = arrow_types(added)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = sent.value
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            x = column["features"].flatten().to_numpy().reshape(-1, len(FEATURES))
            out = verdicts(rules, column["n_words"].to_pylist(), column["n_repeat_words"].to_pylist(), x)
            new = [pa.array(out[n], kinds[n], from_pandas=False) for n in added.names]
            yield pa.RecordBatch.from_arrays([column[c] for c in kept] + new, names=kept + added.names)

    return counted.mapInArrow(judge, StructType([counted.schema[c] for c in kept] + list(added.fields)))


def fit_apply(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """``apply`` of the rules ``fit`` finds on the same documents; each text is read once, and its statistics are stored."""
    passed = [c for c in (docs.columns if keep is None else keep) if c not in (*COUNTS, *StructType.fromDDL(VERDICTS).names, "features")]
    counted = stored(with_statistics(docs, text, list(dict.fromkeys([*passed, key]))))
    judged = apply_counted(counted, fit_counted(counted, labels, key, label))
    return judged if key in passed else judged.drop(key)


def held_out(key: str = "doc_id"):
    return fold(key, 5) == 0
