"""Token counts without materialising ids.

The most frequent pre-tokens of a bounded sample form a table whose piece counts every task knows. All
other pre-tokens of a document leave as (pre-token, document, frequency) rows, meet by pre-token, are cut
into pieces once per distinct pre-token, and their counts return to the documents as sums. The table only
saves traffic; results do not depend on it.

Defined results: a null text is empty and has 0 tokens; documents that share an id and a text repeat their
row; documents that share an id only are counted apart; an empty table gives no rows; special strings in a
text count as the library counts them; other input columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, slices
from tidemark.llm.tokens import byte_pretokens, load, special_splitter

SAMPLE_DOCS = 20_000  # bound of the sample that the table of frequent pre-tokens comes from
FREQUENT = 300_000  # bound of that table, about 40 MB in a task
LIMIT = 512
ENCODE = 20_000


def piece_counts(tokenizer, pretokens: list[str]) -> list[int]:
    out = []
    for i in range(0, len(pretokens), ENCODE):
        out += [len(e) for e in tokenizer.encode_batch_fast(pretokens[i : i + ENCODE], add_special_tokens=False)]
    return out


def frequencies(tokenizer, cut, specials: dict[str, int], text: str) -> tuple[int, Counter]:
    """How many special strings a text has, and its other pre-tokens with their frequencies."""
    parts = cut(text)
    if len(parts) == 1:
        return 0, Counter(byte_pretokens(tokenizer, text))
    total: Counter = Counter()
    for part in parts[::2]:
        total.update(byte_pretokens(tokenizer, part))
    return len(parts) // 2, total


def frequent_pretokens(docs: DataFrame, path: str, text: str, key: str, sample: int, bound: int) -> dict[str, int]:
    """Piece counts of the pre-tokens found twice or more in the sample, the ``bound`` most frequent at most."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        cut, specials = special_splitter(tokenizer)
        for batch in batches:
            for part in slices(batch, text):
                found: Counter = Counter()
                for t in part.column(0).to_pylist():
                    found.update(frequencies(tokenizer, cut, specials, t)[1])
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pretoken", "n"])

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            counts = piece_counts(tokenizer, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["pretoken", "pieces"])

    rows = bounded_sample(docs.select(key, text).where(F.col(f"`{text}`").isNotNull()), key, sample, "pretokens")
    top = rows.select(text).mapInArrow(split, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    top = top.where("n > 1").orderBy(F.desc("n"), "pretoken").limit(bound).select("pretoken")
    table = top.mapInArrow(cut_pieces, "pretoken string, pieces int").toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", sample: int = SAMPLE_DOCS, frequent: int = FREQUENT
) -> DataFrame:
    """``key, n_bytes, n_tokens`` for every document, as the tokenizer file at ``path`` gives them."""
    known = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, path, text, key, sample, frequent))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        tokenizer = load(path)
        cut, specials = special_splitter(tokenizer)
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                size, sums, digests = [], [], []
                at, rest, times = [], [], []
                for d, t in enumerate(part.column(1).to_pylist()):
                    t = t or ""
                    raw = t.encode()
                    size.append(len(raw))
                    digests.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    total, found = frequencies(tokenizer, cut, specials, t)
                    for pretoken, n in found.items():
                        pieces = table.get(pretoken)
                        if pieces is None:
                            at.append(d)
                            rest.append(pretoken)
                            times.append(n)
                        else:
                            total += n * pieces
                    sums.append(total)
                ids, digest = part.column(0), pa.array(digests, pa.int64())
                places = pa.array([*range(len(size)), *at], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(places),
                        digest.take(places),
                        pa.array([None] * len(size) + rest, pa.string()),
                        pa.array(sums + times, pa.int64()),
                        pa.array(size + [None] * len(rest), pa.int64()),
                    ],
                    names=["id", "digest", "pretoken", "n", "n_bytes"],
                )

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by pre-token, so each distinct one is in one run.
        tokenizer = load(path)
        last, pieces = None, 0
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            words = coded.dictionary.to_pylist()
            fresh = [w for w in words if w != last]
            counts = dict(zip(fresh, piece_counts(tokenizer, fresh), strict=True))
            counts.setdefault(last, pieces)
            if words:
                last, pieces = words[-1], counts[words[-1]]
            factor = pc.fill_null(pa.array([counts[w] for w in words], pa.int64()).take(coded.indices), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pc.multiply(batch.column(3), factor), batch.column(4)], names=["id", "digest", "n", "n_bytes"]
            )

    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias(text)).mapInArrow(
        split, f"id {id_type}, digest long, pretoken string, n long, n_bytes long"
    )
    # A document's own row has no pre-token; it is dealt by its digest.
    dealt = rows.repartition(F.coalesce("pretoken", F.col("digest").cast("string"))).sortWithinPartitions("pretoken")
    summed = dealt.mapInArrow(cut_pieces, f"id {id_type}, digest long, n long, n_bytes long").groupBy("id", "digest")
    return (
        summed.agg(F.sum("n").alias("n"), F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("copies"))
        .select("*", F.explode(F.expr("array_repeat(0, int(copies))")).alias("_copy"))
        .selectExpr(f"id AS `{key}`", "n_bytes", "n div copies AS n_tokens")
    )
