"""Best-fit packing of token sequences, by best-two-fit.

A sequence is filled greedily with the longest pieces that fit; then its smallest piece gives way to two
unpacked pieces if together they fill the gap better. Pieces of one length are alike, so the packing is
decided on the counts per length: one filling is repeated for as many sequences as the counts allow. The
plan has at most a few fillings per length, whatever the number of documents; tasks then number the pieces
of each length and look up their places.

Defined results: a null text is empty and is one piece with the end id alone; repeated rows are packed
each; an empty table gives no rows; other columns are carried only when asked for.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import arrow_types, short_batches, slices, stored, tidy
from tidemark.llm.tokens import BYTE_LETTERS, STOP_IN_SYMBOLS, UNCOMMON, WORD_PATTERN, load, special_splitter

CAPACITY = 4096
END_ID = 1
ROWS_PER_RANGE = 50_000
CACHE = 100_000  # words and runs, about 20 MB that a Python worker keeps after its tasks
PART_BYTES = 2 << 20  # text whose runs a task holds at once


class WordIds:
    """Ids of pre-tokens as little-endian bytes; new ones are encoded in batches, and the cache is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.ids: dict[str, bytes] = {}
        self.tokenizer = load(path)
        vocabulary, suffix = self.tokenizer.get_vocab(False), self.tokenizer.model.end_of_word_suffix
        self.bare = None
        if suffix and "ByteLevel" in repr(self.tokenizer.pre_tokenizer):
            # With a word-end suffix many words can be encoded as one text and told apart by their last ids. They are
            # pre-tokens already, so only blanks need to be looked for; both tokenizers share one model.
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def of(self, runs: list[str]) -> list[bytes]:
        """Ids of different runs without blanks; a run is one pre-token or several side by side."""
        known = self.ids
        new = [run for run in runs if run not in known]
        parts = {run: WORD_PATTERN.findall(run) for run in new if not run.isalpha()}
        inside = set().union(*parts.values())
        words = list(set(new).difference(parts).union(inside.difference(known)))
        if len(known) + len(words) + len(parts) > CACHE:
            kept = {w: known[w] for w in (*runs, *inside) if w in known}
            known.clear()
            known.update(kept)
        for i in range(0, len(words), 20_000):
            known.update(self._encode(words[i : i + 20_000]))
        for run, found in parts.items():
            if len(found) != 1:
                known[run] = b"".join(map(known.__getitem__, found))
        return list(map(known.__getitem__, runs))

    def _encode(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        if self.bare is not None:
            text = BYTE_LETTERS[np.frombuffer(" ".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(words):
                raw = ids.tobytes()
                bounds = (4 * last).tolist()
                return zip(words, [raw[a:b] for a, b in pairwise([0, *bounds])], strict=True)
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return zip(words, (np.array(e.ids, "<u4").tobytes() for e in found), strict=True)


@lru_cache(maxsize=1)
def encoder(path: str):
    """A function from texts to their ids as bytes, equal to the library's, without added special tokens.

    It lives as long as the Python worker, so the tasks that a worker runs share the words it has met.
    """
    known = WordIds(path)
    cut, _ = special_splitter(known.tokenizer)

    def common(texts: list[str]) -> Iterator[bytes]:
        # Blanks end every pre-token and have no ids themselves. Each different run is looked up once.
        parted = [t if STOP_IN_SYMBOLS.search(t) else t.replace(",", " ,").replace(".", " .") for t in texts]
        runs = pc.ascii_split_whitespace(pa.array(parted, pa.large_string()))
        coded = runs.flatten().dictionary_encode()
        ids = known.of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, run = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[run])])
        found = np.frombuffer(b"".join(ids), "<u4")[np.repeat(starts[run] - ends[:-1], sizes[run]) + np.arange(ends[-1])]
        bounds = ends[runs.offsets.to_numpy()].tolist()
        return (found[a:b].tobytes() for a, b in pairwise(bounds))

    def encode(texts: list[str]) -> list[bytes]:
        lower = [t.lower() for t in texts]
        apart = [UNCOMMON.search(low) is not None or len(cut(t)) > 1 for low, t in zip(lower, texts, strict=True)]
        whole = iter(known.tokenizer.encode_batch([t for t, own in zip(texts, apart, strict=True) if own], add_special_tokens=False))
        others = common([low for low, own in zip(lower, apart, strict=True) if not own])
        return [np.array(next(whole).ids, "<u4").tobytes() if own else next(others) for own in apart]

    return encode


def to_pieces(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep: list[str] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """``keep`` columns and ``piece, start, length, ids_crc32`` (and ``ids``) for every piece of every document."""
    keep = [key] if keep is None else keep
    fields = "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    added = StructType.fromDDL(fields)
    passed = list(dict.fromkeys([*keep, text]))
    kinds = arrow_types(added)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                rows, out = [], {n: [] for n in added.fieldNames()}
                ids = encode([t or "" for t in part.column(passed.index(text)).to_pylist()])
                for d, raw in enumerate(ids):
                    raw += end
                    for i in range(0, len(raw) // 4, capacity):
                        own = raw[4 * i : 4 * (i + capacity)]
                        rows.append(d)
                        out["piece"].append(i // capacity)
                        out["start"].append(i)
                        out["length"].append(len(own) // 4)
                        out["ids_crc32"].append(zlib.crc32(own))
                        if with_ids:
                            out["ids"].append(np.frombuffer(own, "<u4").astype(np.int32))
                places = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(passed.index(c)).take(places) for c in keep] + [pa.array(out[n], kinds[n]) for n in out], names=[*keep, *out]
                )

    schema = StructType([docs.schema[c] for c in keep] + list(added.fields))
    return docs.select(*[F.col(f"`{c}`") for c in passed]).mapInArrow(tidy(run), schema)


def fill(counts: np.ndarray, have: list[int], capacity: int) -> tuple[dict[int, int], int]:
    """One filling from the unpacked pieces (``counts`` per length, ``have``: lengths left): uses and gap."""
    used: dict[int, int] = {}
    gap = capacity
    while gap:
        i = bisect_right(have, gap) - 1
        while i >= 0 and counts[have[i]] == used.get(have[i], 0):
            i -= 1
        if i < 0:
            break
        times = min(gap // have[i], int(counts[have[i]]) - used.get(have[i], 0))
        used[have[i]] = used.get(have[i], 0) + times
        gap -= times * have[i]
    if gap and used:
        # Two unpacked pieces instead of the smallest one, where they leave less of the sequence empty.
        small = min(used)
        left = np.array([counts[x] - used.get(x, 0) + (x == small) for x in have])
        lengths = np.array(have)[left > 0]
        left = left[left > 0]
        room = gap + small
        other = np.searchsorted(lengths, room - lengths, side="right") - 1
        index = np.arange(len(lengths))
        other = np.where((other == index) & (left < 2), other - 1, other)
        fits = other >= 0
        both = np.where(fits, lengths + lengths[np.maximum(other, 0)], 0)
        best = int(both.argmax())
        if both[best] > small:
            used[small] -= 1
            for x in (int(lengths[best]), int(lengths[other[best]])):
                used[x] = used.get(x, 0) + 1
            gap = room - int(both[best])
    return {x: n for x, n in used.items() if n}, gap


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows ``length, first rank, first sequence, pieces per sequence, offset`` sorted by length and rank."""
    counts = counts.astype(np.int64).copy()
    have = np.flatnonzero(counts).tolist()
    rank = np.zeros(len(counts), np.int64)
    rows, sequence = [], 0
    while have:
        used, _ = fill(counts, have, capacity)
        times = min(int(counts[x]) // n for x, n in used.items())
        offset = 0
        for x in sorted(used, reverse=True):
            rows.append((x, rank[x], sequence, used[x], offset))
            offset += x * used[x]
            rank[x] += used[x] * times
            counts[x] -= used[x] * times
            if not counts[x]:
                have.remove(x)
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; ``order`` lists columns that tell pieces of one length apart."""
    with short_batches(pieces.sparkSession):
        pieces = stored(pieces)
    lengths = pieces.groupBy("length").count().toArrow()  # one row per length
    counts = np.zeros(capacity + 1, np.int64)
    counts[lengths.column("length").to_numpy()] = lengths.column("count").to_numpy()
    sent = pieces.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    parts = max(1, -(-int(counts.max()) // rows_per_range))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(parts)))
    by = ", ".join(f"`{c}`" for c in order)
    before = salted.groupBy("length", "_salt").count().selectExpr(
        "length AS _l", "_salt AS _s", "coalesce(sum(count) OVER (PARTITION BY length ORDER BY _salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before"
    )
    ranked = (
        salted.selectExpr("*", f"row_number() OVER (PARTITION BY length, _salt ORDER BY {by}) AS _rn")
        .join(before, F.expr("length = _l AND _salt = _s"))
        .selectExpr(*[f"`{c}`" for c in pieces.columns], "_before + _rn - 1 AS _rank")
    )
    schema = StructType([*pieces.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    at = pieces.columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        firsts = rows if len(rows) else np.zeros((1, 5), np.int64)
        code = (firsts[:, 0] << 40) + firsts[:, 1]
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = firsts[np.searchsorted(code, (length << 40) + rank, side="right") - 1]
            since, per = rank - row[:, 1], row[:, 3]
            new = [pa.array(row[:, 2] + since // per), pa.array(row[:, 4] + since % per * length)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + new, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    return pack(to_pieces(docs, path, key, text, capacity), [key, "piece", "start", "ids_crc32"], capacity)
