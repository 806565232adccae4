"""Document fingerprints by randomised edit embedding, compared with the text that follows.

A random walk shared by all documents copies each character a random number of times, so that texts a few
edits apart soon walk in step again and edit distance turns into Hamming distance. Places sampled at every
scale of the walked text, one bit each, make the fingerprint: 128 places among the first 128, and 128 more
in each doubling after that. Agreeing bits, weighted by the stretch they stand for and freed of chance,
give a likeness from 0 to 1.

Near prints of the whole table meet in bands, one key per print and band. Every bit of a key is drawn by a
random order of all places that prints share: a print takes the first place of the order that lies in its
walked text. Two prints take the same place as often as their lengths allow, so a bit agrees as often as the
likeness says, whatever the lengths. A key has ``SHARED_BITS`` fewer bits than the table needs to number its
prints, so chance brings about 16 other prints to a band at every size of the table; ``banding`` gives the bands
for ``RECALL`` at ``LIKE`` with that width. Further bits of the same kind travel in the same number as the key and
drop what met by chance before any print is fetched. Members of a band are judged against its least one, and
all pairs of members that are still of different classes in blocks; links then join into classes.

Neighbours in id order meet without a global sort: documents fall into ranges of (id, hash of the text), each
range is sorted on its own, and the first document of the next range stands at its end. Texts travel compressed.

Defined results: a null text is empty; the empty fingerprint is like itself alone; ids are of any ordered type;
documents of one id are ordered by the hash of their text, a null id comes first; the only document follows itself; input columns beyond id and text
are not read; an empty table gives no rows. Whole texts are walked, however long. A class is named by its
least id other than null; equal fingerprints are one class, the empty ones too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored
from tidemark.llm.near_join import bounds, components, grouped

CLASSES = 256
PERIOD = 4096
BITS = 128
SEED = 77_003
ROWS_PER_RANGE = 2_000
MOST_RANGES = 20_000
SAMPLED_PER_RANGE = 20
ZSTD_LEVEL = 1
CHUNK_CHARS = 12 << 20
CELLS = 4 << 20
LIKE = 0.8
RECALL = 0.99
SLACK = 0.02  # a key's bits may differ this much more often than the likeness of two prints says
LEAST_WIDTH, MOST_WIDTH = 12, 34
SHARED_BITS = 4  # 2 ** this many prints share a band by chance
LONGEST = 2.0**40  # walked text that still draws new places
KEY_BITS = 54  # of a key and its check; the band stands above them
MISSED = 0.05  # of near prints that share a key, by its check; more bands make up for it
BLOCK = 512


def walk_table() -> np.ndarray:
    """Steps from place ``j`` (modulo the period) while a character of class ``c`` is copied, 1 at least."""
    stop = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8).astype(bool)
    stop[:, ::64] = True  # bounds a stay to 64 copies
    places = np.where(np.concatenate([stop, stop], axis=1), np.arange(2 * PERIOD), 4 * PERIOD)
    ahead = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    return (ahead - np.arange(PERIOD) + 1).astype(np.int32).ravel()


class Walker:
    """Walks many texts at once: the longest first, one character of each at a time."""

    def __init__(self):
        self.table = walk_table()

    @staticmethod
    def rows(points: np.ndarray) -> np.ndarray:
        return (((points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int32)) * PERIOD

    def walk(self, texts: list[np.ndarray], begin: list[int]) -> list[np.ndarray]:
        """Places after each character, from the given first places; ``out[0]`` is the first place."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            longest = len(texts[order[at]])
            part = order[at : at + max(1, CELLS // (longest + 1))]
            at += len(part)
            size = np.array([len(texts[i]) for i in part])
            codes = np.zeros((longest, len(part)), np.int32)
            for k, i in enumerate(part):
                codes[: size[k], k] = self.rows(texts[i])
            places = np.zeros((longest + 1, len(part)), np.int32)
            places[0] = [begin[i] for i in part]
            live = np.searchsorted(-size, -np.arange(longest), side="left")  # texts longer than each step
            index = np.empty(len(part), np.int32)
            step = np.empty(len(part), np.int32)
            table = self.table
            for s, n in enumerate(live.tolist()):
                now, where, gain = places[s, :n], index[:n], step[:n]
                np.bitwise_and(now, PERIOD - 1, out=where)
                where += codes[s, :n]
                table.take(where, out=gain, mode="clip")
                np.add(now, gain, out=places[s + 1, :n])
            for k, i in enumerate(part):
                out[i] = places[: size[k] + 1, k].copy()
        return out


class Sampler:
    """The sampled places of every scale, and the bits found there."""

    def __init__(self):
        self.places = np.arange(BITS, dtype=np.int64)
        self.drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def upto(self, length: int) -> np.ndarray:
        while len(self.places) == BITS or self.places[-1] < length:
            level = len(self.places) // BITS
            low = BITS << (level - 1)
            rng = np.random.default_rng(SEED + level)
            self.places = np.concatenate([self.places, low + np.sort(rng.choice(low, BITS, replace=False))])
        levels = 1
        while BITS << (levels - 1) < length:
            levels += 1
        return self.places[: levels * BITS]

    def fingerprint(self, points: np.ndarray, places: np.ndarray) -> str:
        length = int(places[-1])
        if not length:
            return "0:"
        sampled = self.upto(length)
        inside = sampled[: np.searchsorted(sampled, length)]
        found = points[np.searchsorted(places[1:], inside, side="right")].astype(np.uint64)
        code = found * np.uint64(0x9E3779B97F4A7C15) + inside.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bits = np.zeros(len(sampled), np.uint8)
        bits[: len(inside)] = code >> np.uint64(63)
        return f"{length:x}:{np.packbits(bits).tobytes().hex()}"

    def likeness(self, one: str, other: str) -> float:
        """Share of the longer walked text on which two fingerprints agree, freed of chance agreement."""
        if one == other:
            return 1.0
        (a, x), (b, y) = (p.split(":") for p in (one, other))
        short, long = sorted((int(a, 16), int(b, 16)))
        if not short:
            return 0.0
        sampled = self.upto(long)
        both = int(np.searchsorted(sampled, short))
        bits = [np.unpackbits(np.frombuffer(bytes.fromhex(h), np.uint8))[:both] for h in (x, y)]
        equal = np.zeros(len(sampled))
        equal[:both] = 2.0 * (bits[0] == bits[1]) - 1
        used = (sampled < long).reshape(-1, BITS).sum(axis=1)
        low = np.array([0] + [BITS << i for i in range(len(used) - 1)])
        high = np.minimum(np.array([BITS << i for i in range(len(used))]), long)
        share = equal.reshape(-1, BITS).sum(axis=1) / np.maximum(used, 1)
        weight = np.where(used > 0, high - low, 0)
        return float(min(1.0, max(0.0, (share * weight).sum() / weight.sum())))

    def records(self, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """``place, slot``: where a longer walked text gives a slot a new place, by place; the first lie below ``BITS``."""
        if slots not in self.drawn:
            rng = np.random.default_rng([SEED, slots])
            place = [rng.random(slots) * BITS]
            last = np.full(slots, float(BITS))
            while last.min() < LONGEST:
                # The first of a random order stays first up to y with probability last / y.
                last = last / (1 - rng.random(slots))
                place.append(last)
            place, slot = np.concatenate(place), np.tile(np.arange(slots), len(place))
            order = np.argsort(place, kind="stable")
            order = order[place[order] < LONGEST]
            self.drawn[slots] = place[order], slot[order]
        return self.drawn[slots]

    def bands(self, prints: list[str], bands: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of prints, their keys of ``width`` bits below the band's number, and the bits that check each."""
        length = np.array([int(p.split(":")[0], 16) for p in prints], np.int64)
        own = np.flatnonzero(length > 0)
        if not len(own):
            return own, own, own
        place, slot = self.records(bands * KEY_BITS)
        sampled = self.upto(int(length.max()))
        level = np.maximum(np.frexp(place / BITS)[1], 0)
        low = np.where(level > 0, BITS * 2.0 ** (level - 1), 0)
        index = level * BITS + ((place - low) * BITS / np.where(level > 0, low, BITS)).astype(np.int64)
        taken = np.zeros(bands * KEY_BITS, np.int64)
        code = np.zeros((len(prints), bands, 64), np.uint8)
        done = 0
        for n in np.unique(length[own]):
            upto = int(np.searchsorted(place, n))
            taken[slot[done:upto]] = index[done:upto]  # later places replace earlier ones
            done = upto
            pick = np.minimum(taken, np.searchsorted(sampled, n) - 1)
            for i in np.flatnonzero(length == n):
                bits = np.unpackbits(np.frombuffer(bytes.fromhex(prints[i].split(":")[1]), np.uint8))
                code[i, :, 64 - KEY_BITS :] = bits[pick].reshape(bands, KEY_BITS)
        whole = np.packbits(code[own], axis=2).view(">i8")[:, :, 0].astype(np.int64)
        checked = KEY_BITS - width
        keys = (whole >> checked) | (np.arange(bands, dtype=np.int64) << width)
        return np.repeat(own, bands), keys.ravel(), (whole & ((1 << checked) - 1)).ravel()

    def all_likeness(self, prints: list[str]) -> np.ndarray:
        """``likeness`` of all pairs of different prints, from products of their bits."""
        length = np.array([int(p.split(":")[0], 16) for p in prints], np.int64)
        sampled = self.upto(int(length.max()))
        levels = len(sampled) // BITS
        bits = np.zeros((len(prints), len(sampled)), np.float32)
        for row, p in zip(bits, prints, strict=True):
            own = np.unpackbits(np.frombuffer(bytes.fromhex(p.split(":")[1]), np.uint8))
            row[: len(own)] = 2.0 * own - 1
        inside = sampled[None, :] < length[:, None]
        bits *= inside
        used = inside.reshape(len(prints), levels, BITS).sum(axis=2)
        weight = np.where(used > 0, np.stack([stretches(levels, n) for n in length]), 0)
        each = weight / np.maximum(used, 1) / np.maximum(weight.sum(axis=1), 1)[:, None]
        longer = length[:, None] >= length[None, :]
        total = np.zeros((len(prints), len(prints)))
        for i in range(levels):
            part = bits[:, i * BITS : (i + 1) * BITS]
            total += (part @ part.T) * np.where(longer, each[:, None, i], each[None, :, i])
        return np.clip(total, 0.0, 1.0)


def stretches(levels: int, length: int) -> np.ndarray:
    """How much of a walked text each scale stands for."""
    low = np.array([0] + [BITS << i for i in range(levels - 1)])
    return np.maximum(0, np.minimum(np.array([BITS << i for i in range(levels)]), length) - low)


def banding(like: float, recall: float = RECALL, rows: int = 1 << 20) -> tuple[int, int]:
    """Bands that a pair ``like`` alike needs to share one with the given chance, and bits of a key, for a table of ``rows`` prints."""
    width = min(MOST_WIDTH, max(LEAST_WIDTH, math.ceil(math.log2(max(rows, 2))) - SHARED_BITS))
    met = (1 - MISSED) * (1 - min(0.5, (1 - like) / 2 + SLACK)) ** width
    return math.ceil(math.log(1 - recall) / math.log(1 - met)), width


def most_differing(like: float, bits: int) -> int:
    """Check bits in which a pair ``like`` alike differs at most, but for a share of ``MISSED``."""
    differ = min(0.5, (1 - like) / 2 + SLACK)
    total, k = (1 - differ) ** bits, 0
    while total < 1 - MISSED:
        k += 1
        total += math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k)
    return k


def with_mates(band: np.ndarray, check: np.ndarray, differ: int) -> np.ndarray:
    """Which members of bands (equal ``band`` stands together) have another one whose check is near theirs."""
    keep = np.zeros(len(band), bool)
    at = np.arange(len(band))
    step = 1
    while True:
        at = at[at + step < len(band)]
        at = at[band[at] == band[at + step]]
        if not len(at):
            return keep
        # Members further apart than a block are kept unseen; the prints decide.
        near = np.bitwise_count(check[at] ^ check[at + step]) <= differ if step < BLOCK else np.ones(len(at), bool)
        keep[at[near]] = keep[at[near] + step] = True
        if step == BLOCK:
            return keep
        step += 1


def banded(batches: Iterator[pa.RecordBatch], checked: int) -> Iterator[pa.Table]:
    """Whole bands of sorted ``key, rep``, with the band's own number in front."""

    def marked() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = batch.column(0).to_numpy() >> checked
            yield pa.RecordBatch.from_arrays([pa.array(band), *batch.columns], names=["band", "key", "rep"])

    return grouped(marked(), 1)


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def describe(texts: list[str], followers: list[int], walker: Walker, sampler: Sampler, count: int) -> dict[str, list]:
    """The result columns of the first ``count`` texts; ``followers`` gives the place of each one's next text."""
    code = [points(t) for t in texts]
    walked = walker.walk(code, [0] * len(texts))
    prints = [sampler.fingerprint(c, w) for c, w in zip(code, walked, strict=True)]
    # The edited text walks with its text until the edit.
    kept = [len(texts[i]) - len(texts[i]) // 2 for i in range(count)]
    tails = [code[followers[i]][: len(texts[i]) // 2] for i in range(count)]
    after = walker.walk(tails, [int(walked[i][kept[i]]) for i in range(count)])
    changed = [
        sampler.fingerprint(np.concatenate([code[i][: kept[i]], tails[i]]), np.concatenate([walked[i][: kept[i] + 1], after[i][1:]])) for i in range(count)
    ]
    return {
        "n_chars": [len(t) for t in texts[:count]],
        "edited_sha256": [hashlib.sha256(edited(texts[i], texts[followers[i]]).encode("utf-8", "surrogatepass")).hexdigest() for i in range(count)],
        "fingerprint": prints[:count],
        "edited_fingerprint": changed,
        "near_edited": [sampler.likeness(prints[i], changed[i]) for i in range(count)],
        "near_next": [sampler.likeness(prints[i], prints[followers[i]]) for i in range(count)],
    }


def range_cuts(rows: DataFrame, parts: int, n: int) -> list[tuple]:
    """About ``parts - 1`` pairs of id and hash that cut the rows evenly, from a sample by hash of bounded size."""
    grain = 1 << 30
    share = min(grain, int(parts * SAMPLED_PER_RANGE / n * grain) + 1)
    drawn = rows.where(F.pmod(F.xxhash64("id", "h", F.lit("range")), F.lit(grain)) < share).select(F.struct("id", "h").alias("at"))
    # Repeated rows share a place; the sample holds some SAMPLED_PER_RANGE * MOST_RANGES places at most.
    found = drawn.groupBy("at").count().agg(F.array_sort(F.collect_list(F.struct("at", "count"))).alias("all")).first()["all"]
    step, seen, cuts = sum(r["count"] for r in found) / parts, 0, []
    for r in found:
        if seen >= step * (len(cuts) + 1):
            cuts.append((r["at"]["id"], r["at"]["h"]))
        seen += r["count"]
    return cuts


def with_ranges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``bucket, ahead, id, h, text``: documents in ranges of id and hash, each followed by the next range's first (``ahead``)."""
    rows = docs.selectExpr(f"`{key}` AS id", f"xxhash64(`{text}`) AS h", f"coalesce(`{text}`, '') AS text")
    n = docs.count()
    parts = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    cuts = range_cuts(rows, parts, n) if parts > 1 else []
    if cuts:
        # Binary search for the number of cuts not above the row.
        steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
        ids = F.array(*[F.lit(c[0]) for c in cuts]).cast(f"array<{rows.schema['id'].dataType.simpleString()}>")
        hashes = F.lit([c[1] for c in cuts])

        def not_above(k):
            cut, own = F.try_element_at(ids, k), F.col("id")
            before = F.when(own.isNull(), False).otherwise(cut.isNull() | (cut < own))
            return (k <= len(cuts)) & (before | (cut.eqNullSafe(own) & (F.try_element_at(hashes, k) <= F.col("h"))))

        place = F.aggregate(F.lit(steps), F.lit(0), lambda low, step: F.when(not_above(low + step), low + step).otherwise(low))
    else:
        place = F.lit(0)
    rows = rows.withColumn("bucket", place)
    # One head per range; MOST_RANGES bounds them.
    heads = rows.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("_h"))
    ring = heads.selectExpr("_h.id AS _id", "_h.h AS _hash", "coalesce(lag(bucket) OVER (ORDER BY bucket), max(bucket) OVER ()) AS _to")
    first = rows.join(F.broadcast(ring), F.expr("id <=> _id AND h = _hash"))
    first = first.groupBy("_to").agg(F.min("id").alias("id"), F.min("h").alias("h"), F.min("text").alias("text"))
    return rows.select("bucket", F.lit(0).alias("ahead"), "id", "h", "text").unionByName(first.selectExpr("_to AS bucket", "1 AS ahead", "id", "h", "text"))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by its compressed bytes."""
    press = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
    for batch in batches:
        for part in slices(batch, "text"):
            blob = pa.array([press.compress(t) for t in part.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], blob], names=part.schema.names)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and their likeness to it and to the next document's."""
    id_type = docs.schema[key].dataType.simpleString()
    ranged = with_ranges(docs, key, text).mapInArrow(packed, f"bucket int, ahead int, id {id_type}, h long, text binary")
    ranged = ranged.repartition("bucket").sortWithinPartitions("bucket", "ahead", "id", "h", "text").drop("h")
    columns = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, sampler = Walker(), Sampler()
        unpack = zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        chars = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            # Each row is followed by the next one of its range; what stands ahead is there only to be followed.
            order = [i for i, r in enumerate(rows[:-1]) if not r[1] and rows[i + 1][0] == r[0]]
            place = {i: p for p, i in enumerate(order)}
            texts = [rows[i][3] for i in order]
            followers = []
            for i in order:
                if i + 1 not in place:
                    place[i + 1] = len(texts)
                    texts.append(rows[i + 1][3])
                followers.append(place[i + 1])
            found = describe(texts, followers, walker, sampler, len(order))
            ids = pa.array([rows[i][2] for i in order], kind)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([ids] + [pa.array(v, t) for v, t in zip(found.values(), kinds, strict=True)], names=["id", *found])

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((*row[:3], unpack.decompress(row[3]).decode("utf-8", "surrogatepass")))
                chars += len(rows[-1][3])
                if chars > CHUNK_CHARS and len(rows) > 1:
                    yield done(rows)
                    rows, chars = rows[-1:], len(rows[-1][3])
        if len(rows) > 1:
            yield done(rows)

    return ranged.mapInArrow(run, f"id {id_type}, {columns}").withColumnRenamed("id", key)


def near_classes(prints: DataFrame, key: str = "doc_id", like: float = LIKE) -> DataFrame:
    """``prints`` with ``near_class``: the least id among the documents linked to it by prints ``like`` alike."""
    prints = stored(prints)
    reps = prints.groupBy("fingerprint").agg(F.min(f"`{key}`").alias("id"))
    reps = stored(reps.select(F.monotonically_increasing_id().alias("rep"), "id", "fingerprint"))
    count, width = banding(like, rows=reps.count())
    checked = KEY_BITS - width
    differ = most_differing(like, checked)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                at, keys, check = sampler.bands(part.column(1).to_pylist(), count, width)
                yield pa.RecordBatch.from_arrays([pa.array(keys << checked | check), part.column(0).take(pa.array(at))], names=["key", "rep"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in banded(batches, checked):
            band, rep = (table.column(c).to_numpy() for c in ("band", "rep"))
            keep = with_mates(band, table.column("key").to_numpy() & ((1 << checked) - 1), differ)
            band, rep = band[keep], rep[keep]
            if len(band):
                start = np.concatenate(([0], np.flatnonzero(band[1:] != band[:-1]) + 1))
                size = np.diff(np.append(start, len(band)))
                lead = np.repeat(np.minimum.reduceat(rep, start), size)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (band, rep, lead, np.repeat(size, size))], names=["band", "rep", "lead", "n"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            alike = [sampler.likeness(a, b) >= like - 1e-9 for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(alike, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for table in grouped(batches, 3):
            edge = bounds(table, 3)
            low, high, block, rep, known = (table.column(c).to_numpy() for c in ("low", "high", "block", "rep", "known"))
            texts = table.column("fingerprint").to_pylist()
            u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                new = np.triu(known[a:b, None] != known[None, a:b], 1)
                if low[a] != high[a]:
                    new &= block[a:b, None] != block[None, a:b]
                if new.any():
                    one, other = np.nonzero(new & (sampler.all_likeness(texts[a:b]) >= like - 1e-9))
                    # Links between the same two classes say the same.
                    _, first = np.unique(np.sort(np.stack([known[a + one], known[a + other]]), axis=0), axis=1, return_index=True)
                    u.append(rep[a + one[first]])
                    v.append(rep[a + other[first]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    keys = reps.select("rep", "fingerprint").mapInArrow(cut, "key long, rep long")
    sorted_ = keys.repartition(F.shiftright("key", checked)).sortWithinPartitions("key", "rep")
    members = stored(sorted_.mapInArrow(shared, "band long, rep long, lead long, n long"))
    texts = reps.select("rep", "fingerprint")
    pairs = members.where("rep <> lead").select("rep", "lead").distinct()
    both = pairs.join(texts, "rep").join(texts.selectExpr("rep AS lead", "fingerprint AS other"), "lead")
    stars = stored(both.select("rep", "lead", "fingerprint", "other").mapInArrow(verify, "u long, v long"))
    found = stored(components(stars))
    # Only pairs without the least member, and of classes not yet joined, are left.
    rest = members.where("rep <> lead AND n > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").selectExpr("band", "rep", "coalesce(root, rep) AS known")
    open_ = rest.groupBy("band").agg(F.count("*").alias("n"), F.min("known").alias("_l"), F.max("known").alias("_h")).where("_l <> _h")
    rest = stored(rest.join(open_.select("band", "n"), "band"))
    blocks = (
        rest.where(f"n > {BLOCK}")
        .selectExpr("*", f"int(ceil(n / {BLOCK})) AS _blocks")
        .selectExpr("*", "int(pmod(xxhash64(known, rep), _blocks)) AS block")
        .selectExpr("band", "rep", "known", "block", "explode(sequence(0, _blocks - 1)) AS _other")
        .selectExpr("band", "least(block, _other) AS low", "greatest(block, _other) AS high", "block", "rep", "known")
    )
    units = rest.where(f"n <= {BLOCK}").selectExpr("band", "0 AS low", "0 AS high", "0 AS block", "rep", "known").union(blocks)
    unit = ("band", "low", "high")
    judged = units.join(texts, "rep").select(*unit, "block", "rep", "known", "fingerprint").repartition(*unit).sortWithinPartitions(*unit)
    links = stars.select("u", "v").union(judged.mapInArrow(judge, "u long, v long"))
    roots = components(links).withColumnRenamed("node", "rep")
    named = stored(reps.join(roots, "rep", "left").selectExpr("fingerprint", "id", "coalesce(root, rep) AS root"))
    least = named.groupBy("root").agg(F.min("id").alias("near_class"))
    return prints.join(named.drop("id").join(least, "root").drop("root"), "fingerprint").select(*prints.columns, "near_class")


def near_leaders(prints: DataFrame, key: str = "doc_id", like: float = LIKE) -> DataFrame:
    """``key, leader``: the least document of the class, for all others of it."""
    found = near_classes(prints.select(key, "fingerprint"), key, like)
    return found.where(F.col("near_class") != F.col(f"`{key}`")).selectExpr(f"`{key}`", "near_class AS leader")
