"""Phrase collocations from Rabin-Karp fingerprints of n-grams.

Texts become numpy arrays of bytes in which one blank follows every word. A prefix polynomial over these
bytes gives the fingerprint of every n-gram by one subtraction. A task compares the occurrences of each
fingerprint in a block with the text of the first of them and emits (fingerprint, count, occurrence
pointer); a shuffle adds the counts up. Only fingerprints that are frequent are materialised: their pointers
are joined to the texts, and the words found there must have the fingerprint again. A fingerprint whose
occurrences disagree in a second, independent polynomial, or whose pointer fails, is a collision: its
phrases are counted anew from the texts themselves.

Words are counted first, then pairs of frequent words, then triples and quadruples of frequent pairs, since
no phrase is more frequent than its parts. The frequent fingerprints are known to tasks as a bitmap of fixed
size; a full bitmap only lets more n-grams into the shuffle, it never loses one.

Defined results: a null text is empty; a null language is ``und``; repeated rows count each; words are told
apart by their bytes after A-Z are lowered; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

LEAST = 30  # occurrences that make a phrase frequent
LONGEST = 4  # words
SHARE = 80  # percent of a phrase's occurrences inside a longer one that make it redundant
TOP = 2000
BLOCK = 1 << 20  # bytes of text whose n-grams are grouped at once
FILTER_BITS = 1 << 27  # of the bitmap of frequent fingerprints, 16 MB
SLICES = 16  # tasks that fill it
FULL = (1 << 64) - 1

# Separators of pieces and of words, as bytes.
SEPARATORS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(SEPARATORS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_WORD = re.compile(b"[" + re.escape(SEPARATORS + BLANKS) + b"]")


class Polynomial:
    """Prefix sums of byte values times powers of an odd base, modulo 2 to the 64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, FULL, 256, np.uint64, endpoint=True)
        base = int(rng.integers(0, FULL >> 4, dtype=np.uint64)) * 8 + 5
        self.bases = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers[0]) <= len(data):
            n = max(len(data) + 1, BLOCK + BLOCK // 4)
            self.powers = [np.concatenate([np.ones(1, np.uint64), np.full(n, b)]).cumprod() for b in self.bases]
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[0][: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of the stretches from ``start`` to ``end``, wherever they lie."""
        return (prefix[end] - prefix[start]) * self.powers[1][start]


@lru_cache(maxsize=4)
def polynomial(seed: int) -> Polynomial:
    return Polynomial(seed)


def mixed(h: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Spreads a polynomial's value and the seed of its language over all bits."""
    h = (h ^ seed) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def lang_seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def parse(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with one blank after each, the bounds of each word there, its place in ``raw``, and its piece."""
    data = np.frombuffer(raw, np.uint8)
    kind = KIND[data]
    word = kind == 0
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    size = end - start
    own_start = np.concatenate([[0], np.cumsum(size + 1)])[:-1].astype(np.int64)
    canon = np.full(int((size + 1).sum()), 32, np.uint8)
    to = np.ones(len(canon), bool)
    to[own_start + size] = False
    canon[to] = LOWER[data[word]]
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    return canon, np.stack([own_start, own_start + size]), start, piece


def same_bytes(padded: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``size`` bytes at ``a`` and at ``b`` are equal; eight bytes at a time."""
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    equal, left, step = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(left):
        mask = np.arange(8) < (size[left] - step)[:, None]
        differ = ((eight[a[left] + step] != eight[b[left] + step]) & mask).any(axis=1)
        equal[left[differ]] = False
        step += 8
        left = left[~differ & (size[left] > step)]
    return equal


def grouped(prints: np.ndarray, same) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal fingerprints whose texts are equal: their first members, sizes, and each member's group.

    ``same(members, firsts)`` compares texts. Members unlike the first of their fingerprint form groups of
    their own, round by round.
    """
    group = np.full(len(prints), -1)
    firsts, sizes = [], []
    rest = np.arange(len(prints))
    known = 0
    while len(rest):
        _, first, back, count = np.unique(prints[rest], return_index=True, return_inverse=True, return_counts=True)
        first = rest[first]
        alike = same(rest, first[back])
        group[rest[alike]] = known + back[alike]
        if not alike.all():
            count = np.bincount(back[alike], minlength=len(first))
        firsts.append(first)
        sizes.append(count)
        known += len(first)
        rest = rest[~alike]
    return np.concatenate([*firsts, np.zeros(0, int)]).astype(np.int64), np.concatenate([*sizes, np.zeros(0, int)]).astype(np.int64), group


def in_bitmap(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    bit = prints % np.uint64(len(bitmap) * 8)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


class Block:
    """The words of some raw bytes, their fingerprints, and the n-grams among them."""

    def __init__(self, raw: bytes, mask: int):
        self.raw, self.mask = raw, np.uint64(mask)
        self.canon, (self.start, self.end), self.place, self.piece = parse(raw)
        self.n = len(self.place)
        self.prefixes = [polynomial(seed).prefix(self.canon) for seed in (1, 2)]

    def prints(self, first: np.ndarray, n: int, seed: np.ndarray, which: int = 0) -> np.ndarray:
        found = mixed(polynomial(which + 1).between(self.prefixes[which], self.start[first], self.end[first + n - 1]), seed)
        return found if which else found & self.mask

    def same_words(self) -> np.ndarray:
        """A number for each word of the block, equal for equal words; texts decide."""
        padded = np.concatenate([self.canon, np.zeros(8, np.uint8)])
        size = self.end - self.start
        none = np.zeros(self.n, np.uint64)
        same = lambda a, b: (size[a] == size[b]) & same_bytes(padded, self.start[a], self.start[b], np.minimum(size[a], size[b]))
        return grouped(self.prints(np.arange(self.n), 1, none), same)[2]

    def inside(self, n: int, new: int) -> np.ndarray:
        """First words of the n-grams that lie in one piece and end with word ``new`` or a later one."""
        first = np.arange(max(0, new - n + 1), max(0, self.n - n + 1))
        return first[self.piece[first] == self.piece[first + n - 1]]


def blocks(texts: Sequence[bytes], block: int = BLOCK) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, int]]:
    """Cuts texts into blocks: raw bytes, the texts in them, the offset of each text's part, and the known words.

    Short texts share a block; a long one is cut between words, and each later block starts with the last
    ``LONGEST - 1`` words of the one before, which are known already.
    """
    held, which, at, size = [], [], [], 0
    for i, raw in enumerate(texts):
        if len(raw) > block:
            start, stop, known = 0, -1, 0
            while start < len(raw):
                found = NOT_WORD.search(raw, max(start + block, stop + 1))  # always past the last cut
                stop = found.start() if found else len(raw)
                yield raw[start:stop] + b"\n", np.array([i]), np.array([-start]), known
                if stop == len(raw):
                    break
                back = parse(raw[start:stop])[2][-(LONGEST - 1) :]
                known = len(back)
                start = start + int(back[0]) if known else stop
            continue
        if size + len(raw) > block and held:
            yield b"".join(held), np.array(which), np.array(at), 0
            held, which, at, size = [], [], [], 0
        held += [raw, b"\n"]
        which.append(i)
        at.append(size)
        size += len(raw) + 1
    if held:
        yield b"".join(held), np.array(which), np.array(at), 0


def grams(b: Block, words, first, n: int, owner, offset, seed, key):
    """(fingerprint, count, check, text key, spot) of the n-grams at ``first``, grouped by their texts.

    A spot is the place of the first word in its text, times eight, plus the number of words.
    """
    prints = b.prints(first, n, seed[owner[first]])

    def same(x, y):
        x, y = first[x], first[y]
        return np.logical_and.reduce([words[x + j] == words[y + j] for j in range(n)]) & (seed[owner[x]] == seed[owner[y]])

    at, count, _ = grouped(prints, same)
    head = first[at]
    return prints[at], count, b.prints(head, n, seed[owner[head]], 1), key[owner[head]], (b.place[head] - offset[owner[head]]) * 8 + n


def word_totals(b: Block, owner, seed, key, known: int):
    """The empty phrase of each language, counted once per word."""
    langs, back = np.unique(seed, return_inverse=True)
    count = np.bincount(back[owner[known:]], minlength=len(langs))
    none = mixed(np.zeros(len(langs), np.uint64), langs)
    first = np.array([np.flatnonzero(back == i)[0] for i in range(len(langs))])
    return none & b.mask, count, none, key[first], np.zeros(len(langs), np.int64)


def blocks_of(batches: Iterator[pa.RecordBatch], mask: int, block: int):
    """Blocks with words in (text, lang, doc) batches, and for each its words' owners and the owners' values."""
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column(1).to_pylist()
            seeds = np.array([lang_seed(g) for g in langs], np.uint64)
            keys = part.column(2).to_numpy()
            for raw, which, offset, known in blocks(part.column(0).to_pylist(), block):
                b = Block(raw, mask)
                if b.n:
                    yield b, np.searchsorted(offset, b.place, "right") - 1, offset, seeds[which], keys[which], [langs[i] for i in which], known


FIELDS = "fp long, a long, mark long, doc long, spot long"


def count_grams(texts: DataFrame, lengths: Sequence[int], part: int, bits: Broadcast | None, least: int, mask: int, block: int) -> DataFrame:
    """Fingerprints of n-grams with their counts and an occurrence, if frequent.

    With ``bits`` only n-grams count all of whose parts of ``part`` words are in that bitmap; without, the
    words of each language are counted as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for b, owner, offset, seed, key, _, known in blocks_of(batches, mask, block):
            words = b.same_words()
            found = [] if bits is not None else [word_totals(b, owner, seed, key, known)]
            if bits is not None:
                frequent = np.zeros(b.n, bool)
                first = b.inside(part, 0)
                frequent[first] = in_bitmap(bitmap, b.prints(first, part, seed[owner[first]]))
            for n in lengths:
                first = b.inside(n, known)
                if bits is not None:
                    first = first[np.logical_and.reduce([frequent[first + j] for j in range(n - part + 1)])]
                found.append(grams(b, words, first, n, owner, offset, seed, key))
            fp, a, mark, doc, spot = (np.concatenate(c) for c in zip(*found, strict=True))
            columns = [fp.view(np.int64), a.astype(np.int64), mark.view(np.int64), doc, spot.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fp", "a", "mark", "doc", "spot"])

    summed = texts.mapInArrow(run, FIELDS).groupBy("fp")
    return summed.agg(
        F.sum("a").alias("a"), F.min("mark").alias("low"), F.max("mark").alias("high"), F.min("doc").alias("doc"), F.min_by("spot", "doc").alias("spot")
    ).where(f"a >= {least} OR spot % 8 = 0")


def bitmap_of(prints: DataFrame, bits: int) -> Broadcast:
    """The column ``fp`` as a bitmap of fixed size, filled slice by slice."""
    width = bits // SLICES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for s in np.unique(at // width):
                place = at[at // width == s] % width
                np.bitwise_or.at(own.setdefault(int(s), np.zeros(width // 8, np.uint8)), place >> 3, (1 << (place & 7)).astype(np.uint8))
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([v.tobytes() for v in own.values()], pa.binary())], names=["part", "bits"])

    placed = prints.selectExpr(f"fp & {bits - 1}L AS bit").repartition(SLICES, F.expr(f"bit div {width}"))
    out = np.zeros((SLICES, width // 8), np.uint8)
    for row in placed.mapInArrow(fill, "part long, bits binary").collect():  # as large as the bitmap
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return prints.sparkSession.sparkContext.broadcast(out.tobytes())


def phrase_pattern(n: int) -> re.Pattern[bytes]:
    word, blank = b"[^" + re.escape(SEPARATORS + BLANKS) + b"]+", b"[" + re.escape(BLANKS) + b"]+"
    return re.compile(word + (blank + word) * (n - 1)) if n else re.compile(b"")


def text_at(raw: bytes, spot: int, patterns: Sequence[re.Pattern[bytes]]) -> bytes:
    """The phrase at a spot as it is counted, or nothing if no phrase of its length stands there."""
    found = patterns[spot % 8].match(raw, spot // 8)
    return b" ".join(found.group().translate(LOWER.tobytes()).replace(b"\t", b" ").split()) if found else b""


def materialise(texts: DataFrame, frequent: DataFrame, mask: int) -> DataFrame:
    """``fp, lang, phrase, a, sound`` of frequent fingerprints; not sound where texts and fingerprints disagree."""
    pointers = frequent.groupBy("doc").agg(F.collect_list(F.struct("fp", "a", "low", "high", "spot")).alias("spots"))
    wanted = texts.join(pointers.select("doc"), "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text"), F.first("lang").alias("lang"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [phrase_pattern(n) for n in range(LONGEST + 1)]
        for batch in batches:
            for raw, lang, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                phrases = [text_at(raw, p["spot"], patterns) for p in spots]
                size = np.array([p["spot"] % 8 for p in spots])
                again = np.zeros(len(spots), np.uint64)
                seed = np.array([lang_seed(lang)], np.uint64)
                b = Block(b"\n".join(phrases) + b"\n", mask)
                held = np.array([len(p.split(b" ")) if p else 0 for p in phrases])
                first = np.cumsum(held) - held
                for n in np.unique(size):
                    at = np.flatnonzero((size == n) & (held == n))
                    again[at] = b.prints(first[at], int(n), seed) if n else mixed(np.zeros(len(at), np.uint64), seed) & b.mask
                prints = np.array([p["fp"] for p in spots], np.int64)
                sound = (again.view(np.int64) == prints) & (held == size) & np.array([p["low"] == p["high"] for p in spots])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prints),
                        pa.array([lang] * len(spots), pa.string()),
                        pa.array([p.decode() for p in phrases], pa.string()),
                        pa.array([p["a"] for p in spots], pa.int64()),
                        pa.array(sound),
                    ],
                    names=["fp", "lang", "phrase", "a", "sound"],
                )

    return wanted.join(pointers, "doc").select("text", "lang", "spots").mapInArrow(look_up, "fp long, lang string, phrase string, a long, sound boolean")


def recount(texts: DataFrame, prints: DataFrame, least: int, mask: int, block: int, bits: int) -> DataFrame:
    """``lang, phrase, a`` of all phrases that have one of some fingerprints, counted from the texts."""
    known_bits = bitmap_of(prints, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(known_bits.value, np.uint8)
        patterns = [phrase_pattern(n) for n in range(LONGEST + 1)]
        for b, owner, offset, seed, key, langs, known in blocks_of(batches, mask, block):
            words = b.same_words()
            fp, count, _, _, _ = word_totals(b, owner, seed, key, known)
            names = dict(zip(seed.tolist(), langs, strict=True))
            total = [[int(v) for v in fp.view(np.int64)], [names[s] for s in np.unique(seed).tolist()], [""] * len(fp), count.tolist()]
            for n in range(1, LONGEST + 1):
                first = b.inside(n, known)
                first = first[in_bitmap(bitmap, b.prints(first, n, seed[owner[first]]))]
                # The occurrences are looked up in the block itself.
                fp, count, _, at, spot = grams(b, words, first, n, owner, np.zeros_like(offset), seed, np.arange(len(seed)))
                total[0] += fp.view(np.int64).tolist()
                total[1] += [langs[i] for i in at]
                total[2] += [text_at(b.raw, s, patterns).decode() for s in spot.tolist()]
                total[3] += count.tolist()
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(total, kinds, strict=True)], names=["fp", "lang", "phrase", "a"])

    rows = texts.mapInArrow(run, "fp long, lang string, phrase string, a long").join(prints, "fp", "left_semi")
    return rows.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(f"a >= {least} OR phrase = ''")


def frequent_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    print_bits: int = 64,
    block: int = BLOCK,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``lang, phrase, a``: all phrases of one to four words with ``least`` occurrences or more in their language.

    The empty phrase of each language counts its words. ``print_bits`` is the width of the fingerprints; few
    bits make collisions, which cost time and change nothing.
    """
    mask = (1 << print_bits) - 1
    own = docs.selectExpr(f"CAST(coalesce(`{text}`, '') AS BINARY) AS text", f"coalesce(`{lang}`, 'und') AS lang")
    texts = own.withColumn("doc", F.xxhash64("lang", "text"))
    words = stored(count_grams(texts, [1], 1, None, least, mask, block))
    pairs = stored(count_grams(texts, [2], 1, bitmap_of(words, filter_bits), least, mask, block))
    more = stored(count_grams(texts, range(3, LONGEST + 1), 2, bitmap_of(pairs, filter_bits), least, mask, block))
    frequent = words.unionByName(pairs).unionByName(more)
    found = stored(materialise(texts, frequent, mask))
    unsound = found.where("NOT sound").select("fp").distinct()
    sound = found.where("sound").select("lang", "phrase", "a")
    if unsound.isEmpty():
        return sound
    return stored(sound.unionByName(recount(texts, unsound, least, mask, block, filter_bits)).groupBy("lang", "phrase").agg(F.max("a").alias("a")))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP, **how) -> DataFrame:
    """The ``top`` phrases of each language by how exclusively their parts meet.

    Returns ``lang, rank, phrase, a, l, r, n, score``: ``score`` is a millionfold share of the occurrences of
    the two parts, at the cut where it is least; phrases of which ``share`` percent or more of the
    occurrences lie inside a longer candidate are left out. Ties go to the more frequent phrase, then to the
    bytes of the phrase.
    """
    phrases = frequent_phrases(docs, text, lang, least, **how)
    counted = phrases.where("phrase <> ''")
    totals = phrases.where("phrase = ''").selectExpr("lang", "a AS n")
    several = counted.selectExpr("lang", "phrase", "a", "split(phrase, ' ') AS words").where("size(words) > 1")
    cuts = several.selectExpr("lang", "phrase", "a", "words", "explode(sequence(1, size(words) - 1)) AS k").selectExpr(
        "lang", "phrase", "a", "k", "array_join(slice(words, 1, k), ' ') AS head", "array_join(slice(words, k + 1, size(words)), ' ') AS tail"
    )
    parts = cuts.join(counted.selectExpr("lang", "phrase AS head", "a AS l"), ["lang", "head"]).join(
        counted.selectExpr("lang", "phrase AS tail", "a AS r"), ["lang", "tail"]
    )
    exact = "CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"
    scored = parts.selectExpr("lang", "phrase", "a", f"struct({exact} AS score, k, l, r) AS cut").groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inner = several.where("size(words) > 2").selectExpr("lang", "a", "words", "explode(sequence(2, size(words) - 1)) AS m")
    inner = inner.selectExpr("lang", "a", "words", "m", "explode(sequence(1, size(words) - m + 1)) AS i")
    longer = inner.selectExpr("lang", "array_join(slice(words, i, m), ' ') AS phrase", "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    inside = f"100 * CAST(coalesce(longer, 0) AS DECIMAL(20,0)) >= {share} * CAST(a AS DECIMAL(20,0))"
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"NOT ({inside})")
    flat = kept.selectExpr("lang", "phrase", "a", "cut.l AS l", "cut.r AS r", "cut.score AS score")
    best = "ORDER BY score DESC, a DESC, phrase"
    few = flat.selectExpr("*", f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), 64) {best}) AS place").where(f"place <= {top}")
    ranked = few.selectExpr("*", f"CAST(row_number() OVER (PARTITION BY lang {best}) AS BIGINT) AS rank").where(f"rank <= {top}")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), words AS (
  SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM lists
), runs AS (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY lang, id ORDER BY i)
), grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM runs
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, j, h.a AS l, t.a AS r, (2000000::HUGEINT * c.a // (h.a::HUGEINT + t.a))::BIGINT AS score
  FROM candidates c JOIN (SELECT unnest([1, 2, 3]) AS j) ON j < c.k
  JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1 : j], ' ')
  JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[j + 1 : c.k], ' ')
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_phrases AS (
  SELECT c.lang, array_to_string(c.w[i : i + m - 1], ' ') AS phrase, max(c.a) AS longer
  FROM candidates c JOIN (SELECT unnest([2, 3]) AS m) ON m < c.k JOIN (SELECT unnest([1, 2, 3]) AS i) ON i + m - 1 <= c.k GROUP BY ALL
), kept AS (
  SELECT v.* FROM worst v LEFT JOIN inner_phrases p ON p.lang = v.lang AND p.phrase = v.phrase
  WHERE NOT coalesce(100::HUGEINT * p.longer >= 80::HUGEINT * v.a, false)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""
