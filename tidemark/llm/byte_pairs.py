"""Byte-level BPE encoding and decoding with a rank file, equal to merging by ranks, in linear time.

Tokens are mapped byte for byte to Latin-1 characters, so an Aho-Corasick automaton finds every token that
occurs in a pre-token. The encoder walks left to right with the longest token at each place and accepts it
if it is compatible with the token before, that is, if merging the bytes of both by ranks gives these two
tokens again, which the parts at their common edge decide. Otherwise it tries shorter tokens, and when none is left it marks the place as a dead end and
takes back the token before. A sequence whose neighbours are all compatible is the one that merging gives;
each place is a dead end once at most, so the work grows with the length. Compatibility is remembered per
pair, encodings per pre-token, both up to a bound.

Defined results: a null text is empty and has no ids; special strings in a text are ordinary text; other
columns pass through, and an input column named like a computed one is replaced; repeated rows are encoded
each; an empty table gives no rows. Decoding null gives no bytes; an id that the vocabulary lacks, or a null
id, makes the decoded value null.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import with_text_columns

REMEMBERED_PAIRS = 1_000_000
REMEMBERED_WORDS = 400_000  # of at most REMEMBERED_CHARS characters each, and as many of an older generation
REMEMBERED_CHARS = 64
AHEAD = 4  # longest tokens' lengths that one search of the automaton may read
RUN = 100_000  # pre-tokens of a long text that are held at once
LONG_TEXT = 1 << 20
IDS = 1 << 18  # decoded at once
NEVER = 1 << 62
UNSEEN, NONE_LEFT = -2, -1


class BytePairs:
    """The encoder and decoder of one vocabulary, given as bytes and their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.raw = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.above = [0] * (max(ranks.values()) + 1)  # bytes after the first
        for b, i in ranks.items():
            self.above[i] = len(b) - 1
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.prefix: dict[int, int] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.blob: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def merge(self, data: bytes) -> list[bytes]:
        """The parts of a token before its last merge, by plain merging; a single part if it has none."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.ranks) + 256
        while len(parts) > 2:
            best, at = min((self.ranks.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """What stands at a token's right or left edge as it is built: each part, and the rank that replaces it.

        Empty for a token that merging its own bytes does not give.
        """
        known = self.edges[right].get(token)
        if known is None:
            data = self.raw[token]
            parts = self.merge(data)
            if len(parts) == 1:
                known = [(data, NEVER)]
            elif len(parts) > 2:
                known = []
            else:
                inner = self.edge(self.ranks[parts[right]], right)
                known = [*inner[:-1], (parts[right], token), (data, NEVER)] if inner else []
            self.edges[right][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart as they are when their bytes are merged; -1 stands for no left one.

        Merges happen in the order of ranks, the leftmost first among equal ones, so both edges grow in that
        order, and the tokens come apart if parts that stand side by side have a token of less rank.
        """
        after = self.edge(right, False)
        if left < 0:
            return bool(after)
        before, ranks, i, j = self.edge(left, True), self.ranks, 0, 0
        if not before or not after:
            return False
        while True:
            (a, a_until), (b, b_until) = before[i], after[j]
            met = ranks.get(a + b, NEVER)
            if met < a_until and met <= b_until and met < NEVER:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def look_ahead(self, letters: str, place: int, longest: array) -> int:
        """Notes the longest tokens from a place on, each where the one before ends; returns the first of them."""
        part, above = letters[place : place + AHEAD * self.longest], self.above
        sure = len(letters) if place + len(part) == len(letters) else place + len(part) - self.longest
        for end, token in self.automaton.iter_long(part):
            at = place + end - above[token]
            if at > sure or longest[at] >= 0:
                break
            longest[at] = token
        return longest[place]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        data = word.encode()
        known = self.ranks.get(data)
        if known is not None and self.compatible(-1, known):
            return [known]
        letters, size, pairs, above = data.decode("latin-1"), len(data), self.pairs, self.above
        dead = bytearray(size + 1)
        ids: list[int] = []
        longest = array("i", [-1]) * size
        place, last, token = 0, -1, UNSEEN
        while place < size:
            if token == UNSEEN:
                token = longest[place]
                if token < 0:
                    token = self.look_ahead(letters, place, longest)
            while token >= 0:
                end = place + above[token] + 1
                if not dead[end]:
                    pair = last << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) > REMEMBERED_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.compatible(last, token)
                    if fits:
                        break
                token = self.shorter(token)
            if token >= 0:
                ids.append(token)
                place, last, token = end, token, UNSEEN
            else:
                dead[place] = 1
                taken = ids.pop()
                place -= above[taken] + 1
                last = ids[-1] if ids else -1
                token = self.shorter(taken)
        return ids

    def shorter(self, token: int) -> int:
        """The longest token that is a shorter prefix of a token, or ``NONE_LEFT``."""
        known = self.prefix.get(token)
        if known is None:
            data = self.raw[token]
            known = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), NONE_LEFT)
            self.prefix[token] = known
        return known

    def encode(self, text: str) -> bytes:
        """The ids of a text as native integers of four bytes."""
        if len(text) <= LONG_TEXT:
            return self._encode_run(self.split.findall(text))
        found = (m.group() for m in self.split.finditer(text))
        return b"".join(iter(lambda: self._encode_run(list(islice(found, RUN))), b""))

    def _encode_run(self, words: list[str]) -> bytes:
        known, older = self.words, self.older
        new = {w for w in words if w not in known}
        if len(known) + len(new) > REMEMBERED_WORDS:
            known, older = {}, known
            self.words, self.older = known, older
            new = set(words)
        long = {}
        for w in new:
            ids = older.get(w) or array("i", self.encode_word(w)).tobytes()
            (known if len(w) <= REMEMBERED_CHARS else long)[w] = ids
        if long:
            return b"".join([long[w] if w in long else known[w] for w in words])
        return b"".join(map(known.__getitem__, words))

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[bytes | None]:
        """The bytes of rows of ids, which lie one after the other, ``size`` of them in each row."""
        if self.blob is None:
            length = np.array([len(self.raw.get(i, b"")) for i in range(len(self.above))], np.int64)
            blob = np.frombuffer(b"".join(self.raw.get(i, b"") for i in range(len(self.above))), np.uint8)
            self.blob = blob, np.cumsum(length) - length, length
        blob, start, length = self.blob
        known = (ids >= 0) & (ids < len(length))
        ids = np.where(known, ids, 0)
        known &= length[ids] > 0
        parts, taken = [], np.where(known, length[ids], 0)
        for i in range(0, len(ids), IDS):
            n = taken[i : i + IDS]
            before = np.cumsum(n) - n
            parts.append(blob[np.repeat(start[ids[i : i + IDS]] - before, n) + np.arange(n.sum())].tobytes())
        data = b"".join(parts)
        row = np.concatenate([[0], np.cumsum(size)])
        at = np.concatenate([[0], np.cumsum(taken)])[row].tolist()
        missing = np.concatenate([[0], np.cumsum(~known)])[row]
        return [None if lost else data[x:y] for x, y, lost in zip(at, at[1:], np.diff(missing).tolist(), strict=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> BytePairs:
    """The vocabulary of a rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return BytePairs({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Adds ``ids array<int>``, the tokens of every whole text; each match of ``pattern`` is encoded separately."""

    def make():
        known = vocabulary(path, pattern)
        return lambda texts: {"ids": [np.frombuffer(known.encode(t), np.int32) for t in texts]}

    return with_text_columns(docs, make, "ids array<int>", text, keep)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded binary``, the bytes of a row's ids."""
    kept = [c for c in df.columns if c != "decoded"]
    schema = StructType([df.schema[c] for c in kept]).add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = part.column(kept.index(ids))
                size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = known.decode(pc.fill_null(rows.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64), size)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=schema.fieldNames())

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
