"""Repair of damaged conversations by the cheapest edits, chosen by prefix-doubling path ranking.

A conversation's rows in order of their turns must become ``(s?(ua)+)?`` in role initials. A row is kept (0),
gets the other role (1) or is deleted (2, required for blank rows and repetitions); empty rows may be put in
anywhere (5 each); a truncated row that stays adds 5. A dynamic program over (rows used, state of the
pattern) gives the cost to the end for every node. The arcs that lie on cheapest ways are then ranked by the
audit that starts with them: by its first initial, and in each round by twice as many, from the pair of the
ranks of an arc and of the one its doubled pointer leads to. Among the arcs that leave a node the one of
least rank starts the least audit, and the doubled pointers spell it out. All conversations of a batch are
ranked at once.

A conversation of more than ``LONG_ROWS`` rows or ``LONG_CHARS`` characters is cut into pieces of its sorted
rows: a range sort with ties spread by where they were read deals them out, each piece gives its cost from
every entering to every leaving state, these are chained backwards per conversation, each piece ranks its
audits, and the states are chained forwards. Only the hash of the repaired text, one value over all of it,
streams through one task per conversation.

Defined results: rows without a conversation are one conversation; null turns come first; rows of a turn are
ordered by role and text; a null role or text counts as one space; a role that starts with none of s, u and
a, or is empty, cannot be kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import arrow_types, stored

LONG_ROWS, LONG_CHARS = 10_000, 16_000_000
PIECE_ROWS = 20_000
BATCH_ROWS, BATCH_CHARS = 20_000, 16_000_000
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
FAR = 1 << 40  # no way

# States of the pattern: nothing yet, after s, after u, after a; the state after a new user or assistant row.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
AFTER_NEW = np.array([2, 2, 3, 2])
AFTER_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # [state, initial]
LAST = np.array([0, FAR, FAR, 0])
LABELS = "DIKR"  # in byte order
LEGAL = {"su", "ua", "au"}


class Runs:
    """Some runs of rows, one after the other: whole conversations, or pieces of long ones."""

    def __init__(self, initial: np.ndarray, forced: np.ndarray, cut: np.ndarray, size: np.ndarray, leaving: np.ndarray):
        self.initial, self.forced, self.cut, self.size, self.leaving = initial, forced, cut.astype(np.int64) * 5, size, leaving
        self.start = np.cumsum(size) - size  # first row of each run
        self.base = self.start + np.arange(len(size))  # first place of each run; a run has a place after its last row
        self.cost = self._costs()

    def _row_costs(self, row: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Costs of keeping, of another role and of deletion in each state, given the costs after the row."""
        out = np.full((3, len(row), 4), FAR)
        stay, more = ~self.forced[row], self.cut[row][:, None]
        to = AFTER_KEPT[:, self.initial[row]].T
        kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), axis=1), FAR) + more
        out[0] = np.where(stay[:, None], kept, FAR)
        out[1] = np.where(stay[:, None], after[:, AFTER_NEW] + 1 + more, FAR)
        out[2] = after + 2
        return np.minimum(out, FAR)

    def _costs(self) -> np.ndarray:
        """Least cost from every (place, state) to the end of its run; runs are walked backwards side by side."""
        cost = np.full((int(self.size.sum()) + len(self.size), 4), FAR)
        order = np.argsort(-self.size, kind="stable")
        sizes = self.size[order]
        for back in range(int(sizes[0]) + 1 if len(sizes) else 0):
            run = order[: np.searchsorted(-sizes, -back, "right")]
            place = self.base[run] + self.size[run] - back
            if back:
                best = self._row_costs(self.start[run] + self.size[run] - back, cost[place + 1]).min(axis=0)
            else:
                best = self.leaving[run].copy()
            u, a = np.minimum(best[:, 2], best[:, 3] + 5), np.minimum(best[:, 3], best[:, 2] + 5)
            cost[place] = np.stack([np.minimum(best[:, 0], u + 5), np.minimum(best[:, 1], u + 5), u, a], axis=1)
        return np.minimum(cost, FAR)

    def arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels, tails and heads of the arcs on cheapest ways; a node is four times a place plus a state.

        Labels are numbers from 1 in byte order. A node has one arc of a label at most.
        """
        rows = np.arange(len(self.initial))
        place = rows + np.repeat(np.arange(len(self.size)), self.size)
        here, state = self.cost[place], np.arange(4)
        kept, changed, deleted = self._row_costs(rows, self.cost[place + 1])
        to = np.maximum(AFTER_KEPT[:, self.initial].T, 0)
        all_places = np.arange(len(self.cost))
        found = []
        for label, ok, at, ahead, target in (
            (1, deleted == here, place, 1, np.broadcast_to(state, here.shape)),
            (2, self.cost[:, AFTER_NEW] + 5 == self.cost, all_places, 0, np.broadcast_to(AFTER_NEW, self.cost.shape)),
            (3, kept == here, place, 1, to),
            (4, changed == here, place, 1, np.broadcast_to(AFTER_NEW, here.shape)),
        ):
            i, s = np.nonzero(ok & (self.cost[at] < FAR))
            found.append((np.full(len(i), label), 4 * at[i] + s, 4 * (at[i] + ahead) + target[i, s]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def audits(self, entering: Sequence[int]) -> list[list[tuple[str, int]]]:
        """For each entering state, every run's least cheapest audit and the state it leaves in."""
        label, tail, head = self.arcs()
        none = len(label)  # stands for the end of an audit
        label, head = np.append(label, 0), np.append(head, 0)
        nodes = 4 * len(self.cost)

        def least(rank: np.ndarray) -> np.ndarray:
            out = np.full(nodes, none)
            order = np.lexsort((rank[:none], tail))
            first = np.flatnonzero(np.diff(tail[order], prepend=-1))
            out[tail[order[first]]] = order[first]
            return out

        rank = label
        ahead = [np.append(least(rank)[head[:none]], none)]
        while (ahead[-1] != none).any():
            rank = np.unique(rank * (rank.max() + 1) + rank[ahead[-1]], return_inverse=True)[1]
            ahead.append(ahead[-1][ahead[-1]])
        best, letters = least(rank), np.frombuffer(b" " + LABELS.encode(), np.uint8)
        out = []
        for state in entering:
            path = best[4 * self.base + state][:, None]
            for pointers in ahead[:-1]:
                path = np.concatenate([path, pointers[path]], axis=1)
            size = (path != none).sum(axis=1)
            leaves = np.where(size > 0, head[path[np.arange(len(size)), np.maximum(size - 1, 0)]] % 4, state)
            spelled = letters[label[path]]
            out.append([(spelled[i, :n].tobytes().decode(), int(e)) for i, (n, e) in enumerate(zip(size, leaves, strict=True))])
        return out


def faults(rows: Sequence[tuple[str, str]]) -> tuple[list[bool], list[bool], list[bool]]:
    """Blank, repeated and truncated rows among (role, text), the first of these that holds."""
    seen: set[tuple[str, str]] = set()
    out = [], [], []
    for row in rows:
        bare = row[1].rstrip(BLANKS)
        kinds = (not bare, row in seen, not bare.endswith(ENDS))
        first = kinds.index(True) if True in kinds else 3
        for kind, flags in enumerate(out):
            flags.append(kind == first)
        seen.add(row)
    return out


def initial_of(role: str) -> int:
    return INITIALS.get(role[:1], OTHER)


def repaired(rows: Sequence[tuple[str, str]], audit: str, state: int = 0) -> Iterator[tuple[str, str]]:
    """The (role, text) rows after the edits of an audit."""
    at = 0
    for label in audit:
        if label == "D":
            at += 1
            continue
        new = "assistant" if state == 2 else "user"
        if label == "I":
            row = new, ""
        else:
            row = rows[at] if label == "K" else (new, rows[at][1])
            at += 1
        yield row
        state = int(AFTER_KEPT[state, initial_of(row[0])])


def solve(conversations: Sequence[list[tuple[int | None, str, str]]]) -> Iterator[tuple]:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired text of whole conversations."""
    flags = [faults([r[1:] for r in rows]) for rows in conversations]
    sizes = np.array([len(rows) for rows in conversations], np.int64)
    found: list[tuple[str, int]] = [("", 0)] * len(conversations)
    # Runs of like length share a batch, so that no path is much longer than the others.
    for kind in np.unique(np.ceil(np.log2(np.maximum(sizes, 1)))):
        own = np.flatnonzero(np.ceil(np.log2(np.maximum(sizes, 1))) == kind).tolist()
        runs = Runs(
            np.array([initial_of(r[1]) for i in own for r in conversations[i]], np.int64),
            np.array([b or d for i in own for b, d in zip(*flags[i][:2], strict=True)], bool),
            np.array([t for i in own for t in flags[i][2]], bool),
            sizes[own],
            np.tile(LAST, (len(own), 1)),
        )
        for i, (audit, _), cost in zip(own, runs.audits([0])[0], runs.cost[runs.base, 0].tolist(), strict=True):
            found[i] = audit, cost
    for rows, (blank, duplicate, truncated), (audit, cost) in zip(conversations, flags, found, strict=True):
        turns = {t for t, _, _ in rows if t is not None}
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        text = "\n".join(f"{r}:{t}" for r, t in repaired([r[1:] for r in rows], audit))
        yield gaps, sum(blank), sum(duplicate), sum(truncated), illegal, cost, audit, text


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _short(rows: DataFrame, conv_type: str) -> DataFrame:
    """Conversations that fit a task's memory, several per batch; the rows of one are side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        held: list[list] = []
        count = chars = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*solve(held), strict=True))
            hashes = [hashlib.sha256(t.encode()).hexdigest() for t in columns[7]]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6]), pa.array(columns[7]), pa.array(hashes)],
                names=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "repaired_sha256"],
            )

        for batch in batches:
            key_type = batch.column(0).type
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not keys or conv != keys[-1]:
                    if count >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield flush()
                        keys, held, count, chars = [], [], 0, 0
                    keys.append(conv)
                    held.append([])
                held[-1].append((turn, role, text))
                count += 1
                chars += len(text)
        if keys:
            yield flush()

    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv {conv_type}, {FACTS}, repaired string, repaired_sha256 string")


def _numbered(rows: DataFrame, conv_type: str, piece_rows: int) -> DataFrame:
    """Rows in order: range part, place in it, and a piece that changes with the conversation or when full."""
    parts = max(1, -(-rows.count() // piece_rows))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, piece, inside, last = TaskContext.get().partitionId(), 0, 0, 0, object()
        for batch in batches:
            pieces = []
            for conv in batch.column(0).to_pylist():
                if conv != last or inside >= piece_rows:
                    piece, inside, last = piece + 1, 0, conv
                inside += 1
                pieces.append(piece)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * n, pa.int64()), pa.array(pieces, pa.int64()), pa.array(range(place, place + n), pa.int64())],
                names=["conv", "turn", "role", "text", "part", "piece", "place"],
            )
            place += n

    order = ["conv", "turn", "role", "text"]
    dealt = rows.withColumn("tie", F.spark_partition_id()).repartitionByRange(parts, *order, "tie").sortWithinPartitions(*order).drop("tie")
    return stored(dealt.mapInArrow(number, f"conv {conv_type}, turn long, role string, text string, part long, piece long, place long"))


def as_table(df: pd.DataFrame, kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(df[c].tolist(), kind, from_pandas=True) for c, kind in kinds.items()], names=list(kinds))


def per_group(groups, fn, ddl: str) -> DataFrame:
    kinds = arrow_types(StructType.fromDDL(ddl))
    return groups.applyInArrow(lambda rows: as_table(fn(rows.to_pandas()), kinds), ddl)


def per_pair(groups, fn, ddl: str) -> DataFrame:
    kinds = arrow_types(StructType.fromDDL(ddl))
    return groups.applyInArrow(lambda left, right: as_table(fn(left.to_pandas(), right.to_pandas()), kinds), ddl)


def _runs(rows: pd.DataFrame, leaving: np.ndarray) -> Runs:
    own = rows.sort_values("place")
    initial = np.array([initial_of(r) for r in own["initial"]])
    forced = (own["blank"] | own["duplicate"]).to_numpy(bool)
    return Runs(initial, forced, own["truncated"].to_numpy(bool), np.array([len(own)]), leaving[None])


def _long(rows: DataFrame, conv_type: str, piece_rows: int) -> DataFrame:
    """Conversations in pieces that are solved apart and chained."""
    ordered = _numbered(rows, conv_type, piece_rows)
    piece, key = ["conv", "part", "piece"], f"conv {conv_type}, part long, piece long"
    digest = "sha2(CAST(concat(length(role), ':', role, text) AS BINARY), 256)"
    number = "part * 1099511627776L + place"
    firsts = ordered.selectExpr("conv", f"{digest} AS row", f"{number} AS at").groupBy("conv", "row").agg(F.min("at").alias("at")).select("at")
    bare = rf"regexp_replace(text, '[{BLANKS}]+\\z', '')".replace("\t", r"\\t").replace("\n", r"\\n").replace("\x0b", r"\\x0b").replace("\x0c", r"\\f").replace("\r", r"\\r")
    judged = ordered.selectExpr(*piece, "place", "left(role, 1) AS initial", f"{number} AS at", f"{bare} AS bare").join(firsts.withColumn("first", F.lit(True)), "at", "left")
    judged = judged.selectExpr(*piece, "place", "initial", "bare = '' AS blank", "bare <> '' AND first IS NULL AS duplicate", "bare <> '' AND first AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated")
    marked = stored(judged.withColumn("truncated", F.coalesce("truncated", F.lit(False))))

    states = [f"c{s}{e}" for s in range(4) for e in range(4)]

    def summary(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("place")
        initials = own["initial"].tolist()
        out = group.iloc[:1][piece].copy()
        for name in ("blank", "duplicate", "truncated"):
            out[name] = int(own[name].sum())
        out["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        out["head"], out["tail"] = initials[0], initials[-1]
        for e in range(4):
            cost = _runs(own, np.where(np.arange(4) == e, 0, FAR)).cost[0]
            for s in range(4):
                out[f"c{s}{e}"] = cost[s]
        return out

    facts = "blank long, duplicate long, truncated long, illegal long"
    pieces = stored(per_group(marked.groupBy(*piece), summary, f"{key}, {facts}, head string, tail string, {', '.join(f'{c} long' for c in states)}"))

    def backwards(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values(["part", "piece"], ascending=False)
        leaving, out = LAST, []
        for cost in own[states].to_numpy().reshape(-1, 4, 4):
            out.append(leaving)
            leaving = np.minimum((cost + leaving).min(axis=1), FAR)
        ends = own[piece].copy()
        for e in range(4):
            ends[f"e{e}"] = [v[e] for v in out]
        heads = own["head"].tolist()  # from the last piece to the first
        tails = own["tail"].tolist()
        ends["between"] = [0] + [int(t + h not in LEGAL) for h, t in zip(heads, tails[1:], strict=False)]
        ends["cost"] = int(leaving[0])
        return ends

    chained = stored(per_group(pieces.groupBy("conv"), backwards, f"{key}, e0 long, e1 long, e2 long, e3 long, between long, cost long"))

    def walks(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        found = _runs(rows, ends[["e0", "e1", "e2", "e3"]].to_numpy()[0]).audits(range(4))
        out = ends[piece].copy()
        for s, ((audit, leaves),) in enumerate(found):
            out[f"a{s}"], out[f"s{s}"] = audit, leaves
        return out

    ways = ", ".join(f"a{s} string, s{s} long" for s in range(4))
    walked = per_pair(marked.groupBy(*piece).cogroup(chained.groupBy(*piece)), walks, f"{key}, {ways}")

    def forwards(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values(["part", "piece"])
        state, entering, audits = 0, [], []
        for row in own.to_dict("records"):
            entering.append(state)
            audits.append(row[f"a{state}"])
            state = int(row[f"s{state}"])
        return own[piece].assign(state=entering, audit=audits)

    chosen = stored(per_group(walked.groupBy("conv"), forwards, f"{key}, state long, audit string"))

    def lines(rows: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("place")
        kept = [f"{r}:{t}" for r, t in repaired(list(zip(own["role"], own["text"], strict=True)), way["audit"].iloc[0], int(way["state"].iloc[0]))]
        return pd.DataFrame({c: [way[c].iloc[0]] * len(kept) for c in piece} | {"place": range(len(kept)), "line": kept})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if total is None or conv != last:
                    if total is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([last], batch.column(0).type), pa.array([total.hexdigest()])], names=["conv", "repaired_sha256"])
                    last, total = conv, hashlib.sha256()
                else:
                    total.update(b"\n")
                total.update(line.encode())
            kind = batch.column(0).type
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([total.hexdigest()])], names=["conv", "repaired_sha256"])

    written = per_pair(ordered.groupBy(*piece).cogroup(chosen.groupBy(*piece)), lines, f"{key}, place long, line string")
    in_order = written.repartition("conv").sortWithinPartitions("conv", "part", "piece", "place").select("conv", "line")
    digests = in_order.mapInArrow(hashed, f"conv {conv_type}, repaired_sha256 string")
    gaps = ordered.groupBy("conv").agg(F.expr("coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps"))
    counts = pieces.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    between = chained.groupBy("conv").agg(F.sum("between").alias("between"), F.max("cost").alias("cost"))
    audit = chosen.groupBy("conv").agg(F.expr("array_join(transform(array_sort(collect_list(struct(part, piece, audit))), p -> p.audit), '') AS audit"))
    out = counts
    for i, other in enumerate((gaps, between, audit, digests)):
        renamed = other.withColumnRenamed("conv", f"conv{i}")
        out = out.join(renamed, F.expr(f"conv <=> conv{i}"), "left").drop(f"conv{i}")
    return out.selectExpr(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal + between AS illegal", "cost", "audit",
        "CAST(NULL AS STRING) AS repaired", f"coalesce(repaired_sha256, '{hashlib.sha256().hexdigest()}') AS repaired_sha256",
    )


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired, repaired_sha256`` per conversation.

    ``repaired`` holds the repaired ``role:text`` lines; it is null for long conversations, of which only the
    hash is taken.
    """
    kind = df.schema[conv].dataType.simpleString()
    rows = df.selectExpr(f"`{conv}` AS conv", f"CAST(`{turn}` AS BIGINT) AS turn", f"coalesce(`{role}`, ' ') AS role", f"coalesce(`{text}`, ' ') AS text")
    sizes = rows.groupBy("conv").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
    long = stored(sizes.where(f"rows > {long_rows} OR chars > {long_chars}").selectExpr("conv AS long"))
    if long.isEmpty():
        out = _short(rows, kind)
    else:
        own = F.expr("conv <=> long")
        out = _short(rows.join(long, own, "left_anti"), kind).unionByName(_long(rows.join(long, own, "left_semi"), kind, piece_rows))
    return out.withColumnRenamed("conv", conv)
