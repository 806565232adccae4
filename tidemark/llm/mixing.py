"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order, up to ``max_repeats`` times over. A document's
virtual finish time is its source's words so far divided by the source's target; the mix takes entries
in order of finish time until the total budget is spent.

Two sums replace sorting a whole source or the whole queue in one task: a source's shuffled order is cut
into hash ranges whose totals give each range its offset, and the global order is range-sorted by finish
time, where only the range in which the budget ends needs its rows in order.

Defined results: a null text has size 0 and is taken 0 times; the null source is the last one; documents
of one id, repeated rows and equal finish times are ordered by shuffle hash, id and size, so reruns agree;
an empty table gives an empty result; input columns with a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, stored

MAX_REPEATS = 3
ROWS_PER_RANGE = 50_000
FINISH_RANGES = 1 << 16  # of finish times, for each pass over the sources
CYCLE = (1, 2, 3)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``size``, the number of words of the whole text."""
    return docs.withColumn("size", F.coalesce(F.expr(f"CAST(regexp_count(`{text}`, '[^\\\\x20\\\\x09-\\\\x0D]+') AS BIGINT)"), F.lit(0).cast("bigint")))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target`` from one row per source; shares by weight, capped, the excess reshared by weight.

    Sources are capped in order of cap over weight. Were the first k capped, the rest would share what is
    left at a level that rises with k while the next source is below it and falls after that, so the highest
    level is the right one and no rounds are needed. Sees one row per source.
    """
    picks = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(cycle))
    return (
        sizes.selectExpr("source", "source_size", "row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS _place")
        .selectExpr("*", f"CASE _place % {len(cycle)} {picks} END AS _w", f"{max_repeats} * source_size AS _cap")
        .selectExpr(
            "*",
            "sum(source_size) OVER () AS _total",
            "coalesce(sum(_cap) OVER (ORDER BY _cap / _w, _place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _capped",
            "sum(_w) OVER (ORDER BY _cap / _w, _place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _left",
        )
        .selectExpr("*", "(_total - _capped) / _left AS _level")
        .selectExpr("*", "max(_level) OVER () AS _water")
        .selectExpr("source", "source_size", "least(CAST(_cap AS DOUBLE), CAST(_w * _water AS DOUBLE)) AS target")
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    keep: list[str] | None = None,
    max_repeats: int = MAX_REPEATS,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Adds ``size, source_size, target, taken`` (words) and ``copies`` to the kept columns of every document."""
    made = ("size", "source_size", "target", "taken", "copies")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    carried = [f"`{c}` AS _k{i}" for i, c in enumerate(kept)]
    queued = sized(docs, text).selectExpr(*carried, f"`{source}` AS _src", f"`{key}` AS _id", "size AS _size", f"md5(CAST(`{key}` AS STRING)) AS _h")
    queued = stored(queued)  # read for range totals, finish times, the edge and the result
    # Ranges of the shuffled order: md5 is uniform, so its leading digits cut a source into even parts.
    digits = _hex_digits(queued.count(), rows_per_range)
    queued = queued.withColumn("_range", F.coalesce(F.substring("_h", 1, digits), F.lit("")))
    parts = queued.groupBy("_src", "_range").agg(F.sum("_size").alias("_part"))
    parts = parts.selectExpr(
        "*", "coalesce(sum(_part) OVER (PARTITION BY _src ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before"
    )
    totals = source_targets(parts.groupBy(F.col("_src").alias("source")).agg(F.sum("_part").alias("source_size")), max_repeats=max_repeats)
    placed = queued.selectExpr(
        "*", "sum(_size) OVER (PARTITION BY _src, _range ORDER BY _h, _id, _size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _within"
    )
    offsets = parts.join(totals.withColumnRenamed("source", "_s"), F.expr("_src <=> _s")).selectExpr(
        "_src AS _osrc", "_range AS _orange", "_before", "source_size AS _ssize", "target AS _target"
    )
    joined = placed.join(offsets, F.expr("_src <=> _osrc AND _range = _orange")).drop("_osrc", "_orange")
    # A document's entries: one for each pass over its source, at a finish time of passes plus its place.
    times = [f"CASE WHEN _size > 0 THEN ({e} * _ssize + _before + _within) / _target END" for e in range(max_repeats)]
    entries = joined.selectExpr("*", f"array({', '.join(times)}) AS _finish")
    slot = f"CAST(floor(least(x, {float(max_repeats)}D) * {FINISH_RANGES}) AS BIGINT)"
    by_slot = (
        entries.where("_size > 0")
        .selectExpr("_size", "_ssize", "explode(_finish) AS x")
        .selectExpr("_size", f"{slot} AS _slot")
        .groupBy("_slot")
        .agg(F.sum("_size").alias("_sum"))
        .selectExpr("_slot", "_sum", "sum(_sum) OVER (ORDER BY _slot) AS _upto")
    )
    budget = totals.agg(F.sum("source_size").alias("_budget"))
    # The range in which the budget ends; all earlier ranges are taken whole, none of the later ones.
    edge = by_slot.join(budget).where("_upto > _budget").agg(
        F.min_by(F.struct("_slot", (F.col("_budget") - (F.col("_upto") - F.col("_sum"))).alias("_room")), "_slot").alias("_e")
    ).selectExpr("_e._slot AS _edge", "_e._room AS _room")
    marked = entries.join(edge)  # one row
    order = "x, _src, _h, _id, _size"
    last = (
        marked.where("_size > 0")
        .selectExpr("_src", "_h", "_id", "_size", "_edge", "_room", "explode(_finish) AS x")
        .where(f"{slot} = _edge")
        .selectExpr("x", "_src", "_h", "_id", "_size", "_room", f"sum(_size) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS _run")
        .where("_run <= _room")
        .agg(F.max_by(F.struct(*order.split(", ")), F.struct("_run", *order.split(", "))).alias("_last"))
    )
    before = [f"({slot.replace('x', f'_finish[{e}]', 1)} < coalesce(_edge, {1 << 62}))" for e in range(max_repeats)]
    within = [
        f"({slot.replace('x', f'_finish[{e}]', 1)} = _edge AND _last IS NOT NULL AND struct(_finish[{e}] AS x, _src, _h, _id, _size) <= _last)" for e in range(max_repeats)
    ]
    count = " + ".join(f"CAST(coalesce({a} OR {b}, false) AS BIGINT)" for a, b in zip(before, within, strict=True))
    return marked.join(last).selectExpr(
        *[f"_k{i} AS `{c}`" for i, c in enumerate(kept)],
        "_size AS size",
        "_ssize AS source_size",
        "_target AS target",
        f"({count}) * _size AS taken",
        f"{count} AS copies",
    )


def _hex_digits(rows: int, per_range: int) -> int:
    digits = 1
    while rows > per_range * 16**digits:
        digits += 1
    return digits


#: The same result for every document of a table, in DuckDB SQL.
MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^{SPACE}]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sized GROUP BY source),
caps AS (SELECT *, 1 + place % 3 AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, (w * (SELECT max(level) FROM levels))::DOUBLE) AS target FROM levels),
queue AS (
  SELECT s.doc_id, s.source, s.size, s.h, t.source_size, t.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
entries AS (SELECT *, (e * source_size + upto) / target AS x FROM queue, range(0, 3) AS r(e) WHERE size > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY x, source NULLS FIRST, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto_all FROM entries),
picked AS (
  SELECT doc_id, source, h, size, upto, count(*) AS copies FROM run
  WHERE upto_all <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(p.copies, 0))::BIGINT AS taken, coalesce(p.copies, 0)::BIGINT AS copies
FROM queue q LEFT JOIN picked p ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.source IS NOT DISTINCT FROM p.source AND q.upto = p.upto AND q.size = p.size
"""
