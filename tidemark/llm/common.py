"""Helpers shared by the text operators: bounded batches, stable folds and samples, scratch tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import ensure_checkpoint_dir

CHUNK_BYTES = 8 << 20
BATCH_ROWS = 1000  # rows that Spark and a Python worker exchange at once where a stage reads whole texts
SPACE = r"\x20\x09-\x0D"


def slices(batch: pa.RecordBatch, text: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no part holds much more than ``chunk_bytes`` of text; one row is never split."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    part = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // chunk_bytes
    edges = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def give_back() -> None:
    """Returns what a finished task has freed to the system; a Python worker outlives its tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same task, which gives its freed memory back at its end."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside exchange at most ``BATCH_ROWS`` rows at once with Python; the setting is restored after them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_text_columns(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], Mapping[str, object]]],
    fields: str,
    text: str = "text",
    keep: Sequence[str] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Adds columns computed from whole texts, in batches bounded by bytes; a null text counts as empty.

    ``make()`` runs once per task and returns the function applied to each list of texts. Columns in
    ``keep`` (default: all) pass through; a computed column replaces an input column of its name.
    """
    added = StructType.fromDDL(fields)
    kept = [c for c in (df.columns if keep is None else keep) if c not in added.fieldNames()]
    schema = StructType([df.schema[c] for c in kept] + list(added.fields))
    names = added.fieldNames()
    passed = list(dict.fromkeys([*kept, text]))
    kinds = arrow_types(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, text, chunk_bytes):
                found = part.column(passed.index(text))
                out = fn([t or "" for t in found.to_pylist()])
                new = [pa.array(out[n], kinds[n], from_pandas=False) for n in names]
                yield pa.RecordBatch.from_arrays([part.column(passed.index(c)) for c in kept] + new, names=kept + names)

    return df.select(*[F.col(f"`{c}`") for c in passed]).mapInArrow(tidy(run), schema)


def arrow_types(schema: StructType) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema.fields}


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, key: str, bound: int, seed: str) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of the key, so reruns agree; all rows if there are fewer."""
    n = df.count()
    if n <= bound:
        return df
    grain = 1 << 30
    share = int(bound / n * grain)
    return df.where(F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), F.lit(grain)) < share)


def stored(df: DataFrame) -> DataFrame:
    """Writes a table that is read several times to the shared checkpoint folder and reads it back.

    Lost executors then cost a reread, not the work before it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
