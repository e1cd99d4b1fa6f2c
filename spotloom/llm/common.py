"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 23


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session: texts are long, and a batch is held by the JVM and by Python at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows and ``size`` bytes; a row of more bytes is a part of its own."""
    if batch.num_rows <= rows and (batch.num_rows <= 1 or batch.nbytes <= size):
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), rows, size)
    yield from slices(batch.slice(half), rows, size)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 256, size: int = 1 << 21) -> DataFrame:
    """``fn`` over slices of bounded rows and bytes, so a task holds few texts and results at a time."""

    def run(batches):
        for batch in batches:
            yield from map(fn, slices(batch, rows, size))
        pa.default_memory_pool().release_unused()  # the worker waits for its next task

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def on_texts(fn: Callable[[list[str]], pa.Array], kind: str) -> Callable[..., Column]:
    """Column function over one text column: only that column reaches Python, in slices, and one value a row returns."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        parts = [fn(text_list(part.column(0))) for part in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 256, 1 << 21)]
        return pa.concat_arrays(parts) if parts else fn([])

    short_batches(SparkSession.active())
    return run


def text_list(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; a null counts as the empty text."""
    return [t or "" for t in column.to_pylist()]


def hash_share(key: Column, wanted: float, total: int) -> Column:
    """True for about ``wanted`` of ``total`` rows, chosen by a hash of ``key``: the same rows on every run."""
    cut = int(min(1.0, wanted / max(total, 1)) * (1 << 32))
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1 << 32)) < F.lit(cut)


def crc_mod(key: Column, n: int) -> Column:
    """CRC-32 of the key's decimal text, modulo ``n``; null for a null key."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(n))


#: Type that holds scores of up to 38 digits in Spark, and the largest of them.
WIDE, MOST = "decimal(38,0)", 10 ** 38 - 1


def finite(vector: Column) -> Column:
    """True for a vector whose components are all finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as a 64-bit number."""
    return F.transform(vector, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))


def numbered(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` with a column ``uid``: a hash of the key columns and of a row's number among equal ones."""
    equals = Window.partitionBy(key[0], "_slice").orderBy(*key[1:])
    placed = rows.withColumn("_slice", F.xxhash64(*key)).withColumn("_copy", F.row_number().over(equals))
    return placed.withColumn("uid", F.xxhash64("_slice", "_copy")).drop("_slice", "_copy")


def exact(x: np.ndarray, other: float) -> np.ndarray:
    """``x`` in a type whose inner products with components up to ``other`` are exact."""
    bound = float(np.abs(x.astype(np.float64)).max(initial=0)) * other * max(1, x.shape[1])
    return x.astype(np.float64 if bound < 2 ** 52 else np.int64 if bound < 2 ** 62 else object)


def most(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


def score_text(score: int) -> str:
    """Digits of an exact score; more than 38 of them count as the largest such number."""
    return str(min(max(score, -MOST), MOST))


def as_long(score: str) -> Column:
    """A column of such digits as a 64-bit number, or the nearest one."""
    limit = lambda n: F.lit(str(n)).cast(WIDE)
    bounds = np.iinfo(np.int64)
    return F.least(F.greatest(F.col(score).cast(WIDE), limit(bounds.min)), limit(bounds.max)).cast("long")
