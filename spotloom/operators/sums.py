"""Element-wise sums of vectors by key, without a row per dimension.

A task adds up the vectors of its rows per key in numpy, with bounded memory, and emits each sum in slices. Slices of one
key and place meet in a group of their own, so wide sums (products of dimensions, say) are added in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Numbers in a slice, and bytes of sums a task holds before it emits them.
SLICE, HELD = 2048, 1 << 26


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a two-dimensional double array."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(flat), -1)


def grouped(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, rows) of each key in the batch, rows as positions."""
    if not names:
        yield (), np.arange(batch.num_rows)
        return
    keys = list(zip(*(batch.column(n).to_pylist() for n in names)))
    codes = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    code = np.fromiter((codes[k] for k in keys), dtype=np.int64, count=len(keys))
    order = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[order], np.arange(len(codes) + 1))
    for key, i in codes.items():
        yield key, order[edges[i]:edges[i + 1]]


def sums_of(df: DataFrame, by: list[str], terms: Callable[[tuple, dict[str, object]], Iterator[tuple[tuple, np.ndarray, int]]], columns: list[str], extra: list[T.StructField] | None = None) -> DataFrame:
    """(by…, extra…, n, sums) of what ``terms`` makes of a group's rows in a batch: (extra key, vector, rows counted).

    ``terms`` gets the key and the columns: list columns as matrices, others as arrays of values.
    """
    fields = [df.schema[c] for c in by] + (extra or [])
    part = T.StructType([*fields, T.StructField("_slot", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("_v", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(part)

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for key, (n, total) in held.items():
            pieces = [total[i:i + SLICE] for i in range(0, max(1, len(total)), SLICE)]
            columns = [pa.array([k] * len(pieces), t.type) for k, t in zip(key, arrow)]
            columns += [pa.array(range(len(pieces)), pa.int32()), pa.array([n] * len(pieces), pa.int64()), pa.array(pieces, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        size = 0
        for batch in batches:
            values = {c: matrix(batch.column(c)) if pa.types.is_list(batch.schema.field(c).type) else batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            for key, rows in grouped(batch, by):
                for more, vector, n in terms(key, {c: v[rows] for c, v in values.items()}):
                    if key + more in held:
                        before = held[key + more]
                        held[key + more] = before[0] + n, before[1] + vector
                    else:
                        held[key + more] = n, vector
                        size += vector.nbytes
            if size > HELD:
                yield from emit(held)
                held, size = {}, 0
        yield from emit(held)

    def add(table: pa.Table) -> pa.Table:
        head = table.slice(0, 1)
        total = matrix(table.column("_v")).sum(axis=0)
        head = head.set_column(head.schema.get_field_index("n"), "n", pa.array([sum(table.column("n").to_pylist())], pa.int64()))
        return head.set_column(head.schema.get_field_index("_v"), "_v", pa.array([total], pa.list_(pa.float64()))).cast(arrow)

    names = [f.name for f in fields]
    sliced = df.select(*by, *[c for c in columns if c not in by]).mapInArrow(run, part).groupBy(*names, "_slot").applyInArrow(add, part)
    return sliced.groupBy(*names).agg(F.max("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_slot", "_v"))), lambda s: s["_v"])).alias("sums"))


def vector_sums(df: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """(by…, n, sums) of a vector column; rows with a null vector do not count."""
    def terms(key, columns):
        yield (), columns[vec].sum(axis=0), len(columns[vec])

    return sums_of(df.where(F.col(vec).isNotNull()), by, terms, [vec])


def product_sums(df: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """(by…, n, sums): the sums of products of every dimension of ``left`` with every one of ``right``, row by row of the matrix."""
    def terms(key, columns):
        yield (), (columns[left].T @ columns[right]).reshape(-1), len(columns[left])

    return sums_of(df.where(F.col(left).isNotNull() & F.col(right).isNotNull()), by, terms, list(dict.fromkeys([left, right])))
