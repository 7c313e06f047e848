"""What several corpus operators share: reading words of a text, and passing rows through Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billweave.session import scratch_dir, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
MOST_BYTES = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the folders of ``stored`` are noted, within ``noting``.
_noted: list[list[str]] = []


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` computed once, as a table in the shared scratch folder."""
    path = scratch_dir(df.sparkSession, purpose)
    for folders in _noted[-1:]:
        folders.append(path)
    return written(df, path)


@contextmanager
def noting(folders: list[str]) -> Iterator[None]:
    """Add the folders of all tables that ``stored`` makes inside to a list."""
    _noted.append(folders)
    try:
        yield
    finally:
        _noted.pop()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def with_columns_schema(df: DataFrame, new: list[tuple[str, str]]) -> T.StructType:
    """The schema of ``df`` with new columns at the end; a column of the same name (names are not
    case-sensitive) is replaced."""
    taken = {n.lower() for n, _ in new}
    added = T.StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in new))
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in taken] + added.fields)


def free_names(df: DataFrame, *wished: str) -> list[str]:
    """Names like those wished that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"_{name}{'_' * k}" for k in range(len(taken) + 1)) if n.lower() not in taken) for name in wished]


def named(column: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def aside(columns: list[str]) -> tuple[list[Column], list[Column]]:
    """The columns as ``own0``, ``own1``, ..., and those under their names again. With all columns of a
    caller renamed, an operator's names cannot clash with them."""
    away = [named(c).alias(f"own{i}") for i, c in enumerate(columns)]
    return away, [F.col(f"own{i}").alias(c) for i, c in enumerate(columns)]


def whole_number(df: DataFrame, name: str) -> Column:
    """An id as a long; ids that are no integers are refused."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"column '{name}' must hold integers, not {kind.simpleString()}; number the documents first")
    return named(name).cast("long")


def map_batches(
    df: DataFrame,
    new: list[tuple[str, str]],
    function: Callable[[pa.RecordBatch], list[pa.Array]],
    keep: Callable[[list[pa.Array]], pa.Array] | None = None,
    bounded: str | None = None,
) -> DataFrame:
    """Add columns that ``function`` makes from each Arrow batch. Rows stay where they are.

    ``keep`` gives a mask from the new columns; rows where it is false are left out. ``bounded`` names a
    column of texts or bytes of which no call gets more than ``MOST_BYTES``, or else a single row.
    """
    schema = with_columns_schema(df, new)
    kept = [f.name for f in schema.fields[: len(schema.fields) - len(new)]]
    names = kept + [n for n, _ in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if bounded is None else (part for batch in batches for part in slices(batch, bounded)):
            made = function(batch)
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in kept] + made, names)
            yield out if keep is None else out.filter(keep(made))

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``MOST_BYTES`` of a column, or of a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > MOST_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    yield batch.slice(first)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


@lru_cache(maxsize=8)
def byte_table(separators: bytes) -> bytes:
    """For ``bytes.translate``: A-Z to lower case, each separator to a blank."""
    lower = bytearray(bytes(range(256)).lower())
    for b in separators:
        lower[b] = 0x20
    return bytes(lower)
