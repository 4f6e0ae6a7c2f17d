"""Helpers shared by the text operators: words, Arrow columns, stored intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from residua.plans.registry import scratch_path

# letters and digits after ASCII lower-casing; every byte of a non-ASCII character belongs to a word
_PLAIN = bytes(
    b if (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) else (b + 32 if 0x41 <= b <= 0x5A else 0x20)
    for b in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode().translate(_PLAIN).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII blanks, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The strings one at a time, so that no second copy of a batch is held."""
    for value in column:
        yield value.as_py()


def by_pieces(make: Callable[..., pa.Array], *columns: pa.Array, rows: int = 256) -> pa.Array:
    """``make`` over a few rows at a time, so that few of a batch's values are Python objects at once."""
    parts = [make(*[c.slice(i, rows) for c in columns]) for i in range(0, len(columns[0]), rows)]
    return pa.concat_arrays(parts) if parts else make(*columns)


def one_text(make: Callable[[], Callable[[str | None], dict]], result: str, fields: dict[str, pa.DataType]):
    """A column function from a text to a struct.

    ``make()`` runs once in a task and returns a function of one text that
    gives a dict with the fields. The function is marked nondeterministic so
    that the optimizer neither repeats it nor moves it into a filter.
    """

    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()

        def piece(texts: pa.Array) -> pa.Array:
            made = [work(t) for t in texts_of(texts)]
            return pa.StructArray.from_arrays(
                [pa.array([m[name] for m in made], kind) for name, kind in fields.items()], names=list(fields))

        for texts in batches:
            yield by_pieces(piece, texts)

    return F.arrow_udf(call, result).asNondeterministic()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the folder all executors share and read it from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_bound(wanted: int, rows: int) -> int:
    """The largest 64-bit hash of about ``wanted`` among ``rows`` values."""
    return min((1 << 63) - 1, -(1 << 63) + ((wanted << 64) // max(1, rows)))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use, whatever the case of its letters."""
    used = {c.lower() for c in df.columns}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def id_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches sorted by ``keys``; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, start = [], mark, i
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
