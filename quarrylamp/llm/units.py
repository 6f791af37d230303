"""Texts packed into units: stretches of one scan task that travel as one compressed row.

A unit is what an operator asks about and gets answers for as a whole.  Packed, its texts take a
third of the room in stored tables and shuffles, and the JVM never looks into them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarrylamp.llm.common import slices

#: Bytes of text in a unit; a longer text is a unit of its own.
UNIT = 14 << 20


def _packed(ids: list[int | None], texts: list[bytes]) -> bytes:
    batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], ["doc_id", "text"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpacked(data: bytes) -> tuple[list[int | None], list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    table = pa.ipc.open_stream(raw).read_all()
    return table.column("doc_id").to_pylist(), table.column("text").to_pylist()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit = TaskContext.get().partitionId() << 24
    ids: list[int | None] = []
    texts: list[bytes] = []
    held = 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([unit], pa.int64()), pa.array([_packed(ids, texts)], pa.binary())], ["unit", "packed"]
        )

    for batch in slices(batches, "text"):
        new = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        size = sum(map(len, new))
        if ids and held + size > UNIT:
            yield row()
            unit, ids, texts, held = unit + 1, [], [], 0
        ids += batch.column("doc_id").to_pylist()
        texts += new
        held += size
    if ids:
        yield row()


def text_units(documents: DataFrame) -> DataFrame:
    """(unit, packed): the doc_id and UTF-8 text (null: empty) of every row; see `unpacked`.

    Unit numbers hold only in the table that they are written to: store it before using them.
    """
    return documents.select("doc_id", "text").mapInArrow(_pack, "unit long, packed binary")
