"""Computed columns beside kept ones, whatever the kept ones are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.encode import release


#: Texts taken from a batch at once.
ROWS = 1024


def map_text(docs: DataFrame, keep: list[Column | str], text: str, outputs: str, compute: Callable[[pa.Array], Iterator[tuple[int, int, list[pa.Array]]]], replaces: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and the outputs (a DDL), which compute gives for runs [first, last) of a batch's texts, in order.

    Kept columns with the name of an output, or a name in `replaces`, give way. Inside, columns go by number, so other names don't matter.
    """
    added = T.StructType.fromDDL(outputs)
    frame = docs.select(*keep)
    own = {*added.names, *replaces}
    fields = [f for f in frame.schema if f.name not in own]
    chosen = [c for c, f in zip(keep, frame.schema, strict=True) if f.name not in own]
    cols = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(chosen)]
    numbered = docs.select(*cols, F.col(text).alias("t"))
    inner = T.StructType([*(T.StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)), *(T.StructField(f"o{i}", f.dataType) for i, f in enumerate(added))])
    names = inner.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for first, last, arrays in compute(b.column(b.num_columns - 1)):
                kept = [c.slice(first, last - first) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=names)

    return numbered.mapInArrow(run, inner).toDF(*(f.name for f in fields), *added.names)


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned crc32 of an ASCII text, bit by bit; it has no function for it."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i::int, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295::bigint)"
