"""A fixed-size filter before a join that keeps few of many wide rows.

The ids that the join will keep set bits in a bitmap of 2**BITS bits; rows whose bit isn't set are dropped where they
are read, before they are exchanged. The bitmap's size, 4 MB, doesn't depend on the data: with more ids it lets more
rows pass, and the join after it keeps the result exact at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, BLOCK = 25, 16


def _bit(name: str):  # type: ignore[no-untyped-def]
    return F.pmod(F.xxhash64(name), F.lit(1 << BITS)).cast("int")


def _pack(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << BLOCK, np.uint8)
    bits[table.column("bit").to_numpy() & ((1 << BLOCK) - 1)] = 1
    return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def bitmap(ids: DataFrame, name: str) -> np.ndarray:
    """The bitmap of the ids in a column, packed; at most 2**(BITS - BLOCK) rows of 2**(BLOCK - 3) bytes reach the driver."""
    bits = ids.select(_bit(name).alias("bit")).distinct().withColumn("block", F.shiftright("bit", BLOCK))
    out = np.zeros((1 << (BITS - BLOCK), 1 << (BLOCK - 3)), np.uint8)
    for r in bits.groupBy("block").applyInArrow(_pack, "block int, bits binary").collect():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def sifted(rows: DataFrame, ids: DataFrame, name: str, columns: list[str], then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
    """rows, cut to name and columns, without most of those whose id isn't in ids; then may make other batches of the rest in the same pass."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap(ids, name))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(0).to_numpy()
            on = (held.value[bit >> 3] >> (7 - (bit & 7))) & 1
            if on.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(on.astype(bool))) for c in batch.columns[1:]], names=[name, *columns])

    source = rows.select(_bit(name).alias("bit"), name, *columns)
    return source.mapInArrow((lambda b: then(kept(b))) if then else kept, schema or ", ".join(f"`{c}` {t}" for c, t in source.dtypes[1:]))
