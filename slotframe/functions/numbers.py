"""Lists of numbers from contiguous bytes, a whole Arrow batch at a time.

Reading item by item would interpret an expression per number. The bytes of all
rows already lie side by side in an Arrow batch, so they become the list items as
they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# NumPy code on the wire, Arrow type and Spark type of the column.
CODES = {
    "u8": ("<u1", pa.int16(), T.ShortType()), "i8": ("<i1", pa.int8(), T.ByteType()),
    "u16": ("<u2", pa.int32(), T.IntegerType()), "i16": ("<i2", pa.int16(), T.ShortType()),
    "u32": ("<u4", pa.int64(), T.LongType()), "i32": ("<i4", pa.int32(), T.IntegerType()),
    "i64": ("<i8", pa.int64(), T.LongType()), "f32": ("<f4", pa.float32(), T.FloatType()),
    "f64": ("<f8", pa.float64(), T.DoubleType()),
}


def number_list(raw: Column, type_name: str) -> Column:
    """ARRAY of numbers from a BINARY column that holds whole items; NULL stays NULL."""
    code, item_type, spark_item = CODES[type_name]
    width = np.dtype(code).itemsize

    @F.arrow_udf(T.ArrayType(spark_item))
    def convert(values: pa.Array) -> pa.Array:
        wide = values.cast(pa.binary())
        _, ends, body = wide.buffers()
        ends = np.frombuffer(ends, dtype=np.int32)[wide.offset:wide.offset + len(wide) + 1]
        first, last = int(ends[0]), int(ends[-1])
        flat = np.frombuffer(body, dtype=np.uint8)[first:last].view(code) if last > first else np.empty(0, code)
        items = pa.array(flat.astype(code[1:])).cast(item_type)
        mask = pa.array(np.asarray(values.is_null())) if values.null_count else None
        return pa.ListArray.from_arrays(pa.array((ends - first) // width, pa.int32()), items, mask=mask)

    return convert(raw)
