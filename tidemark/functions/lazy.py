"""Arrow functions that are made on first use, so modules can be imported where there
is no session: in executors' Python workers.  They do without pandas, which would be most
of a worker's memory."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Rows of a batch that a function has as Python values at a time.
ROWS = 256


def arrow_type(kind: str) -> pa.DataType:
    """Of a text, an array of texts, or names of texts."""
    plain = {"string": pa.string(), "array<string>": pa.list_(pa.string())}
    return plain.get(kind) or pa.struct([(k.split()[0], pa.string()) for k in kind.split(", ")])


def arrow_function(kind: str, nulls: bool = False) -> Callable:
    """A decorator like ``arrow_udf`` for functions of lists of values that give a list;
    ``kind`` is the type of the result.  ``nulls`` says that nulls give nulls, so batches
    of nothing else are not looked at."""

    def wrap(f: Callable) -> Callable[..., Column]:
        made: list[Callable] = []
        rows = ROWS

        def run(*columns: pa.Array) -> pa.Array:
            to = arrow_type(kind)
            if nulls and all(c.null_count == len(c) for c in columns):
                return pa.nulls(len(columns[0]), to)
            done = [pa.array(f(*(c.slice(lo, rows).to_pylist() for c in columns)), to) for lo in range(0, len(columns[0]), rows)]
            return pa.concat_arrays(done) if done else pa.array([], to)

        def call(*columns: Column) -> Column:
            if not made:
                made.append(F.arrow_udf(run, kind))
            return made[0](*columns)

        call.__doc__, call.plain = f.__doc__, f
        return call

    return wrap
