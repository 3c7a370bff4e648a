"""A function over the rows of one document at a time, in batches of documents."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Documents whose rows are Python objects at the same time.
AT_ONCE = 256


def folded(d: DataFrame, f: Callable[[object, list], Iterable[tuple]], kind: str) -> DataFrame:
    """What f(doc_id, its rows by ord) returns for every document, as rows of kind.

    A document's rows are gathered before they leave the JVM, so that many documents cross in one Arrow batch: with a frame for each
    document most of the time would go into making frames.
    """
    others = [c for c in d.columns if c not in ("doc_id", "ord")]
    one = F.struct("ord", *[F.col(f"`{c}`") for c in others])
    gathered = d.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("_rows"))
    row = namedtuple("row", ["ord", *others])
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                lists = part.column(1)
                rows = list(map(row._make, zip(*[c.to_pylist() for c in lists.flatten().flatten()])))
                out, at = [], 0
                for doc, n in zip(part.column(0).to_pylist(), lists.value_lengths().to_pylist()):
                    out += f(doc, rows[at : at + n])
                    at += n
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), schema)], schema=schema)

    return gathered.mapInArrow(run, kind)
