"""What several operators share: word rules, safe counts, batches of documents for Python operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII space and the controls U+0009 to U+000D. ``bytes.split()`` uses the same six bytes.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """The array of words of a text, natively; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != F.lit(""))


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty, without building Python strings."""
    array = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    for value in array:
        yield value.as_py() or b""


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores as keep it apart from the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(docs: DataFrame, *names: str) -> DataFrame:
    """These columns alone: further columns of the input cannot clash with names that an operator makes."""
    return docs.select(*[docs[n] for n in names])
