"""Pre-tokens of whole texts: the pattern runs in the JVM, Python tasks get them as dictionary-encoded Arrow arrays."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship


def split_columns(text: Column, pattern: str, special: str | None = None) -> dict[str, Column]:
    """``pieces``: the matches of ``pattern`` in the text between occurrences of ``special``; ``n_special``: how many.

    Letters that Unicode has assigned since the JVM's version would match otherwise: texts that hold a code point the
    JVM does not know come as ``odd`` and are split in Python.
    """
    parts = F.split(text, r"\Q" + special + r"\E") if special else F.array(text)
    odd = text.rlike(r"\p{Cn}")
    found = lambda t: F.regexp_extract_all(t, F.lit("(?U)" + pattern), F.lit(0))
    pieces = F.flatten(F.transform(parts, found)) if special else found(text)
    return {
        "pieces": F.when(odd, F.array().cast("array<string>")).otherwise(pieces),
        "n_special": (F.size(parts) - 1).cast("long"),
        "odd": F.when(odd, text),
    }


@cache
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def encoded(batch: pa.RecordBatch, pattern: str, special: str | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets per text, index of each pre-token in the dictionary, dictionary of distinct pre-tokens."""
    pieces = batch.column("pieces")
    if batch.column("odd").null_count < batch.num_rows:
        lists = pieces.to_pylist()
        for i, text in enumerate(batch.column("odd").to_pylist()):
            if text is not None:
                parts = text.split(special) if special else [text]
                lists[i] = [x for part in parts for x in _splitter(pattern).findall(part)]
        pieces = pa.array(lists, pa.list_(pa.string()))
    offsets = pieces.offsets.to_numpy()
    words = pieces.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else pieces.values
    found = pc.dictionary_encode(words)
    return offsets - offsets[0], found.indices.to_numpy(), found.dictionary


def rows_with_pieces(docs: DataFrame, id_col: str, text_col: str, pattern: str, special: str | None, *more: Column) -> DataFrame:
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), *more, *[c.alias(k) for k, c in split_columns(text, pattern, special).items()])
