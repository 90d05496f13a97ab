"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary is merged alone: those that end as one token are proven whole. A pre-token
that is whole counts as one; only the distinct others of a batch are merged. Texts are pre-tokenized whole, in the JVM.

Rows: a null text is empty and has 0 tokens; equal rows get equal counts; null ids stay; other columns are ignored; an
empty table gives an empty result. Special strings inside texts count as the library counts them by default: one token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens

#: The byte-level pre-tokenizer's pattern (fixed value of the tokenizer's kind).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a text above which it is over the limit.
LIMIT = 1024


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that the merges, applied in order of rank, turn into one token. Checked one by one."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
    letters, out = byte_letters(), []
    for word in model["vocab"]:
        parts = list(word)
        while len(parts) > 1:
            rank, at = min((ranks.get((a, b), len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 1:
            try:
                out.append(bytes(letters[c] for c in word).decode())
            except (UnicodeDecodeError, KeyError):
                continue  # parts of characters are never pre-tokens
    return out


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, special: str = "<|endoftext|>", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_pieces (pre-tokens), n_whole (those counted by the shortcut)."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # as large as the vocabulary at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proven = pa.array(whole.value, pa.string())
        for batch in batches:
            offsets, index, words = pretokens.encoded(batch, PATTERN, special)
            is_whole = pc.is_in(words, value_set=proven).to_numpy(zero_copy_only=False)
            n = np.ones(len(words), np.int64)
            rest = words.filter(pa.array(~is_whole)).to_pylist()
            n[~is_whole] = [len(e.ids) for e in _tokenizer(path).encode_batch_fast(rest, add_special_tokens=False)]
            total = np.concatenate([[0], np.cumsum(n[index])])
            short = np.concatenate([[0], np.cumsum(is_whole[index].astype(np.int64))])
            sums = [pa.array(x[offsets[1:]] - x[offsets[:-1]], pa.int64()) for x in (total, short)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pc.add(sums[0], batch.column("n_special")), pa.array(np.diff(offsets), pa.int64()), sums[1]],
                names=["doc_id", "n_bytes", "n_tokens", "n_pieces", "n_whole"],
            )

    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes")
    rows = pretokens.rows_with_pieces(docs, id_col, text_col, PATTERN, special, size)
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, n_pieces bigint, n_whole bigint")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_pieces", "n_whole")
