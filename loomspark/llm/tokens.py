"""Token counts with a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: The pre-tokenizing pattern that belongs to the byte-level BPE vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Default vocabulary: ranks of a byte-level BPE.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longer texts are encoded in parts of about this many characters, to bound the memory of one call.
SLICE = 1_000_000
#: No token reaches from a character that isn't a space into a space, so a text can be cut there.
_CUT = re.compile(r"\S(?=\s)")


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The encoder of a vocabulary file of base64 tokens and ranks; once per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = VOCABULARY, slice_: int = SLICE) -> int:
    """Number of tokens of a text. Long texts are counted in parts that the pattern separates anyway, so the sum is exact."""
    own = encoding(path)
    total, a = 0, 0
    while a < len(text):
        at = _CUT.search(text, a + slice_) if a + slice_ < len(text) else None
        b = at.end() if at else len(text)
        total += len(own.encode_ordinary(text[a:b]))
        a = b
    return total


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """(id, tokens): the number of tokens of each text; 0 for null and empty ones. One row per row.

    The vocabulary file is read on the driver's machine and sent to the executors.
    """
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.int64())])
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = SparkFiles.get(name)
        for batch in batches:
            counts = [count_tokens(t, here) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64())], schema=schema)

    return df.select(id_col, text_col).mapInArrow(run, "id long, tokens long")
