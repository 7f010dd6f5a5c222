"""Sizes of texts in tokens of a public byte-level BPE vocabulary; the vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("LUTRIN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Code points handed to the tokenizer at once; longer texts are cut before a space, where no token crosses.
PART = 100_000


@functools.cache
def _encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; 0 for null and empty texts."""
    if not text:
        return 0
    encode, n, at = _encoding(path).encode_ordinary, 0, 0
    while len(text) - at > PART:
        cut = text.rfind(" ", at + 1, at + PART)
        # The space must stand alone between two letters: then it starts a token by the pattern.
        while cut > at and not (text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            break
        n, at = n + len(encode(text[at:cut])), cut
    return n + len(encode(text[at:]))


def sized(rows: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """rows' columns `keep` and `tokens`; the text itself is read by the workers only."""
    fields = [rows.schema[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count(t, path) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], [*keep, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tokens long"
    return rows.select(F.col(text), *keep).mapInArrow(run, schema)
