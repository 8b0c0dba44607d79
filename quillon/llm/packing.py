"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two in n's binary form,
with as many of the longest length as fit. Pieces of equal length form a bucket, and each piece is a
sequence of its own: no sequence crosses documents and none needs padding.

The work is one pass over the documents: no shuffle, and a task holds one Arrow batch. Defined
results: a null or empty text is its end token alone (one piece of length 1); repeated rows and rows
of a null id are packed each; an empty table gives no pieces; texts of any length and runs of white
space of any length are encoded whole; a special token spelled out in a text is ordinary text; extra
columns are ignored. A sequence's number is its task's number and its rank in
the task, the same again when a lost task is run anew over the same split.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

END_TOKEN = 1
MAX_LENGTH = 2048
# Fixed value: how the vocabulary splits texts, but for the rule `\s+(?!\S)`. That rule only matters in
# runs of white space, and without it the expression needs no backtracking.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
SPLIT_RUNS = SPLIT.removesuffix(r"|\s+") + r"|\s+(?!\S)|\s+"
_RUN = re.compile(r"\s\s")
# White space as the expression above knows it, in runs too long for its look ahead.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Token ids of whole texts, from a file of ranks; equal to those of the same vocabulary in `tokenizers`."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        form = lambda split: tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        self.plain, self.runs = form(SPLIT), form(SPLIT_RUNS)

    def encode(self, text: str) -> list[int]:
        if not _RUN.search(text):
            return self.plain.encode_ordinary(text)
        out, at = [], 0
        for run in _LONG_RUN.finditer(text):
            # a run is one piece but for its last character, which goes with what follows
            end = run.end() - (run.end() < len(text))
            out += self.runs.encode_ordinary(text[at : run.start()])
            out += self.runs._encode_single_piece(text[run.start() : end])
            at = end
        return out + self.runs.encode_ordinary(text[at:])


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def decomposition(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens, longest first."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, longest: int = MAX_LENGTH, with_tokens: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length (its bucket), ids_crc32, doc_tokens, sequence_id, offset, and the tokens if asked."""
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    out = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + ([("tokens", pa.list_(pa.int32()))] if with_tokens else [])
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        task = TaskContext.get().partitionId() << 40
        rank = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols: list[list] = [[] for _ in range(8)]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    code = np.asarray([*encode(text or ""), END_TOKEN], dtype="<u4").tobytes()
                    n, start = len(code) // 4, 0
                    for length in decomposition(n, longest):
                        span = code[4 * start : 4 * (start + length)]
                        row = (doc, start, length, zlib.crc32(span), n, task + rank, 0)
                        for c, v in zip(cols, row, strict=False):
                            c.append(v)
                        if with_tokens:
                            cols[7].append(np.frombuffer(span, dtype="<u4").astype(np.int32))
                        start, rank = start + length, rank + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=False)], schema=out)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return d.mapInArrow(pack, ddl + (", tokens array<int>" if with_tokens else ""))


def write_buckets(docs: DataFrame, tokenizer: str, path: str, longest: int = MAX_LENGTH) -> None:
    """Write the packed sequences with one folder per length, so that batches of one length can be read."""
    pieces(docs, tokenizer, longest, with_tokens=True).write.partitionBy("length").parquet(path)
