"""The whole corpus encoded by a public byte-level BPE tokenizer.

The vocabulary is a local rank file, its path a parameter. Long texts are cut
before they reach the merges, only where the pre-tokenizer always cuts too:
before white space that follows something else, so that the pieces' ids in a
row are the text's ids.

Defined results: null and empty texts give an empty list; a text that looks
like a special token is plain text; any string, also of white space, control
characters or mixed scripts, decodes to its own bytes again.
"""

from __future__ import annotations

import base64
import os
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from paperlake.session import spread

#: Folder of the vocabulary files, the same on every executor.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
# Fixed value: the public pre-tokenizer pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this are cut into pieces of about this many characters.
PIECE = 50_000


def encoding(name: str = TOKENIZER, folder: str = TOKENIZER_DIR):
    """The tiktoken encoding of ``<folder>/<name>.tiktoken``, loaded once per process."""
    import tiktoken

    kept = sys.modules.setdefault("_paperlake_kept", types.ModuleType("_paperlake_kept")).__dict__
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        kept[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces cut only before white space that follows a character of another kind."""
    import regex

    safe = regex.compile(r"(?<=\S)(?=\s)")
    start = 0
    while len(text) - start > size:
        cut = safe.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str | None, size: int = PIECE) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for p in pieces(text, size):
        ids += enc.encode_ordinary(p)
    return ids


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``ids`` (array of int) of each row."""

    def run(batches):
        enc = encoding(name, folder)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            step = 256
            for i in range(0, b.num_rows, step):
                ids = [encode_text(enc, t) for t in texts.slice(i, step).to_pylist()]
                yield pa.RecordBatch.from_arrays([keys.slice(i, step), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return spread(docs.select(key, text)).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, key: str = "doc_id", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``bytes`` (binary) of each row of ``encode``; null ids give null."""

    def run(batches):
        enc = encoding(name, folder)
        for b in batches:
            out = [None if x is None else enc.decode_bytes(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [key, "bytes"])

    return coded.select(key, "ids").mapInArrow(run, f"{key} {coded.schema[key].dataType.simpleString()}, bytes binary")


def count(docs: DataFrame, columns: list[str], text: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``columns`` and ``tokens`` (long), the length of each row's ids."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        enc = encoding(name, folder)
        for b in batches:
            n = [len(encode_text(enc, t)) for t in b.column(b.num_columns - 1).to_pylist()]
            arrays = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64())], [*columns, "tokens"])

    return spread(docs.select(*columns, text)).mapInArrow(run, f"{kinds}, tokens long")
