"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut at safe boundaries first: before a blank or line feed that follows a character which
is no white space. There every match of the pattern ends, so the ids are those of the whole text. Long runs
of white space, on which the pattern's matcher runs out of stack, are matched here and encoded by the ranks.

Defined results: a null text counts as empty and gives no ids. Ids decode to the exact bytes of the text, of
any length, also where it is one run of white space. Repeated rows stay, and equal texts get equal ids. An empty
table gives an empty result. Other columns are carried; the column made replaces one of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heightline.llm.columns import others
from heightline.llm.text import tidied
from heightline.staging import extended

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG = 1 << 16
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")
#: A run of white space of at least RUN characters, as the pattern's \s has it, from its first.
RUN = 4096
_RUNS = r"(?<![^\S\x1c-\x1f])[^\S\x1c-\x1f]{%d,}"


@lru_cache(4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = LONG) -> Iterator[str]:
    """Cuts text at the first safe boundary after each `limit` characters."""
    at = 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(text: str, enc: tiktoken.Encoding, limit: int = LONG, run: int = RUN) -> np.ndarray:
    """Ids of the whole text. A run of white space is one match but for its last character where more text follows."""
    if len(text) <= limit:
        return np.asarray(enc.encode_ordinary(text), "<u4")
    coded, at = [], 0
    for found in re.finditer(_RUNS % max(run, 2), text):
        end = found.end() - (found.end() < len(text))
        coded += [enc.encode_ordinary(p) for p in pieces(text[at : found.start()], limit)]
        coded.append(enc._encode_single_piece(text[found.start() : end]))
        at = end
    coded += [enc.encode_ordinary(p) for p in pieces(text[at:], limit)]
    return np.concatenate([np.asarray(ids, "<u4") for ids in coded])


def encode_column(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of little-endian unsigned 32-bit ids in place of `text`."""
    kept = others(docs.columns, text, ids)

    @tidied
    def run(batches):
        enc = encoding(path)
        for batch in batches:
            coded = [encode(t or "", enc).tobytes() for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(coded, pa.binary())], [*kept, ids])

    return docs.select(*kept, F.col(text).alias(ids)).mapInArrow(run, extended(docs.select(*kept), f"`{ids}` binary"))


def decode_column(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with the raw bytes that its ids stand for in place of `ids`."""
    kept = others(coded.columns, ids, out)

    @tidied
    def run(batches):
        enc = encoding(path)
        for batch in batches:
            raw = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], [*kept, out])

    return coded.select(*kept, F.col(ids).alias(out)).mapInArrow(run, extended(coded.select(*kept), f"`{out}` binary"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    coded = encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    digest = coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode_column(digest, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
