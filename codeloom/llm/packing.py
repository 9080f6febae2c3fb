"""Packing documents into training sequences by power-of-two decomposition.

A document of n tokens is cut into as many full windows as fit and then into one piece for each binary digit of
the rest. Every piece's length is a power of two and every piece is a sequence of its own, so no sequence crosses
documents and none needs padding; sequences of one length form a bucket, from which batches of one shape are drawn.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

WINDOW = 1024
END = 0
#: Texts with a longer run of one kind (white space or not) go to the slower tokenizer, which is linear in it.
LONG_RUN = 4000
_long = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


class Encoder:
    """The ids of a byte-level BPE file, by its path or its public name. Strings of special tokens in a text are ordinary text.

    Two libraries read the same vocabulary: the faster one encodes, the other takes texts with very long runs.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.plain.encode_special_tokens = True
        vocabulary = self.plain.get_vocab(with_added_tokens=False)
        letters = _byte_letters()
        special = {t.content for t in self.plain.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and _long.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text), np.uint32)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full windows, then the powers of two of the rest, largest first."""
    out = [(i * window, window) for i in range(n // window)]
    at = n - n % window
    for bit in reversed(range(window.bit_length())):
        if n % window >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


_made: dict[str, Encoder] = {}


def _pack(tokenizer: str, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _made.get(tokenizer) or _made.setdefault(tokenizer, Encoder(tokenizer))
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for at in range(0, len(batch), 1000):
                text = batch.column(1).slice(at, 1000).to_pylist()
                rows = []
                for doc, t in zip(docs[at : at + 1000], text, strict=True):
                    ids = np.append(encoder.ids(t or ""), np.uint32(END)).astype("<u4")
                    for start, length in pieces(len(ids), window):
                        piece = ids[start : start + length]
                        rows.append((doc, start, length, zlib.crc32(piece.tobytes()), len(ids), sequence, 0, *([piece] if with_ids else [])))
                        sequence += 1
                types = [pa.int64()] * 7 + ([pa.list_(pa.int64())] if with_ids else [])
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(types)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    return run


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids].

    A document's tokens are its ids and a closing ``END``; start counts from its first. Each piece is the sequence
    ``sequence_id``, at offset 0, and its length, a power of two of at most ``window`` (itself one), is the bucket.
    sequence_id is unique: the input partition's number and a count in it.

    A null or empty text is the one token ``END``. Null and repeated ids are documents like others, each packed on
    its own. Further columns are not read. No rows give no rows.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer, window, with_ids), schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
