"""Cost-balanced packing of documents into sequences of bounded length.

A piece of n tokens costs ``n + quadratic * n * n``: what attention inside a
document adds grows with the square. Documents are taken in descending order of
cost; each goes whole to the sequence of lowest cost that can still hold it, or is
cut at the sequence of lowest cost with any room left. The room of a group of
documents is exactly its tokens: full sequences, and for what remains sequences
whose lengths are powers of two, which need no padding.

Packing is narrow: each task packs its own rows in groups of bounded size, and
nothing is shuffled.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from townhall_spark.llm.common import values

SEQUENCE_TOKENS = 1024
GROUP_TOKENS = 2 * 1024 * 1024
# Cost of attention relative to the linear layers, per pair of tokens.
QUADRATIC = 1 / 1024
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_OF_TEXT = "<|endoftext|>"
END_ID = 0

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class Encoder:
    """Ids of ``byte_bpe_50k.json``, special tokens not added.

    The same vocabulary as ranks gives the same ids several times as fast; where that
    reader gives up (white space of a million characters and more), the file's own
    tokenizer reads the text. The special token's string in a text is the special
    token for both.
    """

    def __init__(self, ranks: str | None = None, tokenizer: str | None = None):
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            ids = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids,
            special_tokens={END_OF_TEXT: len(ids)})
        self.path, self.own = tokenizer or public_tokenizers.path(VOCABULARY), None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.own is None:
                self.own = Tokenizer.from_file(self.path)
            return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)


def capacities(tokens: int, most: int = SEQUENCE_TOKENS) -> list[int]:
    """Lengths of the sequences that hold exactly ``tokens``: full ones, then powers of two."""
    full, rest = divmod(tokens, most)
    return [most] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: np.ndarray, most: int = SEQUENCE_TOKENS, quadratic: float = QUADRATIC
         ) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a group.

    Documents over ``most`` tokens first give full sequences; what is left of them
    competes with the other documents. Equal costs keep the order of arrival.
    """
    room = np.array(capacities(int(lengths.sum()), most), np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    pieces, sequence = [], 0
    parts = []
    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= most:
            pieces.append((doc, start, most, sequence, 0))
            room[sequence] = 0
            sequence, start = sequence + 1, start + most
        if start < n:
            parts.append((start - n, doc, start))
    parts.sort()
    first = sequence
    room, size, cost = room[first:], size[first:], cost[first:]
    for left, doc, start in parts:
        n = -left
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            at = int(np.argmin(np.where(fits, cost, np.inf)))
            take = min(n, int(room[at]))
            pieces.append((doc, start, take, first + at, int(size[at] - room[at])))
            room[at] -= take
            cost[at] += take + quadratic * take * take
            start, n = start + take, n - take
    return pieces


def _packed(most: int, group_tokens: int, quadratic: float, files: tuple[str | None, str | None]):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*files)
        # Sequence ids: the partition's number, then a count in it; a task that runs
        # again packs the same rows to the same ids.
        base = TaskContext.get().partitionId() << 40
        held, tokens = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, base
            lengths = np.array([len(ids) for _, ids in held], np.int64)
            rows = [(held[d][0], start, n, zlib.crc32(held[d][1][start:start + n].tobytes()),
                     len(held[d][1]), base + sequence, offset)
                    for d, start, n, sequence, offset in pack(lengths, most, quadratic)]
            base += max((r[5] for r in rows), default=base - 1) - base + 1
            held, tokens = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)], names)

        for batch in batches:
            for key, text in zip(*map(values, batch.columns), strict=True):
                ids = np.append(encode(text), END_ID).astype("<u4")
                held.append((key, ids))
                tokens += len(ids)
                if tokens >= group_tokens:
                    yield flush()
        if held:
            yield flush()
    return run


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   most: int = SEQUENCE_TOKENS, group_tokens: int = GROUP_TOKENS,
                   quadratic: float = QUADRATIC, ranks: str | None = None,
                   tokenizer: str | None = None) -> DataFrame:
    """Every token of every document in exactly one piece of one sequence.

    A document is the ids of its text (null: empty) and the end id 0, so an empty
    text is one token. Repeated rows are packed each by itself; an empty table
    gives an empty table; other columns are not read; rows without a key keep a null one.
    A task holds the ids of one group, ``group_tokens`` and
    its last document. ``ranks`` and ``tokenizer`` are paths of the vocabulary's two
    files, the same on every machine.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_packed(most, group_tokens, quadratic, (ranks, tokenizer)), SCHEMA)
