"""Vector bin packing of token pieces into sequences, by the dot-product heuristic.

A sequence has three capacities: tokens, segments (pieces) and loss-bearing tokens. Of the pieces that still fit, the
one whose demand has the largest dot product with what is left of the capacities goes in next, each dimension
weighted by the pool's mean demand. Where nothing fits whole and cutting is allowed, the best piece is cut at the gap.
A sequence that can't be filled is divided at powers of two, so that it needs no padding either.

Each bounded batch of documents is packed by itself: nothing is gathered beyond it, and what is left open is one
sequence a batch.

Defined results: a null or empty text is its end id alone; repeated rows are packed each by itself; of pieces with
equal dot products the first in the batch goes in; an empty table gives an empty table; long texts fill as many whole
sequences as they can; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinweave.llm.shared import arrow_schema, bounded, give_back

#: A task numbers its sequences from its partition's number shifted by so many bits.
PARTITION_BITS = 36


#: Characters whose documents are packed together.
PACKED_CHARS = 8_000_000


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


#: Texts of these characters only: letter, number and space classes have been the same in all versions of Unicode.
STABLE = re.compile("[\t\n\r\x20-\x7e\u00a1-\u024f]*")


class VocabularyIds:
    """Ids of texts as the tokenizers library gives them, the strings of its added tokens included.

    tiktoken's merges (any neighbours whose concatenation is a token, lowest id first) give the same ids as the
    library's merge list if each token's own string encodes to that one token: as long as no merge crosses a token's
    ends, the merges within it are those of the token alone, which end in it. That is checked for the whole
    vocabulary on loading; texts with other than STABLE characters, for which the two libraries' character classes
    might differ, texts that hold an added token's string, and vocabularies that fail the check or normalise take the
    slower way.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)")
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab().items() if i not in added}
        model = self.tokenizer.model
        same = self.tokenizer.normalizer is None and all(len(x := model.tokenize(t)) == 1 and x[0].id == i for t, i in vocabulary.items())
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items()}, special_tokens={}) if same else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast and STABLE.fullmatch(text) and not self.added.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(byte if byte in plain else next(others)) for byte in range(256)]


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool = True) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length).

    ``tokens``, ``loss``: each item's length and how many of its leading tokens bear loss. Without ``cut``, items must
    fit a sequence whole and each stays in one piece; a sequence may then hold less than it could.
    """
    if not cut and ((tokens > limits.tokens) | (loss > limits.loss)).any():
        raise ValueError("an item exceeds the limits and may not be cut")
    whole = min(limits.tokens, limits.loss)
    start = np.zeros(len(tokens), np.int64)
    if cut:
        for item in np.flatnonzero(tokens >= whole).tolist():
            size = int(tokens[item])
            for at in range(0, size - whole + 1, whole):
                yield [(item, at, whole)]
            start[item] = size // whole * whole
    left, bears = tokens - start, np.maximum(loss - start, 0)
    pool = np.flatnonzero(left > 0)
    demand = np.stack([left[pool], np.ones(len(pool), np.int64), bears[pool]], 1).astype(np.float64)
    capacity = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    weight = demand.mean(0) / capacity**2 if len(pool) else capacity
    while len(pool):
        free, held = capacity.copy(), []
        open_ = np.ones(len(pool), bool)
        while free[0] >= 1 and free[1] >= 1:
            score = demand @ (weight * free)
            fits = open_ & (demand <= free).all(1)
            if fits.any():
                best = int(np.where(fits, score, -1.0).argmax())
                size = int(demand[best, 0])
            elif cut and open_.any() and (free[2] >= 1 or (demand[open_, 2] == 0).any()):
                able = open_ if free[2] >= 1 else open_ & (demand[:, 2] == 0)
                best = int(np.where(able, score, -1.0).argmax())
                size = int(min(free[0], free[2] if demand[best, 2] > free[2] else free[0], demand[best, 0]))
            else:
                break
            item, bear = int(pool[best]), min(size, demand[best, 2])
            held.append((item, int(start[item]), size))
            start[item] += size
            free -= (size, 1, bear)
            demand[best, 0] -= size
            demand[best, 2] -= bear
            open_[best] = demand[best, 0] > 0
        yield from powers(held, limits.tokens) if cut else [held]
        stay = demand[:, 0] > 0
        pool, demand = pool[stay], demand[stay]


def powers(held: list[tuple[int, int, int]], full: int) -> Iterator[list[tuple[int, int, int]]]:
    """A sequence that isn't full, divided into sequences with a power of two tokens each."""
    total = sum(size for _, _, size in held)
    if total == full or not total & (total - 1):
        yield held
        return
    room, now = 1 << (total.bit_length() - 1), []
    for item, at, size in held:
        while size:
            take = min(size, room)
            now.append((item, at, take))
            at, size, room, total = at + take, size - take, room - take, total - take
            if not room:
                yield now
                room, now = 1 << (total.bit_length() - 1) if total else 0, []


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, limits: Limits = Limits(), end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: where it stands in its document and in its sequence, its ids' CRC-32 and the ids.

    A document's end id bears no loss. The tokenizer file must exist on every machine.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_segments long, loss_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = VocabularyIds(tokenizer_path, pattern)
        sequence = TaskContext.get().partitionId() << PARTITION_BITS
        end = np.array([end_id], "<u4").tobytes()
        for keys, texts in bounded(batches, PACKED_CHARS):
            ids = [encoder.ids(text or "").astype("<u4", copy=False).tobytes() + end for text in texts]
            tokens = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            sizes = tokens.tolist()
            rows = []
            for held in pack(tokens, tokens - 1, limits):
                offset = 0
                for item, at, size in held:
                    rows.append((keys[item], at, size, zlib.crc32(ids[item][4 * at : 4 * (at + size)]), sizes[item], sequence, offset, len(held), min(size, sizes[item] - 1 - at)))
                    offset += size
                sequence += 1
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 20_000], strict=True), arrow, strict=True)], schema=arrow)
        del encoder
        give_back()

    arrow = arrow_schema(docs.sparkSession, schema)
    return docs.select(id_col, text_col).mapInArrow(run, schema)
