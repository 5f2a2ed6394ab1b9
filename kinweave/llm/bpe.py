"""Byte-level BPE by merge replay over the words of the whole corpus, and decoding.

Documents are read once. Each pack of them gives its distinct pre-tokens, dealt by hash over buckets, and its texts as
places in that list. A bucket is one shard of the corpus's word list: an inverted index leads from a token pair's rank
to the word positions where the pair stands, a heap gives the ranks in order, each one's merge is applied at all its
positions, and only the touched neighbours enter the index anew. The ids of a pack's words travel back to it, where
they are put together to the ids of its texts. Merges of a word depend on no other word, so shards need no exchange.

Every word is replayed once for each ``list_bytes`` of text (once in all below that), so that a word of every pack
meets a bounded number of them. Packs and buckets stand for a bounded size of text; a longer text is a pack.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows give equal rows; an empty
table gives an empty table; further columns are ignored. Very long texts are handled whole, one at a time. A lone
surrogate can't reach Python from a Spark string, so every text has UTF-8 bytes.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.pieces import CACHE_PIECES, PieceEncoder
from kinweave.llm.shared import arrow_schema, bounded, give_back, map_batches


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@dataclass(frozen=True)
class Settings:
    #: Text bytes of a pack, of a bucket of words, and of what shares a word list.
    pack_bytes: int = 16_000_000
    bucket_bytes: int = 16 << 20
    list_bytes: int = 512 << 30


class PairRanks(dict):
    """Rank of a pair's merge by ``left << 32 | right``, -1 if there is none; filled as pairs are met."""

    def __init__(self, ranks: dict[bytes, int], tokens: list[bytes]):
        super().__init__()
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, pair: int) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = self[pair] = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
        return found


class Numbers(dict):
    """Numbers from 0 for what is met, in the order of first meetings."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


class PieceList(PieceEncoder):
    """Texts as numbers of their pre-tokens."""

    def __init__(self, pattern: str):
        super().__init__()
        self.split = regex.compile(pattern).findall
        self.numbers = Numbers()

    def encode_each(self, chunks: list[str], texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        split, number = self.split, self.numbers.__getitem__
        return [array("I", map(number, split(" " + chunk))).tobytes() for chunk in chunks], [array("I", map(number, split(text))).tobytes() for text in texts]

    def pack(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """How many pieces each text has, their places in the pack's word list, and that list, frequent words first."""
        if len(self.numbers) > CACHE_PIECES:
            self.numbers.clear()
            self.chunks.clear()
        rows = self.encode_all(texts)
        found = np.frombuffer(b"".join(rows), np.uint32)
        counts = np.bincount(found, minlength=len(self.numbers))
        used = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        places = np.zeros(len(counts), np.uint32)
        places[used] = np.arange(len(used))
        names = list(self.numbers)
        return np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows)), places[found], [names[k].encode() for k in used.tolist()]


class MergeReplay(PieceEncoder):
    """Encodes words by replaying merges over a list of words; decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pairs = PairRanks(ranks, self.tokens)
        self.bytes_at = np.array([ranks.get(bytes((b,)), -1) for b in range(256)])
        single = [b for b in self.bytes_at.tolist() if b >= 0]
        self.pairs_at = np.full((max(single, default=0) + 1,) * 2, -1, np.int64)
        for left in single:
            for right in single:
                self.pairs_at[left, right] = ranks.get(self.tokens[left] + self.tokens[right], -1)

    def encode_each(self, chunks: list[str], texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        pieces = [[self.split(" " + chunk) for chunk in chunks], list(map(self.split, texts))]
        met = set().union(*pieces[0], *pieces[1])
        new = [p for p in met if p not in self.known]
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known = {p: self.known[p] for p in met if p in self.known}
        for piece, ids in zip(new, self.replay([p.encode() for p in new]), strict=True):
            self.known[piece] = array("I", ids).tobytes()
        ids_of = self.known.__getitem__
        return tuple([b"".join(map(ids_of, got)) for got in part] for part in pieces)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        collects = gc.isenabled()
        gc.disable()  # the index is many small lists without cycles
        try:
            return self._replay(words)
        finally:
            if collects:
                gc.enable()

    def _replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word.

        ``ids`` holds the tokens of all words, one after the other; ``before`` and ``after`` link living positions,
        -1 at a word's ends. A position stands for the pair that starts there.
        """
        if not words:
            return []
        pairs = self.pairs
        first = self.bytes_at[np.frombuffer(b"".join(words), np.uint8)]
        size = len(first)
        starts = np.cumsum([0, *map(len, words)])[:-1]
        own = np.full(size, -1, np.int64)  # rank of the pair that starts at each position
        own[:-1] = self.pairs_at[first[:-1], first[1:]]
        own[starts[1:] - 1] = -1
        before, after = np.arange(-1, size - 1), np.arange(1, size + 1)
        before[starts] = -1
        after[starts[1:] - 1] = after[-1] = -1
        places = np.flatnonzero(own >= 0)
        places = places[np.argsort(own[places], kind="stable")]
        edges = np.flatnonzero(np.r_[True, own[places][1:] != own[places][:-1], True]) if len(places) else np.zeros(1, np.int64)
        order = own[places[edges[:-1]]].tolist()
        flat, edges = places.tolist(), edges.tolist()
        index = {rank: flat[i:j] for rank, i, j in zip(order, edges[:-1], edges[1:], strict=True)}
        ids, own, before, after, starts = first.tolist(), own.tolist(), before.tolist(), after.tolist(), starts.tolist()
        while order:
            rank = heappop(order)
            places = index.pop(rank, None)
            if places is None:
                continue
            if len(places) > 1:
                places.sort()
            until = -1  # end of the word in which a merge made a pair of a lower rank: that one comes first there
            later = []
            for at in places:
                if at < until:
                    later.append(at)
                    continue
                if own[at] != rank:
                    continue  # a merge of a neighbour took this position
                follower = after[at]
                ids[at], ids[follower], own[follower] = rank, -1, -1
                end = after[at] = after[follower]
                lower = False
                new = -1
                if end >= 0:
                    before[end] = at
                    new = pairs[rank << 32 | ids[end]]
                    if new >= 0:
                        lower = new < rank
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heappush(order, new)
                own[at] = new
                start = before[at]
                if start >= 0:
                    new = own[start] = pairs[ids[start] << 32 | rank]
                    if new >= 0:
                        lower = lower or new < rank
                        if new in index:
                            index[new].append(start)
                        else:
                            index[new] = [start]
                            heappush(order, new)
                if lower:
                    k = bisect_right(starts, at)
                    until = starts[k] if k < len(starts) else size
            if later:
                if rank in index:
                    index[rank] += later
                else:
                    index[rank] = later
                    heappush(order, rank)
        ends = [*starts[1:], len(ids)]
        return [[x for x in ids[a:b] if x >= 0] for a, b in zip(starts, ends, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_replays: dict[tuple[str, str], MergeReplay] = {}


def replay_of(path: str, pattern: str) -> MergeReplay:
    """One per worker and vocabulary, kept between tasks."""
    if (path, pattern) not in _replays:
        _replays[path, pattern] = MergeReplay(read_ranks(path), pattern)
    return _replays[path, pattern]


def numbers_in(data: bytes) -> np.ndarray:
    """The integers of ``written``."""
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def written(numbers: np.ndarray) -> bytes:
    """Integers below 2**32, compressed: their lowest bytes, then the next ones."""
    raw = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts`` and have ``counts`` entries, for each of ``chosen``, joined."""
    n = counts[chosen]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[chosen] - ends + n, n) + np.arange(n.sum())]


def replayed(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, settings: Settings, finish: Callable[[list, list[bytes]], dict], schema: str) -> DataFrame:
    """Rows of ``schema``, made by ``finish`` of the documents' ids and of their token ids."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    lists = max(1, -(-size // settings.list_bytes))
    buckets = max(1, -(-size // (lists * settings.bucket_bytes)))
    # A row with key >= 0 has the documents of the pack ``key``: ids, pieces of each, places of the pieces in the word
    # list, bucket of each word. A negative key is a bucket's, with the sizes and bytes of words, or their numbers of ids and ids.
    message = f"key long, pack long, ids array<{dict(docs.dtypes)[id_col]}>, sizes binary, data binary, deal binary"
    rows, result = arrow_schema(docs.sparkSession, message), arrow_schema(docs.sparkSession, schema)

    def made(columns: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*columns, strict=True), rows, strict=True)], schema=rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, pieces = TaskContext.get().partitionId(), PieceList(pattern)
        for at, (ids, texts) in enumerate(bounded(batches, settings.pack_bytes)):
            pack = task << 32 | at
            sizes, places, words = pieces.pack(texts)
            deal = (np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64) % np.uint64(buckets)).astype(np.int64)
            out = [(pack, pack, ids, written(sizes), written(places), written(deal))]
            order = np.argsort(deal, kind="stable")
            words = [words[k] for k in order.tolist()]
            edges = np.flatnonzero(np.diff(deal[order], prepend=-1, append=buckets))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                bucket = task % lists * buckets + int(deal[order[a]])
                part = words[a:b]
                out.append((-1 - bucket, pack, None, written(np.fromiter(map(len, part), np.int64, b - a)), zstandard.compress(b"".join(part), 1), None))
            for k in range(0, len(out), 2000):
                yield made(out[k : k + 2000])
        del pieces
        give_back()

    def answer(table: pa.Table) -> pa.Table:
        if table["key"][0].as_py() >= 0:
            return table.select(rows.names).cast(rows)
        words, asked = Numbers(), []
        for sizes, data in zip(table["sizes"].to_pylist(), table["data"].to_pylist(), strict=True):
            ends, data = np.cumsum(numbers_in(sizes)).tolist(), zstandard.decompress(data)
            asked.append(np.fromiter((words[data[a:b]] for a, b in zip([0, *ends[:-1]], ends, strict=True)), np.int64, len(ends)))
        ids = replay_of(ranks_path, pattern).replay(list(words))
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, counts.sum())
        starts = np.cumsum(counts) - counts
        del ids
        out = [(key, pack, None, written(counts[own]), written(gathered(flat, starts, counts, own)), None) for key, pack, own in zip(table["key"].to_pylist(), table["pack"].to_pylist(), asked, strict=True)]
        return pa.Table.from_batches([made(out)])

    def join(table: pa.Table) -> pa.Table:
        own = table.filter(pc.greater_equal(table["key"], 0)).to_pylist()[0]
        found = table.filter(pc.less(table["key"], 0)).sort_by([("key", "descending")])
        none = np.empty(0, np.int64)
        order = np.argsort(numbers_in(own["deal"]), kind="stable")
        given = np.concatenate([none, *map(numbers_in, found["sizes"].to_pylist())])
        if len(given) != len(order):
            raise RuntimeError(f"{len(order)} words of a pack have {len(given)} answers")
        counts, starts = np.empty_like(given), np.empty_like(given)
        counts[order], starts[order] = given, np.cumsum(given) - given
        flat = np.concatenate([none, *map(numbers_in, found["data"].to_pylist())]).astype("<u4")
        places = numbers_in(own["data"])
        ids = gathered(flat, starts, counts, places)
        ends = np.concatenate([[0], np.cumsum(counts[places])])[np.cumsum(numbers_in(own["sizes"]))].tolist()
        return pa.Table.from_pydict(finish(own["ids"], [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]), schema=result)

    asked = docs.select(id_col, text_col).mapInArrow(ask, message)
    return asked.groupBy("key").applyInArrow(answer, message).groupBy("pack").applyInArrow(join, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``id_col``, ``ids`` (binary: little-endian unsigned 32-bit). The rank file must exist on every machine."""
    return replayed(docs, ranks_path, pattern, id_col, text_col, settings, lambda keys, ids: {id_col: keys, "ids": ids}, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids``, ``decoded`` (binary: the bytes of the text)."""

    def run(keys: list, ids: list) -> dict:
        replay = replay_of(ranks_path, pattern)
        return {id_col: keys, "ids": ids, "decoded": [None if x is None else replay.decode(x) for x in ids]}

    return map_batches(encoded, [id_col, ids_col], run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Digests of each text's ids and of the bytes that they decode to."""

    def digests(keys: list, ids: list[bytes]) -> dict:
        replay = replay_of(ranks_path, pattern)
        return {
            id_col: keys,
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(replay.decode(x)).hexdigest() for x in ids],
        }

    return replayed(docs, ranks_path, pattern, id_col, text_col, settings, digests, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
