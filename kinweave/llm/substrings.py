"""Substring deduplication by suffix automata of reference passages and matching statistics.

``remove_references`` takes a reference of proven size: its shards' automata are broadcast and documents stream past.

``remove_repeats`` has the corpus for its own reference, which nothing may broadcast. There the reference passages are
found first. (1) Each bounded batch hashes its windows of ``least`` words, keeps the first of equal ones and sends the
rest of the batch nothing but their place: a hot window is one entry a batch. (2) Buckets by hash, sized by the
corpus, find windows whose first place is elsewhere. (3) Buckets by document join such windows to runs, each with the
passage of the earlier document that it points to. (4) The passages are cut out and go, as the reference shard of
their readers, to the documents; there the passages' suffix automata give the matching statistics of the documents'
runs, word by word, and what matches ``least`` words or more is removed. Hashes thus only propose; automata decide.

Defined results: a null or empty text has no words and stays so; texts shorter than a window keep all words; the
earliest place (smaller id, then earlier start) of a passage stays; a null id counts as the largest; rows that share
an id count as one document, whose equal starts don't remove each other; an empty table gives an empty table; further
columns, whatever their names, are ignored unless carried. Ids must be integers; 2**63 - 1 stands with the null ids.
Texts of any length are handled whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.automaton import SuffixAutomaton, long_matches
from kinweave.llm.shared import BATCH_CHARS, arrow_schema, bounded, give_back, hashed, map_batches, materialise, windows, words_of

LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    least: int = 20
    #: Text bytes that a hash bucket stands for: the smaller number until there are ``buckets`` of them, then up to the
    #: larger. A bucket's comparison takes about 82 bytes a window, of which 16 MB of text have some 2.7 million.
    bucket_bytes: int = 4 << 20
    large_bucket_bytes: int = 16 << 20
    buckets: int = 256
    #: Passages' places are broadcast up to so many (24 bytes each); else they meet the texts by a shuffle.
    broadcast_rows: int = 500_000
    #: Automata that a task keeps for the passages that many documents share.
    kept_automata: int = 256


def packed(*columns: np.ndarray) -> bytes:
    """Integer columns as differences, compressed."""
    return zstandard.compress(b"".join(np.diff(c.astype(np.int64), prepend=np.int64(0)).tobytes() for c in columns), 1)


def unpacked(data: bytes, number: int) -> np.ndarray:
    """The columns of ``packed``, one row each."""
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.int64).reshape(number, -1), axis=1)


def cuts(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of the runs of equal sorted keys."""
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(keys[a]), a, b


def firsts(hashes: np.ndarray) -> np.ndarray:
    """For each entry the index of the first entry with its hash; entries are in the order of their places."""
    order = np.argsort(hashes, kind="stable")
    new = np.r_[True, hashes[order][1:] != hashes[order][:-1]] if len(order) else np.zeros(0, bool)
    found = np.empty(len(order), np.int64)
    found[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    return found


ASK, KNOWN = 0, 1
MESSAGE = "bucket long, kind int, entries long, hashes binary, places binary"


def propose(rows: DataFrame, settings: Settings, buckets: int) -> DataFrame:
    """Runs of windows that repeat an earlier place: ``_id, first, n, source, low, high`` (the passage's words)."""
    n = settings.least
    message = arrow_schema(rows.sparkSession, MESSAGE)

    def sent(kind: int, keys: np.ndarray, hashes: np.ndarray | None, *places: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(keys, kind="stable")
        places = tuple(p[order] for p in places)
        hashes = hashes[order] if hashes is not None else None
        for key, a, b in cuts(keys[order]):
            yield key, kind, b - a, hashes[a:b].tobytes() if hashes is not None else b"", packed(*(p[a:b] for p in places))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), message, strict=True)], schema=message)

    def bucket_of(ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for ids, texts in bounded(batches, 2 * BATCH_CHARS):
            order = sorted(range(len(ids)), key=ids.__getitem__)
            parts = [windows(hashed(words_of(texts[k])), n) for k in order]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            if not len(hashes):
                continue
            ids_ = np.repeat(np.array([ids[k] for k in order], np.int64), sizes)
            starts = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = firsts(hashes)
            # rows of one id may stand at the same place
            own = first == np.arange(len(hashes))
            again = ~own & ~((ids_ == ids_[first]) & (starts == starts[first]))
            found = list(sent(ASK, ((hashes[own] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), hashes[own], ids_[own], starts[own]))
            if again.any():
                found += sent(KNOWN, bucket_of(ids_[again]), None, ids_[again], starts[again], ids_[first[again]], starts[first[again]] - starts[again])
            for k in range(0, len(found), 2000):
                yield made(found[k : k + 2000])
        give_back()

    def compare(table: pa.Table) -> pa.Table:
        asks = table.filter(pc.equal(table["kind"], ASK))
        passed = table.filter(pc.equal(table["kind"], KNOWN)).select(message.names).cast(message)
        del table
        out = []
        if asks.num_rows:
            ids, starts = np.concatenate([unpacked(p.as_py(), 2) for p in asks["places"]], axis=1)
            all_hashes = np.concatenate([np.frombuffer(h.as_py(), np.uint64) for h in asks["hashes"]])
            del asks
            order = np.lexsort((starts, ids))
            ids, starts = ids[order], starts[order]
            first = firsts(all_hashes[order])
            again = (first != np.arange(len(first))) & ~((ids == ids[first]) & (starts == starts[first]))
            if again.any():
                out += sent(KNOWN, bucket_of(ids[again]), None, ids[again], starts[again], ids[first[again]], starts[first[again]] - starts[again])
        give_back()
        return pa.concat_tables([passed, pa.Table.from_batches([made(out)] if out else [], message)])

    def runs(table: pa.Table) -> pa.Table:
        ids, starts, sources, shifts = np.concatenate([unpacked(p.as_py(), 4) for p in table["places"]], axis=1)
        del table
        order = np.lexsort((starts, ids))
        ids, starts, sources, froms = ids[order], starts[order], sources[order], (shifts + starts)[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (starts[1:] - starts[:-1] > 1) | (sources[1:] != sources[:-1])]
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        # within a run, the windows' passages join to intervals
        by = np.lexsort((froms, run))
        start_of = np.r_[True, (run[by][1:] != run[by][:-1]) | (froms[by][1:] > froms[by][:-1] + n)]
        edge = np.flatnonzero(start_of)
        ends = np.r_[edge[1:], len(by)] - 1
        head = np.flatnonzero(new)[run[by][edge]]
        last = head + size[run[by][edge]] - 1
        columns = [ids[head], starts[head], starts[last] - starts[head] + 1, sources[head], froms[by][edge], froms[by][ends] + n]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=found)

    schema = "_id long, first long, n long, source long, low long, high long"
    found = arrow_schema(rows.sparkSession, schema)
    asked = rows.select("_id", "_text").mapInArrow(hash_all, MESSAGE)
    return asked.groupBy("bucket").applyInArrow(compare, MESSAGE).groupBy("bucket").applyInArrow(runs, schema)


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``carry``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space)."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), F.col(id_col).cast("long").alias("_given"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(1, min(settings.buckets, -(-size // settings.bucket_bytes)), -(-size // settings.large_bucket_bytes))
    spans = materialise(propose(rows, settings, buckets), "spans")
    needs = materialise(spans.select("source", "low", "high").distinct(), "needs")
    few = needs.count() <= settings.broadcast_rows
    texts = rows.select(F.col("_id").alias("source"), "_text")
    words = F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    passages = texts.join(F.broadcast(needs) if few else needs, "source").select("source", "low", "high", F.array_join(F.slice(words, (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")), " ").alias("passage"))
    passages = materialise(passages, "passages")
    read = spans.join(passages, ["source", "low", "high"]).groupBy("_id").agg(F.collect_list(F.struct("first", "n", "passage")).alias("_runs"))
    types = dict(rows.dtypes)
    columns = ["_given", "_text", *(f"_c{k}" for k in range(len(carry))), "_runs"]
    kept = [f"_c{k}" for k in range(len(carry))]
    least = settings.least

    def clean(*values: list) -> dict:
        given = dict(zip(columns, values, strict=True))
        automata: dict[tuple[str, ...], SuffixAutomaton] = {}
        counts, removed, texts = [], [], []
        for text, marked in zip(given["_text"], given["_runs"], strict=True):
            words = words_of(text)
            gone = bytearray(len(words))
            by_run: dict[tuple[int, int], set[str]] = {}
            for run in marked or ():
                by_run.setdefault((run["first"], run["n"]), set()).add(run["passage"])
            for (first, n), passages in by_run.items():
                key = tuple(sorted(passages))
                automaton = automata.get(key)
                if automaton is None:
                    if len(automata) >= settings.kept_automata:
                        automata.clear()
                    automaton = automata[key] = SuffixAutomaton(words_of(p) for p in key)
                for a, b in long_matches(automaton.statistics(words[first : first + n + least - 1]), least):
                    gone[first + a : first + b] = b"\1" * (b - a)
            counts.append(len(words))
            removed.append(gone.count(1))
            stay = [w for w, out in zip(words, gone, strict=True) if not out] if marked else words
            texts.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
        return {"_id": given["_given"]} | {c: given[c] for c in kept} | {"n_words": counts, "n_removed": removed, "kept": texts}

    schema = ", ".join(["_id long", *(f"{c} {types[c]}" for c in kept), "n_words long, n_removed long, kept string"])
    done = map_batches(rows.join(read, "_id", "left"), columns, clean, schema)
    names = [id_col, *carry, "n_words", "n_removed", "kept"]
    return done.toDF(*names)


def remove_references(docs: DataFrame, reference: DataFrame, least: int = 20, shard_words: int = 200_000, most_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text") -> DataFrame:
    """Remove from ``docs`` what matches ``least`` words or more of ``reference``, whose size must stay under ``most_bytes``.

    The reference goes to each task as a broadcast variable, in shards of about ``shard_words`` words; a task has the
    automaton of one shard at a time and passes its batch of documents by it.
    """
    size = reference.agg(F.sum(F.octet_length(reference_col))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the reference has {size} bytes, more than may be broadcast")
    shards: list[list[str]] = [[]]
    count = 0
    for row in reference.select(reference_col).filter(F.col(reference_col).isNotNull()).distinct().toLocalIterator():
        if count > shard_words:
            shards.append([])
            count = 0
        shards[-1].append(row[0])
        count += len(words_of(row[0]))
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    def clean(ids: list, texts: list) -> dict:
        words = [words_of(t) for t in texts]
        gone = [bytearray(len(w)) for w in words]
        for shard in sent.value:
            automaton = SuffixAutomaton(words_of(p) for p in shard)
            for own, marks in zip(words, gone, strict=True):
                for a, b in long_matches(automaton.statistics(own), least):
                    marks[a:b] = b"\1" * (b - a)
        kept = [b" ".join([w for w, out in zip(own, marks, strict=True) if not out]).decode("utf-8", "surrogatepass") for own, marks in zip(words, gone, strict=True)]
        return {id_col: ids, "n_words": list(map(len, words)), "n_removed": [m.count(1) for m in gone], "kept": kept}

    return map_batches(docs, [id_col, text_col], clean, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept string")
