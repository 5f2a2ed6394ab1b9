"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from both sides.

The vocabulary comes from the word counts of the whole corpus. The ``frequent`` most frequent words are outcomes of
their own; all others belong to ``classes`` classes. A class lists ``listed`` words, the next most frequent ones dealt
in turn, and holds the rest of the corpus's words, by hash, as its tail. For each position the network sees ``side``
tokens to the left and to the right, never the token itself: embeddings of the neighbours, one hidden layer, a softmax
over the frequent words and the classes, and for a word of a class a second softmax, over the class's listed words and
its tail, from the same hidden layer. A document's score is the sum of its tokens' conditional log-probabilities. Given
the corpus's counts, a word of a tail has the tail's probability times its share of the tail's tokens, so that every
word of the corpus has a probability of its own. The shares of the ``sent_words`` most frequent words of tails go to
all tasks; rarer words meet theirs in a join.

Training is data-parallel: each task gets runs of ids, trains (Adagrad) on the windows around all their positions from
the common weights, and returns its weights with the number of its windows. Runs overlap by ``side`` ids, so that each
position of the corpus is trained in one task of one round. Weights are averaged in groups of ``fan_in``, level by
level, so that neither a task nor the driver meets more than ``fan_in`` sets of weights. Rounds repeat that on the
next share of the windows.

Defined results: a document without words has no token, log-probability 0 and a null mean; equal texts score equally;
words equal in count enter the vocabulary in alphabetical order; a word that the counts lack counts as one token
beyond its class's tail; an empty table gives an empty table; further columns, whatever their names, are ignored. Texts are
scored whole, in bounded blocks; one text is held at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, compress, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import arrow_schema, bounded, map_batches, materialise, slices, trim, words_of


@dataclass(frozen=True)
class Settings:
    frequent: int = 63
    classes: int = 64
    listed: int = 63
    side: int = 2
    dims: int = 16
    hidden: int = 32
    rounds: int = 3
    #: Positions a training task handles, over all rounds; the number of tasks follows the corpus.
    task_examples: int = 4_800_000
    #: Positions in a run of ids on its way to training.
    run: int = 16_384
    step_size: float = 0.12
    batch: int = 4096
    fan_in: int = 16
    #: Counts a task holds before it passes them on.
    counted_words: int = 400_000
    counted_bytes: int = 64 << 20
    #: Words of tails whose shares every task holds.
    sent_words: int = 150_000
    #: Positions scored together, and those of them whose first softmax is held at a time.
    block: int = 32_768
    softmax_block: int = 1024

    @property
    def heads(self) -> int:
        """Outcomes of the first softmax: 0 is the space beyond an end of a text, then frequent words, then classes."""
        return 1 + self.frequent + self.classes

    @property
    def slots(self) -> int:
        """Outcomes within a class: 0 is its tail, then the listed words."""
        return 1 + self.listed

    @property
    def size(self) -> int:
        """Ids: those of the first softmax but the classes, then each class's slots."""
        return 1 + self.frequent + self.classes * self.slots


def shapes(s: Settings) -> list[tuple[int, ...]]:
    """Embeddings, hidden layer and its bias, first softmax and its bias, the classes' softmaxes and their biases."""
    return [(s.size, s.dims), (2 * s.side * s.dims, s.hidden), (s.hidden,), (s.hidden, s.heads), (s.heads,), (s.classes, s.hidden, s.slots), (s.classes, s.slots)]


def unflatten(flat: np.ndarray, s: Settings) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes(s):
        n = math.prod(shape)
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def start(s: Settings, counts: np.ndarray) -> np.ndarray:
    """First weights: small random numbers, and the frequencies of the ids in the corpus as the biases."""
    rng = np.random.default_rng(7)
    within = counts[1 + s.frequent :].reshape(s.classes, s.slots)
    first = np.r_[counts[: 1 + s.frequent], within.sum(1)]
    parts = [
        rng.normal(0, 0.3, shapes(s)[0]), rng.normal(0, 1 / math.sqrt(2 * s.side * s.dims), shapes(s)[1]), np.zeros(s.hidden),
        rng.normal(0, 0.05, shapes(s)[3]), np.log((first + 0.5) / (first.sum() + 0.5 * s.heads)),
        rng.normal(0, 0.05, shapes(s)[5]), np.log((within + 0.5) / (within.sum(1, keepdims=True) + 0.5 * s.slots)),
    ]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def bucket(word: bytes, s: Settings) -> int:
    """The class whose tail holds a word that no class lists."""
    return xxhash.xxh3_64_intdigest(word) % s.classes


def listed_ids(words: list[bytes], s: Settings) -> dict[bytes, int]:
    """Ids of the words, given from the most frequent on: frequent ones in order, then one for each class in turn."""
    out = {w: k for k, w in enumerate(words[: s.frequent], 1)}
    for k, w in enumerate(words[s.frequent : s.frequent + s.classes * s.listed]):
        out[w] = 1 + s.frequent + k % s.classes * s.slots + 1 + k // s.classes
    return out


class Vocabulary:
    """Ids of words; those of tails are hashed as they are met, which costs less than a cache of them.

    ``sent``: words of tails with the logarithms of their shares, so that one look-up tells both.
    """

    def __init__(self, words: list[bytes], s: Settings, sent: tuple[list[bytes], np.ndarray] = ([], np.empty(0))):
        listed, (more, shares), self.s = listed_ids(words, s), sent, s
        self.known = {w: k for k, w in enumerate(chain(listed, more), 1)}
        self.of_known = np.r_[0, np.fromiter(listed.values(), np.int32, len(listed)), self.tails(more)].astype(np.int32)
        self.shares = np.r_[math.nan, np.zeros(len(listed)), shares]

    def tails(self, words: list[bytes]) -> np.ndarray:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        return 1 + self.s.frequent + (hashes % np.uint64(self.s.classes)).astype(np.int32) * self.s.slots

    def joined(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """The ids of all texts in one array, ``side`` zeros before and after each; each word's place there, its text's number
        and its share: 0 for listed words, nan for those neither listed nor sent."""
        s, words = self.s, list(chain.from_iterable(texts))
        which = np.fromiter(map(self.known.get, words, repeat(0)), np.int32, len(words))
        found, new = self.of_known[which], which == 0
        found[new] = self.tails(list(compress(words, new.tolist())))
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        at = np.arange(len(words)) + s.side * (1 + 2 * text)
        out = np.zeros(len(words) + 2 * s.side * len(texts), np.int32)
        out[at] = found
        return out, at, text, self.shares[which]

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids with ``side`` zeros before and after."""
        return self.joined([words])[0]


def is_tail(ids: np.ndarray, s: Settings) -> np.ndarray:
    return (ids > s.frequent) & ((ids - 1 - s.frequent) % s.slots == 0)


def kind(s: Settings) -> type:
    """The least type that holds all ids."""
    return np.uint16 if s.size <= 1 << 16 else np.int32


def runs(ids: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    """Runs of ``ids``, which begin and end with ``side`` zeros; together they have each other place in their inside once."""
    for at in range(s.side, len(ids) - s.side, s.run):
        yield ids[at - s.side : at + s.run + s.side].astype(kind(s))


def places(ids: np.ndarray, s: Settings) -> np.ndarray:
    """Places of the words inside a run."""
    return np.flatnonzero(ids[s.side : len(ids) - s.side]) + s.side


def offsets(s: Settings) -> np.ndarray:
    return np.r_[-s.side : 0, 1 : s.side + 1]


def outcomes(ids: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ids: the outcome of the first softmax, the class (-1 without) and the slot within it."""
    inside = ids.astype(np.int64) - 1 - s.frequent
    class_ = np.where(inside >= 0, inside // s.slots, -1)
    return np.where(inside >= 0, 1 + s.frequent + class_, ids), class_, inside % s.slots


def cuts(classes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(class, start, end) of the runs of equal sorted classes, those without one left out."""
    edges = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1], True]) if len(classes) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if classes[a] >= 0:
            yield int(classes[a]), a, b


#: Sums of exponentials outside these bounds are taken again, from each row's greatest value.
SURE = (1e-30, 1e36)


def exponentials(logits: Callable[[], object], z: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``z``, which ``logits`` fills: the value at ``wanted`` and the sum of the exponentials, left in ``z``."""
    rows = np.arange(len(z))
    logits()
    own = z[rows, wanted]
    with np.errstate(over="ignore", under="ignore"):
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], z.dtype)
    if not (total.min(initial=1) > SURE[0] and total.max(initial=1) < SURE[1]):
        logits()
        z -= z.max(1, keepdims=True)
        own = z[rows, wanted]
        np.exp(z, out=z)
        total = z.sum(1)
    return own, total


def loss_gradient(logits: Callable[[], object], z: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Leaves the loss's gradient in ``z`` but for a factor of each row, which it returns."""
    _, total = exponentials(logits, z, wanted)
    z[np.arange(len(z)), wanted] -= total
    return 1 / total[:, None]


class Trainer:
    """Adagrad over mini-batches; an embedding's row has one step size."""

    def __init__(self, flat: np.ndarray, s: Settings):
        self.flat, self.s = flat.copy(), s
        self.gradient = np.zeros_like(self.flat)
        self.weights, self.found = unflatten(self.flat, s), unflatten(self.gradient, s)
        # the first softmax and its bias lie side by side: one matrix, whose last row meets a one beside the hidden layer
        at = sum(map(math.prod, shapes(s)[:3]))
        self.outer, self.of_outer = (x[at : at + (s.hidden + 1) * s.heads].reshape(-1, s.heads) for x in (self.flat, self.gradient))
        self.slots = np.empty((s.classes, s.hidden + 1, s.slots), flat.dtype)
        self.of_slots = np.empty_like(self.slots)
        self.squares = np.full_like(self.flat[s.size * s.dims :], 1e-8)
        self.row_squares = np.full((s.size, 1), 1e-8, flat.dtype)

    def step(self) -> None:
        """Rows of embeddings without a gradient stay as they are."""
        n = self.s.size * self.s.dims
        rows, rest = self.found[0], self.gradient[n:]
        self.row_squares += (rows * rows).mean(1, keepdims=True)
        self.weights[0] -= rows * (self.s.step_size / np.sqrt(self.row_squares))
        room = rest * rest
        self.squares += room
        np.sqrt(self.squares, out=room)
        np.divide(rest, room, out=room)
        room *= self.s.step_size
        self.flat[n:] -= room

    def batch(self, context: np.ndarray, target: np.ndarray) -> list:
        """Gradients of the mean loss at the weights as they are, until the next batch; the embeddings' as (rows, gradient)."""
        s = self.s
        embed, into, inner, outer, _, slots, slot_bias = self.weights
        n = len(target)
        first, class_, slot = outcomes(target, s)
        order = np.argsort(first.astype(kind(s)), kind="stable")
        context, first, class_, slot = context.take(order, axis=0), first[order], class_[order], slot[order]
        x = embed.take(context.ravel(), axis=0).reshape(n, -1)
        h = np.ones((n, s.hidden + 1), x.dtype)
        hidden = h[:, :-1]
        np.tanh(x @ into + inner, out=hidden)
        back = np.empty((n, s.hidden), x.dtype)
        self.of_outer[:] = 0
        room = np.empty((min(n, s.softmax_block), s.heads), x.dtype)
        for a in range(0, n, s.softmax_block):
            b = min(n, a + s.softmax_block)
            p = room[: b - a]
            scale = loss_gradient(lambda: np.matmul(h[a:b], self.outer, out=p), p, first[a:b])  # noqa: B023
            np.matmul(p, outer.T, out=back[a:b])
            back[a:b] *= scale
            self.of_outer += (h[a:b] * scale).T @ p
        # those with a class come last, class by class
        begin = int(np.searchsorted(first, 1 + s.frequent))
        runs_ = [(c, a + begin, b + begin) for c, a, b in cuts(class_[begin:])]
        self.slots[:, :-1], self.slots[:, -1] = slots, slot_bias
        q = np.empty((n - begin, s.slots), x.dtype)

        def fill() -> None:
            for c, a, b in runs_:
                np.matmul(h[a:b], self.slots[c], out=q[a - begin : b - begin])

        scale = loss_gradient(fill, q, slot[begin:])
        scaled, more = h[begin:] * scale, np.empty((n - begin, s.hidden), x.dtype)
        self.of_slots[:] = 0
        for c, a, b in runs_:
            at = slice(a - begin, b - begin)
            np.matmul(scaled[at].T, q[at], out=self.of_slots[c])
            np.matmul(q[at], slots[c].T, out=more[at])
        more *= scale
        back[begin:] += more
        self.found[5][:], self.found[6][:] = self.of_slots[:, :-1], self.of_slots[:, -1]
        back *= 1 - hidden * hidden
        self.found[1][:], self.found[2][:] = x.T @ back, back.sum(0)
        # sums by row of the embeddings, one dimension of all neighbours at a time
        down = (into @ back.T).reshape(2 * s.side, s.dims, n)
        ids = context.T.ravel().astype(np.int64)
        for d in range(s.dims):
            self.found[0][:, d] = np.bincount(ids, down[:, d].ravel(), s.size)
        self.gradient /= n
        return [(slice(None), self.found[0]), *self.found[1:]]

    def learn(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One pass over the places ``at``, each batch spread evenly over all of them; the weights after it."""
        beside = offsets(self.s)
        # a small corpus gets smaller batches, so that it has steps enough
        batches = -(-len(at) // min(self.s.batch, max(256, len(at) // 64)))
        for k in range(batches):
            pick = at[k::batches]
            self.batch(ids.take(pick[:, None] + beside), ids.take(pick))
            self.step()
        return self.flat


class Scorer:
    def __init__(self, flat: np.ndarray, s: Settings):
        embed, into, self.inner, outer, bias, slots, slot_bias = unflatten(flat, s)
        # what a token at a neighbouring place adds to the hidden layer
        self.tables = [embed @ part for part in into.reshape(2 * s.side, s.dims, s.hidden)]
        # the last row, the bias, meets a one beside the hidden layer
        self.outer, self.slots = np.vstack([outer, bias]), np.concatenate([slots, slot_bias[:, None]], 1)
        self.s = s

    @staticmethod
    def chosen(h: np.ndarray, weights: np.ndarray, which: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Log-probability of an outcome of each row; ``room`` has at least as many rows."""
        z = room[: len(h)]
        own, total = exponentials(lambda: np.matmul(h, weights, out=z), z, which)
        return own - np.log(total)

    def log_probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Of each token given its neighbours; ``ids`` may join texts, each with zeros around it."""
        s = self.s
        n = len(ids) - 2 * s.side
        out = np.empty(max(n, 0), np.float32)
        rows = min(max(n, 0), s.block, s.softmax_block)
        heads, slots = np.empty((rows, s.heads), self.outer.dtype), np.empty((rows, s.slots), self.outer.dtype)
        for at in range(0, n, s.block):
            m = min(s.block, n - at)
            first, class_, slot = outcomes(ids[at + s.side : at + s.side + m], s)
            order = np.argsort(class_.astype(np.int16), kind="stable")
            sorted_ = np.empty(m, np.float32)
            h = np.ones((m, s.hidden + 1), self.outer.dtype)
            first, class_, slot, places_ = first[order], class_[order], slot[order], order + at + s.side
            for a in range(0, m, s.softmax_block):
                b = min(m, a + s.softmax_block)
                inner = np.repeat(self.inner[None], b - a, 0)
                for table, offset in zip(self.tables, offsets(s), strict=True):
                    inner += table.take(ids.take(places_[a:b] + offset), axis=0)
                np.tanh(inner, out=h[a:b, :-1])
                sorted_[a:b] = self.chosen(h[a:b], self.outer, first[a:b], heads)
            for c, a, b in cuts(class_):
                for k in range(a, b, s.softmax_block):
                    e = min(b, k + s.softmax_block)
                    sorted_[k:e] += self.chosen(h[k:e], self.slots[c], slot[k:e], slots)
            out[at : at + m][order] = sorted_
        return out


def count_words(docs: DataFrame, s: Settings, text_col: str) -> DataFrame:
    """word, bucket, n over the whole corpus, counted in each task first. Arrow's white space is that of ``words_of``."""
    schema = "word binary, bucket int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in slices(batches):
            found = pc.ascii_split_whitespace(part.column(0)).flatten().value_counts()
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            if sum(x.num_rows for x in held) > 2 * s.counted_words or sum(x.nbytes for x in held) > s.counted_bytes:
                held = [merged(held)]
                if held[0].num_rows > s.counted_words or 2 * held[0].nbytes > s.counted_bytes:
                    yield from flush(held.pop())
        if held:
            yield from flush(merged(held))
        del held
        trim()  # the worker lives on

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # the split leaves an empty word where a text begins or ends in white space
        for part in table.filter(pc.field("word") != "").to_batches(max_chunksize=50_000):
            words = part.column("word").cast(pa.binary())
            _, ends, held = words.buffers()
            ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
            held = memoryview(held)
            buckets = [bucket(held[a:b], s) for a, b in pairwise(ends)]
            yield pa.RecordBatch.from_arrays([words, pa.array(buckets, pa.int32()), part.column("n")], schema=arrow)

    arrow = arrow_schema(docs.sparkSession, schema)
    return docs.select(text_col).mapInArrow(run, schema).groupBy("word", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    words: list[bytes]
    weights: np.ndarray
    settings: Settings
    #: Tokens in each class's tail.
    tail_tokens: np.ndarray | None = None


def average(parts: DataFrame, s: Settings) -> np.ndarray:
    """Mean of the weights, by their numbers of examples; level by level in groups of ``fan_in``."""

    def merge(table: pa.Table) -> pa.Table:
        total, n = None, 0
        for flat, own in zip(table["flat"], table["n"].to_pylist(), strict=True):
            part = np.frombuffer(flat.as_py(), np.float32).astype(np.float64) * own
            total = part if total is None else total + part
            n += own
        mean = (total / max(n, 1)).astype(np.float32).tobytes()
        return pa.table({"task": [min(table["task"].to_pylist()) // s.fan_in], "n": [n], "flat": [mean]}, schema=arrow)

    schema = "task long, n long, flat binary"
    arrow = arrow_schema(parts.sparkSession, schema)
    level = materialise(parts, "weights")
    while level.count() > s.fan_in:
        level = materialise(level.groupBy(F.floor(F.col("task") / s.fan_in)).applyInArrow(merge, schema), "weights")
    rows = level.collect()  # at most fan_in sets of weights
    total = sum(r["n"] for r in rows)
    return sum(np.frombuffer(r["flat"], np.float32).astype(np.float64) * (r["n"] / total) for r in rows).astype(np.float32)


def learner(sent: Broadcast, s: Settings, round_: int, arrow: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Training on one task's runs from the weights ``sent``."""

    def learn(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b.as_py(), kind(s)) for b in table["rows"]]
        starts = np.cumsum([0, *map(len, parts)])
        at = np.concatenate([places(part, s) + first for part, first in zip(parts, starts, strict=False)])
        if not len(at):
            return arrow.empty_table()
        weights = Trainer(sent.value, s).learn(np.concatenate(parts), at)
        return pa.table({"task": [table["task"][0].as_py() // s.rounds], "n": [len(at)], "flat": [weights.tobytes()]}, schema=arrow)

    return learn


def fit(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", counted: DataFrame | None = None) -> Model:
    """``counted``: what ``count_words`` found, if it is there already."""
    s, spark = settings, docs.sparkSession
    if counted is None:
        counted = materialise(count_words(docs, s, text_col), "counts")
    top = counted.orderBy(F.desc("n"), "word").limit(s.frequent + s.classes * s.listed).collect()
    words = [bytes(r["word"]) for r in top]
    counts = np.zeros(s.size)
    counts[list(listed_ids(words, s).values())] = [r["n"] for r in top]
    tail_tokens = np.zeros(s.classes)
    for r in tails(counted, words).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per class
        tail_tokens[r["bucket"]] = r["n"]
    counts[1 + s.frequent :: s.slots] = tail_tokens
    flat = start(s, counts)
    total = counts.sum()
    if not total:
        return Model(words, flat, s, tail_tokens)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, place = Vocabulary(words, s), TaskContext.get().partitionId() << 32
        for (texts,) in bounded(batches):
            parts = [own for own in map(words_of, texts) if own]
            for part in runs(vocabulary.joined(parts)[0], s) if parts else ():
                # the place seeds the hash, so that equal runs don't meet in one task
                place += 1
                yield pa.RecordBatch.from_pydict({"slot": [int(xxhash.xxh3_64_intdigest(part.tobytes(), place) >> 1)], "rows": [part.tobytes()]}, schema=drawn)
        del vocabulary
        trim()

    drawn = arrow_schema(spark, "slot long, rows binary")
    tasks = max(1, math.ceil(total / s.task_examples))
    windows = materialise(docs.select(text_col).mapInArrow(draw, "slot long, rows binary").repartition(tasks * s.rounds, "slot").withColumn("task", F.spark_partition_id().cast("long")), "windows")
    parts_schema = "task long, n long, flat binary"
    arrow = arrow_schema(spark, parts_schema)
    for round_ in range(s.rounds):
        share = windows.filter(F.col("task") % s.rounds == round_)
        if not share.isEmpty():
            # a number of its own keeps adaptive execution from joining the small partitions of much work
            spread = share.repartition(2 * tasks, "task")
            flat = average(spread.groupBy("task").applyInArrow(learner(spark.sparkContext.broadcast(flat), s, round_, arrow), parts_schema), s)
    return Model(words, flat, s, tail_tokens)


def tails(counted: DataFrame, words: list[bytes]) -> DataFrame:
    """The counts of all words but ``words``."""
    own = counted.sparkSession.createDataFrame([(bytearray(w),) for w in words], "word binary")
    return counted.join(F.broadcast(own), "word", "left_anti")


def word_shares(counted: DataFrame, model: Model) -> DataFrame:
    """word, n, share: the logarithm of each word's part of its class's tail, for all words without an id of their own."""
    total = F.element_at(F.array(*map(F.lit, model.tail_tokens.tolist())), F.col("bucket") + 1)
    return tails(counted, model.words).select("word", "n", (F.log("n") - F.log(total)).alias("share"))


_loaded: dict[int, tuple] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", counted: DataFrame | None = None) -> DataFrame:
    """``id_col``, ``n_tokens``, ``log_likelihood`` (the sum), ``mean_log_likelihood``.

    With ``counted``, of the words; without, of their ids, so that words of a tail are one.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    head = None
    if counted is not None:
        shares = materialise(word_shares(counted, model), "shares")
        top = shares.orderBy(F.desc("n"), "word").limit(model.settings.sent_words).select("word", "share").collect()
        head = spark.sparkContext.broadcast(([bytes(r["word"]) for r in top], np.array([r["share"] for r in top], float)))

    def run(ids: list, texts: list, rows: list) -> dict:
        model = sent.value
        if id(model) not in _loaded:
            _loaded.clear()
            _loaded[id(model)] = Vocabulary(model.words, model.settings, *([head.value] if head else [])), Scorer(model.weights, model.settings), model
        vocabulary, scorer, _ = _loaded[id(model)]
        s = model.settings
        words = [words_of(text) for text in texts]
        # the texts of a batch in one array: the zeros after a text and before the next keep them apart
        joined, at, text, shares = vocabulary.joined(words)
        found = scorer.log_probabilities(joined)[at - s.side].astype(np.float64)
        rest: list[list | None] = [None] * len(ids)
        if head:
            rest = [[] for _ in ids]
            lacks = np.isnan(shares)
            found += np.where(lacks, 0, shares)
            # not among the words sent: to be joined
            of_class = -np.log1p(model.tail_tokens)[outcomes(joined[at[lacks]], s)[1]]
            for k, word, unseen in zip(text[lacks].tolist(), compress(chain.from_iterable(words), lacks.tolist()), of_class.tolist(), strict=True):
                rest[k].append((word, unseen))
        return {id_col: ids, "n_tokens": list(map(len, words)), "log_likelihood": np.bincount(text, found, len(ids)), "_row": rows, "_rest": rest}

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, log_likelihood double, _row long, _rest array<struct<word: binary, unseen: double>>"
    got = map_batches(docs.select(id_col, text_col, F.monotonically_increasing_id().alias("_row")), [id_col, text_col, "_row"], run, schema, collect=False)
    if counted is not None:
        got = materialise(got, "scores")
        # words beyond ``sent_words`` are rare, so no word has many of the rows
        within = got.select("_row", F.explode("_rest").alias("_rest")).select("_row", "_rest.*").join(shares.select("word", "share"), "word", "left")
        within = within.groupBy("_row").agg(F.sum(F.coalesce("share", "unseen")).alias("_within"))
        got = got.drop("_rest").join(within, "_row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("_within", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return got.select(id_col, "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))
