"""Near-duplicate classes by BagMinHash over word shingles, banding and exact verification.

A text is the multiset of its runs of ``words`` words. Per shingle and dyadic interval of its count ([0,1), [1,2),
[2,4), ...) a Poisson process of the interval's length yields points: a time, a register and a level within the
interval; a text sees the points whose level lies below its own count. This is the hierarchy of the discretised weights
in one step: intervals are not split further, as the levels of their points are drawn instead, which thins the process
to any count just as the descent through halves would. All of that is drawn from hashes, so equal
shingles of two texts see equal points, and the earliest point of each register agrees in two texts with just the
probability of their weighted Jaccard similarity. Only points up to a time limit are drawn, which shrinks as a text
grows, so that long texts cost one draw a shingle and little more.

Bands of registers propose pairs; the multiset overlap of the pair's texts decides. Members of a band's bucket are
compared with one pivot, not with each other; classes are the connected components of the links so far; then only
members of one bucket that are still in different classes are compared. So no link between two texts of a bucket is
lost for the classes, and groups of copies cost their size, not its square.

Where many such pairs are left (a large family whose outer members resemble its pivot but not closely enough), most
are ruled out without being formed. A bucket's centre is its pivot's multiset with what most of the pivot's texts
gained; against it a member x has gained G(x) shingles and lost L(x). Two members that gained nothing in common
differ in G(x) + G(y) + |L(x) - L(y)| shingles at least, and a link allows (n(x) + n(y)) * (1 - s) / (1 + s) at
similarity s. Members that pass this bound are compared; members that gained a shingle in common meet in that
shingle's group, again first with one of it and then, within the same bound less what they can have in common, across
classes.

Defined results: texts with equal words are copies and share a signature; a text without words (null, empty, blank)
is alone in its class; a text of fewer words than a shingle is one shingle; rows of a null id are alone; rows that
share an id count as one document; an empty table gives an empty table; further columns, whatever their names, are
ignored. Ids must be integers (others raise). Texts of any length are handled whole, one at a time in signatures and
two at a time in comparisons.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import MULTIPLIER, hashed, map_batches, materialise, mixed, windows, words_of


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    #: At the least similarity, all bands of a pair differ with probability (1 - 0.8**5)**26, about 0.00003.
    bands: int = 26
    rows: int = 5
    #: Up to so many pairs a document, pairs left in buckets are all compared; beyond, the bound picks among them.
    open_pairs: float = 0.25
    #: Ids of texts to compare are broadcast up to so many (8 bytes each); else they meet the texts by a shuffle.
    broadcast_rows: int = 500_000
    #: Rows of one key, and pairs of one text, that a task gets at most: larger groups are dealt over several tasks.
    group_rows: int = 1024

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles' hashes, sorted, and their counts."""
    return np.unique(windows(hashed(words), min(n, len(words))), return_counts=True) if words else (np.empty(0, np.uint64), np.empty(0, np.int64))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets."""
    total = int(a[1].sum() + b[1].sum())
    _, at, other = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][at], b[1][other]).sum())
    return common / (total - common) if total else 0.0


STEP = np.uint64(0xD6E8FEB86659FD93)


def signature(items: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """For each register the identity of its earliest point."""
    limit = registers * (math.log(registers) + 4) / float(counts.sum())
    top = int(counts.max())
    while True:
        times, places, names = [], [], []
        level, low, high = 0, 0, 1
        while low < top:
            rate = high - low
            chosen = counts > low if level else slice(None)
            own, most = items[chosen], counts[chosen]
            mean = limit * rate
            draws = int(mean + 6 * math.sqrt(mean) + 8) if mean > 0.05 else 2
            level_seed = mixed(np.array([level], np.uint64) * MULTIPLIER + STEP)
            before = np.zeros(len(own))
            first = 0
            while len(own):
                # one row per shingle, one column per further point of its process
                point = mixed((own * MULTIPLIER + level_seed)[:, None] + np.arange(first + 1, first + draws + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
                uniform = ((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
                time = before[:, None] + np.cumsum(-np.log(uniform), axis=1) / rate
                seen = time < limit
                name = mixed(point ^ STEP)
                if level:
                    inside = low + (mixed(name + STEP) % np.uint64(rate)).astype(np.int64)
                    seen &= inside < most[:, None]
                times.append(time[seen])
                names.append(name[seen])
                more = time[:, -1] < limit
                own, most, before, first = own[more], most[more], time[more, -1], first + draws
            level, low, high = level + 1, high, 2 * high
        time, name = np.concatenate(times), np.concatenate(names)
        places = (name >> np.uint64(20)) % np.uint64(registers)
        order = np.argsort(-time)
        result, filled = np.zeros(registers, np.uint64), np.zeros(registers, bool)
        result[places[order]] = name[order]  # the earliest comes last and stays
        filled[places] = True
        if filled.all():
            return result
        limit *= 2


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per band, its number included."""
    parts = registers.reshape(bands, -1)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * STEP
    for k in range(parts.shape[1]):
        keys = mixed(keys * MULTIPLIER + parts[:, k])
    return keys.view(np.int64)


def signatures(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_copy`` (digest of the words, null without words) and ``_keys`` (of the bands) for each row."""

    def run(ids: list, texts: list) -> dict:
        copies, keys = [], []
        for text in texts:
            words = words_of(text)
            copies.append(hashlib.sha256(b" ".join(words)).digest()[:16] if words else None)
            keys.append(band_keys(signature(*shingles(words, settings.words), settings.registers), settings.bands).tolist() if words else [])
        return {"_id": ids, "_copy": copies, "_keys": keys}

    return map_batches(docs, [id_col, text_col], run, "_id long, _copy binary, _keys array<long>")


def dealt(rows: DataFrame, keys: list[str], by: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with ``_part``, which divides a key's rows into parts of about ``most``, and the keys with their ``_parts``.

    Without a key of more than ``most`` rows there is nothing to deal, and no table of keys.
    """
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    own = materialise(parts.filter("_parts > 1"), "hot")
    if own.isEmpty():
        return rows.withColumn("_part", F.lit(0)), None
    placed = rows.join(own, keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int"))
    return placed.drop("_parts"), own


def to_parts(rows: DataFrame, parts: DataFrame | None, keys: list[str], name: str = "_part") -> DataFrame:
    """Each row once for each part of its key."""
    if parts is None:
        return rows.withColumn(name, F.lit(0))
    every = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    return rows.join(parts, keys, "left").withColumn(name, F.explode(every)).drop("_parts")


def with_texts(pairs: DataFrame, docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """a, b and their texts ``_a``, ``_b``. ``a`` may stand in many pairs, which are dealt over several tasks."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("_need")).distinct(), "needed")
    few = ids.count() <= settings.broadcast_rows
    texts = docs.select(F.col(id_col).cast("long").alias("_need"), F.col(text_col).alias("_text")).join(F.broadcast(ids) if few else ids, "_need")
    texts = materialise(texts, "texts")
    pairs, parts = dealt(pairs, ["a"], "b", settings.group_rows)
    left = to_parts(texts.select(F.col("_need").alias("a"), F.col("_text").alias("_a")), parts, ["a"])
    return pairs.join(left, ["a", "_part"]).drop("_part").join(texts.select(F.col("_need").alias("b"), F.col("_text").alias("_b")), "b")


class Bags(dict):
    """Shingles of texts, some kept: one text stands in many pairs."""

    def __init__(self, words: int):
        super().__init__()
        self.words, self.held = words, 0

    def __missing__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = shingles(words_of(text), self.words)
        self.held += len(found[0])
        if self.held > 1_000_000:
            self.clear()
            self.held = len(found[0])
        self[text] = found
        return found


def compared(pairs: DataFrame, docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """Each pair (a, b) and whether it is ``linked``."""

    def run(a: list, b: list, left: list, right: list) -> dict:
        bags = Bags(settings.words)
        return {"a": a, "b": b, "linked": [similarity(bags[x], bags[y]) >= settings.similarity for x, y in zip(left, right, strict=True)]}

    return materialise(map_batches(with_texts(pairs, docs, settings, id_col, text_col), ["a", "b", "_a", "_b"], run, "a long, b long, linked boolean"), "compared")


def elements(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set: the k-th copy of a shingle is an element of its own."""
    items, counts = np.repeat(bag[0], bag[1]), np.cumsum(bag[1])
    copy = np.arange(len(items)) - np.repeat(counts - bag[1], bag[1])
    return mixed(items + copy.astype(np.uint64) * STEP)


def around_centres(groups: DataFrame, docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Members of groups (``a``: the pivot, ``_id``, ``_class``) against their group's centre, and what they share beyond it.

    The centre is the pivot with what more than half of the members gained; what they lost changes no difference of
    two members' losses and stays. First: a, _id, n, gained, lost. Second: a, _gain, _id, _one: the elements outside the centre that members of several classes hold, with the first
    of these members.
    """

    def run(a: list, b: list, left: list, right: list) -> dict:
        bags = Bags(settings.words)
        out: dict[str, list] = {"a": a, "_id": b, "n": [], "_gains": [], "_l": []}
        for x, y in zip(left, right, strict=True):
            own, other = elements(bags[x]), elements(bags[y])
            out["n"].append(len(other))
            gains = np.setdiff1d(other, own)
            out["_gains"].append(gains.view(np.int64).tolist())
            out["_l"].append(len(own) - len(other) + len(gains))
        return out

    whole = groups.select("a", F.col("_id").alias("b")).distinct()
    rows = map_batches(with_texts(whole, docs, settings, id_col, text_col), ["a", "b", "_a", "_b"], run, "a long, _id long, n long, _gains array<long>, _l long")
    rows = materialise(rows.join(groups.select("a", "_id", "_class").distinct(), ["a", "_id"]), "differences")
    sizes = rows.groupBy("a").agg(F.count("*").alias("_size"))
    each = materialise(rows.select("a", "_id", "_class", F.explode("_gains").alias("_gain")), "elements")
    counts = each.groupBy("a", "_gain").agg(F.count("*").alias("_n")).filter("_n > 1")
    centre = materialise(counts.join(sizes, "a").filter(2 * F.col("_n") > F.col("_size")).select("a", "_gain"), "centres")
    of_group = centre.groupBy("a").agg(F.count("*").alias("_f"))
    of_member = each.join(centre, ["a", "_gain"]).groupBy("a", "_id").agg(F.count("*").alias("_k"))
    measured = rows.select("a", "_id", "n", "_l", F.size("_gains").cast("long").alias("_g"))
    measured = measured.join(of_group, "a", "left").join(of_member, ["a", "_id"], "left").fillna(0, ["_f", "_k"])
    measured = materialise(measured.select("a", "_id", "n", (F.col("_g") - F.col("_k")).alias("gained"), (F.col("_l") + F.col("_f") - F.col("_k")).alias("lost")), "measured")
    beyond = each.join(centre, ["a", "_gain"], "left_anti")
    several = beyond.groupBy("a", "_gain").agg(F.min("_id").alias("_one"), F.min("_class").alias("_least"), F.max("_class").alias("_most")).filter("_least <> _most").select("a", "_gain", "_one")
    return measured, materialise(beyond.drop("_class").join(several, ["a", "_gain"]), "shared")


def components(links: DataFrame) -> DataFrame:
    """``_id``, ``_class``: the least id that links lead to, for each id with a link.

    Each round takes the least label among the neighbours and then the label's own label.
    """
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("_id")).agg(F.least(F.min("b"), F.col("_id")).alias("_class")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("_id")).groupBy("a").agg(F.min("_class").alias("_near"))
        better = labels.join(near, F.col("_id") == F.col("a")).select("_id", F.least("_class", "_near").alias("_new"), F.col("_class").alias("_old"))
        jump = labels.select(F.col("_id").alias("_at"), F.col("_class").alias("_to"))
        after = better.join(jump, F.col("_new") == F.col("_at"), "left").select("_id", F.least("_new", F.coalesce("_to", "_new")).alias("_class"), "_old")
        after = materialise(after, "labels")
        if after.filter("_class <> _old").isEmpty():
            return after.select("_id", "_class")
        labels = after.select("_id", "_class")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links: only links between different classes count, once for each two classes."""
    known = labels.select(F.col("_id").alias("_of"), F.col("_class").alias("_was"))
    ends = links.join(known, F.col("a") == F.col("_of"), "left").select(F.coalesce("_was", "a").alias("_x"), "b")
    ends = ends.join(known, F.col("b") == F.col("_of"), "left").select("_x", F.coalesce("_was", "b").alias("_y"))
    ends = ends.filter("_x <> _y").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()
    lead = components(ends).select(F.col("_id").alias("_was"), F.col("_class").alias("_now"))
    before = labels.select("_id", F.col("_class").alias("_was"))
    old = before.join(lead, "_was", "left").select("_id", F.coalesce("_now", "_was").alias("_class"))
    new = lead.join(before, F.col("_id") == lead["_was"], "left_anti").select(F.col("_was").alias("_id"), F.col("_now").alias("_class"))
    return materialise(old.unionByName(new), "merged")


def with_class(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "_id", "left").withColumn("_class", F.coalesce("_class", "_id"))


def across(rows: DataFrame, others: DataFrame, keys: list[str], most: int, bound: Column | None = None, measures: tuple[str, ...] = ()) -> DataFrame:
    """Distinct pairs (a < b) of a row and another of the same key and another class. ``measures``: columns for ``bound``.

    Both sides of a key with more than ``most`` rows are dealt into parts, and each two parts meet in a task of their own.
    """
    rows, own = dealt(rows, keys, "_id", most)
    others, theirs = dealt(others, keys, "_id", most)
    rows = to_parts(rows, theirs, keys, "_meets")
    others = to_parts(others.withColumnRenamed("_part", "_meets"), own, keys)
    keys = [*keys, "_part", "_meets"]
    renamed = others.select(*(F.col(k).alias(f"_by_{k}") for k in keys), F.col("_id").alias("_other"), F.col("_class").alias("_theirs"), *(F.col(m).alias(f"_{m}") for m in measures))
    same = [F.col(k) == F.col(f"_by_{k}") for k in keys] + [F.col("_class") != F.col("_theirs")] + ([bound] if bound is not None else [])
    where = same[0]
    for part in same[1:]:
        where &= part
    return rows.join(renamed, where).select(F.least("_id", "_other").alias("a"), F.greatest("_id", "_other").alias("b")).distinct()


def classes(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of ``docs``: ``id_col``, ``class_id`` (the least id of the class), ``copy_of`` (the least id with
    equal words), and of these words ``links``: the other texts that a comparison found similar enough.

    Comparisons stop where two texts are known to be of one class, so ``links`` counts the links that were verified:
    one at least for each text in a class with others.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer")
    rows = materialise(signatures(docs, settings, id_col, text_col), "signatures")
    named = rows.filter(F.col("_id").isNotNull() & F.col("_copy").isNotNull())
    copies = named.groupBy("_copy").agg(F.min(F.struct("_id", "_keys")).alias("_one"))
    copies = materialise(copies.select("_copy", F.col("_one._id").alias("_first"), F.col("_one._keys").alias("_keys")), "copies")
    bands = copies.select(F.explode("_keys").alias("_key"), F.col("_first").alias("_id")).distinct()
    crowded = bands.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_id").alias("_pivot")).filter("_n > 1")
    bands = materialise(bands.join(crowded, "_key").select("_key", "_id", "_pivot"), "bands")

    def compare(pairs: DataFrame) -> DataFrame:
        return compared(materialise(pairs, "pairs"), docs, settings, id_col, text_col)

    verified = []
    tested = compare(bands.filter("_id <> _pivot").select(F.col("_pivot").alias("a"), F.col("_id").alias("b")).distinct())
    verified.append(tested)
    labels = components(tested.filter("linked").select("a", "b"))
    labelled = materialise(with_class(bands, labels).select("_key", "_id", "_class", "_pivot"), "labelled")
    groups = labelled.groupBy("_key", "_class").agg(F.count("*").alias("_n")).groupBy("_key").agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.col("_n")).alias("_own"), F.count("*").alias("_classes"))
    open_keys = materialise(groups.filter("_classes > 1").select("_key", ((F.col("_all") * F.col("_all") - F.col("_own")) / 2).alias("_pairs")), "open")
    left = open_keys.agg(F.sum("_pairs")).first()[0] or 0
    if left:
        members = labelled.join(open_keys.select("_key"), "_key")
        known = tested.select("a", "b")
        if left <= settings.open_pairs * max(1, copies.count()):
            more = [across(members, members, ["_key"], settings.group_rows)]
        else:
            own = members.select(F.col("_pivot").alias("a"), "_id", "_class").distinct()
            measured, shared = around_centres(own, docs, settings, id_col, text_col)
            placed = materialise(members.join(measured.withColumnRenamed("a", "_pivot"), ["_pivot", "_id"]), "placed")
            lead = placed.groupBy("_key", "_class").agg(F.count("*").alias("_n")).groupBy("_key").agg(F.max_by("_class", F.struct("_n", "_class")).alias("_lead"))
            best = placed.groupBy("_key").agg(F.max("n").alias("_n"), F.max(F.col("lost") - F.col("gained")).alias("_back"))
            slack = (1 - settings.similarity) / (1 + settings.similarity)
            able = F.col("gained") + F.col("lost") - F.col("_back") <= (F.col("n") + F.col("_n")) * slack + 1e-6
            outer = placed.join(lead.join(best, "_key"), "_key").filter((F.col("_class") != F.col("_lead")) & able).drop("_lead", "_n", "_back")
            bound = F.col("gained") + F.col("_gained") + F.abs(F.col("lost") - F.col("_lost")) <= (F.col("n") + F.col("_n")) * slack + 1e-6
            near = across(outer, placed, ["_key"], settings.group_rows, bound, ("n", "gained", "lost"))
            first = near.unionByName(shared.filter("_id <> _one").select(F.least("_id", "_one").alias("a"), F.greatest("_id", "_one").alias("b"))).distinct()
            found = compare(first.join(known, ["a", "b"], "left_anti"))
            verified.append(found)
            known = known.unionByName(found.select("a", "b"))
            labels = merged(labels, found.filter("linked").select("a", "b"))
            # of two members' common gains there are at most as many as either shares with another class
            several = shared.groupBy("a", "_id").agg(F.count("*").alias("several"))
            shared = shared.join(materialise(with_class(measured.join(several, ["a", "_id"]), labels), "several"), ["a", "_id"])
            most = F.least("several", "_several")
            bound = F.col("gained") + F.col("_gained") - 2 * most + F.abs(F.col("lost") - F.col("_lost")) <= (F.col("n") + F.col("_n")) * slack + 1e-6
            shared = materialise(shared, "shared")
            more = [across(shared, shared, ["a", "_gain"], settings.group_rows, bound, ("n", "gained", "lost", "several"))]
        for pairs in more:
            found = compare(pairs.join(known, ["a", "b"], "left_anti"))
            verified.append(found)
            labels = merged(labels, found.filter("linked").select("a", "b"))
    links = reduce(DataFrame.unionByName, verified).filter("linked").select(F.explode(F.array("a", "b")).alias("_first")).groupBy("_first").agg(F.count("*").alias("_links"))
    table = copies.select("_copy", "_first").join(labels.select(F.col("_id").alias("_first"), "_class"), "_first", "left").join(links, "_first", "left")
    named = rows.select(F.col("_id").alias(id_col), "_copy")
    found = named.join(table, F.when(F.col(id_col).isNotNull(), named["_copy"]) == table["_copy"], "left")
    return found.select(F.col(id_col).cast(dict(docs.dtypes)[id_col]), F.coalesce("_class", "_first", id_col).alias("class_id"), F.coalesce("_first", id_col).alias("copy_of"), F.coalesce("_links", F.lit(0)).alias("links"))
