"""String and set similarities of a pair. Edit distances that Spark lacks are Arrow UDFs; the rest are expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per place of ``a``."""
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


#: Masks of letters that ``_scan`` holds at once.
MASKS = 1 << 21


def _scan(pairs: list[tuple[str, str]], starts: bool = False) -> np.ndarray:
    """``_common`` of many pairs at once, or with ``starts`` of the first text and each start of the second: a column for each length.

    A row of bits for each pair, in as many machine words as the first text needs; a table holds the places of each letter.
    """
    a, b = (np.array([p[side] for p in pairs], str) for side in (0, 1))
    a, b = (x.astype(f"U{max(1, x.dtype.itemsize // 4)}").view(np.uint32).reshape(len(pairs), -1) for x in (a, b))
    letters, code = np.unique(a, return_inverse=True)
    words = -(-a.shape[1] // 64)
    if len(pairs) > 1 and len(pairs) * (len(letters) + 1) * words > MASKS:
        half = len(pairs) // 2
        parts = _scan(pairs[:half], starts), _scan(pairs[half:], starts)
        if starts:  # beyond a text's end its last value holds
            parts = [np.pad(x, ((0, 0), (0, b.shape[1] + 1 - x.shape[1])), mode="edge") for x in parts]
        return np.concatenate(parts)
    code, every = code.reshape(a.shape), np.arange(len(pairs))
    places = np.zeros((len(letters) + 1, words, len(pairs)), np.uint64)  # the last: letters that the first text lacks
    for k in range(a.shape[1]):
        places[code[:, k], k // 64, every] |= np.uint64(1 << k % 64)
    places[:-1][letters == 0] = 0  # beyond the text's end
    at = np.minimum(np.searchsorted(letters, b), len(letters) - 1)
    at = np.where(letters[at] == b, at, len(letters))
    whole = [np.bitwise_or.reduce(places[:, w], axis=0) for w in range(words)]
    row = [x.copy() for x in whole]
    size = sum(np.bitwise_count(x).astype(np.int64) for x in whole)
    out = [np.zeros(len(pairs), np.int64)]
    for j in range(b.shape[1]):
        carry = np.zeros(len(pairs), np.uint64)
        for w in range(words):
            hit = row[w] & places[at[:, j], w, every]
            total = row[w] + hit
            over = total < hit
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            row[w] = (total | (row[w] & ~hit)) & whole[w]
        if starts:
            out.append(size - sum(np.bitwise_count(x).astype(np.int64) for x in row))
    return np.stack(out, 1) if starts else size - sum(np.bitwise_count(x).astype(np.int64) for x in row)


def common_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``_common`` of many pairs, those of like lengths together."""
    out = np.zeros(len(pairs), np.int64)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    order = sorted((k for k, (a, _) in enumerate(pairs) if a), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        out[part] = _scan([pairs[k] for k in part])
    return out


def indels(pairs: list[tuple[str, str]]) -> np.ndarray:
    sizes = np.array([len(a) + len(b) for a, b in pairs], np.float64)
    return np.where(sizes > 0, 2 * common_lengths(pairs) / np.maximum(sizes, 1), 1.0)


def partials(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``partial`` of many pairs: one scan has all starts of the longer text, one all ends; a stretch between is measured if it can be better.

    From one stretch to the next the common length changes by one at most.
    """
    out, open_ = np.zeros(len(pairs)), []
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    for k, (a, b) in enumerate(pairs):
        if not a or a in b:
            out[k] = float(bool(a) or not b)
        else:
            open_.append(k)
    open_.sort(key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    stretches, owner = [], []
    for first in range(0, len(open_), 4096):
        part = open_[first : first + 4096]
        n = np.array([len(pairs[k][0]) for k in part])
        ends = []
        # starts and ends no longer than the shorter text
        for own in ([(pairs[k][0], pairs[k][1][: len(pairs[k][0])]) for k in part], [(pairs[k][0][::-1], pairs[k][1][::-1][: len(pairs[k][0])]) for k in part]):
            common = _scan(own, starts=True)
            length = np.minimum(np.arange(common.shape[1]), n[:, None])
            out[part] = np.maximum(out[part], (2 * common / (n[:, None] + length)).max(1))
            ends.append(common[:, -1])
        for k, size, left, right in zip(part, n.tolist(), *[x.tolist() for x in ends], strict=True):
            a, b = pairs[k]
            last = len(b) - size
            own = {b[i : i + size] for i in range(1, last) if min(left + i, right + last - i, size) > out[k] * size}
            stretches += [(a, s) for s in own]
            owner += [k] * len(own)
    if stretches:
        np.maximum.at(out, owner, indels(stretches))
    return out


def partial(a: str, b: str) -> float:
    """Best indel similarity of the shorter text with a stretch of the longer that is as long, or cut at an end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    n = len(a)
    stretches = [b[k : k + n] for k in range(len(b) - n + 1)] + [b[:k] for k in range(1, n)] + [b[-k:] for k in range(1, n)]
    return max(indel(a, s) for s in stretches)


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free: dict[str, int] = {}  # a bit for each place of b that isn't taken
    for k, y in enumerate(b):
        free[y] = free.get(y, 0) | 1 << k
    taken, left = 0, []
    for k, x in enumerate(a):
        low = max(0, k - reach)
        near = (free.get(x, 0) & (1 << k + reach + 1) - 1) >> low << low
        if near:
            place = near & -near
            free[x] ^= place
            taken |= place
            left.append(x)
    m = len(left)
    if not m:
        return 0.0
    right = [y for k, y in enumerate(b) if taken >> k & 1]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


def _pairwise(function: Callable[[str, str], float]):  # noqa: ANN202
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = np.empty(len(a))
        for k, pair in enumerate(zip(a, b, strict=True)):
            if None in pair:
                out[k] = np.nan
                continue
            if pair not in known:
                known[pair] = function(*pair)
            out[k] = known[pair]
        return pd.Series(out).where(~np.isnan(out), None)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


def _batched(function: Callable[[list[tuple[str, str]]], np.ndarray]):  # noqa: ANN202
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        places: dict[tuple[str, str], int] = {}
        at = [-1 if None in pair else places.setdefault(pair, len(places)) for pair in zip(a, b, strict=True)]
        values = np.append(function(list(places)), np.nan)
        out = pd.Series(values[at])
        return out.where(out.notna(), None)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


ratio = _batched(indels)
partial_ratio = _batched(partials)
jaro_winkler_similarity = _pairwise(jaro_winkler)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(F.array_join(F.array_sort(F.split(a, " ")), " "), F.array_join(F.array_sort(F.split(b, " ")), " "))


def token_sets(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The best ratio among the common tokens and them with either side's rest; 1 if one side's rest is empty."""
    jobs, owner = [], []
    for k, (a, b) in enumerate(pairs):
        x, y = set(a.split()), set(b.split())
        both = " ".join(sorted(x & y))
        left, right = (" ".join([*filter(None, [both]), *sorted(rest)]) for rest in (x - y, y - x))
        own = [(left, right)] + ([(both, left), (both, right)] if both else [])
        jobs += own
        owner += [k] * len(own)
    out = np.zeros(len(pairs))
    if jobs:
        np.maximum.at(out, owner, indels(jobs))
    return out


token_set_ratio = _batched(token_sets)


def shared(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x, y))


def jaccard(x: Column, y: Column) -> Column:
    """Null if either set is empty."""
    common = shared(x, y)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), common / (F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - common))


def overlap(x: Column, y: Column) -> Column:
    return F.when((F.size(x) > 0) & (F.size(y) > 0), shared(x, y) / F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y))))


def dot(x: Column, y: Column) -> Column:
    """Inner product of two vectors of one length: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
