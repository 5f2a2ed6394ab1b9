"""Quality rules on repetition: rolling hashes of several n-gram lengths, in numpy.

For each whole text the operator measures how many characters lie inside repeated n-grams (each further
occurrence of an n-gram counts, its first one does not; a character counts once) and inside repeated lines.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are each judged alone;
an empty table gives an empty table; further columns are ignored, and a carried one with the name of a measure gives
way to the measure. One document is held at a time, so memory is
bounded by the longest text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from kinweave.llm.shared import map_batches, windows, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class Rules:
    """Most of a text's characters that may lie in repeated n-grams (by n) and in repeated lines."""

    min_words: int = 10
    base_window: int = 5
    base_percent: int = 20
    ngram_share: tuple[tuple[int, float], ...] = ((5, 0.20), (6, 0.18), (8, 0.16), (10, 0.14))
    line_share: float = 0.30


def repeated(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks: grams that occur twice or more, and those of them that are not the first."""
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        none = np.zeros(len(grams), bool)
        return none, none
    every = np.isin(grams, twice)
    later = every.copy()
    at = np.flatnonzero(every)
    later[at[np.unique(grams[at], return_index=True)[1]]] = False
    return every, later


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the ``size`` positions that a run of ``n`` from a marked start covers."""
    edge = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, rules: Rules) -> tuple:
    text = text or ""
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(line for line in text.split("\n") if line.strip(SPACES)) if "\n" in text else {}
    dup_lines = sum(lines.values()) - len(lines)
    line_chars = sum((k - 1) * (len(line) - sum(map(line.count, SPACES))) for line, k in lines.items() if k > 1)
    ids = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    every, later = repeated(windows(ids, rules.base_window))
    in_repeats = int(covered(every, rules.base_window, n).sum()) if every.any() else 0
    shares = []
    lengths = None
    for size, _ in rules.ngram_share:
        if size != rules.base_window:
            # a longer n-gram repeats only where the shorter ones do
            _, later = repeated(windows(ids, size)) if in_repeats else (None, np.zeros(0, bool))
        if not later.any():
            shares.append(0)
            continue
        if lengths is None:
            lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
        shares.append(int(lengths[covered(later, size, n)].sum()))
    failed = n < rules.min_words or 100 * in_repeats > rules.base_percent * n
    kept = not failed and line_chars <= rules.line_share * chars and all(c <= most * chars for c, (_, most) in zip(shares, rules.ngram_share, strict=True))
    return n, chars, symbols, dup_lines, in_repeats, failed, kept, line_chars, shares


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Measures and verdict for each row of ``docs``. ``carry``: further columns to return unchanged."""
    shorter = [s for s, _ in rules.ngram_share]
    if min(shorter) < rules.base_window:
        raise ValueError("n-grams shorter than the base window aren't supported")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars"]
    kinds = ["long"] * 5 + ["boolean"] * 2 + ["long"]
    columns = list(dict.fromkeys([id_col, text_col, *(c for c in carry if c not in names and c not in [f"dup_chars_{s}" for s in shorter])]))
    types = dict(docs.dtypes)
    out = [c for c in columns if c != text_col or text_col in carry]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in out), *(f"{a} {b}" for a, b in zip(names, kinds, strict=True)), *(f"dup_chars_{s} long" for s in shorter)])

    def run(*values: list) -> dict:
        given = dict(zip(columns, values, strict=True))
        found = [measure(text, rules) for text in given[text_col]]
        got = {c: given[c] for c in out} | {name: [f[i] for f in found] for i, name in enumerate(names)}
        return got | {f"dup_chars_{s}": [f[8][i] for f in found] for i, s in enumerate(shorter)}

    return map_batches(docs, columns, run, schema)


def judge_sql(rules: Rules = Rules()) -> str:
    """DuckDB SQL for the rows of ``judge`` over the table documents."""
    word = r"[^\x20\x09-\x0D]+"
    sizes = sorted({rules.base_window, *(n for n, _ in rules.ngram_share)})

    def gram(n: int) -> str:
        nexts = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER d" for k in range(1, n))])
        return f"{nexts} AS g{n}"

    marked = ", ".join(f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY r, g{n} ORDER BY k) > 1 AS again{n}" for n in sizes)
    inside = ", ".join(f"coalesce(bool_or(again{n}) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false) AS in{n}" for n, _ in rules.ngram_share)
    base = rules.base_window
    shares = ", ".join(f"coalesce(sum(length(w)) FILTER (in{n}), 0)::BIGINT AS dup_chars_{n}" for n, _ in rules.ngram_share)
    keep = " AND ".join(f"coalesce(dup_chars_{n}, 0) <= {most}::DOUBLE * word_chars" for n, most in rules.ngram_share)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM (SELECT r, regexp_extract_all(text, '{word}') AS ws FROM docs)),
grams AS (SELECT r, k, w, {", ".join(map(gram, sizes))} FROM words WINDOW d AS (PARTITION BY r ORDER BY k)),
marked AS (SELECT r, k, w, g{base} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{base}) > 1 AS twice, {marked} FROM grams),
inside AS (SELECT r, w, coalesce(bool_or(twice) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN {base - 1} PRECEDING AND CURRENT ROW), false) AS in_repeat, {inside} FROM marked),
measured AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (in_repeat) AS n_repeat_words, {shares} FROM inside GROUP BY r),
lines AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{word}') GROUP BY r, line),
repeated AS (SELECT r, sum(n - 1)::BIGINT AS n_dup_lines, sum((n - 1) * length(array_to_string(regexp_extract_all(line, '{word}'), '')))::BIGINT AS dup_line_chars FROM lines GROUP BY r),
judged AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_words, 0) < {rules.min_words} OR 100 * coalesce(n_repeat_words, 0) > {rules.base_percent} * coalesce(n_words, 0) AS base_failed,
    coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n, _ in rules.ngram_share)}
    FROM docs LEFT JOIN measured USING (r) LEFT JOIN repeated USING (r))
SELECT *, NOT base_failed AND dup_line_chars <= {rules.line_share}::DOUBLE * word_chars AND {keep} AS kept FROM judged"""
