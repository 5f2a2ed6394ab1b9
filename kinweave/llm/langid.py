"""Language identification by compression.

Per language a raw-content dictionary is cut from a bounded sample of labelled rows. A text is compressed, block by
block, once with each dictionary; the language that needs the fewest bytes is chosen. A text whose two best languages
lie within a narrow margin is marked ``rejected``.

Defined results: null texts and texts without a letter (Unicode category L; numerals like Ⅷ, ½ and ① are none) get
``und``, score 0 and are rejected, as are all texts if nothing could be learned; a carried column with the name of a
result gives way to the result; languages with equal sizes are taken in alphabetical order; repeated rows give equal rows;
an empty table gives an empty table; further columns are ignored. Long texts are compressed whole, in blocks.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import map_batches

UNDETERMINED = "und"
OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    #: Bounds of the sample: documents taken for a language, bytes taken from one of them, bytes of a dictionary.
    sample_docs: int = 192
    doc_bytes: int = 512
    dictionary_bytes: int = 98_304
    level: int = 6
    block_bytes: int = 4096
    #: A text is rejected if the second language needs less than this share more than the first.
    margin: float = 0.004


def letters(text: str) -> str:
    """Lower case, with one space for whatever lies between letters: case, digits and signs tell no language."""
    return OTHER.sub(" ", text.lower()).strip()


def learn(docs: DataFrame, learnable: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of the rows where ``learnable`` holds.

    The driver gets at most about 2 * ``sample_docs`` pieces of ``doc_bytes`` for each language: rows are drawn by a
    hash of their id, under a bound that the language's row count sets. The row counts need no text column.
    """
    rows = docs.filter(learnable & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000))
    share = {lang: min(1_000_000, math.ceil(1_000_000 * (settings.sample_docs + 3 * math.sqrt(settings.sample_docs)) / n)) for lang, n in counts.items()}
    bound = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])
    # the middle of a text is taken: near copies often share their first words
    size = F.length(text_col)
    piece = F.substring(F.col(text_col), F.greatest(F.lit(1), F.floor(size / 2 - settings.doc_bytes / 2)).cast("int"), F.lit(settings.doc_bytes))
    drawn = rows.filter(F.col(text_col).isNotNull() & (draw < F.element_at(bound, F.col(lang_col)))).select(lang_col, draw.alias("draw"), piece.alias("piece")).distinct()
    taken: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(drawn.collect()):
        if len(taken.setdefault(lang, [])) < settings.sample_docs:
            taken[lang].append(letters(text).encode()[: settings.doc_bytes])
    return {lang: b"\n".join(pieces)[-settings.dictionary_bytes :] for lang, pieces in taken.items() if any(pieces)}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], settings: Settings):
        self.settings = settings
        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            held = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=settings.level)
            self.compressors.append(zstandard.ZstdCompressor(level=settings.level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether the text is rejected.

        The score is the share of the best language among weights of two to the minus bits, at 1/64 of the bits.
        """
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, True
        data = letters(text).encode("utf-8", "surrogatepass")
        step = self.settings.block_bytes
        blocks = [data[at : at + step] for at in range(0, len(data), step)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(others) - sizes[best]) / sizes[best] if others else 1.0
        score = 1.0 / (1.0 + sum(2.0 ** max(-60.0, (sizes[best] - s) / 8) for s in others))
        return self.languages[best], score, margin, bool(others) and margin < self.settings.margin


_classifiers: dict[int, Classifier] = {}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``carry``, ``lang_pred``, ``score``, ``margin``, ``rejected`` for each row.

    The dictionaries travel as a broadcast variable: one bounded piece for each language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    results = ("lang_pred", "score", "margin", "rejected")
    columns = list(dict.fromkeys([id_col, text_col, *(c for c in carry if c not in results)]))
    out = [c for c in columns if c != text_col or text_col in carry]
    types = dict(docs.dtypes)
    key = sent.id if hasattr(sent, "id") else sent._jbroadcast.id()

    def run(*values: list) -> dict:
        if key not in _classifiers:
            _classifiers.clear()
            _classifiers[key] = Classifier(sent.value, settings)
        given = dict(zip(columns, values, strict=True))
        found = [_classifiers[key].predict(text) for text in given[text_col]]
        return {c: given[c] for c in out} | {name: [f[i] for f in found] for i, name in enumerate(results)}

    return map_batches(docs, columns, run, ", ".join([*(f"`{c}` {types[c]}" for c in out), "lang_pred string, score double, margin double, rejected boolean"]))
