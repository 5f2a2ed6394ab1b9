"""Encoding of texts by way of their distinct pre-tokens, kept in bounded caches."""

from __future__ import annotations

CACHE_PIECES = 600_000


class PieceEncoder:
    """A tokenizer that cuts a text into pieces, encoded independently; no piece holds white space past its start.

    A piece then never reaches across a single space between two characters that aren't white space. Texts are cut
    there, and each distinct cut is encoded once as long as the cache holds it.
    """

    def __init__(self):
        self.chunks: dict[str, bytes] = {}

    def encode_each(self, chunks: list[str], texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of each chunk with a space before it, and of each text: little-endian unsigned 32-bit integers."""
        raise NotImplementedError

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        heads, cuts = [], []
        for text in texts:
            head, *parts = text.split(" ") if text else ("",)
            heads.append(head)
            cuts.append(parts)
        met = set().union(*cuts)
        if len(self.chunks) > CACHE_PIECES:
            self.chunks = {part: self.chunks[part] for part in met & self.chunks.keys()}
        unknown = met - self.chunks.keys()
        # at an end, white space would belong to a run that reaches beyond the cut
        open_ended = {part for part in unknown if not part or part[0].isspace() or part[-1].isspace()}
        whole = {k for k, head in enumerate(heads) if cuts[k] and (not head or head[-1].isspace() or not open_ended.isdisjoint(cuts[k]))}
        fresh = list(unknown - open_ended)
        new, first = self.encode_each(fresh, [texts[k] if k in whole else head for k, head in enumerate(heads)])
        self.chunks.update(zip(fresh, new, strict=True))
        ids_of = self.chunks.__getitem__
        return [got if k in whole else b"".join([got, *map(ids_of, cuts[k])]) for k, got in enumerate(first)]
