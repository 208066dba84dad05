"""Token counts of a public byte-level BPE vocabulary, by pieces the vocabulary never merges across."""

from __future__ import annotations

import base64
import re

import numpy as np

# fixed values: the splitting pattern of the vocabulary for ASCII texts; other texts use the published Unicode pattern
_ASCII = re.compile(r"'(?:[smtd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+")
_KEPT = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TokenCounter:
    """Counts tokens; ``pieces`` gives the splits and ``sizes`` their token counts, which add up to the text's."""

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        import regex
        import tiktoken

        with open(vocabulary or default_vocabulary(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._other = regex.compile(public_tokenizers.PATTERN)
        self._known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        return (_ASCII if text.isascii() else self._other).findall(text)

    def sizes(self, pieces: list[str]) -> list[int]:
        known = self._known
        if len(known) > _KEPT:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = len(self._encode(p))
        return list(map(known.__getitem__, pieces))

    def count(self, text: str | None) -> int:
        return sum(self.sizes(self.pieces(text))) if text else 0

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(character end, tokens up to there) of each piece, both starting with 0."""
        p = self.pieces(text)
        ends = np.zeros(len(p) + 1, np.int64)
        toks = np.zeros(len(p) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, p), np.int64, len(p)), out=ends[1:])
        np.cumsum(np.array(self.sizes(p), np.int64), out=toks[1:])
        return ends, toks
