"""Splitting long texts at natural boundaries by content-defined chunking.

A rolling hash over the characters marks landmarks; each landmark moves to the
nearest natural boundary (section, paragraph, environment, line, sentence).
From the start of a piece the next landmark between the least and the greatest
size ends it; without one, the last of the strongest boundaries before the
greatest size; without any, the last place between two tokenizer pieces.
Landmarks depend on the text around them alone, so an edit alters the pieces
beside it and later pieces fall into step at the next landmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytoscape.llm.tokens import TokenCounter

# kinds of boundary, strongest first; the cut lies at the end of the match
_BOUNDARIES = [
    re.compile(r"\n(?=\\(?:sub)*section\b|\\chapter\b|\\begin\{(?:document|abstract|thebibliography)\})"),
    re.compile(r"\n[ \t\r]*\n\s*|\n(?=\\begin\{)|\\end\{[^}\n]*\}[ \t]*\r?\n?|\\par\b\s*"),
    re.compile(r"[.!?](?:['\")\]}]|\$)*(?:\s+|~)(?=\S)|(?<=[.!?])\r?\n"),
    re.compile(r"\r?\n|[;:,]\s"),
]
_WINDOW = 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Split:
    """Sizes in tokens. A piece has at most ``limit`` tokens, its overlap with the piece before included."""

    limit: int = 512
    least: int = 128
    overlap: int = 32
    landmark_chars: int = 1_024


def landmarks(text: str, every: int) -> np.ndarray:
    """Character positions whose last 32 characters hash to 0 modulo ``every``."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(h) < _WINDOW:
        return np.zeros(0, np.int64)
    h = h * _MULT
    h ^= h >> np.uint64(29)
    width, mult = 1, int(_MULT)
    while width < _WINDOW:  # hashes of windows of twice the width
        g = h.copy()
        g[width:] += h[:-width] * np.uint64(mult)
        h, mult, width = g, mult * mult % (1 << 64), width * 2
    h = h[_WINDOW - 1:]
    return np.flatnonzero(((h >> np.uint64(20)) * np.uint64(every)) >> np.uint64(44) < 1) + _WINDOW if every > 1 else np.arange(_WINDOW, _WINDOW + len(h))


def split_text(text: str, counter: TokenCounter, p: Split) -> list[tuple[int, int, int, int]]:
    """(start, core start, end, tokens) of the pieces; cores follow each other without gap and make up the text. Tokens are what the tokenizer gives the piece itself. [] if the text is within the limit."""
    ends, toks = counter.spans(text)
    if toks[-1] <= p.limit:
        return []
    kinds = [np.array([m.end() for m in b.finditer(text)], np.int64) for b in _BOUNDARIES]
    at = lambda chars: np.searchsorted(ends, chars, "right") - 1  # noqa: E731  # the last tokenizer piece boundary at or before: a blank belongs to the word after it
    kinds = [np.unique(at(k)) for k in kinds]
    natural = np.unique(np.concatenate(kinds[:3]))
    marks = at(landmarks(text, p.landmark_chars))
    if len(natural) and len(marks):
        i = np.clip(np.searchsorted(natural, marks), 1, len(natural) - 1) if len(natural) > 1 else np.zeros(len(marks), int)
        low = natural[np.maximum(i - 1, 0)]
        marks = np.unique(np.where(np.abs(ends[low] - ends[marks]) <= np.abs(ends[natural[i]] - ends[marks]), low, natural[i]))
    out, s, n = [], 0, len(ends) - 1
    while s < n:
        back = s
        if s:
            back = int(np.searchsorted(toks, toks[s] - p.overlap))  # at most the overlap
        room = toks[back] + p.limit - 1  # one token is kept for white space that joins at a piece's end
        last = int(np.searchsorted(toks, room, "right")) - 1
        if last <= s:  # a single tokenizer piece that leaves no room beside the overlap
            back, last = s, max(s + 1, int(np.searchsorted(toks, toks[s] + p.limit - 1, "right")) - 1)
        if last >= n:
            e = n
        else:
            first = int(np.searchsorted(toks, toks[s] + p.least))
            e = 0
            i = np.searchsorted(marks, first)
            if i < len(marks) and marks[i] <= last:
                e = int(marks[i])
            else:
                for k in kinds:
                    j = np.searchsorted(k, last, "right") - 1
                    if j >= 0 and k[j] >= max(first, s + 1):
                        e = int(k[j])
                        break
            e = e or last
        # white space at the end joins when the piece stands alone: only that part is counted anew
        stop = int(ends[back]) + len(text[ends[back]:ends[e]].rstrip())
        word = int(np.searchsorted(ends, stop))
        tokens = int(toks[word] - toks[back]) + counter.count(text[stop:ends[e]]) if ends[word] == stop else counter.count(text[ends[back]:ends[e]])
        out.append((int(ends[back]), int(ends[s]), int(ends[e]), tokens))
        s = e
    return out


def split_documents(docs: DataFrame, key: str, text: str, p: Split = Split(), vocabulary: str | None = None) -> DataFrame:
    """(key, piece, start, core_start, end, tokens, piece_text) of every text longer than the limit.

    Missing, empty and short texts give no rows; rows are independent, repeated
    keys included. A tokenizer piece longer than the limit (a very long run of
    one kind of character) is cut by characters.
    """

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(vocabulary)
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"]):
                if not t:
                    continue
                no = 0
                for start, core, end, tokens in split_text(t, counter, p):
                    if tokens <= p.limit:
                        rows.append((k, no, start, core, end, tokens, t[start:end]))
                        no += 1
                        continue
                    step = p.limit // 4  # a character has at most four bytes, so as many tokens
                    for c in range(core, end, step):
                        part = t[c:min(end, c + step)]
                        rows.append((k, no, c, c, c + len(part), counter.count(part), part))
                        no += 1
            yield pd.DataFrame(rows, columns=["key", "piece", "start", "core_start", "end", "tokens", "piece_text"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(go, "key long, piece int, start int, core_start int, end int, tokens int, piece_text string")
