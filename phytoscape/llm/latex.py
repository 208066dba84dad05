"""Words of LaTeX texts: own macros written out, markup, citations and comment signs disregarded."""

from __future__ import annotations

import re
import sys
import unicodedata

_DEFINED = re.compile(r"\\(?:(?:re)?newcommand|providecommand|DeclareRobustCommand)\*?\s*\{?\s*\\([A-Za-z]+)\s*\}?\s*(?:\[(\d)\])?(?:\[[^\]]*\])?\s*(?=\{)|\\[gex]?def\s*\\([A-Za-z]+)\s*((?:#\d)*)\s*(?=\{)")
_BREAK = re.compile(r"-(?:[ \t]*%?[ \t]*\r?\n[ \t%]*(?=\w)|(?<=\w-)(?=\w))")
_DROPPED = re.compile(
    r"\\(?:[a-z]*cite[a-z]*|ref|eqref|autoref|cref|pageref|label|bibitem|bibliography|bibliographystyle|input|include|includegraphics|usepackage|documentclass|begin|end|vspace|hspace)\*?\s*(?:\[[^\[\]]*\]\s*)*(?:\{[^{}]*\})?|\\[a-z@]+\*?",
)
_ACCENT = re.compile(r"\{?\\(?:[\"'`^~=.]\s*\{?\\?([a-zA-Z])\}?|[cvukrHdb]\s*\{\s*\\?([a-zA-Z])\s*\})\}?")
_LETTERS = {"ss": "ss", "ae": "ae", "AE": "ae", "oe": "oe", "OE": "oe", "o": "o", "O": "o", "aa": "a", "AA": "a", "l": "l", "L": "l", "i": "i", "j": "j"}
_LETTER = re.compile(r"\{?\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L)(?![A-Za-z])(?:\{\}|\s)?\}?")
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b]+")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def _group(text: str, at: int) -> int:
    """End of the brace group that opens at ``at``; -1 if it never closes."""
    depth, i = 0, at
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                i = m.end()
                return i
    return -1


def _definitions(text: str) -> tuple[str, dict[str, tuple[int, str]]]:
    """The text without the definitions of its own macros, and their (number of arguments, body); of several definitions the last holds."""
    bodies: dict[str, tuple[int, str]] = {}
    out, last = [], 0
    for m in _DEFINED.finditer(text):
        if m.start() < last:
            continue
        end = _group(text, m.end())
        if end < 0:
            continue
        bodies[m[1] or m[3]] = (int(m[2] or 0) if m[1] else len(m[4] or "") // 2, text[m.end() + 1:end - 1].replace("\\xspace", ""))
        out.append(text[last:m.start()])
        last = end
    return "".join([*out, text[last:]]), bodies


class Overgrown(ValueError):
    """The macros of a text write out to more than any article could hold."""


def write_out_macros(text: str, growth: int = 64) -> str:
    """The text with the uses of its own macros replaced by their bodies, arguments included; definitions are left out.

    Macros are written out at any depth and length. A macro that is used within
    itself stays as it stands there (it has no finite form). Macros that would
    make the text more than ``growth`` times as long, and longer than 16 million
    characters, raise ``Overgrown``.
    """
    text, bodies = _definitions(text)
    if not bodies:
        return text
    use = re.compile(r"\\(" + "|".join(sorted(map(re.escape, bodies), key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\}|\\(?=\s)|[ \t]*\{\})?")
    most, made, plain = max(16_000_000, growth * len(text)), 0, {}

    def expand(t: str, within: frozenset) -> str:
        nonlocal made
        parts, last = [], 0
        for m in use.finditer(t):
            if m.start() < last or m[1] in within:
                continue
            n, body = bodies[m[1]]
            end = m.end()
            args = []
            for _ in range(n):
                while t[end:end + 1].isspace():
                    end += 1
                close = _group(t, end) if t[end:end + 1] == "{" else -1
                args.append(expand(t[end + 1:close - 1] if close > 0 else t[end:end + 1], within))
                end = close if close > 0 else end + 1
            if not n and (m[1], within) in plain:
                body = plain[m[1], within]
            else:
                body = re.sub(r"#([1-9])", lambda a, args=args: args[int(a[1]) - 1] if int(a[1]) <= len(args) else a[0], body) if n else body
                body = expand(body, within | {m[1]})
                if not n:
                    plain[m[1], within] = body
            made += len(body)
            if made > most:
                raise Overgrown
            parts += [t[last:m.start()], body, "" if n else " "]
            last = end
        return "".join([*parts, t[last:]])

    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(max(depth, 4 * len(bodies) + text.count("{") + 10_000))  # as deep as macros and groups can nest
    try:
        return expand(text, frozenset())
    finally:
        sys.setrecursionlimit(depth)


def words(text: str | None) -> list[str]:
    """Lower-case words; accents are disregarded, hyphens within words and at line breaks join, dashes part."""
    if not text:
        return []
    if "\\" in text:
        if "newcommand" in text or "def" in text or "providecommand" in text or "DeclareRobust" in text:
            try:
                text = write_out_macros(text)
            except Overgrown:  # reported by leakage.overgrown; the bodies count where they are defined
                pass
        text = _LETTER.sub(lambda m: _LETTERS[m[1]], _ACCENT.sub(lambda m: m[1] or m[2], text))
    plain = text.isascii()
    text = text.lower() if plain else _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))
    if "-" in text:
        text = _BREAK.sub("", text.replace("\\-", ""))
    if "\\" in text:
        text = _DROPPED.sub(" ", text)
    return (_ASCII_WORD if plain else _WORD).findall(text)
