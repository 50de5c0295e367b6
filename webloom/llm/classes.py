"""The byte-pair split patterns in the form of Python's own ``re``.

A bracket expression with all letters of Unicode is slow in ``re``; one for code points below U+0250 is
fast. So a pattern is kept in two forms: the short one for texts that stay below U+0250, and for other
texts the full one, run by ``regex``. Both give the same pieces.
"""

from __future__ import annotations

import re

from webloom.llm.common import kept_by_worker

LATIN = 0x250


def spelled(prop: str) -> str:
    """The code points below U+0250 of a Unicode property, as the inside of a bracket expression."""
    import regex

    every = "".join(map(chr, range(LATIN)))
    return "".join(f"\\u{ord(m[0]):04x}-\\u{ord(m[-1]):04x}" for m in regex.findall(rf"\p{{{prop}}}+", every))


def rewritten(pattern: str, letters: str, numbers: str, space: str) -> str:
    """``pattern`` with \\p{L}, \\p{N}, \\s and \\S replaced by bracket expressions of these insides."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two, five = pattern[i : i + 2], pattern[i : i + 5]
        if five in (r"\p{L}", r"\p{N}"):
            body = letters if five == r"\p{L}" else numbers
            out.append(body if inside else f"[{body}]")
            i += 5
        elif two in (r"\s", r"\S"):
            if inside and two == r"\S":
                raise ValueError(r"\S inside a bracket expression can't be rewritten")
            out.append(space if inside else f"[{'^' if two == r'\S' else ''}{space}]")
            i += 2
        else:
            inside = {"[": True, "]": False}.get(pattern[i], inside)
            out.append(pattern[i])
            i += 1
    return "".join(out)


class Splitter:
    """All matches of a pattern in a text."""

    def __init__(self, pattern: str):
        import regex

        self.short = re.compile(rewritten(pattern, spelled("L"), spelled("N"), spelled("White_Space"))).findall
        # \s of the property engine also takes U+001C to U+001F, which the tokenizer libraries don't
        self.full = regex.compile(rewritten(pattern, r"\p{L}", r"\p{N}", r"\p{White_Space}")).findall
        self.low = re.compile(f"[\\0-\\u{LATIN - 1:04x}]*").fullmatch

    def __call__(self, text: str) -> list[str]:
        return self.short(text) if self.low(text) else self.full(text)


def splitter(pattern: str) -> Splitter:
    return kept_by_worker(("pattern", pattern), lambda: Splitter(pattern))
