"""What byte-level BPE counting and encoding share: where a text may be cut, and the pattern's matches.

The pattern of the rank files never lets a match cross a space that has a character other than white space on both
sides: such a space starts a match. Texts are cut there, and the pieces, which repeat a lot, are worked out once each.
"""

from __future__ import annotations

import re

import regex

#: White space as Unicode's property has it (fixed values); Python's own \\s has a few control characters more.
WHITE = r"\t-\r\x20\x85\xa0  -     　"

_BESIDE_SPACE = re.compile(r" \s|\s ")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


#: Letters and numbers (fixed values) of Unicode 17 and 18, which the installed regex module knows and the libraries, at
#: Unicode 16, take for neither.
NEWER = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    r"\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_NEWER = regex.compile(f"[{NEWER}]")


class Pattern:
    """A tokenizer's pattern, with white space written out as above and letters and numbers as of the libraries' Unicode version."""

    def __init__(self, source: str):
        plain = source.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        other = f"[^{WHITE}" + r"\p{L}\p{N}]"
        exact = plain.replace(other, "\0").replace(r"\p{L}", rf"(?:(?![{NEWER}])\p{{L}})").replace(r"\p{N}", rf"(?:(?![{NEWER}])\p{{N}})")
        self.plain, self.exact = regex.compile(plain).findall, regex.compile(exact.replace("\0", f"(?:{other}|[{NEWER}])")).findall

    def findall(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or not _NEWER.search(text) else self.exact(text)


def pattern(source: str) -> Pattern:
    return Pattern(source)


def pieces(text: str) -> list[str]:
    """The first piece as it stands; each later one stands for a space and itself."""
    if _BESIDE_SPACE.search(text):
        return _SAFE_SPACE.split(text)
    return text.split(" ")
