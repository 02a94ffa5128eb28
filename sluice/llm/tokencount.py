"""Edit-aware token counting.

A document is kept as a segment tree: leaves are runs of whole pre-tokens, inner
nodes sum characters and tokens.  An edit touches a few leaves; only those, and
neighbours as far as a pre-token could reach across, are encoded again, and the
sums above them are updated.  A leaf that grows full is split; the tree keeps gaps between
leaves and grows by a level when it has too few.
"""

from __future__ import annotations

import base64

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import _process_cache, release

#: Characters that a leaf is aimed at.
LEAF = 1_024
#: Where pre-tokens never reach across: before white space that follows anything else,
#: and between a letter, a number and any other mark, but for an apostrophe and the
#: letters behind it, which may be one pre-token.  Control characters make no safe place.
_SAFE = regex.compile(
    r"(?<=\S)[ \n]"
    r"|(?<=\p{L})(?=[\p{N}]|[^\s\p{L}\p{N}\p{C}])"
    r"|(?<=\p{N})(?=[\p{L}]|[^\s\p{L}\p{N}\p{C}])"
    r"|(?<=[^\s\p{L}\p{N}\p{C}])(?=\p{N})"
    r"|(?<=[^\s\p{L}\p{N}\p{C}'])(?=\p{L})"
)


def _encoder(path: str, pattern: str):
    cache = _process_cache()
    kept = getattr(cache, "bpe", None)
    if kept is None or kept[0] != (path, pattern):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        kept = cache.bpe = ((path, pattern), enc)
    return kept[1].encode_ordinary


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    """Cut a text at safe places into leaves of about ``size`` characters.

    A run of letters alone (or of numbers, or of marks) is one pre-token and stays whole.
    """
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class TokenTree:
    """Token counts of one document under edits."""

    def __init__(self, text: str, encode, size: int = LEAF):
        self.encode, self.size, self.encoded_chars = encode, size, 0
        self.n = 1
        self.leaf, self.chars, self.tokens = [""], [0, 0], [0, 0]
        self._put(0, 0, [(x, len(x), self._count(x)) for x in leaves_of(text, size)])

    def _count(self, x: str) -> int:
        self.encoded_chars += len(x)
        return len(self.encode(x)) if x else 0

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, offset in it) of a character position; the end is in the last leaf used."""
        i = 1
        while i < self.n:
            i *= 2
            if at > self.chars[i] or (at == self.chars[i] and self.chars[i + 1]):
                at -= self.chars[i]
                i += 1
        return i - self.n, at

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters start..end (end exclusive)."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        (lo, a), (hi, b) = self._find(start), self._find(end)
        body = self.leaf[lo][:a] + new + self.leaf[hi][b:]
        old = {lo, hi}
        # Boundary context: go on until both ends are safe places again.
        while (k := self._beside(lo, -1)) is not None and not self._safe(self.leaf[k][-1], body[:1]):
            lo, body = k, self.leaf[k] + body
            old.add(k)
        while (k := self._beside(hi, 1)) is not None and not self._safe(body[-1:], self.leaf[k][0]):
            hi, body = k, body + self.leaf[k]
            old.add(k)
        known = {self.leaf[k]: self.tokens[self.n + k] for k in old}
        # A leaf that is full becomes two halves, not a whole one and a scrap.
        piece = len(body) // 2 if self.size < len(body) <= 2 * self.size else self.size
        parts = leaves_of(body, piece) if body else []
        self._put(lo, hi, [(x, len(x), known[x] if x in known else self._count(x)) for x in parts])

    def _put(self, lo: int, hi: int, parts: list[tuple[str, int, int]]) -> None:
        """Put ``parts`` (text, characters, tokens) in place of the leaves lo..hi.

        What does not fit there is spread over the least subtree around that is not too full, gaps
        left between; a subtree may be the fuller the smaller it is, so leaves move seldom. If
        all is too full the tree gets a level more.
        """
        width = 1
        while lo // width != hi // width:
            width *= 2
        while True:
            a = lo // width * width
            around = [self._entry(k) for k in range(a, lo) if self.leaf[k]], [self._entry(k) for k in range(hi + 1, a + width) if self.leaf[k]]
            used = [*around[0], *parts, *around[1]]
            levels = max(1, self.n.bit_length() - 1)
            if len(used) <= width * (1 - 0.5 * (width.bit_length() - 1) / levels) or (width == self.n and len(used) <= width <= 2):
                break
            if width < self.n:
                width *= 2
                continue
            while len(used) > self.n // 2:
                self.n *= 2
            self.leaf, self.chars, self.tokens = [""] * self.n, [0] * (2 * self.n), [0] * (2 * self.n)
            a, width = 0, self.n
            break
        for k in range(a, a + width):
            self.leaf[k], self.chars[self.n + k], self.tokens[self.n + k] = "", 0, 0
        for j, entry in enumerate(used):
            k = a + j * width // len(used)
            self.leaf[k], self.chars[self.n + k], self.tokens[self.n + k] = entry
        lo, hi = (a + self.n) // 2, (a + width - 1 + self.n) // 2
        while lo:
            for i in range(lo, hi + 1):
                self._sum(i)
            lo, hi = lo // 2, hi // 2

    def _entry(self, k: int) -> tuple[str, int, int]:
        return self.leaf[k], self.chars[self.n + k], self.tokens[self.n + k]

    def _beside(self, k: int, step: int) -> int | None:
        """The nearest leaf with text before (step -1) or behind (1) a leaf, found by the sums."""
        i = self.n + k
        while i > 1:
            if (i & 1) == (step < 0) and self.chars[i + step]:
                i += step
                while i < self.n:
                    i = 2 * i + (step < 0)
                    i = i if self.chars[i] else i ^ 1
                return i - self.n
            i //= 2
        return None

    @staticmethod
    def _safe(before: str, after: str) -> bool:
        if not before or not after:
            return not before and not after
        return _SAFE.match(before + after, 1) is not None


def count_tokens(text: Column, edits: Column, ranks_path: str, pattern: str) -> Column:
    """struct(n_chars, n_tokens, edited_chars, edited_tokens, reencoded_chars).

    ``edits``: array<struct<start int, end int, new string>>, applied in order
    to the whole text (positions in code points, of the text as edited so far;
    out of range: moved into it; a null field: 0, 0 or empty; a null array: no
    edit).  A null text is empty; texts may be of any length; repeated rows are counted each; an
    empty table gives no rows.
    """

    def run(texts: pd.Series, changes: pd.Series) -> pd.DataFrame:
        encode, rows = _encoder(ranks_path, pattern), []
        for t, es in zip(texts, changes):
            tree = TokenTree(t, encode)
            before, built = (tree.n_chars, tree.n_tokens), tree.encoded_chars
            for e in es if es is not None else ():
                tree.edit(int(e["start"] or 0), int(e["end"] or 0), e["new"] or "")
            rows.append((*before, tree.n_chars, tree.n_tokens, tree.encoded_chars - built))
        release()
        return pd.DataFrame(rows, columns=["n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars"])

    kind = "n_chars long, n_tokens long, edited_chars long, edited_tokens long, reencoded_chars long"
    return F.pandas_udf(run, kind)(F.coalesce(text, F.lit("")), edits)
