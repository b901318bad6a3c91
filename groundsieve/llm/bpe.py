"""Exact word-level BPE: pre-token split, merge ranks and prefix dynamic programming.

The vocabulary file marks word ends, so a pre-token of bytes b1..bn is encoded as the symbols
b1, .., b(n-1), bn+end. Byte 0xFF never occurs in UTF-8; here it stands for the end mark, which
turns every token into plain bytes and lets a byte-pair encoder by rank encode a pre-token.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken

END = b"\xff"
#: The pre-token pattern of the file, and its two strings that are one token each.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words between these are encoded on their own: no pre-token, composition or special string spans them.
WORDS = regex.compile(r"[^ \t\n\r]+")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level files: printable Latin-1 stays, the rest moves above 255."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in stays]
    return {chr(b): b for b in stays} | {chr(256 + k): b for k, b in enumerate(moved)}


class WordBpe:
    """Encoder of one vocabulary file. ``ids`` and ``prefix_counts`` agree with the library's encode of the same text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, ranks = _byte_of(), {}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for token, i in spec["model"]["vocab"].items():
            if i not in self.special.values():
                last = token.endswith("</w>")
                ranks[bytes(byte_of[c] for c in token.removesuffix("</w>")) + END * last] = i
        self._bpe = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special))) if self.special else None
        self._pieces = regex.compile(PIECES)
        self._bytes_of = {i: b for b, i in ranks.items()}
        self._whole = {b: i for b, i in ranks.items() if self._bpe.encode_single_piece(b) == [i]}  # tokens that the merges reach
        self._longest = max(map(len, ranks))
        self._fits: dict[tuple[int, int], bool] = {}
        self._totals = Cache(self._total)  # words share pre-tokens: "The", "the" and "the," have one

    def _normal(self, s: str) -> str:
        s = unicodedata.normalize("NFC", s)
        return s.lower() if "Σ" not in s else "".join(c.lower() for c in s)  # no context rule for sigma

    def _parts(self, word: str) -> list[tuple[str, bool]]:
        """(text, whether it is a special string) in order; special strings are found before normalising."""
        if self._special is None or "<|" not in word:
            return [(word, False)]
        out, at = [], 0
        for m in self._special.finditer(word):
            out += [(word[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [p for p in [*out, (word[at:], False)] if p[0]]

    def ids(self, word: str) -> list[int]:
        """Token ids of a text without white space between words (a longer text is fine, only slower)."""
        out: list[int] = []
        for part, special in self._parts(word):
            if special:
                out.append(self.special[part])
            else:
                for piece in self._pieces.findall(self._normal(part)):
                    out += self._bpe.encode_single_piece(piece.encode() + END)
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow ``a`` inside a pre-token: encoding their bytes gives just these two."""
        key = (a, b)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._bpe.encode_single_piece(self._bytes_of[a] + self._bytes_of[b]) == [a, b]
        return known

    def piece_counts(self, piece: bytes, ends: list[int]) -> list[int]:
        """Tokens of each prefix piece[:e] as a pre-token of its own, for the ascending byte positions ``ends``.

        inner[i] holds count and last token of the first i bytes without an end mark. A token that ends at i extends the
        one solution before it where the two fit, and exactly one does; the end-marked variant gives the prefix's count.
        """
        n, ranks, fits, spare = len(piece), self._whole, self._fits, self.fits
        count, last, wanted, out = [0] * (n + 1), [-1] * (n + 1), set(ends), []
        for i in range(1, n + 1):
            low = max(0, i - self._longest)
            for j in range(low, i):
                if (t := ranks.get(piece[j:i])) is not None:
                    before = last[j]
                    if not j or fits.get((before, t)) or ((before, t) not in fits and spare(before, t)):
                        count[i], last[i] = count[j] + 1, t
                        break
            if i in wanted:
                for j in range(low, i):
                    if (t := ranks.get(piece[j:i] + END)) is not None and (j == 0 or spare(last[j], t)):
                        out.append(count[j] + 1)
                        break
        return out

    def count(self, word: str) -> int:
        """Tokens of a whole word by the same programme."""
        total = 0
        for part, special in self._parts(word):
            if special:
                total += 1
            else:
                total += sum(map(self._totals.__getitem__, self._pieces.findall(self._normal(part))))
        return total

    def _total(self, piece: str) -> int:
        data = piece.encode()
        return self.piece_counts(data, [len(data)])[0]

    def prefix_counts(self, word: str) -> np.ndarray:
        """Token count of every code-point prefix of a word: position k holds the count of word[:k].

        Where normalising keeps each code point apart (composed text), a prefix's pre-tokens are those of the word, the
        last one cut. Otherwise (combining marks, contractions, special strings) each prefix is encoded by itself.
        """
        plain = word.isascii() or (unicodedata.is_normalized("NFC", word) and len(self._normal(word)) == len(word)
                                   and not any(unicodedata.combining(c) for c in word))
        if not plain or "'" in word or "<|" in word:
            return np.array([len(self.ids(word[:k])) for k in range(len(word) + 1)], np.int32)
        out, before = [0] * (len(word) + 1), 0
        for m in self._pieces.finditer(self._normal(word)):
            ends, at = [], 0
            for c in m[0]:
                at += len(c.encode())
                ends.append(at)
            counts = self.piece_counts(m[0].encode(), ends)
            for k, c in enumerate(counts, m.start() + 1):
                out[k] = before + c
            before += counts[-1]
            for k in range(m.end() + 1, len(word) + 1):
                out[k] = before
                break
        # code points outside any pre-token keep the count before them
        run = 0
        for k in range(len(out)):
            run = out[k] = out[k] or run
        return np.array(out, np.int32)


@lru_cache(maxsize=4)
def encoder(path: str) -> WordBpe:
    """One encoder per process and file."""
    return WordBpe(path)


@lru_cache(maxsize=4)
def word_counts(path: str) -> "Cache":
    """Token counts by word, kept from task to task of a worker process."""
    return Cache(encoder(path).count)


class Cache(dict):
    """Word -> value by ``make``; forgets everything beyond ``most`` words. Words above ``longest`` are not kept."""

    def __init__(self, make, most: int = 500_000, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value
