"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case runs of letters and digits joined by single blanks. An item of n characters may
differ in k = floor(``RATE`` * n) edits. Cut into k + 1 pieces, one piece at least survives any k edits unharmed, so exact
piece hits (an Aho-Corasick automaton over a whole text) miss no passage. Hits on one diagonal give one window, which
Myers' bit-parallel distance verifies.

Items are the stated query set: they are taken in blocks of about ``BLOCK``, each against all texts; texts are never
shuffled. Null texts and items, and items without a letter or digit, match nothing; items shorter than 1 / ``RATE``
characters need an exact hit. Repeated rows give repeated results; empty tables give an empty table.
"""

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

RATE, BLOCK = 0.08, 5_000
_APART = regex.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _APART.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (offset, text) of nearly equal length that cover the item."""
    edges = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any substring of ``text`` and where that substring ends, one bit a character."""
    m = len(item)
    at: dict[str, int] = {}
    for j, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << j
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (mask & ~(diagonal | plus)), plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus, minus = (down | ~(diagonal | up)) & mask, up & diagonal & mask
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """All items of a block over one text at a time."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items, by_piece = [], {}
        for item_id, text in items:
            n = normal(text)
            if n:
                k = int(rate * len(n))
                for offset, piece in pieces(n, k):
                    by_piece.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, n, k))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        if by_piece:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, its least possible budget) of every item found, with its best distance."""
        t = normal(text)
        if not t or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(t):
            for item, offset in where:
                starts.setdefault(item, set()).add(last + 1 - size - offset)
        out = []
        for item, found in starts.items():
            item_id, n, k = self.items[item]
            best, at = k + 1, sorted(found)
            low = at[0]
            for j, s in enumerate(at):
                if j + 1 < len(at) and at[j + 1] - s <= k:
                    continue  # same window
                best = min(best, myers(n, t[max(0, low - k) : s + len(n) + k])[0])
                low = at[j + 1] if j + 1 < len(at) else low
            if best <= k:
                out.append((item_id, best, k))
        return out


def _finder(shared, rate: float):
    @F.pandas_udf("array<struct<item_id:bigint,distance:bigint,budget:bigint>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Matcher(shared.value, rate)
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "distance", "budget"), hit)) for hit in of(t)] for t in texts])

    return find


def with_items(docs: DataFrame, items: DataFrame, text: str = "text", rate: float = RATE, name: str = "items") -> DataFrame:
    """``docs`` with ``name``: an array of (item_id, distance, budget) of the items found in the row's text.

    ``items`` has item_id and text. No join takes place, so any other columns ride along.
    """
    usable = items.where("text is not null").select("item_id", "text").distinct()
    blocks = max(1, -(-usable.count() // BLOCK))
    of_block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for b in range(blocks):
        block = [(r.item_id, r.text) for r in usable.where(of_block == b).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found.append(_finder(shared, rate)(F.col(text)))
    return docs.withColumn(name, F.concat(*found))


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, budget): every item found in every text of ``docs`` (doc_id, text)."""
    named = with_items(docs.select("doc_id", "text"), items, rate=rate, name="found")
    return named.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
