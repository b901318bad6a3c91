"""Token counts by prefix dynamic programming.

A document's prefix table is exact and two-level: running counts at word ends, and per distinct word the counts of all
its prefixes (``bpe.WordBpe.piece_counts``). Any "tokens of the first k characters" or "longest prefix within a budget"
question is a look-up; no text is encoded twice, and equal words share one table per task.

Null text counts as empty (0 tokens); texts may have any length; repeated rows give repeated results; an empty table
gives an empty table. Columns other than the text pass through ``with_counts`` untouched.
"""

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.llm.bpe import WORDS, Cache, encoder, word_counts


class PrefixTable:
    """Counts of every prefix of one text, without storing one number per character."""

    def __init__(self, text: str, path: str, counts: Cache | None = None):
        self.bpe, self.spans = encoder(path), [m.span() for m in WORDS.finditer(text)]
        self.text = text
        counts = word_counts(path) if counts is None else counts
        self.totals = [0, *accumulate(counts[text[a:b]] for a, b in self.spans)]

    def tokens(self, k: int) -> int:
        """Tokens of text[:k]."""
        w = bisect_right(self.spans, (k, -1))  # words that begin before k
        if w and self.spans[w - 1][1] > k:
            a, b = self.spans[w - 1]
            return self.totals[w - 1] + int(self.bpe.prefix_counts(self.text[a:b])[k - a])
        return self.totals[w]

    def longest(self, budget: int) -> int:
        """The largest k for which text[:k] has at most ``budget`` tokens."""
        w = bisect_right(self.totals, budget)  # the first word whose end is beyond the budget, from 1
        if w > len(self.spans):
            return len(self.text)
        a, b = self.spans[w - 1]
        inside = self.bpe.prefix_counts(self.text[a:b])
        return a + max(k for k in range(len(inside)) if self.totals[w - 1] + inside[k] <= budget)


def _counter(path: str, limit: int):
    @F.pandas_udf("n_tokens long, limit_chars long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = word_counts(path)
        of = known.__getitem__
        for texts in batches:
            rows = []
            for text in texts:
                n = sum(map(of, WORDS.findall(text)))
                rows.append((n, len(text) if n <= limit else PrefixTable(text, path, known).longest(limit)))
            yield pd.DataFrame(rows, columns=["n_tokens", "limit_chars"])

    return count


def with_counts(df: DataFrame, path: str, text: Column, limit: int = 2048) -> DataFrame:
    """Add ``tokens`` = struct(n_tokens, limit_chars): the count, and the longest prefix of at most ``limit`` tokens."""
    return df.withColumn("tokens", _counter(path, limit)(text))
