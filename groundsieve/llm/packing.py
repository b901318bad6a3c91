"""Best-fit packing of token sequences: Spark ranks and places the pieces, the driver matches length classes.

Documents become pieces of at most ``capacity`` tokens. Pieces are range-sorted once by (length, row), which gives every
piece a rank inside its length class without a window over a hot class. Best fit then runs in a sequential loop on the
driver over the class table, which has at most ``capacity`` rows whatever the number of documents: in each step the longest class left is matched to its successor,
the smallest gap that is large enough; ranks settle who gets which sequence; the gaps are updated; and so on until the
class is placed, what finds no gap opening new sequences. A step yields intervals of ranks, so placing the pieces is one
narrow look-up over the sorted table: no piece, sequence or gap is collected, and no further shuffle takes place.

Null text counts as empty. An empty document still has its closing id and so one piece. Repeated rows are packed each.
An empty table gives an empty table.
"""

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.llm.bpe import WORDS, Cache, encoder
from groundsieve.llm.common import written

_INDEX = (1 << 33) - 1  # low bits of monotonically_increasing_id: place inside a partition


def token_pieces(df: DataFrame, path: str, text: Column, keep: list[str], capacity: int = 4096, closing: int = 1,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: ``keep`` columns, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    wide = 4 * capacity
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    @F.pandas_udf(f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe, end = encoder(path), np.array([closing], "<u4").tobytes()
        of = Cache(lambda w: np.array(bpe.ids(w), "<u4").tobytes()).__getitem__
        for texts in batches:
            out = []
            for t in texts:
                data = b"".join(map(of, WORDS.findall(t))) + end
                rows = []
                for k, at in enumerate(range(0, len(data), wide)):
                    part = data[at : at + wide]
                    row = {"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                    rows.append(row | ({"ids": np.frombuffer(part, "<u4").astype(np.int32)} if with_ids else {}))
                out.append(rows)
            yield pd.Series(out)

    return df.select(*keep, F.explode(cut(text)).alias("p")).select(*keep, "p.*")


def best_fit(classes: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Match length classes (length -> count) to gaps, longest first, each to the smallest gap that holds it.

    Returns segments and the number of sequences. A segment is (length, first rank, first sequence, pieces per sequence,
    offset of the first of them, count): rank r of the class goes to sequence first + (r - rank) // per.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> intervals [low, high) of sequences that have it
    order: list[int] = []  # gaps that have a sequence, ascending
    segments, opened = [], 0

    def add(gap: int, low: int, high: int) -> None:
        if gap and low < high:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((low, high))

    for length in sorted(classes, reverse=True):
        left, rank = classes[length], 0
        while left:
            at = bisect_left(order, length)  # the successor
            if at == len(order):
                break
            gap = order[at]
            low, high = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            n = min(left, high - low)
            segments.append((length, rank, low, 1, capacity - gap, n))
            add(gap, low + n, high)
            add(gap - length, low, low + n)
            left, rank = left - n, rank + n
        if left:
            per = capacity // length
            full, rest = divmod(left, per)
            for sequences, pieces in ((full, per), (1, rest)):
                if sequences and pieces:
                    segments.append((length, rank, opened, pieces, 0, sequences * pieces))
                    add(capacity - pieces * length, opened, opened + sequences)
                    rank, opened = rank + sequences * pieces, opened + sequences
    return np.array(segments, np.int64).reshape(-1, 6), opened


def pack(pieces: DataFrame, capacity: int = 4096, length: str = "length") -> DataFrame:
    """Add sequence_id and offset to every row; rows of a sequence fill it gaplessly from 0."""
    spark = pieces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = written(pieces.withColumn("row", F.monotonically_increasing_id()))  # the ids are stored, so they hold on re-reading
    order = [F.col(length).desc(), F.col("row")]
    ranged = written(table.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    sizes = {r.p: r.n for r in ranged.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}  # one row per partition
    classes = {r.k: r.n for r in ranged.groupBy(F.col(length).alias("k")).agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    if any(k > capacity or k < 1 for k in classes):
        raise ValueError(f"a piece is longer than {capacity} or empty")
    segments, _ = best_fit(classes, capacity)
    firsts = np.zeros(max(sizes, default=0) + 2, np.int64)
    for p in range(len(firsts) - 1):
        firsts[p + 1] = firsts[p] + sizes.get(p, 0)
    begins, before = np.zeros(capacity + 1, np.int64), 0
    for k in sorted(classes, reverse=True):
        begins[k], before = before, before + classes[k]
    # segments come in order of (length descending, rank): their global first position ascends
    starts = begins[segments[:, 0]] + segments[:, 1] if len(segments) else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((firsts, starts, segments))
    columns = [c for c in ranged.columns if c not in ("row", "at")]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, starts, segments = shared.value
        for b in batches:
            at = b["at"].to_numpy()
            position = firsts[at >> 33] + (at & _INDEX)
            s = np.searchsorted(starts, position, "right") - 1
            k = position - starts[s]
            size, _, first, per, offset, _ = segments[s].T if len(s) else np.zeros((6, 0), np.int64)
            yield b[columns].assign(sequence_id=first + k // per, offset=offset + k % per * size)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema if f.name in columns)
    return ranged.mapInPandas(place, f"{schema}, sequence_id long, offset long")
