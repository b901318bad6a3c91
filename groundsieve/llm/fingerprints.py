"""SimHash document fingerprints in SQL functions only.

Terms are word shingles (five words, lower-cased; fewer words make one term). Every occurrence of a term votes with its
64-bit hash, so a term weighs as often as it occurs. Votes are added two bit positions to a long, in lanes of 32 bits: no
text has 2^31 terms, so lanes never run over. ``within`` finds all fingerprints inside a Hamming radius through permuted
block tables. Null and empty texts have the fingerprint 0. Equal texts have equal fingerprints; repeated rows are kept.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.llm.common import SPACE, written

BITS, WORDS = 64, 5
_PAIR = (1 << 32) + 1
_INDEX = (1 << 33) - 1


def terms(text: Column, width: int = WORDS) -> Column:
    """Hashes of the word shingles, in order, repeats included."""
    words = F.filter(F.split(F.lower(text), f"[{SPACE}]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    shingles = F.transform(F.array(hashes), lambda h: F.transform(  # the outer array binds ``hashes`` once
        F.sequence(F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, width))))
    shingles = F.element_at(shingles, 1)
    return F.when(text.rlike(f"[^{SPACE}]"), shingles).otherwise(F.array().cast("array<bigint>"))


def voted(df: DataFrame, keys: list[str], term: str) -> DataFrame:
    """``keys`` and ``bits``, the fingerprint as a long: one row per key from rows of term hashes.

    All sums are longs, so this stays a hash aggregate; what depends on a key may be listed as another key.
    """
    t = F.col(term)
    sums = [F.sum(F.shiftrightunsigned(t, b).bitwiseAND(F.lit(_PAIR))).alias(f"v{b}") for b in range(BITS // 2)]
    counted = df.groupBy(*keys).agg(F.count(t).alias("votes"), *sums)
    out = F.lit(0).cast("long")
    for b in range(BITS // 2):
        v = F.coalesce(F.col(f"v{b}"), F.lit(0).cast("long"))
        for lane, shift in ((v.bitwiseAND(F.lit((1 << 32) - 1)), b), (F.shiftrightunsigned(v, 32), b + 32)):
            bit = (1 << shift) - (1 << 64) * (shift == 63)
            out = out.bitwiseOR(F.when(lane * 2 > F.col("votes"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, out.alias("bits"))


def fingerprints(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key`` and ``bits`` of every row; ``key`` must be unique."""
    return voted(df.select(key, F.explode_outer(terms(text)).alias("term")), [key], "term")


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), BITS // 4, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of the term vectors: the angle is the share of differing bits; 1 for equal, 0 for unrelated."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * (3.141592653589793 / BITS)))


def within(prints: DataFrame, radius: int = 3, extra: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints ``bits`` that differ in at most ``radius`` bits: none is missed.

    The bits are cut into ``radius + extra`` blocks; whatever ``radius`` flipped bits touch, ``extra`` blocks stay equal. So
    there is one table per choice of ``extra`` blocks, keyed by those blocks' bits, and near fingerprints meet in one.
    """
    blocks = radius + extra
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    mask_of = [sum(1 << i for i in range(edges[k], edges[k + 1])) for k in range(blocks)]
    masks = [sum(mask_of[k] for k in chosen) for chosen in combinations(range(blocks), extra)]
    signed = [m - (1 << 64) * (m >= 1 << 63) for m in masks]
    table = prints.select("bits").distinct().select("bits", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("table", "mask"))
    keyed = table.select("bits", "table", F.col("bits").bitwiseAND(F.col("mask")).alias("block"))
    a, b = keyed.withColumnRenamed("bits", "a"), keyed.withColumnRenamed("bits", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return a.join(b, ["table", "block"]).where(near).select("a", "b").distinct()


def successors(ids: DataFrame, row: str, key: str) -> DataFrame:
    """``ids`` with ``next_row``: the next row in descending ``key`` order (nulls last, ties by row), the first after the last.

    Ids only: a range sort numbers the rows, then places meet place + 1. No window over the whole table.
    """
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).desc_nulls_last(), F.col(row)]
    ranged = written(ids.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    sizes = {r.p: r.n for r in ranged.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}  # one row per partition
    firsts, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        firsts.append(total)
        total += sizes.get(p, 0)
    place = F.element_at(F.lit(firsts).cast("array<bigint>"), (F.shiftright("at", 33) + 1).cast("int")) + F.col("at").bitwiseAND(F.lit(_INDEX))
    numbered = ranged.withColumn("place", place)
    follows = numbered.select(F.pmod(F.col("place") - 1, F.lit(max(total, 1))).alias("place"), F.col(row).alias("next_row"))
    return numbered.select("place", *ids.columns).join(follows, "place").select(*ids.columns, "next_row")
