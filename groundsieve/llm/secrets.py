"""Secret scan in SQL functions only: named patterns, then a randomness test battery over the remaining key-like runs.

Named patterns (``assign``, ``access``, ``hex``) always count. Every other run of at least ``SHORTEST`` key characters with
letters and digits is a candidate. Its encoding is the smallest alphabet that holds it; against a uniform source over that
alphabet it takes a chi-squared test of symbol counts, a runs test about the middle symbol and a lag-one serial
correlation test, joined by Bonferroni. Ordinary text fails them. Rejections are controlled for false discovery (Benjamini
and Hochberg at ``RATE``) within strata of encoding and length, so that long and short runs do not share a threshold; what
is not rejected is reported as ``random``.

The false-discovery table has one row per stratum and probability step: at most 6 x 31 x ``STEPS`` rows, so thresholds are
collected; runs are not, and nothing but this table is shuffled. Null text counts as empty; a text may hold any number of
spans; repeated rows give repeated results; an empty table gives an empty table.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundsieve.llm.common import written

KINDS = ["assign", "access", "hex", "random"]
#: The named patterns. A run of the last two is matched greedily, so its least length can stand in the pattern.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{18,}"
SHORTEST, RATE, STEPS = 18, 0.05, 400
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [("hex_lower", "0-9a-f", _DIGITS + "abcdef"), ("hex_upper", "0-9A-F", _DIGITS + "ABCDEF"), ("base36_lower", "0-9a-z", _DIGITS + _LOWER),
             ("base36_upper", "0-9A-Z", _DIGITS + _UPPER), ("base62", "0-9A-Za-z", _DIGITS + _LOWER + _UPPER),
             ("base64", "0-9A-Za-z+/_-", _DIGITS + _LOWER + _UPPER + "+/_-")]
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,found:string>>"


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """All matches as structs (start, kind, end, found) in code points; texts without a match skip the splitting."""
    p = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, p, F.lit(group)).alias("part"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["part"].alias("found"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))
    found = F.aggregate(parts, zero, lambda a, x: step(a, x).cast(f"struct<at:bigint,out:{_SPAN}>"))["out"]
    if keep is not None:
        found = F.filter(found, keep)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0, by a public rational approximation of erfc (error below 1.5e-7)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * poly * F.exp(-x * x)


def encoding(run: Column) -> Column:
    """Index of the smallest alphabet that holds the run."""
    out = F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(run.rlike(f"^[{ENCODINGS[k][1]}]+$"), F.lit(k)).otherwise(out)
    return out


def battery(run: Column, kind: Column) -> Column:
    """p-value of 'uniform over its alphabet': Bonferroni over the chi-squared, runs and serial-correlation tests."""
    alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), kind + 1)
    size = F.length(alphabet).cast("double")
    chars = F.filter(F.split(run, ""), lambda c: c != "")

    def tests(c: Column, size: Column, alphabet: Column) -> Column:
        n = F.size(c).cast("double")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        squares = total(F.transform(F.array_distinct(c), lambda u: F.pow(F.size(F.filter(c, lambda x: x == u)).cast("double"), 2.0)))
        z1 = (size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        values = F.transform(c, lambda x: F.instr(alphabet, x).cast("double"))
        mid = size / 2 + 0.5
        high = total(F.transform(values, lambda v: (v > mid).cast("double")))
        pair = lambda f: F.zip_with(F.slice(values, 1, F.size(c) - 1), F.slice(values, 2, F.size(c) - 1), f)
        turns = total(pair(lambda a, b: ((a > mid) != (b > mid)).cast("double"))) + 1
        mean = 2 * high * (n - high) / n + 1
        z2 = (turns - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        centre = total(values) / n
        spread = total(F.transform(values, lambda v: (v - centre) * (v - centre)))
        z3 = total(pair(lambda a, b: (a - centre) * (b - centre))) / F.greatest(spread, F.lit(1e-9)) * F.sqrt(n)
        ps = [F.when(z1 > 0, _normal_tail(z1)).otherwise(F.lit(0.5)), 2 * _normal_tail(F.abs(z2)), 2 * _normal_tail(F.abs(z3))]
        return F.least(F.lit(1.0), 3 * F.least(*ps))

    return F.element_at(F.transform(F.array(chars), lambda c: tests(c, size, alphabet)), 1)


def tested(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``base`` spans and ``runs``, the candidates with stratum and p-value, of every text."""
    base = F.concat(_spans(text, ASSIGN, 0, lambda s: F.length(s["found"]) >= 6, group=2), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    runs = _spans(text, RUN, 3, lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]"))
    found = df.select(*keep, base.alias("base"), runs.alias("runs"))
    apart = lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    found = found.withColumn("runs", F.filter("runs", apart))
    coded = F.transform("runs", lambda r: F.struct(r["start"], r["end"], r["found"], encoding(r["found"]).alias("encoding"),
                                                    F.floor(F.log2(r["end"] - r["start"])).cast("int").alias("octave")))
    scored = F.transform(coded, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), (r["encoding"] * 100 + r["octave"]).alias("stratum"),
                                                    battery(r["found"], r["encoding"]).alias("p")))
    return found.select(*keep, "base", scored.alias("runs"))


def thresholds(found: DataFrame) -> dict[int, float]:
    """Per stratum, the largest p-value that Benjamini and Hochberg's rule rejects; p-values are rounded up to steps of 1/20 decade."""
    step = F.least(F.floor(-F.log10(F.greatest(F.col("r.p"), F.lit(1e-300))) * 20), F.lit(STEPS - 1)).cast("int")
    counts = found.select(F.explode("runs").alias("r")).groupBy(F.col("r.stratum").alias("stratum"), step.alias("step")).agg(F.count("*").alias("n"))
    every = Window.partitionBy("stratum")
    small_first = every.orderBy(F.desc("step"))
    edge = F.pow(F.lit(10.0), -F.col("step") / 20.0)
    ranked = counts.withColumns({"edge": edge, "upto": F.sum("n").over(small_first), "all": F.sum("n").over(every)})
    passed = ranked.where(F.col("edge") <= F.col("upto") * RATE / F.col("all")).groupBy("stratum").agg(F.max("edge").alias("p"))
    return {r.stratum: r.p for r in passed.collect()}


def decided(found: DataFrame, keep: list[str], cut: dict[int, float]) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans``: arrays of (start, kind, end) in order of start, then kind."""
    table = F.create_map(*[F.lit(x) for k, p in sorted(cut.items()) for x in (k, p)]) if cut else F.create_map().cast("map<int,double>")
    random = F.transform(F.filter("runs", lambda r: r["p"] > F.coalesce(table[r["stratum"]], F.lit(0.0))),
                         lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(*keep, F.array_sort(plain).alias("base"), F.array_sort(F.concat(plain, random)).alias("spans"))


def find(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``decided`` over one pass of the texts; ``keep`` should be narrow, since it is written with the candidates."""
    found = written(tested(df, text, keep))
    return decided(found, keep, thresholds(found))


def find_wide(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``decided`` over two passes, for wide ``keep``: only the candidates of the first are written."""
    cut = thresholds(written(tested(df, text, []).select("runs").where(F.size("runs") > 0)))
    return decided(tested(df, text, keep), keep, cut)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans share one."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, zero, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))
