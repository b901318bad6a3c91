"""Geology legend text to codes: first matching keyword rule wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Code names.
REGIMES = ("ALLUVIAL", "DILUVIAL", "VOLCANIC_ASH", "SEDIMENTARY", "IGNEOUS", "METAMORPHIC",
           "LIMESTONE", "UNKNOWN")
ERAS = ("HOLOCENE", "LATE_PLEISTOCENE", "MIDDLE_PLEISTOCENE", "EARLY_PLEISTOCENE", "PLIOCENE",
        "MIOCENE", "PALEOGENE", "CRETACEOUS", "PRE_CRETACEOUS", "OTHER", "UNKNOWN")
LITHO_MACROS = ("ALLUVIAL_FAN_FLUVIAL", "TERRACE", "MARINE_SEDIMENT", "VOLCANIC_PYROCLASTIC",
                "VOLCANIC_LAVA", "GRANITIC", "SEDIMENTARY_ROCK", "METAMORPHIC", "LIMESTONE",
                "RECLAIMED", "LOESS", "ACCRETIONARY", "BRACKISH_MIXED", "OTHER", "UNKNOWN")

# Regime keywords, in rule order: lithology, then age, then whole group names.
REGIME_LITHOLOGY = (("LIMESTONE", ("石灰岩",)), ("VOLCANIC_ASH", ("火山灰", "テフラ", "ローム")))
REGIME_AGE = (("ALLUVIAL", ("完新世",)), ("DILUVIAL", ("更新世",)))
REGIME_GROUP = {"堆積岩": "SEDIMENTARY", "火成岩": "IGNEOUS", "変成岩": "METAMORPHIC",
                "付加体": "SEDIMENTARY", "火砕岩": "VOLCANIC_ASH", "大陸地殻深部": "METAMORPHIC"}

# Era keywords in rule order; spans resolve to the older end.
ERA_RULES = (
    ("HOLOCENE", ("完新世",)),
    ("LATE_PLEISTOCENE", ("後期更新世",)),
    ("PRE_CRETACEOUS", ("ジュラ紀", "三畳紀", "古生代", "先カンブリア時代", "ペルム紀", "石炭紀", "デボン紀",
                        "シルル紀", "オルドビス紀", "カンブリア紀", "古第二紀")),
    ("CRETACEOUS", ("白亜紀", "セノマニアン期", "チューロニアン期", "コニアシアン期", "サントニアン期",
                    "カンパニアン期", "マーストリヒチアン期", "アプチアン期", "アルビアン期", "バレミアン期",
                    "オーテリビアン期", "バランギニアン期", "ベリアシアン期", "ハウテリビアン期")),
    ("PRE_CRETACEOUS", ("中生代",)),
    ("PALEOGENE", ("古第三紀", "暁新世", "始新世", "漸新世", "セランディアン期", "ダニアン期", "サネチアン期",
                   "イーペル期", "ルテシアン期", "バートン期", "プリアボン期", "ルペル期", "シャッティアン期")),
    ("MIOCENE", ("中新世", "アキタニアン期", "バーディガリアン期", "ランギアン期", "セラバリアン期",
                 "トートニアン期", "メッシニアン期")),
    ("PLIOCENE", ("鮮新世", "ピアセンジアン期", "ザンクリアン期")),
    ("EARLY_PLEISTOCENE", ("前期更新世", "ジェラシアン期")),
    ("MIDDLE_PLEISTOCENE", ("中期更新世", "チバニアン期")),
    ("MIDDLE_PLEISTOCENE", ("更新世",)),
)

# Lithology keywords in rule order.
LITHO_RULES = (
    ("LIMESTONE", ("石灰岩",)),
    ("RECLAIMED", ("盛り土", "埋立地", "干拓地", "人工")),
    ("LOESS", ("火山灰", "テフラ", "ローム")),
    ("VOLCANIC_PYROCLASTIC", ("火砕", "デイサイト", "流紋岩", "凝灰岩", "凝灰", "安山岩")),
    ("VOLCANIC_LAVA", ("溶岩", "玄武岩")),
    ("GRANITIC", ("花崗", "閃緑", "トーナル", "斑れい", "はんれい")),
    ("TERRACE", ("段丘",)),
    ("ALLUVIAL_FAN_FLUVIAL", ("谷底平野", "扇状地", "崖錐", "河川", "自然堤防", "海岸平野", "三角州",
                              "後背湿地", "氾濫原")),
    ("BRACKISH_MIXED", ("汽水", "海成・非海成混合", "非海成・海成混合")),
    ("MARINE_SEDIMENT", ("海成層", "海成", "海底堆積")),
    ("ACCRETIONARY", ("付加体",)),
    ("METAMORPHIC", ("片麻", "片岩", "ホルンフェルス", "結晶質", "変成", "ミグマタイト", "蛇紋岩", "角閃岩",
                     "エクロジャイト")),
    ("SEDIMENTARY_ROCK", ("砂岩", "泥岩", "礫岩", "頁岩", "シルト岩", "チャート", "石炭")),
)


#: White space that is stripped from legend text: the ASCII kinds and the Unicode blanks.
BLANK = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{BLANK}+|{BLANK}+$", "")


def _first_match(text: Column, rules: Sequence[tuple[str, Sequence[str]]], names: Sequence[str], start=None):
    out = start
    for name, words in rules:
        hit = text.rlike("|".join(words))
        code = F.lit(names.index(name))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def regime_code(symbol: Column, age: Column, group: Column, lithology: Column) -> Column:
    """Regime from lithology keywords, then age, then group; nothing known is UNKNOWN."""
    unknown = F.lit(REGIMES.index("UNKNOWN"))
    out = _first_match(_clean(lithology), REGIME_LITHOLOGY, REGIMES)
    out = _first_match(_clean(age), REGIME_AGE, REGIMES, out)
    for name, regime in REGIME_GROUP.items():
        out = out.when(_clean(group) == name, F.lit(REGIMES.index(regime)))
    return out.otherwise(unknown)


def era_code(age: Column) -> Column:
    text = _clean(age)
    empty = F.when(text == "", F.lit(ERAS.index("UNKNOWN")))
    return _first_match(text, ERA_RULES, ERAS, empty).otherwise(F.lit(ERAS.index("OTHER")))


def litho_macro_code(lithology: Column) -> Column:
    text = _clean(lithology)
    empty = F.when(text == "", F.lit(LITHO_MACROS.index("UNKNOWN")))
    return _first_match(text, LITHO_RULES, LITHO_MACROS, empty).otherwise(F.lit(LITHO_MACROS.index("OTHER")))


def with_granular_codes(df: DataFrame) -> DataFrame:
    missing = {"formation_age_ja", "lithology_ja"} - set(df.columns)
    if missing:
        raise KeyError(f"legend table is missing columns: {sorted(missing)}")
    return df.withColumns({
        "era_code": era_code(F.col("formation_age_ja")).cast("short"),
        "litho_macro_code": litho_macro_code(F.col("lithology_ja")).cast("short")})


def title(name: Column) -> Column:
    """ALLUVIAL_FAN_FLUVIAL -> Alluvial Fan Fluvial."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def dimension(spark: SparkSession, names: Sequence[str], code: str, label: str) -> DataFrame:
    """Code table of an enumeration (at most 15 rows)."""
    return spark.createDataFrame(list(enumerate(names)), f"{code} int, {label} string")
