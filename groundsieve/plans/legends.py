"""Queries: legend classification, code lookups and the legend cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsieve.functions import legend
from groundsieve.plans import inputs
from groundsieve.plans.inputs import check_sql
from groundsieve.plans.keys import LOC_CTE, locations
from groundsieve.plans.registry import query, rounded
from groundsieve.sources import legends as src

# Legend samples: symbol, age, group, lithology; picked by borehole key.
SAMPLES = [
    ("H", "新生代 第四紀 完新世", "堆積岩", "谷底平野・山間盆地・河川・海岸平野堆積物"),
    ("Q3", "新生代 第四紀 後期更新世", "堆積岩", "段丘堆積物"),
    ("Q2", "新生代 第四紀 中期更新世", "火成岩", "溶岩・火砕岩 デイサイト・流紋岩"),
    ("Q1", "前期更新世 ジェラシアン期", "堆積岩", "海成層 砂岩泥岩互層"),
    ("N3", "中新世〜鮮新世", "堆積岩", "汽水成層ないし海成・非海成混合層"),
    ("N2", "鮮新世", "火砕岩", "玄武岩 溶岩"),
    ("PG", "古第三紀 漸新世", "火成岩", "花崗閃緑岩・トーナル岩"),
    ("K", "白亜紀 アルビアン期〜暁新世 セランディアン期", "付加体", "付加体 砂岩泥岩"),
    ("J", "中生代 ジュラ紀", "変成岩", "片麻岩・片岩"),
    ("L", "古生代 ペルム紀", "堆積岩", "石灰岩"),
    ("V", "更新世", "堆積岩", " 火山灰・ローム "),
    ("R", "", "堆積岩", "埋立地・盛り土"),
    (None, None, None, None),
    ("", " ", "", ""),
    ("X", "時代未詳", "その他", "その他の岩石"),
    ("S", "中生代", "大陸地殻深部", "礫岩・チャート"),
    ("W", "　中生代 三畳紀　", "　変成岩　", "\u2003結晶片岩\u00a0"),
    ("U", "　", "　", "\u3000\u2009"),
]


def _q(v):
    return "null" if v is None else f"'{v}'"


SAMPLES_CTE = ("samples(i, symbol, formation_age_ja, group_ja, lithology_ja) as (values "
               + ", ".join(f"({i}, {', '.join(_q(v) for v in s)})" for i, s in enumerate(SAMPLES)) + "),\n"
               "fx_legend as (select boring_key, latitude_deg, longitude_deg, symbol, formation_age_ja, group_ja, lithology_ja "
               "from fx_loc join samples on i = boring_key % 18)")


def legend_rows(spark, sf):
    fields = [f.name for f in legend_struct()]
    pick = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(fields, s)]) for s in SAMPLES])
    return locations(spark, sf).select("boring_key", "latitude_deg", "longitude_deg", F.get(pick, (F.col("boring_key") % 18).cast("int")).alias("_s")).select(
        "boring_key", "latitude_deg", "longitude_deg", "_s.*")


def legend_struct():
    from pyspark.sql import types as T

    return T.StructType([T.StructField(n, T.StringType()) for n in src.LEGEND_FIELDS])


def _rule_sql(text: str, rules, names) -> str:
    out = []
    for name, words in rules:
        out.append("when " + " or ".join(f"contains({text}, '{w}')" for w in words) + f" then {names.index(name)}")
    return " ".join(out)


def _clean(c):
    blank = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    return f"regexp_replace(coalesce({c}, ''), '^{blank}+|{blank}+$', '', 'g')"


REGIME_SQL = ("case " + _rule_sql(_clean("lithology_ja"), legend.REGIME_LITHOLOGY, legend.REGIMES) + " "
              + _rule_sql(_clean("formation_age_ja"), legend.REGIME_AGE, legend.REGIMES) + " "
              + " ".join(f"when {_clean('group_ja')} = '{g}' then {legend.REGIMES.index(r)}" for g, r in legend.REGIME_GROUP.items())
              + " else 7 end")
ERA_SQL = f"case when {_clean('formation_age_ja')} = '' then 10 {_rule_sql(_clean('formation_age_ja'), legend.ERA_RULES, legend.ERAS)} else 9 end"
LITHO_SQL = f"case when {_clean('lithology_ja')} = '' then 14 {_rule_sql(_clean('lithology_ja'), legend.LITHO_RULES, legend.LITHO_MACROS)} else 13 end"


@query("c1_regime_from_legend", check_sql(f"select boring_key, {REGIME_SQL} as regime from fx_legend", LOC_CTE, SAMPLES_CTE))
def c1_regime_from_legend(spark, sf):
    return legend_rows(spark, sf).select("boring_key", legend.regime_code(*[F.col(c) for c in src.LEGEND_FIELDS]).alias("regime"))


@query("c2_era_from_age", check_sql(f"select boring_key, {ERA_SQL} as era from fx_legend", LOC_CTE, SAMPLES_CTE))
def c2_era_from_age(spark, sf):
    return legend_rows(spark, sf).select("boring_key", legend.era_code(F.col("formation_age_ja")).alias("era"))


@query("c3_litho_macro", check_sql(f"select boring_key, {LITHO_SQL} as litho from fx_legend", LOC_CTE, SAMPLES_CTE))
def c3_litho_macro(spark, sf):
    return legend_rows(spark, sf).select("boring_key", legend.litho_macro_code(F.col("lithology_ja")).alias("litho"))


@query("c4_batch_codes", check_sql(f"""
select era_code, litho_macro_code, count(*) as n from (
  select cast({ERA_SQL} as smallint) as era_code, cast({LITHO_SQL} as smallint) as litho_macro_code from fx_legend) group by 1, 2""", LOC_CTE, SAMPLES_CTE))
def c4_batch_codes(spark, sf):
    return legend.with_granular_codes(legend_rows(spark, sf)).groupBy("era_code", "litho_macro_code").agg(F.count(F.lit(1)).alias("n"))


def _titles(names):
    return ", ".join(f"({i}, '{n.replace('_', ' ').title()}')" for i, n in enumerate(names))


@query("c5_code_names", check_sql(f"""
select litho_macro_code, name, count(*) as n from fx_raw join (values {_titles(legend.LITHO_MACROS)}) v(code, name) on code = litho_macro_code group by 1, 2"""))
def c5_code_names(spark, sf):
    n = inputs.measurements(spark, sf).groupBy("litho_macro_code").agg(F.count(F.lit(1)).alias("n"))
    dim = legend.dimension(spark, legend.LITHO_MACROS, "litho_macro_code", "label")
    return n.join(F.broadcast(dim), "litho_macro_code").select("litho_macro_code", legend.title(F.col("label")).alias("name"), "n")


@query("s6_legend_json", check_sql("""
select boring_key, coalesce(symbol, '') as symbol, coalesce(formation_age_ja, '') as formation_age_ja,
  coalesce(group_ja, '') as group_ja, coalesce(lithology_ja, '') as lithology_ja from fx_legend""", LOC_CTE, SAMPLES_CTE))
def s6_legend_json(spark, sf):
    payload = legend_rows(spark, sf).select("boring_key", F.to_json(F.struct(*src.LEGEND_FIELDS)).alias("payload"))
    return src.parse_legend(payload, "payload")


@query("s7_code_to_regime", check_sql("""
select boring_key, coalesce(case when boring_key % 23 < 15 then cast((boring_key % 23) % 7 as int) end, 7) as regime from fx_loc""", LOC_CTE))
def s7_code_to_regime(spark, sf):
    lookup = inputs.table(spark, sf, "nation").where("n_nationkey < 15").select(
        F.col("n_nationkey").cast("long").alias("code"), (F.col("n_nationkey") % 7).cast("int").alias("regime"))
    df = locations(spark, sf).select("boring_key", (F.col("boring_key") % 23).alias("code"))
    return src.regime_of_code(df, lookup).select("boring_key", "regime")


@query("s8_age_code", check_sql("""
select boring_key, coalesce(case when boring_key % 4 = 0 then null else cast(boring_key % 9 as int) end, 4) as age_code, 4 as other_age from fx_loc""", LOC_CTE))
def s8_age_code(spark, sf):
    df = locations(spark, sf).select("boring_key", F.when(F.col("boring_key") % 4 != 0, (F.col("boring_key") % 9).cast("int")).alias("age_code"))
    return src.normalise_age(src.normalise_age(df), "other_age")


@query("s9_distinct_codes", check_sql("select distinct symbol from fx_legend", LOC_CTE, SAMPLES_CTE))
def s9_distinct_codes(spark, sf):
    return src.distinct_codes(legend_rows(spark, sf), "symbol")


CACHE_CTE = """
fx_cache as (select round_even(latitude_deg * 1e4, 0) / 1e4 as lat, round_even(longitude_deg * 1e4, 0) / 1e4 as lon, min_by(symbol, boring_key) as symbol,
  min_by(formation_age_ja, boring_key) as formation_age_ja, min_by(group_ja, boring_key) as group_ja, min_by(lithology_ja, boring_key) as lithology_ja
  from (select boring_key, latitude_deg, longitude_deg, coalesce(symbol, '') as symbol, coalesce(formation_age_ja, '') as formation_age_ja,
    coalesce(group_ja, '') as group_ja, coalesce(lithology_ja, '') as lithology_ja from fx_legend) where boring_key % 5 <> 1 group by 1, 2)"""


def legend_cache(spark, sf, where="boring_key % 5 <> 1"):
    rows = legend_rows(spark, sf).where(where)
    return rows.groupBy(src.rounded_key("latitude_deg").alias("lat"), src.rounded_key("longitude_deg").alias("lon")).agg(
        *[F.min_by(F.coalesce(f, F.lit("")), "boring_key").alias(f) for f in src.LEGEND_FIELDS])


@query("j2_rounded_lookup_join", check_sql("""
select l.boring_key, c.symbol, c.lithology_ja from fx_loc l
left join fx_cache c on c.lat = round_even(l.latitude_deg * 1e4, 0) / 1e4 and c.lon = round_even(l.longitude_deg * 1e4, 0) / 1e4""", LOC_CTE, SAMPLES_CTE, CACHE_CTE))
def j2_rounded_lookup_join(spark, sf):
    return src.with_legend(locations(spark, sf), legend_cache(spark, sf)).select("boring_key", "symbol", "lithology_ja")


@query("j11_cache_upsert", check_sql("""
select round(lat, 4) as lat, round(lon, 4) as lon, symbol from fx_cache union all
select round_even(latitude_deg * 1e4, 0) / 1e4, round_even(longitude_deg * 1e4, 0) / 1e4, min(case when boring_key % 10 = 1 then coalesce(symbol, '') else '' end) from fx_legend l
where not exists (select 1 from fx_cache c where c.lat = round_even(l.latitude_deg * 1e4, 0) / 1e4 and c.lon = round_even(l.longitude_deg * 1e4, 0) / 1e4) group by 1, 2""",
                                       LOC_CTE, SAMPLES_CTE, CACHE_CTE))
def j11_cache_upsert(spark, sf):
    known = legend_cache(spark, sf, "boring_key % 10 = 1")
    out = src.upsert_cache(legend_cache(spark, sf), locations(spark, sf), known)
    return rounded(out.select("lat", "lon", "symbol"), "lat", "lon")
