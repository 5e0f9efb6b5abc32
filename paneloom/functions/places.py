"""Place names: the gazetteer, longest-prefix resolution and origin, as joins and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.numerals import COURT_CITY, PROVINCES
from paneloom.functions.text import settled
from paneloom.sources.scratch import staged

# fixed values: municipalities by code prefix
MUNICIPALITIES = {"11": "北京市", "12": "天津市", "31": "上海市", "50": "重庆市"}
# fixed values: words for the court's own area
LOCAL = ("本市", "本区", "本县", "本省", "本镇", "本乡", "本地", "本辖区")
# fixed values: endings that a short name drops, longest first
ENDINGS = "(地区|林区|特区|市|县|区|旗|盟)$"
# fixed values: the provinces whose short names are those of other places too, and so don't count
ONLY_FULL = ("吉林省", "海南省")
TOKENS, CHAIN = 3, 10
#: What a raw place is read from, in this order; the last one isn't an origin in the strict sense.
ORIGINS = ("hukou", "birthplace", "native", "residence")

CANDIDATE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("level", "full_name", "province", "prefecture", "prefecture_code")] + [T.StructField("in_window", T.BooleanType())]))


def valid_in(year: int) -> Column:
    return (F.col("valid_from") <= year) & (F.col("valid_to").isNull() | (F.col("valid_to") > year))


def successors(records: DataFrame, year: int, depth: int = CHAIN) -> DataFrame:
    """code, code_now: the code valid in `year` that a chain of new codes leads to; null if none within `depth` steps.

    records: code, valid_from, valid_to, new_codes (separated by ;, the first counts, marks of a year in
    brackets are dropped). One join a step; codes that have arrived leave the loop's work to nobody else.
    """
    now = records.where(valid_in(year)).select(F.col("code").alias("_ok")).distinct()
    step = records.where(F.coalesce(F.col("new_codes"), F.lit("")) != "").groupBy("code").agg(F.max_by("new_codes", "valid_from").alias("new_codes"))
    step = step.select(F.col("code").alias("_from"), F.regexp_replace(F.split("new_codes", ";")[0], "\\[[0-9]{4}\\]", "").alias("_to"))
    out = records.select("code").distinct().withColumn("at", F.col("code"))
    for _ in range(depth):
        out = out.join(now, F.col("at") == F.col("_ok"), "left").join(step, F.col("at") == F.col("_from"), "left")
        out = out.select("code", F.when(F.col("_ok").isNotNull(), F.col("at")).otherwise(F.col("_to")).alias("at"))
    return out.join(now, F.col("at") == F.col("_ok"), "left").select("code", F.col("_ok").alias("code_now"))


def build(records: DataFrame, year: int, window: tuple[int, int]) -> DataFrame:
    """name, is_short and the record's place in `year`, as a written table: a row for each full and each short name.

    records: code (6 digits), full_name, level (province, prefecture, county), valid_from, valid_to, new_codes.
    A municipality is its own prefecture; a county without a prefecture above it stands for one.
    """
    current = records.where(valid_in(year)).select(F.col("code").alias("c"), F.col("full_name").alias("n"), F.col("level").alias("l"))
    of = lambda name: current.select(*[F.col(x).alias(f"{name}_{x}") for x in ("c", "n", "l")])
    rows = records.join(successors(records, year), "code", "left").withColumn("code_now", F.when(F.col("level") == "province", F.col("code")).otherwise(F.col("code_now")))
    base = F.coalesce("code_now", "code")
    rows = rows.join(of("own"), F.col("own_c") == F.col("code_now"), "left").join(of("up"), F.col("up_c") == F.concat(F.substring(F.col("code_now"), 1, 4), F.lit("00")), "left").join(of("prov"), F.col("prov_c") == F.concat(F.substring(base, 1, 2), F.lit("0000")), "left")
    city = F.substring("code_now", 1, 2).isin(*MUNICIPALITIES)
    named = lambda name: F.struct(F.col(f"{name}_n").alias("n"), F.col(f"{name}_c").alias("c"))
    pref = F.when(F.col("own_l") != "province", F.when(city, named("prov")).when(F.col("own_l") == "prefecture", named("own")).when(F.col("up_l") == "prefecture", named("up")).otherwise(named("own")))
    inside = (F.col("valid_from") <= window[1]) & (F.col("valid_to").isNull() | (F.col("valid_to") > window[0]))
    rows = rows.select("full_name", "level", "code", "code_now", F.col("prov_n").alias("province"), pref["n"].alias("prefecture"), pref["c"].alias("prefecture_code"), inside.alias("in_window"))
    short = F.when(F.col("level") == "province", F.regexp_replace("full_name", "(壮族|回族|维吾尔)?自治区$|省$|市$", "")).otherwise(F.regexp_replace("full_name", ENDINGS, ""))
    both = rows.withColumn("name", F.explode(F.array_distinct(F.array(F.col("full_name"), F.when(F.length(short) >= 2, short).otherwise(F.col("full_name"))))))
    # a chain of joins that every lookup would run again
    return staged(both.withColumn("is_short", F.col("name") != F.col("full_name")), "gazetteer")


def resolve(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """places (raw, court_province, court_prefecture) with province, prefecture, county and status added.

    Up to three names are read from the left, each the longest in the gazetteer; reading stops after a
    county. Provinces constrain what follows, prefectures the next name, names of the window come first;
    what stays ambiguous is settled by the court's province. Each distinct triple is resolved once.
    Statuses: resolved, province_only, ambiguous_resolved_by_court_prov, ambiguous, unresolved, local_word.
    """
    keys = ["raw", "court_province", "court_prefecture"]
    names = gazetteer.groupBy("name").agg(F.collect_set(F.struct("level", "full_name", "province", "prefecture", "prefecture_code", "in_window")).alias("found"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", "^[：: ，,。]+|[：: ，,。]+$", ""), "^(中国|中华人民共和国)", ""), "人$", "")
    rows = places.select(*keys).distinct().withColumn("_id", F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))).withColumn("_s", bare).withColumn("_at", F.lit(1)).withColumn("_done", F.lit(False))
    longest = gazetteer.agg(F.coalesce(F.max(F.length("name")), F.lit(2)).alias("_longest"))  # one row
    rows = rows.crossJoin(F.broadcast(longest))
    for k in range(TOKENS):
        open_ = rows.where(~F.col("_done") & (F.length("_s") > F.col("_at")))
        left = open_.select("_id", F.explode(F.transform(F.sequence(F.lit(2), F.least("_longest", F.length("_s") - F.col("_at") + 1)), lambda n: F.substring(F.col("_s"), F.col("_at"), n))).alias("name"))
        hit = left.join(names, "name").groupBy("_id").agg(F.max_by(F.struct("name", "found"), F.length("name")).alias("_hit"))
        rows = rows.join(hit, "_id", "left").withColumn(f"_t{k}", F.col("_hit.found")).withColumn("_at", F.col("_at") + F.coalesce(F.length("_hit.name"), F.lit(0)))
        rows = rows.withColumn("_done", F.col("_done") | F.col("_hit").isNull() | F.coalesce(F.forall("_hit.found", lambda c: c["level"] == "county"), F.lit(False))).drop("_hit")
    rows = settled(rows)
    nothing = F.array().cast(CANDIDATE)
    tokens = [F.coalesce(F.col(f"_t{k}").cast(CANDIDATE), nothing) for k in range(TOKENS)]
    rows = rows.withColumn("_provs", F.array_distinct(F.transform(F.filter(F.concat(*tokens), lambda c: c["level"] == "province"), lambda c: c["province"]))).withColumn("_cands", nothing)
    some = lambda wanted, otherwise: F.when(F.size(wanted) > 0, wanted).otherwise(otherwise)
    for k in range(TOKENS):
        rows = rows.withColumn("_sub", F.filter(tokens[k], lambda c: c["level"] != "province"))
        rows = rows.withColumn("_sub", F.when(F.size("_provs") > 0, some(F.filter("_sub", lambda c: F.array_contains("_provs", c["province"])), F.col("_sub"))).otherwise(F.col("_sub")))
        rows = rows.withColumn("_prefs", F.transform("_cands", lambda c: c["prefecture_code"]))
        rows = rows.withColumn("_sub", F.when(F.size("_cands") > 0, some(F.filter("_sub", lambda c: F.coalesce(F.array_contains("_prefs", c["prefecture_code"]), F.lit(False))), F.col("_sub"))).otherwise(F.col("_sub")))
        rows = settled(rows.withColumn("_cands", some(some(F.filter("_sub", lambda c: c["in_window"]), F.col("_sub")), F.col("_cands"))))
    pair = lambda c: F.struct(c["province"].alias("p"), c["prefecture"].alias("f"))
    rows = rows.withColumn("_keys", F.array_distinct(F.transform(F.filter("_cands", lambda c: c["prefecture"].isNotNull()), pair)))
    rows = rows.withColumn("_own", F.filter("_keys", lambda k: k["p"] == F.col("court_province"))).withColumn("_counties", F.array_distinct(F.transform(F.filter("_cands", lambda c: c["level"] == "county"), lambda c: c["full_name"])))
    rows = rows.withColumn("_ps", F.array_distinct(F.transform("_keys", lambda k: k["p"])))
    local = F.coalesce(F.substring("_s", 1, 2).isin(*LOCAL) | F.col("_s").startswith("本辖区"), F.lit(False))
    empty, only = F.size("_cands") == 0, (F.size("_cands") == 0) & (F.size("_provs") == 1)
    one, by_court = F.size("_keys") == 1, F.size("_own") == 1
    status = F.when(local, "local_word").when(only, "province_only").when(empty, "unresolved").when(one, "resolved").when(by_court, "ambiguous_resolved_by_court_prov").otherwise("ambiguous")
    first = lambda a: F.get(F.col(a), 0)
    province = F.when(local, F.col("court_province")).when(only, first("_provs")).when(empty, F.lit(None)).when(one, first("_keys")["p"]).when(by_court, first("_own")["p"]).when(F.size("_ps") == 1, first("_ps"))
    prefecture = F.when(local, F.when(~F.col("_s").startswith("本省"), F.col("court_prefecture"))).when(empty, F.lit(None)).when(one, first("_keys")["f"]).when(by_court, first("_own")["f"])
    county = F.when(~local & ~empty & (one | by_court) & (F.size("_counties") == 1), first("_counties"))
    solved = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], province.alias("province"), prefecture.alias("prefecture"), county.alias("county"), status.alias("status"))
    return places.join(solved, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def migrant(province: Column, prefecture: Column, court_province: Column, court_prefecture: Column, by_city: bool = True) -> Column:
    """True, False or null; another province is another city, and an unknown city in the same province is null."""
    same = F.when(prefecture.isNull() | court_prefecture.isNull(), F.lit(None)).otherwise(prefecture != court_prefecture) if by_city else F.lit(False)
    return F.when(province.isNull() | court_province.isNull(), F.lit(None).cast("boolean")).when(province != court_province, True).otherwise(same)


def origin_label(text: Column, moved: Column, home: bool = False) -> Column:
    """1, 0 or NA of a resolved text: whether an origin lies elsewhere, or with home whether a residence lies here."""
    yes, no = ("0", "1") if home else ("1", "0")
    return F.when(text.isNull() | (text == "NA") | moved.isNull(), "NA").when(moved, yes).otherwise(no)


def first_source(columns: list[str]) -> tuple[Column, Column]:
    """(name, value) of the first column that isn't null or empty."""
    value = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])
    name = F.coalesce(*[F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.lit(c.removesuffix("_raw"))) for c in columns])
    return name, value


def prefecture_provinces(cases: DataFrame, prefecture: str = "prefecture", province: str = "province") -> DataFrame:
    """prefecture, province: the province that most rows of a prefecture name, the least of equals."""
    return cases.where(F.col(prefecture).isNotNull() & F.col(province).isNotNull()).groupBy(F.col(prefecture).alias("prefecture")).agg(F.mode(province, True).alias("province"))


def provinces_of(places: DataFrame, prefectures: DataFrame, raw: str = "raw") -> DataFrame:
    """places with `province_named` added: the province that a raw place begins with, LOCAL for words for the court's own area, or null.

    The longest prefecture that is a prefix counts before the longest province. A prefecture's name
    without 市 counts too, unless a district's or town's ending follows it. Each distinct place is looked up once.
    """
    full = prefectures.where("prefecture <> '' and province <> ''").select(F.col("prefecture").alias("key"), "province")
    stems = full.where(F.col("key").endswith("市") & (F.length("key") >= 3)).select(F.regexp_replace("key", "市$", "").alias("key"), "province").join(full.select("key"), "key", "left_anti")
    named = places.sparkSession.createDataFrame([(p,) for p in PROVINCES.values()], "province string")
    short = F.when(~F.col("province").isin(*ONLY_FULL), F.regexp_replace("province", "省$|市$|(壮族|回族|维吾尔)?自治区$|特别行政区$", ""))
    provinces = named.select(F.explode(F.array_compact(F.array_distinct(F.array("province", short)))).alias("key"), "province")
    keys = full.unionByName(stems).groupBy("key").agg(F.min("province").alias("province")).withColumn("kind", F.lit(0)).unionByName(provinces.withColumn("kind", F.lit(1)))
    rows = places.select(F.col(raw).alias("_raw")).where("_raw is not null").distinct().withColumn("_s", F.regexp_replace("_raw", "^[： :]+|[： :]+$", ""))
    heads = rows.where("_s <> ''").select("_raw", "_s", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("_s"))), lambda n: F.substring(F.col("_s"), F.lit(1), n))).alias("key")).distinct()
    hits = heads.join(keys, "key").withColumn("after", F.substring(F.col("_s"), F.length("key") + 1, F.lit(1)))
    hits = hits.where((F.col("kind") == 1) | F.col("key").rlike("(市|州|盟|地区)$") | ~F.col("after").isin("区", "县", "镇", "乡"))
    best = hits.groupBy("_raw").agg(F.min_by("province", F.struct("kind", -F.length("key"))).alias("_province"))
    found = rows.join(best, "_raw", "left").select("_raw", F.when(F.col("_s").rlike(f"^({'|'.join(LOCAL)})"), "LOCAL").otherwise(F.col("_province")).alias("province_named"))
    return places.join(found, F.col(raw) == F.col("_raw"), "left").drop("_raw")


def court_cities(cases: DataFrame, prefecture: str = "prefecture", province: str = "province", court: str = "court_name") -> DataFrame:
    """cases with court_city and court_city_source added.

    The stated prefecture counts first, then a municipality as province, then the prefecture that the
    court's name begins with if any row states it, then a municipality's name there; else unresolved.
    """
    known = cases.where(F.col(prefecture).isNotNull()).select(F.col(prefecture).alias("_known")).distinct()
    rows = cases.withColumn("_parsed", F.nullif(F.regexp_extract(F.trim(court), COURT_CITY, 1), F.lit(""))).join(known, F.col("_parsed") == F.col("_known"), "left")
    cities = list(MUNICIPALITIES.values())
    city = F.when(F.col(province).isin(*cities), F.col(province))
    begins = F.coalesce(*[F.when(F.col(court).startswith(m[:2]), m) for m in cities])
    source = F.when(F.col(prefecture).isNotNull(), "prefecture").when(city.isNotNull(), "municipality").when(F.coalesce("_known", begins).isNotNull(), "court_name").otherwise("unresolved")
    return rows.withColumn("court_city", F.coalesce(F.col(prefecture), city, "_known", begins, F.lit("unresolved"))).withColumn("court_city_source", source).drop("_parsed", "_known")


def court_prefectures(courts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """courts (court_city, prefecture_code, province, court_name) with court_prefecture added: its name in the gazetteer's year.

    A municipality is its own; then the city's name with its code, the name alone (names of the window
    first), the code alone, and last what the court's name resolves to. Distinct courts are looked up once.
    """
    keys = ["court_city", "prefecture_code", "province", "court_name"]
    rows = courts.select(*keys).distinct().withColumn("_city", F.when(F.col("court_city") != "unresolved", F.col("court_city"))).withColumn("_code", F.col("prefecture_code").try_cast("double").cast("long").cast("string"))
    g = gazetteer.where("prefecture_code is not null")
    fit = (F.col("level") == "prefecture") | ((F.col("level") == "county") & (F.col("prefecture") == F.col("full_name")))
    both = g.groupBy(F.col("name").alias("_n1"), F.col("code").alias("_c1")).agg(F.min("prefecture_code").alias("_by_both"))
    named = gazetteer.groupBy(F.col("name").alias("_n2")).agg(F.max("in_window").alias("_w"), F.min(F.when(fit & F.col("in_window"), F.col("prefecture_code"))).alias("_inside"), F.min(F.when(fit, F.col("prefecture_code"))).alias("_any"))
    named = named.select("_n2", F.when(F.col("_w"), F.col("_inside")).otherwise(F.col("_any")).alias("_by_name"))
    coded = g.groupBy(F.col("code").alias("_c2")).agg(F.min("prefecture_code").alias("_by_code"))
    names = g.groupBy(F.col("prefecture_code").alias("_pc")).agg(F.min("prefecture").alias("_pref"))
    rows = rows.join(both, (F.col("_city") == F.col("_n1")) & (F.col("_code") == F.col("_c1")), "left").join(named, F.col("_city") == F.col("_n2"), "left").join(coded, F.col("_code") == F.col("_c2"), "left")
    rows = rows.withColumn("_found", F.coalesce("_by_both", "_by_name", "_by_code")).join(names, F.col("_found") == F.col("_pc"), "left")
    read = resolve(rows.select(F.col("court_name").alias("raw"), F.col("province").alias("court_province"), F.lit(None).cast("string").alias("court_prefecture")).distinct(), gazetteer)
    read = read.where(F.col("raw").isNotNull() & F.col("status").isin("resolved", "ambiguous_resolved_by_court_prov")).select(F.col("raw").alias("_raw"), F.col("court_province").alias("_prov"), F.col("prefecture").alias("_read"))
    rows = rows.join(read, (F.col("court_name") == F.col("_raw")) & F.col("province").eqNullSafe(F.col("_prov")), "left")
    pref = F.when(F.col("province").isin(*MUNICIPALITIES.values()), F.col("province")).when(F.col("_found").isNotNull(), F.col("_pref")).otherwise(F.col("_read"))
    found = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], pref.alias("court_prefecture"))
    return courts.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def origins(parties: DataFrame, gazetteer: DataFrame, keys: list[str]) -> DataFrame:
    """parties with the origin fields added.

    parties: keys that tell rows apart, hukou_raw, birthplace_raw, native_raw, residence_raw,
    court_province, court_prefecture. The first of these that isn't empty is the origin; migrant_city
    and migrant_prov compare it with the court's place, migrant_city_nores leaves residences out, and
    local_residence says whether the residence lies in the court's prefecture.
    """
    raws = [f"{o}_raw" for o in ORIGINS]
    court = ["court_province", "court_prefecture"]
    long = parties.select(*keys, *court, F.explode(F.array(*[F.struct(F.lit(o).alias("source"), F.col(f"{o}_raw").alias("raw")) for o in ORIGINS])).alias("_o")).select(*keys, *court, "_o.source", "_o.raw").where("raw <> ''")
    place = F.struct("province", "prefecture", "county", "status")
    # four entries a row at most
    found = resolve(long, gazetteer).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("source", place))).alias("_found"))
    source, raw = first_source(raws)
    rows = parties.join(found, keys, "left").withColumn("origin_source", source).withColumn("origin_raw", raw)
    rows = rows.withColumn("_at", F.try_element_at("_found", F.col("origin_source"))).withColumn("_home", F.try_element_at("_found", F.lit("residence"))).withColumn("_strict", F.try_element_at("_found", first_source(raws[:3])[0]))
    moved = lambda at, by_city=True: migrant(F.col(f"{at}.province"), F.col(f"{at}.prefecture"), F.col("court_province"), F.col("court_prefecture"), by_city)
    rows = rows.withColumn("origin_province", F.col("_at.province")).withColumn("origin_prefecture", F.col("_at.prefecture")).withColumn("origin_county", F.col("_at.county")).withColumn("origin_status", F.col("_at.status"))
    return rows.withColumn("migrant_city", moved("_at")).withColumn("migrant_prov", moved("_at", False)).withColumn("migrant_city_nores", moved("_strict")).withColumn("local_residence", ~moved("_home")).drop("_found", "_at", "_home", "_strict")
