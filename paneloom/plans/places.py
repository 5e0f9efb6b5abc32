"""Gazetteer queries over a small hand-written gazetteer, with expected values."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions import places
from paneloom.sources.tables import table

QUERIES, ORACLES = {}, {}

# code, name, level, valid from, valid to, new codes
RECORDS = [
    ("110000", "北京市", "province", 1980, None, None), ("110105", "朝阳区", "county", 1980, None, None), ("120000", "天津市", "province", 1980, None, None), ("120225", "蓟县", "county", 1980, 2016, "120119[2016]"), ("120119", "蓟州区", "county", 2016, None, None),
    ("220000", "吉林省", "province", 1980, None, None), ("220100", "长春市", "prefecture", 1980, None, None), ("220104", "朝阳区", "county", 1980, None, None), ("320000", "江苏省", "province", 1980, None, None), ("320800", "淮安市", "prefecture", 2001, None, None), ("320830", "盱眙县", "county", 1980, None, None),
    ("340000", "安徽省", "province", 1980, None, None), ("340100", "合肥市", "prefecture", 1980, None, None), ("341400", "巢湖市", "prefecture", 1999, 2011, "340181[2011];340800"), ("340181", "巢湖市", "county", 2011, None, None), ("420000", "湖北省", "province", 1980, None, None), ("420600", "襄樊市", "prefecture", 1980, 2010, "420600[2010]"),
    ("420600", "襄阳市", "prefecture", 2010, None, None), ("429004", "仙桃市", "county", 1994, None, None), ("422800", "恩施土家族苗族自治州", "prefecture", 1993, None, None), ("422802", "利川市", "county", 1986, None, None), ("130000", "河北省", "province", 1980, None, None), ("130100", "石家庄市", "prefecture", 1980, None, None),
    ("130105", "新华区", "county", 1980, None, None), ("130900", "沧州市", "prefecture", 1980, None, None), ("130902", "新华区", "county", 1980, None, None), ("410000", "河南省", "province", 1980, None, None), ("410400", "平顶山市", "prefecture", 1980, None, None), ("410402", "新华区", "county", 1980, None, None),
]

PLACES = [
    ("江苏省淮安市盱眙县", None, "江苏省", "淮安市", "resolved"), ("盱眙县", None, "江苏省", "淮安市", "resolved"), ("盱眙", None, "江苏省", "淮安市", "resolved"), ("蓟县", None, "天津市", "天津市", "resolved"), ("襄樊市", None, "湖北省", "襄阳市", "resolved"), ("安徽省巢湖市", None, "安徽省", "合肥市", "resolved"),
    ("朝阳区", "北京市", "北京市", "北京市", "ambiguous_resolved_by_court_prov"), ("朝阳区", "吉林省", "吉林省", "长春市", "ambiguous_resolved_by_court_prov"), ("朝阳区", None, None, None, "ambiguous"), ("新华区", "河南省", "河南省", "平顶山市", "ambiguous_resolved_by_court_prov"), ("新华区", "河北省", None, None, "ambiguous"),
    ("湖北省", None, "湖北省", None, "province_only"), ("本市", "浙江省", "浙江省", None, "local_word"), ("XXX", None, None, None, "unresolved"), ("中国湖北省利川市人", None, "湖北省", "恩施土家族苗族自治州", "resolved"), ("湖北仙桃市某镇", None, "湖北省", "仙桃市", "resolved"), (None, None, None, None, "unresolved"),
]


def _records(spark):
    return spark.createDataFrame(RECORDS, "code string, full_name string, level string, valid_from int, valid_to int, new_codes string")


def _values(rows):
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def successor_chain(spark, d):
    return places.successors(_records(spark), 2016).orderBy("code")


def place_resolve(spark, d):
    asked = spark.createDataFrame([(i, r, c, None) for i, (r, c, *_) in enumerate(PLACES)], "id long, raw string, court_province string, court_prefecture string")
    return places.resolve(asked, places.build(_records(spark), 2016, (2010, 2020))).select("id", "province", "prefecture", "status")


ORIGINS = [("湖北省", "恩施土家族苗族自治州", "浙江省", "衢州市", True, True), ("浙江省", "温州市", "浙江省", "衢州市", True, False), ("浙江省", None, "浙江省", "衢州市", None, False), (None, None, "浙江省", "衢州市", None, None), ("浙江省", "衢州市", "浙江省", "衢州市", False, False)]


def origin_migrant(spark, d):
    rows = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(ORIGINS)], "id long, p string, f string, cp string, cf string")
    cols = [F.col(c) for c in ("p", "f", "cp", "cf")]
    return rows.select("id", places.migrant(*cols).alias("by_city"), places.migrant(*cols, by_city=False).alias("by_province"))


QUERIES |= {"successor_chain": successor_chain, "place_resolve": place_resolve, "origin_migrant": origin_migrant}
ORACLES |= {
    "successor_chain": f"""WITH RECURSIVE r(code, full_name, level, valid_from, valid_to, new_codes) AS (VALUES {_values(RECORDS)}),
ok AS (SELECT DISTINCT code FROM r WHERE valid_from <= 2016 AND (valid_to IS NULL OR valid_to > 2016)),
step AS (SELECT code AS f, regexp_replace(string_split(max_by(new_codes, valid_from), ';')[1], '\\[[0-9]{{4}}\\]', '', 'g') AS t FROM r WHERE coalesce(new_codes, '') <> '' GROUP BY code),
walk(code, pos, n) AS (SELECT DISTINCT code, code, 0 FROM r UNION ALL SELECT w.code, s.t, n + 1 FROM walk w JOIN step s ON w.pos = s.f WHERE w.pos NOT IN (SELECT code FROM ok) AND n < 10)
SELECT code, max(CASE WHEN pos IN (SELECT code FROM ok) THEN pos END) AS code_now FROM walk GROUP BY code ORDER BY code""",
    "place_resolve": f"SELECT CAST(id AS BIGINT) AS id, CAST(province AS VARCHAR) AS province, CAST(prefecture AS VARCHAR) AS prefecture, status FROM (VALUES {_values([(i, *r[2:]) for i, r in enumerate(PLACES)])}) AS t(id, province, prefecture, status)",
    "origin_migrant": f"SELECT CAST(id AS BIGINT) AS id, CAST(by_city AS BOOLEAN) AS by_city, CAST(by_province AS BOOLEAN) AS by_province FROM (VALUES {_values([(i, *r[4:]) for i, r in enumerate(ORIGINS)])}) AS t(id, by_city, by_province)",
}


CITY_CASES = [("合肥市", "安徽省", "某法院", "合肥市", "prefecture"), (None, "北京市", "某法院", "北京市", "municipality"), (None, "安徽省", "安徽省合肥市某区人民法院", "合肥市", "court_name"), (None, None, "北京市朝阳区人民法院", "北京市", "court_name"), (None, "河南省", "灵宝市人民法院", "unresolved", "unresolved"), (None, None, None, "unresolved", "unresolved")]


def _by_key(spark, d, cases, columns, n):
    """Each customer with the inputs of the case that its key falls on."""
    one = spark.createDataFrame([(i, *c[:n]) for i, c in enumerate(cases)], "i long, " + ", ".join(f"{x} string" for x in columns))
    return table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % len(cases)).alias("i")).join(one, "i").drop("i")


def _expected(cases, names, n):
    rows = _values([(i, *c[n:]) for i, c in enumerate(cases)])
    return f"SELECT c_custkey, {', '.join(f'CAST({x} AS VARCHAR) AS {x}' for x in names)} FROM customer JOIN (VALUES {rows}) AS t(i, {', '.join(names)}) ON c_custkey % {len(cases)} = i"


def court_city_cascade(spark, d):
    return places.court_cities(_by_key(spark, d, CITY_CASES, ("prefecture", "province", "court_name"), 3)).select("c_custkey", "court_city", "court_city_source")


PREFECTURES = [("合肥市", "安徽省"), ("朝阳市", "辽宁省"), ("吉林市", "吉林省"), ("海南藏族自治州", "青海省"), ("", "x"), (None, "y")]
NAMED = [("江苏省某县", "江苏省"), ("合肥市某区", "安徽省"), ("合肥某区", "安徽省"), ("朝阳区", None), ("朝阳某村", "辽宁省"), ("吉林市船营区", "吉林省"), ("海南藏族自治州某县", "青海省"), ("海南某县", None), ("海南省某县", "海南省"), ("广西某县", "广西壮族自治区"), ("新疆某县", "新疆维吾尔自治区"), ("：本县某村", "LOCAL"), ("某村", None), ("京", None), ("", None), (None, None)]


def province_named(spark, d):
    prefectures = spark.createDataFrame(PREFECTURES, "prefecture string, province string")
    return places.provinces_of(_by_key(spark, d, NAMED, ("raw",), 1), prefectures).select("c_custkey", "province_named")


COURTS = [
    ("北京市", None, "北京市", "某法院", "北京市"), ("襄樊市", "420600", "湖北省", "某法院", "襄阳市"), ("合肥市", None, "安徽省", "某法院", "合肥市"), ("unresolved", "320800.0", "江苏省", "某法院", "淮安市"), ("unresolved", None, "湖北省", "湖北省利川市人民法院", "恩施土家族苗族自治州"), ("unresolved", None, "吉林省", "朝阳区人民法院", "长春市"),
    ("unresolved", None, None, "朝阳区人民法院", None), ("巢湖市", "341400", "安徽省", "某法院", "合肥市"), ("unresolved", "x", None, None, None),
]


def court_prefecture_cascade(spark, d):
    gazetteer = places.build(_records(spark), 2016, (2010, 2020))
    return places.court_prefectures(_by_key(spark, d, COURTS, ("court_city", "prefecture_code", "province", "court_name"), 4), gazetteer).select("c_custkey", "court_prefecture")


def prefecture_mode(spark, d):
    cases = table(spark, d, "customer").select(F.concat(F.lit("p"), (F.col("c_nationkey") % 7).cast("string")).alias("prefecture"), F.col("c_mktsegment").alias("province"))
    return places.prefecture_provinces(cases)


LABELLED = [("江苏省淮安市盱眙县", "1", "0"), ("安徽省巢湖市", "0", "1"), ("本市", "0", "1"), ("XXX", "NA", "NA"), ("NA", "NA", "NA"), (None, "NA", "NA")]


def place_labels(spark, d):
    """What answered places say: an origin elsewhere, a residence here; the court is in 安徽省合肥市."""
    from paneloom.operators import labels

    rows = _by_key(spark, d, LABELLED, ("value",), 1)
    courts = rows.select("c_custkey", F.lit("安徽省").alias("court_province"), F.lit("合肥市").alias("court_prefecture"))
    both = rows.withColumn("field", F.explode(F.array(F.lit("origin_text"), F.lit("residence_text"))))
    found = labels.placed_answers(both, courts, places.build(_records(spark), 2016, (2010, 2020)), "c_custkey")
    return found.groupBy("c_custkey").pivot("field", ["origin_text", "residence_text"]).agg(F.first("label"))


QUERIES |= {"court_city_cascade": court_city_cascade, "province_named": province_named, "court_prefecture_cascade": court_prefecture_cascade, "prefecture_mode": prefecture_mode, "place_labels": place_labels}
ORACLES |= {
    "court_city_cascade": _expected(CITY_CASES, ("court_city", "court_city_source"), 3),
    "province_named": _expected(NAMED, ("province_named",), 1),
    "court_prefecture_cascade": _expected(COURTS, ("court_prefecture",), 4),
    "prefecture_mode": "SELECT prefecture, province FROM (SELECT 'p' || (c_nationkey % 7) AS prefecture, c_mktsegment AS province, row_number() OVER (PARTITION BY c_nationkey % 7 ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY c_nationkey % 7, c_mktsegment) WHERE r = 1",
    "place_labels": _expected(LABELLED, ("origin_text", "residence_text"), 1),
}
