"""Text operators over literal inputs, each with the values that are expected of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from paneloom.functions import judgments, numerals

QUERIES, ORACLES = {}, {}


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, dt.date):
        return f"DATE '{v}'"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _kind(values) -> str:
    v = next((x for x in values if x is not None), "")
    return "BOOLEAN" if isinstance(v, bool) else "BIGINT" if isinstance(v, int) else "DOUBLE" if isinstance(v, float) else "DATE" if isinstance(v, dt.date) else "VARCHAR"


def register(name: str, cases: list[tuple], outputs: list[str], build) -> None:
    """cases: (input..., expected...) with one input; build(column) gives the outputs by name."""
    inputs = [c[0] for c in cases]

    def run(spark, sf_dir):
        rows = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "id long, s string")
        made = build(F.col("s"))
        return rows.select("id", *[made[o].alias(o) for o in outputs])

    columns = list(zip(*[c[1:] for c in cases], strict=True))
    values = ", ".join("(" + ", ".join([str(i), *[_sql(v) for v in c[1:]]]) + ")" for i, c in enumerate(cases))
    select = ", ".join(f"CAST({o} AS {_kind(col)}) AS {o}" for o, col in zip(outputs, columns, strict=True))
    QUERIES[name] = run
    ORACLES[name] = f"SELECT CAST(id AS BIGINT) AS id, {select} FROM (VALUES {values}) AS t(id, {', '.join(outputs)})"


# fixed values: inputs with the values that any implementation of these rules must give, up to REFERENCES; those that end each list are this library's own
NUMBERS = [("1996", 1996.0), ("1,996", 1996.0), ("3，000", 3000.0), ("1,234,567", 1234567.0), ("24332.30", 24332.3), ("2，983.50", 2983.5), ("6.2万", 62000.0), ("1万2千", 12000.0), ("三千五百", 3500.0), ("两千", 2000.0), ("一万三千八百八十八", 13888.0), ("十", 10.0), ("十五", 15.0), ("二十", 20.0), ("一百零五", 105.0), ("三十万", 300000.0), ("１２３", 123.0), ("１，２００", 1200.0), ("1300余", 1300.0), ("700多", 700.0), ("3千", 3000.0), ("二〇一五", 2015.0), ("壹万", 10000.0), ("一亿二千万", 120000000.0), ("12,34", 12.0), ("无", None), ("", None), ("四千零七", 4007.0), ("2万5千", 25000.0), ("９８７.5", 987.5), ("廿", None), (None, None)]
register("num_parse", NUMBERS, ["value"], lambda s: {"value": numerals.number(s)})

DURATIONS = [("一年六个月", 18.0), ("八个月", 8.0), ("十年", 120.0), ("1年零3个月", 15.0), ("两年", 24.0), ("十五日", 0.5), ("一年又三个月", 12.0), ("一个月十五日", 1.5), ("终身", None), ("三年", 36.0), ("九个月二十日", 9.667), ("", None), (None, None)]
register("duration_parse", DURATIONS, ["months"], lambda s: {"months": numerals.months(s)})

DATES = [("2018-08-28", dt.date(2018, 8, 28), "iso"), ("2018年8月28日", dt.date(2018, 8, 28), "cn_arabic"), ("2015年十二月二十九日", dt.date(2015, 12, 29), "cn_numeral"), ("二〇一五年一月五日", dt.date(2015, 1, 5), "cn_numeral"), ("于2016年十月三十日宣判", dt.date(2016, 10, 30), "cn_numeral"), ("2017年2月30日", None, "cn_arabic"), ("不详", None, "other"), ("2020-02-30", None, "iso"), ("二〇一九年十一月三十日", dt.date(2019, 11, 30), "cn_numeral"), ("", None, "missing"), (None, None, "missing")]
register("date_parse", DATES, ["day", "kind"], lambda s: {"day": numerals.judgment_date(s), "kind": numerals.date_kind(s)})

CASES = [("(2018)粤0902刑初370号", "粤", "0902", "刑初", 370), ("(2018)浙07刑终21号", "浙", "07", "刑终", 21), ("(2019)京0105刑更123号", "京", "0105", "刑更", 123), ("（2019）沪0115刑初1号", "沪", "0115", "刑初", 1), ("(2016)津0116刑初字第8号", "津", "0116", "刑初", 8), ("(2016)鲁0683行初19号", "鲁", "0683", "其他", 19), ("(2015)兴刑初字第153号", None, None, "刑初", 153), ("(2015)武法民初字第01659号", None, None, "其他", 1659), ("(2018)川01刑监5号", "川", "01", "其他", 5), ("永刑初字第70号", None, None, "刑初", 70), (None, None, None, "其他", None)]


def _case(s):
    abbr, code, kind, _ = numerals.case_parts(s)
    return {"abbr": abbr, "code": code, "kind": kind, "serial": numerals.case_serial(s)}


register("case_number_parse", CASES, ["abbr", "code", "kind", "serial"], _case)

CITIES = ["茂名市", "三门峡市", "南京市", "杭州市", "黔南布依族苗族自治州", "大兴安岭地区", "锡林郭勒盟"]
COURTS = [("茂名市茂南区人民法院", "茂名市"), ("江苏省南京市中级人民法院", "南京市"), ("浙江省杭州市西湖区人民法院", "杭州市"), ("灵宝市人民法院", None), ("黔南布依族苗族自治州中级人民法院", "黔南布依族苗族自治州"), ("大兴安岭地区中级人民法院", "大兴安岭地区"), ("锡林郭勒盟中级人民法院", "锡林郭勒盟"), ("某县人民法院", None), (None, None)]
register("court_city", COURTS, ["city"], lambda s: {"city": numerals.court_city(s, F.array(*map(F.lit, CITIES)))})

P = "被告人张某犯盗窃罪，判处"
PENALTIES = [
    (P + "有期徒刑一年六个月，并处罚金人民币二千元。", "有期徒刑", 18.0, False, None, 2000.0),
    (P + "拘役三个月，缓刑六个月，并处罚金人民币一千元。", "拘役", 3.0, True, 6.0, 1000.0),
    (P + "有期徒刑一年八个月，并处罚金人民币五千元；与前罪并罚，决定执行有期徒刑六年四个月，并处罚金人民币一万五千元。", "有期徒刑", 76.0, False, None, 15000.0),
    (P + "罚金人民币2000元。", "单处罚金", None, False, None, 2000.0),
    ("被告人张某犯盗窃罪，免予刑事处罚。", "免予刑事处罚", None, False, None, None),
    (P + "管制六个月，并处罚金人民币一千元。", "管制", 6.0, False, None, 1000.0),
    (P + "无期徒刑，剥夺政治权利终身。", "无期徒刑", None, False, None, None),
    (P + "有期徒刑六个月（刑期自2014年9月15日起至2015年3月14日止），并处罚金人民币二千元。", "有期徒刑", 6.0, False, None, 2000.0),
    (P + "有期徒刑九年，并处罚金人民币100000元；二、被告人张某退赔人民币380000元", "有期徒刑", 108.0, False, None, 100000.0),
    (P + "拘役一个月十五日，并处罚金人民币一千元。", "拘役", 1.5, False, None, 1000.0),
    ("被告人张某犯故意杀人罪，判处死刑，缓期二年执行，剥夺政治权利终身。", "死缓", None, False, None, None),
]
register("penalty_parse", PENALTIES, ["penalty_type", "term_months", "probation", "probation_months", "fine_yuan"], lambda s: {k: judgments.penalty(s)[k] for k in ("penalty_type", "term_months", "probation", "probation_months", "fine_yuan")})

CHARGES = [("被告人甲犯盗窃罪、抢劫罪，判处", "盗窃罪;抢劫罪"), ("被告人甲犯盗窃罪，判处；犯抢劫罪，判处；被告人乙犯盗窃罪", "盗窃罪;抢劫罪"), ("无罪", ""), ("被告人犯罪", "")]
register("charges_parse", CHARGES, ["found"], lambda s: {"found": F.array_join(judgments.charges(s), ";")})

AMOUNTS = [("本院认为，被告人盗窃他人财物，合计价值人民币1,996元，数额较大。", 1996.0, "reasoning_total"), ("本院认为，价值人民币300元，数额较大。", 300.0, "reasoning"), ("退赔被害人3000元。", None, None), ("窃得手机一部（经鉴定，价值人民币1,582元，已发还）及手机一部(经鉴定价值人民币557元，已扣押)", 2139.0, "reasoning_sum"), ("盗窃物品共计价值人民币6.2万元", 62000.0, "reasoning_total"), (None, None, None)]
register("amount_parse", AMOUNTS, ["value", "source"], lambda s: {k: judgments.amount(s, F.lit(None).cast("string"), F.lit(None).cast("string"))[k] for k in ("value", "source")})

PROCEDURES = [("本院依法适用简易程序，公开开庭", "简易"), ("不宜适用简易程序，决定适用普通程序", "普通"), ("适用速裁程序审理", "速裁"), ("（2018）粤0902刑速1号", "速裁"), ("组成合议庭", None), (None, None)]
register("procedure_parse", PROCEDURES, ["procedure"], lambda s: {"procedure": judgments.procedure(s)})

FULL = (
    "某某法院刑事判决书（2018）粤0902刑初1号公诉机关某检察院。被告人甲，男，1990年1月1日出生。因涉嫌犯盗窃罪被刑事拘留。"
    "某检察院以某检刑诉（2018）1号起诉书指控被告人甲犯盗窃罪，于2018年1月1日向本院提起公诉。"
    "公诉机关指控：2017年被告人甲窃得手机一部，价值1000元。经审理查明，2017年被告人甲窃得手机一部。"
    "本院认为，被告人甲构成盗窃罪。依照某规定，判决如下：被告人甲犯盗窃罪，判处拘役三个月。"
)
ALL = "header,charge,facts,reasoning,verdict"
SPANS = [
    (FULL, ALL, "经审理查明，2017年被告人甲窃得手机一部。", "：被告人甲犯盗窃罪，判处拘役三个月。"),
    (FULL.replace("经审理查明，", ""), "header,charge,reasoning,verdict", None, "：被告人甲犯盗窃罪，判处拘役三个月。"),
    (FULL.replace("判决如下", "判�如下"), ALL, "经审理查明，2017年被告人甲窃得手机一部。", "：被告人甲犯盗窃罪，判处拘役三个月。"),
    (FULL.replace("依照某规定，判决如下：", "依照某规定。"), ALL, "经审理查明，2017年被告人甲窃得手机一部。", "被告人甲犯盗窃罪，判处拘役三个月。"),
    ("没有标记的文本", "", None, None),
    (None, "", None, None),
]


def _spans(s):
    sp = judgments.spans(s)
    found = F.concat_ws(",", *[F.when(sp[k].isNotNull(), k) for k in judgments.SEGMENTS])
    return {"found": found, "facts": judgments.segment(s, sp["facts"]), "verdict": judgments.segment(s, sp["verdict"])}


register("segment_spans", SPANS, ["found", "facts", "verdict"], _spans)


def _flags(s):
    sp = judgments.spans(s)
    f = judgments.flags(s, {k: judgments.segment(s, sp[k]) for k in judgments.SEGMENTS})
    return {k: f[k] for k in ("surrender", "forgiveness", "plea_formal", "spec_pickpocket")}


FLAGS = [("本院认为，被告人系自首。被告人未取得被害人谅解。", True, False, False, False), ("本院认为，不构成自首。已取得谅解；认罪认罚。", False, True, True, False), ("经审理查明，被告人扒窃手机。本院认为，成立。", False, False, False, True)]
register("doc_flags", FLAGS, ["surrender", "forgiveness", "plea_formal", "spec_pickpocket"], _flags)


TWO = (
    "某法院刑事判决书公诉机关某检察院。被告人王某，男，1990年1月1日出生，住某县。因涉嫌犯盗窃罪被刑事拘留。现羁押于某看守所。"
    "被告人王某，男，1985年2月2日出生，住某县。因涉嫌犯盗窃罪被取保候审。现取保候审于其住所地。"
    "某检察院以某号起诉书指控被告人王某、王某犯盗窃罪，于某日提起公诉。本院适用速裁程序审理。"
    "公诉机关指控：两被告人窃得财物价值人民币50000100000元。被告人对指控无异议并签字具结。"
    "本院认为，被告人构成盗窃罪。判决如下：一、被告人王某犯盗窃罪，判处有期徒刑一年，并处罚金人民币2000元。"
    "二、被告人王某犯盗窃罪，判处拘役三个月，缓刑六个月，并处罚金人民币50000100000元。"
)


def _two(spark):
    from paneloom.operators import extract

    return extract, extract.segmented(spark.createDataFrame([(1, TWO, None)], "doc_id long, judgment string, judged date"))


def party_extract(spark, sf_dir):
    extract, rows = _two(spark)
    found = extract.defendants(rows)
    return found.select("doc_id", F.col("def_idx").cast("long").alias("def_idx"), "def_name", "pretrial_status_at_judgment", F.array_join("charges", ";").alias("charges"), "term_months", "probation", "fine_outlier", "fine_yuan_ctrl", "dup_pseudonym", "outcomes_ok")


def synthetic_doc(spark, sf_dir):
    extract, rows = _two(spark)
    return extract.documents(rows).select("doc_id", "speedy", "jiejie", "plea_formal", "leniency_proc", "amt_outlier", "amt_yuan_ctrl", "amt_source", "procedure", "has_facts", "has_verdict")


def json_validate(spark, sf_dir):
    from paneloom.operators import labels

    replies = spark.createDataFrame(
        [(1, '```json\n{"type": {"value": "A", "evidence": "x"}, "term": {"value": "1,200元", "evidence": null}}\n```'), (2, 'Here: {"type": {"value": "Z"}, "term": {"value": "未知"}} done'), (3, "no json"), (4, '{"type": {"value": null}}'), (5, None)],
        "doc_id long, raw string",
    )
    spec = spark.createDataFrame([("type", "choice", ["A", "B"]), ("term", "number", None)], "field string, kind string, allowed array<string>")
    return labels.validate(replies, spec).select("doc_id", "field", "value", "error")


QUERIES |= {"party_extract": party_extract, "synthetic_doc": synthetic_doc, "json_validate": json_validate}
ORACLES |= {
    "party_extract": "SELECT CAST(1 AS BIGINT) AS doc_id, CAST(i AS BIGINT) AS def_idx, '王某' AS def_name, s AS pretrial_status_at_judgment, '盗窃罪' AS charges, CAST(t AS DOUBLE) AS term_months, p AS probation, o AS fine_outlier, CAST(f AS DOUBLE) AS fine_yuan_ctrl, TRUE AS dup_pseudonym, TRUE AS outcomes_ok FROM (VALUES (0, '在押', 12, FALSE, FALSE, 2000), (1, '取保', 3, TRUE, TRUE, NULL)) AS v(i, s, t, p, o, f)",
    "synthetic_doc": "SELECT CAST(1 AS BIGINT) AS doc_id, TRUE AS speedy, TRUE AS jiejie, FALSE AS plea_formal, TRUE AS leniency_proc, TRUE AS amt_outlier, CAST(NULL AS DOUBLE) AS amt_yuan_ctrl, 'charge_sum' AS amt_source, '速裁' AS procedure, FALSE AS has_facts, TRUE AS has_verdict",
    "json_validate": "SELECT CAST(d AS BIGINT) AS doc_id, f AS field, CAST(v AS VARCHAR) AS value, CAST(e AS VARCHAR) AS error FROM (VALUES (1, 'type', 'A', NULL), (1, 'term', '1200.0', NULL), (2, 'type', NULL, 'invalid:type'), (2, 'term', 'NA', NULL), (3, 'type', NULL, 'json_error'), (3, 'term', NULL, 'json_error'), (4, 'type', NULL, 'missing:type'), (4, 'term', NULL, 'missing:term'), (5, 'type', NULL, 'json_error'), (5, 'term', NULL, 'json_error')) AS t(d, f, v, e)",
}


REFERENCES = [("上诉人不服某法院（2015）兴刑初字第153号刑事判决", "（2015）兴刑初字第153号"), ("不服(2018)粤0902刑初370号判决", "(2018)粤0902刑初370号"), ("没有", None), (None, None)]
register("first_instance_reference", REFERENCES, ["found"], lambda s: {"found": F.nullif(F.regexp_extract(s, "([（(][0-9]{4}[)）][^，。；]{1,12}?刑[^，。；]{0,6}?初[^，。；]{0,6}?[0-9]+号)", 1), F.lit(""))})

CANDIDATES = [("盗窃罪", True, False), ("未知", False, True), ("抢劫罪", False, False), (None, False, False)]
register("theft_candidates", CANDIDATES, ["is_theft", "is_unclassified"], lambda s: {"is_theft": F.coalesce(s == "盗窃罪", F.lit(False)), "is_unclassified": F.coalesce(s.startswith("未"), F.lit(False))})

YEARS = [("案发于2014年3月", 2014), ("1999年与2001年", 1999), ("3014", None), ("", None), (None, None)]
register("year_parse", YEARS, ["year"], lambda s: {"year": numerals.year_in(s)})

WHERE = [(FULL + "|窃得手机一部", "charge"), (FULL + "|构成盗窃罪", "reasoning"), (FULL + "|不在其中", "not_found_in_text"), ("|x", "not_found_in_text")]


def _where(s):
    """The first segment that holds a returned text."""
    text, sought = F.substring_index(s, "|", 1), F.substring_index(s, "|", -1)
    sp = judgments.spans(text)
    found = F.coalesce(*[F.when(judgments.segment(text, sp[k]).contains(sought), k) for k in judgments.SEGMENTS], F.lit("not_found_in_text"))
    return {"place": found}


register("evidence_location", WHERE, ["place"], _where)
