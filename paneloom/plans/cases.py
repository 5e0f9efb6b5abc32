"""Judgments written from the rows of a table, and read back: what is read is held against the columns they were written from.

Each customer is a case. Every fourth one has a second defendant, with counsel; terms, dates, amounts,
records and flags follow from the customer's key, so that SQL can tell them without the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions import casetext, judgments, numerals, places
from paneloom.functions.text import mark, normalized
from paneloom.operators import extract, labels
from paneloom.plans.places import _records
from paneloom.sources import scratch
from paneloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Place of birth and household by key mod 5, the last one being the court's own; the court is in 安徽省合肥市.
HOMES = ("江苏省淮安市盱眙县", "湖北省利川市", "河北省石家庄市新华区", "安徽省巢湖市", "本市")
TERMS = "一二三四五六七八九"
#: Judgments that one task reads, about.
TEXTS_A_TASK = 10_000


def chosen(values, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def cn_date(d: Column) -> Column:
    return F.date_format(d, "yyyy年M月d日")


def judgment_texts(spark, d) -> DataFrame:
    """doc_id, judged, judgment: the cases."""
    key = F.col("k")
    # keys are dealt out before each becomes a text that takes time to read, so many to a task at most that its time doesn't grow with the table
    keys = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    rows = keys.repartition(max(spark.sparkContext.defaultParallelism, -(-keys.count() // TEXTS_A_TASK)), "k")
    born, judged = F.date_add(F.lit("1950-01-01").cast("date"), (key * 37 % 15000).cast("int")), F.date_add(F.lit("2018-01-01").cast("date"), (key % 365).cast("int"))
    caught = F.date_sub(judged, 100)
    first = F.concat(
        F.lit("被告人甲某，"), F.when(key % 2 == 0, "女").otherwise("男"), F.lit("，"), cn_date(born), F.lit("出生，汉族，初中文化，农民，户籍所在地"), chosen(HOMES, key % 5), F.lit("，住安徽省合肥市某路。"),
        F.when(key % 7 == 0, "2010年3月4日因犯盗窃罪被判处拘役二个月。").otherwise(""), F.lit("因涉嫌犯盗窃罪于"), cn_date(caught), F.lit("被刑事拘留，"),
        F.when(key % 3 == 0, "次日被取保候审。现取保候审于其住所地。").otherwise("同日被逮捕。现羁押于某看守所。"),
    )
    second = F.when(key % 4 == 0, "被告人乙某，男，1980年5月6日出生，回族。因涉嫌犯盗窃罪被监视居住。辩护人丙某，某律师事务所律师。").otherwise("")
    body = F.concat(
        F.lit("某检察院以某检刑诉（2018）1号起诉书指控被告人甲某犯盗窃罪，向本院提起公诉。本院"), F.when(key % 6 == 0, "依法适用速裁程序。").when(key % 6 == 1, "依法适用简易程序。").otherwise("依法审理。"),
        F.lit("公诉机关指控：甲某窃得手机一部，价值人民币"), (key % 50 * 100 + 100).cast("string"), F.lit("元。经审理查明，甲某"), F.when(key % 8 == 0, "扒窃").otherwise("入户窃得"), F.lit("手机一部，价值人民币"), (key % 50 * 100 + 100).cast("string"), F.lit("元。"),
        F.lit("本院认为，甲某构成盗窃罪。"), F.when(key % 5 == 0, "其系自首。").when(key % 5 == 1, "不构成自首。").otherwise(""), F.when(key % 9 == 0, "自愿认罪认罚。").otherwise(""), F.lit("判决如下：一、被告人甲某犯盗窃罪，判处有期徒刑"), chosen(TERMS, key % 9), F.lit("年，并处罚金人民币"), (key % 20 * 1000 + 1000).cast("string"), F.lit("元。"),
        F.when(key % 4 == 0, "二、被告人乙某犯盗窃罪，判处拘役三个月，缓刑六个月。").otherwise(""), F.lit("如不服本判决，可以上诉。"),
    )
    number = F.concat(F.lit("（2018）皖0104刑初"), key.cast("string"), F.lit("号"))
    return rows.select(key.alias("doc_id"), judged.alias("judged"), F.concat(F.lit("某法院 刑事判决书"), number, F.lit("公诉机关某检察院。"), first, second, body).alias("judgment"))


CASES_SQL = """c AS (SELECT c_custkey::BIGINT AS k, DATE '1950-01-01' + (c_custkey * 37 % 15000)::INT AS born, DATE '2018-01-01' + (c_custkey % 365)::INT AS judged FROM customer)"""
HOMES_SQL = "[" + ", ".join(f"'{h}'" for h in HOMES) + "]"


@query(f"""WITH {CASES_SQL}, d AS (
SELECT k AS doc_id, 0 AS def_idx, '甲某' AS def_name, CASE WHEN k % 2 = 0 THEN '女' ELSE '男' END AS gender, born AS birth_date,
 CASE WHEN y BETWEEN 10 AND 100 THEN y END AS age_at_judgment, '汉族' AS ethnicity, '初中文化' AS education, '农民' AS occupation_raw, ({HOMES_SQL})[k % 5 + 1] AS hukou_raw, '安徽省合肥市某路' AS residence_raw,
 k % 7 = 0 AS prior_record, k % 7 = 0 AS prior_theft, TRUE AS detained, judged - 100 AS detained_date, k % 3 <> 0 AS arrested, CASE WHEN k % 3 <> 0 THEN judged - 100 END AS arrested_date,
 k % 3 = 0 AS bail, CASE WHEN k % 3 = 0 THEN judged - 99 END AS bail_date, FALSE AS rsl, CASE WHEN k % 3 = 0 THEN '取保' ELSE '在押' END AS pretrial_status_at_judgment, FALSE AS counsel,
 '有期徒刑' AS penalty_type, (k % 9 + 1) * 12.0::DOUBLE AS term_months, (k % 20 + 1) * 1000.0::DOUBLE AS fine_yuan, FALSE AS probation
FROM (SELECT *, date_diff('year', born, judged) - (month(judged) * 100 + day(judged) < month(born) * 100 + day(born))::INT AS y FROM c)
UNION ALL SELECT k, 1, '乙某', '男', DATE '1980-05-06', date_diff('year', DATE '1980-05-06', judged) - (month(judged) * 100 + day(judged) < 506)::INT, '回族', NULL, NULL, NULL, NULL,
 FALSE, FALSE, FALSE, NULL, FALSE, NULL, FALSE, NULL, TRUE, 'rsl', TRUE, '拘役', 3.0, NULL, TRUE FROM c WHERE k % 4 = 0)
SELECT * FROM d""")
def case_parties(spark, d):
    found = extract.defendants(extract.segmented(judgment_texts(spark, d)))
    names = "doc_id def_idx def_name gender birth_date age_at_judgment ethnicity education occupation_raw hukou_raw residence_raw prior_record prior_theft detained detained_date arrested arrested_date bail bail_date rsl pretrial_status_at_judgment counsel penalty_type term_months fine_yuan probation"
    return found.select(*names.split())


@query(f"""WITH {CASES_SQL}
SELECT k AS doc_id, (k % 50 + 1) * 100.0::DOUBLE AS amt_yuan, CASE WHEN k % 6 = 0 THEN '速裁' WHEN k % 6 = 1 THEN '简易' END AS procedure, k % 6 = 0 AS speedy, k % 9 = 0 AS plea_formal, k % 9 = 0 OR k % 6 = 0 AS leniency_proc,
 k % 8 = 0 AS spec_pickpocket, k % 8 <> 0 AS spec_burglary, k % 5 = 0 AS surrender, FALSE AS restitution, FALSE AS attempted, k % 4 = 0 AS counsel, CASE WHEN k % 4 = 0 THEN '委托' END AS counsel_type,
 TRUE AS has_header, TRUE AS has_facts, FALSE AS has_fffd, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS n_defendants, '盗窃罪' AS charge_main, TRUE AS is_theft, FALSE AS is_robbery, k % 4 = 0 AS accomplice, FALSE AS dup_pseudonym FROM c""")
def case_documents(spark, d):
    rows = extract.segmented(judgment_texts(spark, d))
    found = extract.whole_documents(rows)
    names = "doc_id amt_yuan procedure speedy plea_formal leniency_proc spec_pickpocket spec_burglary surrender restitution attempted counsel counsel_type has_header has_facts has_fffd n_defendants charge_main is_theft is_robbery accomplice dup_pseudonym"
    return found.select(*names.split())


def _cases(spark, d) -> DataFrame:
    rows = judgment_texts(spark, d).withColumn("text", normalized(F.col("judgment")))
    return rows.withColumn("spans", judgments.spans(F.col("text")))


HEAD_SQL = f"""'某法院刑事判决书（2018）皖0104刑初' || k || '号公诉机关某检察院。被告人甲某，' || CASE WHEN k % 2 = 0 THEN '女' ELSE '男' END || '，' || strftime(born, '%Y年%-m月%-d日') || '出生，汉族，初中文化，农民，户籍所在地' || ({HOMES_SQL})[k % 5 + 1] || '，住安徽省合肥市某路。' ||
 CASE WHEN k % 7 = 0 THEN '2010年3月4日因犯盗窃罪被判处拘役二个月。' ELSE '' END || '因涉嫌犯盗窃罪于' || strftime(judged - 100, '%Y年%-m月%-d日') || '被刑事拘留，' || CASE WHEN k % 3 = 0 THEN '次日被取保候审。现取保候审于其住所地。' ELSE '同日被逮捕。现羁押于某看守所。' END ||
 CASE WHEN k % 4 = 0 THEN '被告人乙某，男，1980年5月6日出生，回族。因涉嫌犯盗窃罪被监视居住。辩护人丙某，某律师事务所律师。' ELSE '' END || '某检察院以某检刑诉（2018）1号起诉书指控被告人甲某犯盗窃罪，向本院提起公诉。本院' || CASE k % 6 WHEN 0 THEN '依法适用速裁程序。' WHEN 1 THEN '依法适用简易程序。' ELSE '依法审理。' END"""
VERDICT_SQL = """'：一、被告人甲某犯盗窃罪，判处有期徒刑' || ('一二三四五六七八九')[k % 9 + 1] || '年，并处罚金人民币' || (k % 20 * 1000 + 1000) || '元。' || CASE WHEN k % 4 = 0 THEN '二、被告人乙某犯盗窃罪，判处拘役三个月，缓刑六个月。' ELSE '' END || '如不服本判决，可以上诉。'"""
WHY_SQL = """'本院认为，甲某构成盗窃罪。' || CASE k % 5 WHEN 0 THEN '其系自首。' WHEN 1 THEN '不构成自首。' ELSE '' END || CASE WHEN k % 9 = 0 THEN '自愿认罪认罚。' ELSE '' END || '判决如下'"""
FACTS_SQL = """'经审理查明，甲某' || CASE WHEN k % 8 = 0 THEN '扒窃' ELSE '入户窃得' END || '手机一部，价值人民币' || (k % 50 * 100 + 100) || '元。'"""
CHARGE_SQL = """'公诉机关指控：甲某窃得手机一部，价值人民币' || (k % 50 * 100 + 100) || '元。'"""


@query(f"""WITH {CASES_SQL} SELECT k AS doc_id, sha256('【当事人段】' || chr(10) || {HEAD_SQL} || chr(10) || chr(10) || '【本院认为段】' || chr(10) || {WHY_SQL} || chr(10) || chr(10) || '【判决段】' || chr(10) || {VERDICT_SQL}) AS core,
sha256('【当事人段】' || chr(10) || {HEAD_SQL} || chr(10) || chr(10) || '【指控段】' || chr(10) || {CHARGE_SQL} || chr(10) || chr(10) || '【查明段】' || chr(10) || {FACTS_SQL}) AS origin,
sha256('【当事人段】' || chr(10) || {HEAD_SQL} || CASE WHEN k % 2 = 0 THEN chr(10) || chr(10) || '【判决段】' || chr(10) || {VERDICT_SQL} ELSE '' END) AS fill,
sha256('m|v2|core|' || k) AS cache_key FROM c""")
def case_inputs(spark, d):
    """The inputs of models, by digest, and their keys in a cache."""
    text, spans = F.col("text"), F.col("spans")
    digest = lambda c: F.sha2(c, 256)
    key = labels.cache_key(F.lit("m"), F.lit("v2"), F.lit("core"), F.col("doc_id").cast("string"))
    return _cases(spark, d).select("doc_id", digest(casetext.model_input(text, spans)).alias("core"), digest(casetext.model_input(text, spans, "origin")).alias("origin"), digest(casetext.fill_input(text, spans, F.col("doc_id") % 2 == 0)).alias("fill"), key.alias("cache_key"))


@query(f"""WITH {CASES_SQL} SELECT k AS doc_id, i AS block, CASE i WHEN 0 THEN '当事人段' WHEN 1 THEN '其他' WHEN 2 THEN '指控段' WHEN 3 THEN '查明段' WHEN 4 THEN '本院认为段' ELSE '判决段' END AS title,
CASE i WHEN 2 THEN length({CHARGE_SQL}) WHEN 3 THEN length({FACTS_SQL}) WHEN 4 THEN length({WHY_SQL}) WHEN 5 THEN length({VERDICT_SQL})
 ELSE CASE WHEN i = 0 THEN length({HEAD_SQL}) - length(tail) ELSE length(tail) END END::BIGINT AS n_chars
FROM (SELECT *, '某检察院以某检刑诉（2018）1号起诉书指控被告人甲某犯盗窃罪，向本院提起公诉。本院' || CASE k % 6 WHEN 0 THEN '依法适用速裁程序。' WHEN 1 THEN '依法适用简易程序。' ELSE '依法审理。' END AS tail FROM c), unnest(range(0, 6)) AS t(i)""")
def case_blocks(spark, d):
    """A text as titled blocks without gaps."""
    found = _cases(spark, d).select("doc_id", F.posexplode(casetext.text_blocks(F.col("text"), F.col("spans"))).alias("block", "b"))
    return found.select("doc_id", F.col("block").cast("long").alias("block"), "b.title", F.length("b.body").cast("long").alias("n_chars"))


@query(f"""WITH {CASES_SQL}, f AS (SELECT * FROM c, (VALUES ('origin_text'), ('penalty_type'), ('ever_bail'), ('procedure'), ('plea_formal'), ('probation')) AS v(field))
SELECT k AS doc_id, field, CASE field
 WHEN 'origin_text' THEN CASE WHEN k % 5 = 4 THEN substr('户籍所在地本市', 1, 30) ELSE substr('户籍所在地' || ({HOMES_SQL})[k % 5 + 1] || '，住', 1, 30) END
 WHEN 'penalty_type' THEN substr('判处有期徒刑' || ('一二三四五六七八九')[k % 9 + 1] || '年，并处罚金人民币' || (k % 20 * 1000 + 1000) || '元', 1, 22)
 WHEN 'ever_bail' THEN CASE WHEN k % 3 = 0 THEN '取保候审' ELSE '' END
 WHEN 'procedure' THEN CASE WHEN k % 6 = 0 THEN '适用速裁程序' WHEN k % 6 = 1 THEN '适用简易程序' ELSE '' END
 WHEN 'plea_formal' THEN CASE WHEN k % 9 = 0 THEN '认罪认罚' ELSE '' END
 ELSE CASE WHEN k % 4 = 0 THEN '缓刑六个月' ELSE '' END END AS excerpt FROM f""")
def case_evidence(spark, d):
    """Excerpts that speak for each field's value; the origin is sought by its place, where one is given."""
    fields = F.explode(F.array(*map(F.lit, ("origin_text", "penalty_type", "ever_bail", "procedure", "plea_formal", "probation")))).alias("field")
    rows = _cases(spark, d).select("*", fields)
    value = F.when((F.col("field") == "origin_text") & (F.col("doc_id") % 5 != 4), chosen(HOMES, F.col("doc_id") % 5)).otherwise(F.lit("NA"))
    rows = rows.withColumn("value", value)
    found = rows.withColumn("excerpt", casetext.excerpt(F.col("text"), F.col("spans"), F.col("field"), F.col("value")))
    # an origin excerpt begins six characters before the place; the test looks at it from the word on
    return found.select("doc_id", "field", F.when(F.col("field") == "origin_text", F.regexp_replace("excerpt", "^.*?(?=户籍)|^，", "")).otherwise(F.col("excerpt")).alias("excerpt"))


@query(f"""WITH {CASES_SQL} SELECT k AS doc_id, FALSE AS custody_doubtful, k % 2 = 1 AS origin_doubtful, FALSE AS home_doubtful FROM c""")
def case_answer_errors(spark, d):
    """Answers that the input doesn't bear out: odd cases answer their residence as origin."""
    text, spans = F.col("text"), F.col("spans")
    rows = _cases(spark, d).withColumn("input", casetext.model_input(text, spans))
    answered = F.when(F.col("doc_id") % 2 == 1, "安徽省合肥市某路").otherwise(chosen(HOMES, F.col("doc_id") % 5))
    return rows.select("doc_id", casetext.status_without_cue(F.lit("在押"), F.col("input")).alias("custody_doubtful"), casetext.residence_as_origin(answered, F.col("input")).alias("origin_doubtful"), casetext.residence_as_origin(F.lit("NA"), F.col("input")).alias("home_doubtful"))


ORIGINS_SQL = f"""o AS (SELECT *, CASE k % 5 WHEN 0 THEN '江苏省' WHEN 1 THEN '湖北省' WHEN 2 THEN '河北省' ELSE '安徽省' END AS p, CASE k % 5 WHEN 0 THEN '淮安市' WHEN 1 THEN '恩施土家族苗族自治州' WHEN 2 THEN '石家庄市' ELSE '合肥市' END AS f FROM c)"""


#: Fields of a party that tell its origin, and what rule labels of its custody need besides.
PLACES, CUSTODY = ("hukou_raw", "birthplace_raw", "native_raw", "residence_raw"), ("bail", "pretrial_status_at_judgment")
SENTENCE = ("penalty_type", "term_months", "probation")


def origin_rows(spark, d, fields: tuple[str, ...] = PLACES) -> DataFrame:
    """Defendants with their origins and sentences; fields: what else is read of them, the places among it."""
    read = extract.defendants(extract.segmented(judgment_texts(spark, d)), fields).select("doc_id", "def_idx", *fields, *SENTENCE)
    found = scratch.staged(read, "defendants").withColumn("court_province", F.lit("安徽省")).withColumn("court_prefecture", F.lit("合肥市"))
    # several of the queries read it more than once
    return scratch.staged(places.origins(found, places.build(_records(spark), 2016, (2010, 2020)), ["doc_id", "def_idx"]), "origins")


@query(f"""WITH {CASES_SQL}, {ORIGINS_SQL} SELECT k AS doc_id, 0 AS def_idx, 'hukou' AS origin_source, p AS origin_province, f AS origin_prefecture, CASE WHEN k % 5 = 4 THEN 'local_word' ELSE 'resolved' END AS origin_status,
p <> '安徽省' AS migrant_city, p <> '安徽省' AS migrant_prov, p <> '安徽省' AS migrant_city_nores, TRUE AS local_residence FROM o
UNION ALL SELECT k, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c WHERE k % 4 = 0""")
def case_origins(spark, d):
    names = "doc_id def_idx origin_source origin_province origin_prefecture origin_status migrant_city migrant_prov migrant_city_nores local_residence"
    return origin_rows(spark, d).select(*names.split())


@query(f"""WITH {CASES_SQL}, {ORIGINS_SQL}, v AS (SELECT k AS doc_id, (p <> '安徽省')::INT::VARCHAR AS nonlocal_origin, '1' AS residence_local, CASE WHEN k % 3 = 0 THEN '取保' ELSE '在押' END AS status_at_judgment, (k % 3 = 0)::INT::VARCHAR AS ever_bail,
 '有期徒刑' AS penalty_type, ((k % 9 + 1) * 12)::DOUBLE::VARCHAR AS term_months, '0' AS probation, ({HOMES_SQL})[k % 5 + 1] AS origin_text, '安徽省合肥市某路' AS residence_text FROM o)
UNPIVOT v ON COLUMNS(* EXCLUDE doc_id) INTO NAME field VALUE rule""")
def case_rule_labels(spark, d):
    """The rules' features of the first defendant in the words of the labels."""
    rows = origin_rows(spark, d, PLACES + CUSTODY).where("def_idx = 0")
    return labels.long_values(rows, labels.rule_values(rows), "rule")


MODELS_SQL = f"""{CASES_SQL}, {ORIGINS_SQL}, wanted AS (SELECT k, p, unnest(['nonlocal_origin', 'penalty_type', 'term_months']) AS field FROM o),
m AS (SELECT k AS doc_id, field, CASE field WHEN 'nonlocal_origin' THEN (p <> '安徽省')::INT::VARCHAR WHEN 'penalty_type' THEN '有期徒刑' ELSE ((k % 9 + 1) * 12)::DOUBLE::VARCHAR END AS rule,
 CASE WHEN k % 10 = 9 THEN NULL WHEN k % 10 = 8 THEN 'NA' WHEN field = 'term_months' AND k % 10 = 7 THEN '7.2' WHEN field = 'penalty_type' AND k % 10 = 6 THEN '拘役'
  WHEN field = 'nonlocal_origin' THEN (p <> '安徽省')::INT::VARCHAR WHEN field = 'penalty_type' THEN '有期徒刑' ELSE ((k % 9 + 1) * 12)::DOUBLE::VARCHAR END AS a,
 CASE WHEN k % 10 = 8 THEN 'NA' WHEN field = 'term_months' THEN ((k % 9 + 1) * 12 + 0.25)::VARCHAR WHEN field = 'nonlocal_origin' THEN (p <> '安徽省')::INT::VARCHAR ELSE '有期徒刑' END AS b FROM wanted)"""


def answers(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rule, a, b) of three fields: two models that answer like the rules but for some keys; model A has no reply where the key ends in 9."""
    rows = origin_rows(spark, d).where("def_idx = 0")
    rule = labels.long_values(rows, {k: v for k, v in labels.rule_values(rows).items() if k in ("nonlocal_origin", "penalty_type", "term_months")}, "rule")
    last, f = F.col("doc_id") % 10, F.col("field")
    a = rule.select("doc_id", "field", F.when(last == 8, "NA").when((f == "term_months") & (last == 7), "7.2").when((f == "penalty_type") & (last == 6), "拘役").otherwise(F.col("rule")).alias("a")).where(last != 9)
    b = rule.select("doc_id", "field", F.when(last == 8, "NA").when(f == "term_months", (F.col("rule").try_cast("double") + 0.25).cast("decimal(20,2)").cast("string")).otherwise(F.col("rule")).alias("b"))
    return rule, a, b


SAME_SQL = "(a = b OR (field = 'term_months' AND abs(TRY_CAST(a AS DOUBLE) - TRY_CAST(b AS DOUBLE)) < 0.5))"


@query(f"""WITH {MODELS_SQL} SELECT doc_id, field, a, b, CASE WHEN why = 'A=B' THEN a END AS filled, why AS filled_by FROM (
SELECT *, CASE WHEN a <> 'NA' AND b <> 'NA' AND {SAME_SQL} THEN 'A=B' WHEN doc_id % 10 = 9 THEN 'llm_missing' WHEN a = 'NA' AND b = 'NA' THEN 'both_NA' ELSE 'unresolved_llm' END AS why FROM m)""")
def label_fills(spark, d):
    rule, a, b = answers(spark, d)
    return labels.fills(rule.select("doc_id", "field"), a, b)


@query(f"""WITH {MODELS_SQL}, x AS (SELECT *, CASE WHEN a <> 'NA' AND b <> 'NA' AND {SAME_SQL} THEN 'A=B' WHEN doc_id % 10 = 9 THEN 'llm_missing' WHEN a = 'NA' AND b = 'NA' THEN 'both_NA' ELSE 'unresolved_llm' END AS why FROM m)
SELECT field, count(*) AS n, count(*) FILTER (why = 'A=B') AS filled, count(*) FILTER (why = 'both_NA') AS both_NA, count(*) FILTER (why = 'unresolved_llm') AS unresolved, count(*) FILTER (why = 'llm_missing') AS missing, round(avg((why = 'A=B')::INT), 9) AS fill_rate FROM x GROUP BY field""")
def label_fill_summary(spark, d):
    rule, a, b = answers(spark, d)
    return labels.fill_summary(labels.fills(rule.select("doc_id", "field"), a, b)).withColumn("fill_rate", F.round("fill_rate", 9))


ITEMS_SQL = f"""{MODELS_SQL}, items AS (SELECT doc_id, field, rule, a AS model, b, ('0x' || substr(md5('7-' || doc_id || '-' || field), 1, 1))::INT % 2 = 1 AS reversed, doc_id % 4 AS r FROM m WHERE a IS NOT NULL AND NOT (rule = a OR (field = 'term_months' AND abs(TRY_CAST(rule AS DOUBLE) - TRY_CAST(a AS DOUBLE)) < 0.5) IS TRUE)),
adj AS (SELECT *, CASE r WHEN 0 THEN 'failed' WHEN 1 THEN CASE WHEN reversed THEN 'model' ELSE 'rule' END WHEN 2 THEN CASE WHEN reversed THEN 'rule' ELSE 'model' END ELSE 'third' END AS side, CASE WHEN r > 0 THEN CASE WHEN r = 2 THEN '低' ELSE '高' END END AS conf, CASE WHEN r = 3 THEN '管制' END AS val FROM items)"""


def adjudication(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(adjudicated items, rule, a, b); replies are missing, 1, 2 or a third answer by the key."""
    from paneloom.operators.sampling import blind_order

    rule, a, b = answers(spark, d)
    items = labels.adjudication_items(rule, a.withColumnRenamed("a", "model"), blind_order(7, F.col("doc_id"), F.col("field")))
    r = F.col("doc_id") % 4
    one = lambda f: F.concat(F.lit(f'"{f}": {{"choice": "'), F.when(r == 3, "other").otherwise(r.cast("string")), F.lit('", "confidence": "'), F.when(r == 2, "低").otherwise("高"), F.lit('"'), F.when(r == 3, ', "value": "管制"').otherwise(""), F.lit("}"))
    fields = ("nonlocal_origin", "penalty_type", "term_months")
    replies = rule.select("doc_id").distinct().where(r != 0).select("doc_id", F.concat(F.lit("```json\n{"), one(fields[0]), F.lit(", "), one(fields[1]), F.lit(", "), one(fields[2]), F.lit("}\n```")).alias("raw"))
    return labels.adjudicated(items, replies), rule, a, b


@query(f"""WITH {ITEMS_SQL} SELECT doc_id, field, rule, model, reversed, side, conf AS confidence, val AS value FROM adj""")
def adjudicated_items(spark, d):
    return adjudication(spark, d)[0].select("doc_id", "field", "rule", "model", "reversed", "side", "confidence", "value")


@query(f"""WITH {ITEMS_SQL}, z AS (SELECT *, CASE side WHEN 'rule' THEN rule WHEN 'model' THEN model ELSE val END AS post FROM adj),
s AS (SELECT *, coalesce(post = b OR (field = 'term_months' AND abs(TRY_CAST(post AS DOUBLE) - TRY_CAST(b AS DOUBLE)) < 0.5), FALSE) AS same FROM z)
SELECT coalesce(field, 'ALL') AS field, count(*) AS n, round(avg((side = 'rule')::INT), 9) AS side_rule, round(avg((side = 'model')::INT), 9) AS side_model, round(avg((side = 'third')::INT), 9) AS side_third, round(avg((side = 'failed')::INT), 9) AS side_failed,
round(avg(coalesce(conf = '低', FALSE)::INT), 9) AS low_conf, round(avg(same::INT), 9) AS consistent FROM s GROUP BY ROLLUP (field)""")
def adjudication_summary(spark, d):
    rows, _, _, b = adjudication(spark, d)
    out = labels.adjudication_summary(rows.join(b.withColumnRenamed("b", "other"), ["doc_id", "field"], "left"))
    return out.select("field", "n", *[F.round(c, 9).alias(c) for c in ("side_rule", "side_model", "side_third", "side_failed", "low_conf", "consistent")])


@query(f"""WITH {ITEMS_SQL} SELECT doc_id, sha256('输入' || chr(10) || chr(10) || '【待复核字段】' || chr(10) || string_agg('- ' || field || '：答案1 = ' || CASE WHEN reversed THEN model ELSE rule END || '；答案2 = ' || CASE WHEN reversed THEN rule ELSE model END, chr(10) ORDER BY field)) AS input FROM items GROUP BY doc_id""")
def adjudication_inputs(spark, d):
    items, rule, _, _ = adjudication(spark, d)
    inputs = rule.select("doc_id").distinct().withColumn("input", F.lit("输入"))
    return labels.adjudication_inputs(items, inputs).select("doc_id", F.sha2("input", 256).alias("input"))


@query(f"""WITH {ITEMS_SQL}, t AS (SELECT m.doc_id, m.field, m.rule, m.a, m.b, adj.side, adj.val, adj.conf FROM m LEFT JOIN adj ON m.doc_id = adj.doc_id AND m.field = adj.field),
q AS (SELECT DISTINCT doc_id FROM (SELECT *, CASE side WHEN 'rule' THEN rule WHEN 'model' THEN a ELSE val END AS post FROM t WHERE side IS NOT NULL) WHERE (post IS DISTINCT FROM b OR conf = '低') AND doc_id % 3 <> 0),
f AS (SELECT doc_id, string_agg(DISTINCT field, ';' ORDER BY field) AS fields FROM (SELECT *, CASE side WHEN 'rule' THEN rule WHEN 'model' THEN a ELSE val END AS post FROM t WHERE side IS NOT NULL) WHERE (post IS DISTINCT FROM b OR conf = '低') AND doc_id % 3 <> 0 GROUP BY doc_id)
SELECT doc_id, fields FROM f ORDER BY md5('20240-' || doc_id), doc_id LIMIT 60""")
def label_disputes(spark, d):
    """The sixty doubtful documents that are drawn for a second look, outside the audit's own (a report of sixty is the feature)."""
    from paneloom.operators.sampling import draw

    adjudicated, rule, a, b = adjudication(spark, d)
    weights = rule.select("doc_id").distinct().withColumn("weight", F.lit(1.0))
    long = labels.label_table(rule, a, b, adjudicated, weights)
    return labels.disputes(long, rule.select("doc_id").distinct().where("doc_id % 3 = 0"), draw(20240, F.col("doc_id")), 60)


@query(f"""WITH {ITEMS_SQL} SELECT m.doc_id, m.field, m.rule, m.a, m.b, adj.side AS adj_side, adj.val AS adj_value, adj.conf AS adj_conf, m.doc_id % 5 AS stratum, CASE WHEN m.rule = 'NA' AND m.a = m.b AND m.a <> 'NA' THEN m.a ELSE coalesce(m.rule, 'NA') END AS value,
CASE WHEN m.rule = 'NA' AND m.a = m.b AND m.a <> 'NA' THEN 'llm_AB' ELSE 'rule' END AS source FROM m LEFT JOIN adj ON m.doc_id = adj.doc_id AND m.field = adj.field""")
def label_table(spark, d):
    adjudicated, rule, a, b = adjudication(spark, d)
    weights = rule.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 5).alias("stratum"))
    return labels.prefilled(labels.label_table(rule, a, b, adjudicated, weights))


NEEDS_SQL = """n AS (SELECT doc_id, lang, n_chars, doc_id % 6 = 0 AS origin, doc_id % 4 = 0 AND doc_id % 8 = 0 AS residence, doc_id % 3 = 0 AS penalty, doc_id % 10 = 0 AS no_defendant FROM documents)"""


def _needs(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.when(k % 6 == 0, F.when(k % 12 == 0, "unresolved").otherwise("ambiguous")).when(k % 6 == 1, "resolved").alias("origin_status"), F.when(k % 4 == 0, "x").alias("residence_raw"), F.when(k % 8 != 0, True).alias("local_residence"), F.when(k % 3 != 0, True).when(k % 9 == 0, False).alias("outcomes_ok"), F.when(k % 10 == 0, 0).otherwise(1).alias("n_defendants"))
    return labels.needs(rows)


@query(f"""WITH {NEEDS_SQL} SELECT doc_id, origin, residence, penalty, no_defendant FROM n WHERE origin OR residence OR penalty OR no_defendant""")
def fill_needs(spark, d):
    return _needs(spark, d)


@query(f"""WITH {NEEDS_SQL} SELECT DISTINCT doc_id, unnest(list_concat(CASE WHEN origin OR no_defendant THEN ['nonlocal_origin'] ELSE [] END, CASE WHEN residence OR no_defendant THEN ['residence_local'] ELSE [] END, CASE WHEN penalty OR no_defendant THEN ['penalty_type', 'term_months', 'probation'] ELSE [] END)) AS field FROM n""")
def fill_fields(spark, d):
    return labels.needed_fields(_needs(spark, d))


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 2 END AS migrant, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 12.5 END AS term FROM documents)
SELECT doc_id, coalesce(migrant, CASE WHEN doc_id % 6 = 0 THEN 1 END)::BIGINT AS migrant, coalesce(term, CASE WHEN doc_id % 8 = 0 THEN 6.0 END)::DOUBLE AS term,
CASE WHEN migrant IS NOT NULL THEN 'rule' WHEN doc_id % 6 = 0 THEN 'llm_AB' ELSE 'NA' END AS migrant_source, CASE WHEN term IS NOT NULL THEN 'rule' WHEN doc_id % 8 = 0 THEN 'llm_AB' ELSE 'NA' END AS term_source FROM b""")
def hybrid_panel(spark, d):
    """Gaps of two columns filled from a long table of fills, by a pivot that is aligned on the key."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id")
    base = docs.select("doc_id", F.when(k % 3 != 0, k % 2).alias("migrant"), F.when(k % 4 != 0, 12.5).alias("term"))
    filled = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("nonlocal_origin").alias("field"), F.when(k % 6 == 0, "1").alias("filled")), F.struct(F.lit("term_months").alias("field"), F.when(k % 8 == 0, "6.0").alias("filled")))).alias("f"))
    filled = filled.select("doc_id", "f.*").withColumn("filled_by", F.when(F.col("filled").isNotNull(), "A=B").otherwise("both_NA"))
    return labels.hybrid(base, filled, {"migrant": "nonlocal_origin", "term": "term_months"})


@query(f"""WITH {CASES_SQL} SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN '取保' ELSE '在押' END AS marked, length({HEAD_SQL}) > 0 AS any_text, 'x &lt;b&gt; &amp; <mark>盗窃</mark>罪' AS html FROM c""")
def case_marks(spark, d):
    """Highlighted excerpts, escaped for HTML."""
    rows = _cases(spark, d)
    state = F.regexp_extract(mark(F.col("text"), "现取保|现羁押"), "<mark>(现取保|现羁押)</mark>", 1)
    return rows.select("doc_id", labels.recoded(state, {"现取保": "取保", "现羁押": "在押"}).alias("marked"), (F.length("text") > 0).alias("any_text"), mark(F.lit("x <b> & 盗窃罪"), "盗窃").alias("html"))


@query(f"""WITH {CASES_SQL} SELECT k AS doc_id, k % 3 = 0 AS is_theft, k % 3 = 1 AS is_unclassified, k % 3 = 1 AS hint, TRUE AS has_verdict, '皖' AS abbr, '安徽省' AS province, k AS serial FROM c""")
def case_candidates(spark, d):
    """Candidates by the named charge and by the verdict of unclassified cases; the case number's parts."""
    rows = judgment_texts(spark, d)
    charge = F.when(F.col("doc_id") % 3 == 0, "盗窃罪").when(F.col("doc_id") % 3 == 1, "未分类").otherwise(F.lit(None))
    found = casetext.theft_candidate(charge, F.col("judgment"))
    number = F.regexp_extract("judgment", "（2018）[^号]*号", 0)
    abbr, _, _, province = numerals.case_parts(number)
    return rows.select("doc_id", *[c.alias(n) for n, c in found.items()], abbr.alias("abbr"), province.alias("province"), numerals.case_serial(number).alias("serial"))
