"""Model replies and labels: validation, cost, agreement, adjudication and fill-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from paneloom.functions import places
from paneloom.sources.tables import running_total

REPLY = T.MapType(T.StringType(), T.StructType([T.StructField("value", T.StringType()), T.StructField("evidence", T.StringType())]))

# fixed values: words for a missing answer
NOT_GIVEN = ("", "na", "n/a", "null", "none", "unknown", "未知", "不详", "无", "未提及")
EVIDENCE_CHARS = 40


def reply_json(raw: Column) -> Column:
    """The JSON text of a reply: fences are stripped, and else the span from the first to the last brace counts."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, "^\\s*```[A-Za-z]*\\s*", ""), "\\s*```\\s*$", ""))
    return F.when(bare.startswith("{") & bare.endswith("}"), bare).otherwise(F.nullif(F.regexp_extract(bare, "(?s)[{].*[}]", 0), F.lit("")))


def parsed(raw: Column) -> Column:
    return F.from_json(reply_json(raw), REPLY)


def validate(replies: DataFrame, spec: DataFrame, raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """key, field, value, evidence, error for every field of spec (field, kind, allowed).

    kind: text, number or choice. Missing fields give missing:, unfit values invalid: and null; replies
    that aren't JSON json_error in every field. Words for a missing answer become NA.
    """
    fields = F.collect_list(F.struct("field", "kind", "allowed")).alias("_spec")  # a row for each field of the form, as one array
    rows = replies.withColumn("_map", parsed(F.col(raw))).crossJoin(spec.agg(fields)).withColumn("_f", F.explode("_spec")).select("*", "_f.field", "_f.kind", "_f.allowed").drop("_f", "_spec")
    got = F.try_element_at("_map", F.col("field"))
    text = F.trim(got["value"])
    given = F.when(F.lower(text).isin(*NOT_GIVEN), "NA").otherwise(text)
    number = F.regexp_replace(given, "[,，\\s]|元|个月|月$", "").try_cast("double")
    value = F.when(given == "NA", "NA").when(F.col("kind") == "number", number.cast("string")).when(F.col("kind") == "choice", F.when(F.array_contains("allowed", given), given)).otherwise(given)
    error = F.when(F.col("_map").isNull(), "json_error").when(got.isNull() | text.isNull(), F.concat(F.lit("missing:"), F.col("field"))).when(value.isNull(), F.concat(F.lit("invalid:"), F.col("field")))
    return rows.select(key, "field", value.alias("value"), F.substring(got["evidence"], 1, EVIDENCE_CHARS).alias("evidence"), error.alias("error"))


def reply_status(errors: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, status: json_error, invalid_value or ok."""
    return errors.groupBy(key).agg(F.when(F.max((F.col("error") == "json_error").cast("int")) == 1, "json_error").when(F.count("error") > 0, "invalid_value").otherwise("ok").alias("status"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def is_peak(ts: Column) -> Column:
    """Monday to Friday, 01-04 and 06-10 UTC."""
    h = F.hour(ts)
    return F.weekday(ts).between(0, 4) & (((h >= 1) & (h < 4)) | ((h >= 6) & (h < 10)))


def cost(hit: Column, miss: Column, out: Column, prices: tuple[float, float, float], peak: Column) -> Column:
    """Prices a million tokens; peak hours cost double."""
    return (hit * prices[0] + miss * prices[1] + out * prices[2]) / 1e6 * F.when(peak, 2.0).otherwise(1.0)


def ledger(calls: DataFrame, order: list[str], budget: float) -> DataFrame:
    """spent: what all calls up to this one cost; over: whether the budget was used up before it."""
    rows = running_total(calls, order, "cost", "spent")
    return rows.withColumn("over", F.col("spent") - F.col("cost") >= budget)


def agrees(field: Column, a: Column, b: Column) -> Column:
    """Equal strings; terms in months within half a month."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when((field == "term_months") & x.isNotNull() & y.isNotNull(), F.abs(x - y) < 0.5).otherwise(a == b)


def kappa(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, n, agree, kappa from the contingency table; null where chance agreement is 1 or there are under two categories."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(*by) if by else W.partitionBy()
    cells = cells.withColumn("total", F.sum("n").over(whole))
    rows = cells.groupBy(*by, F.col("a").alias("c")).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*by, F.col("b").alias("c")).agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, [*by, "c"]).groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("_pe")) if by else rows.join(cols, "c").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("_pe"))
    kinds = cells.select(*by, F.explode(F.array("a", "b")).alias("c")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
    same = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    out = same.join(chance, by, "left").join(kinds, by) if by else same.crossJoin(chance).crossJoin(kinds)  # one row each
    po, pe = F.col("same") / F.col("n"), F.coalesce("_pe", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return out.select(*by, "n", po.alias("agree"), F.when((F.col("_k") >= 2) & (pe < 1), (po - pe) / (1 - pe)).alias("kappa"))


def pattern(rule: Column, a: Column, b: Column) -> Column:
    """Which of three labels agree."""
    return F.when((rule == a) & (a == b), "all").when(rule == a, "rule_a").when(rule == b, "rule_b").when(a == b, "a_b").otherwise("differ")


def adjudicated_side(choice: Column, reversed_: Column) -> Column:
    """1 and 2 are the shown answers, rule and model unless reversed; other is a third answer."""
    first, second = F.when(reversed_, "model").otherwise("rule"), F.when(reversed_, "rule").otherwise("model")
    return F.when(choice == "1", first).when(choice == "2", second).when(choice == "other", "third").otherwise("failed")


def fill(rule: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """(value, source): the rule's value, else the models' where they agree on one."""
    agreed = F.when((a == b) & (a != "NA"), a)
    source = F.when(rule.isNotNull(), "rule").when(agreed.isNotNull(), "models").when(a.isNull() | b.isNull(), "llm_missing").when((a == "NA") & (b == "NA"), "both_NA").otherwise("unresolved_llm")
    return F.coalesce(rule, agreed), source


# ---- from rules and replies to labels


def recoded(c: Column, table: dict, default: Column | str | None = None) -> Column:
    """c by a table; the default for values that it hasn't, and for null."""
    otherwise = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), otherwise)


# fixed values: states and penalties in the labels' words
STATES = {"在押": "在押", "取保": "取保", "rsl": "监视居住"}
PENALTIES = ("有期徒刑", "拘役", "管制", "单处罚金", "免予刑事处罚")
OTHER_PENALTY = "其他"
WITH_TERM = ("有期徒刑", "拘役")
LOW = "低"

#: Fields that a gap calls for.
GAPS = {
    "origin": ("nonlocal_origin",),
    "residence": ("residence_local",),
    "penalty": ("penalty_type", "term_months", "probation"),
    "no_defendant": ("nonlocal_origin", "residence_local", "penalty_type", "term_months", "probation"),
}


def yes_no(c: Column) -> Column:
    return F.when(c.isNull(), "NA").when(c, "1").otherwise("0")


def rule_values(rows: DataFrame) -> dict[str, Column]:
    """The rules' features in the words of the labels, NA where they have none."""
    c = F.col
    penalty = F.when(c("penalty_type").isNull(), "NA").when(c("penalty_type").isin(*PENALTIES), c("penalty_type")).otherwise(OTHER_PENALTY)
    return {
        "nonlocal_origin": yes_no(c("migrant_city_nores")),
        "residence_local": yes_no(c("local_residence")),
        "status_at_judgment": recoded(c("pretrial_status_at_judgment"), STATES, "NA"),
        "ever_bail": yes_no(c("bail")),
        "penalty_type": penalty,
        "term_months": F.coalesce(c("term_months").cast("double").cast("string"), F.lit("NA")),
        "probation": yes_no(c("probation")),
        "origin_text": F.coalesce("hukou_raw", "birthplace_raw", "native_raw", F.lit("NA")),
        "residence_text": F.coalesce(c("residence_raw"), F.lit("NA")),
    }


def long_values(rows: DataFrame, values: dict[str, Column], name: str, key: str = "doc_id") -> DataFrame:
    """key, field, name: one row a field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), v.cast("string").alias(name)) for f, v in values.items()])
    return rows.select(key, F.explode(pairs).alias("_v")).select(key, "_v.*")


def placed_answers(answers: DataFrame, courts: DataFrame, gazetteer: DataFrame, key: str = "doc_id") -> DataFrame:
    """The labels 1, 0 or NA of answered places: key, field (origin_text or residence_text), value -> key, field, label.

    courts: key, court_province, court_prefecture. An origin is labelled by whether it lies elsewhere, a
    residence by whether it lies in the court's prefecture.
    """
    rows = answers.join(courts, key).withColumn("raw", F.when(F.col("value") != "NA", F.col("value")))
    found = places.resolve(rows, gazetteer)
    moved = places.migrant(F.col("province"), F.col("prefecture"), F.col("court_province"), F.col("court_prefecture"))
    home = F.col("field") == "residence_text"
    label = F.when(home, places.origin_label(F.col("raw"), moved, True)).otherwise(places.origin_label(F.col("raw"), moved))
    return found.select(key, "field", label.alias("label"))


def adjudication_items(rule: DataFrame, model: DataFrame, reversed_: Column, key: str = "doc_id") -> DataFrame:
    """key, field, rule, model, reversed: what rule and model disagree on; models that gave nothing don't.

    rule: key, field, rule; model: key, field, model. reversed_ says from key and field whether the
    model's answer is shown first.
    """
    both = rule.join(model, [key, "field"]).where(F.col("model").isNotNull() & ~F.coalesce(agrees(F.col("field"), F.col("rule"), F.col("model")), F.lit(False)))
    return both.withColumn("reversed", reversed_)


def adjudication_inputs(items: DataFrame, inputs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, input: the document's input and a line for each doubtful field, in the order of the fields; a document has a dozen at most."""
    first, second = F.when(F.col("reversed"), F.col("model")).otherwise(F.col("rule")), F.when(F.col("reversed"), F.col("rule")).otherwise(F.col("model"))
    line = F.concat(F.lit("- "), F.col("field"), F.lit("：答案1 = "), F.coalesce(first, F.lit("NA")), F.lit("；答案2 = "), F.coalesce(second, F.lit("NA")))
    lines = items.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return inputs.join(lines, key).select(key, F.concat("input", F.lit("\n\n【待复核字段】\n"), "lines").alias("input"))


CHOICES = T.MapType(T.StringType(), T.StructType([T.StructField(n, T.StringType()) for n in ("choice", "value", "confidence", "evidence")]))


def adjudicated(items: DataFrame, replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """items with choice, value, confidence and side; replies: key, raw. Missing and unreadable replies have side failed."""
    parsed_ = replies.select(key, F.from_json(reply_json(F.col("raw")), CHOICES).alias("_map"))
    got = F.try_element_at("_map", F.col("field"))
    rows = items.join(parsed_, key, "left")
    choice = F.trim(got["choice"])
    return rows.select(*items.columns, choice.alias("choice"), got["value"].alias("value"), got["confidence"].alias("confidence"), adjudicated_side(choice, F.col("reversed")).alias("side"))


def settled(side: Column, rule: Column, model: Column, value: Column) -> Column:
    """What an adjudication settles on."""
    return F.when(side == "rule", rule).when(side == "model", model).otherwise(value)


def adjudication_summary(rows: DataFrame) -> DataFrame:
    """field, n, shares of sides and of low confidence, and how often the outcome agrees with the other model's own answer; a row ALL.

    rows: field, rule, model, value, side, confidence, other (the adjudicating model's independent answer).
    """
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    outcome = settled(F.col("side"), F.col("rule"), F.col("model"), F.col("value"))
    aggs = [F.count(F.lit(1)).alias("n"), *[share(F.col("side") == s).alias(f"side_{s}") for s in ("rule", "model", "third", "failed")], share(F.col("confidence") == LOW).alias("low_conf"), share(agrees(F.col("field"), outcome, F.col("other"))).alias("consistent")]
    out = rows.rollup("field").agg(F.grouping_id().alias("_g"), *aggs)
    return out.withColumn("field", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("field"))).drop("_g")


def needs(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and a flag for each gap, of the documents with any: origin_status, residence_raw, local_residence, outcomes_ok, n_defendants."""
    gaps = {
        "origin": F.coalesce(F.col("origin_status").isin("unresolved", "ambiguous"), F.lit(False)),
        "residence": F.col("residence_raw").isNotNull() & F.col("local_residence").isNull(),
        "penalty": ~F.coalesce("outcomes_ok", F.lit(False)),
        "no_defendant": F.coalesce(F.col("n_defendants") == 0, F.lit(False)),
    }
    out = rows.select(key, *[c.alias(n) for n, c in gaps.items()])
    return out.where(F.col("origin") | F.col("residence") | F.col("penalty") | F.col("no_defendant"))


def needed_fields(need: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, field: the fields that a document's gaps call for, each once."""
    nothing = F.array().cast("array<string>")
    fields = F.concat(*[F.when(F.col(gap), F.array(*map(F.lit, fs))).otherwise(nothing) for gap, fs in GAPS.items()])
    return need.select(key, F.explode(F.array_distinct(fields)).alias("field"))


def label_table(rule: DataFrame, a: DataFrame, b: DataFrame, adjudication: DataFrame, weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document and field of `rule`: rule, a, b, what the adjudication chose, and the stratum and weight of the document."""
    chosen = adjudication.select(key, "field", F.col("side").alias("adj_side"), F.col("value").alias("adj_value"), F.col("confidence").alias("adj_conf"))
    return rule.join(a, [key, "field"], "left").join(b, [key, "field"], "left").join(chosen, [key, "field"], "left").join(weights, key, "left")


def fills(wanted: DataFrame, a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """wanted (key, field) with a, b, filled and filled_by: A=B, llm_missing, both_NA or unresolved_llm.

    a, b: key, field, a or b, of the documents that a model answered at all; a field that an answered
    document lacks is null there.
    """
    answered = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = wanted.join(a, [key, "field"], "left").join(b, [key, "field"], "left").join(answered(a, "_a"), key, "left").join(answered(b, "_b"), key, "left")
    none = lambda c: F.coalesce(F.col(c), F.lit("NA")) == "NA"
    ok = ~none("a") & ~none("b") & F.coalesce(agrees(F.col("field"), F.col("a"), F.col("b")), F.lit(False))
    by = F.when(ok, "A=B").when(F.col("_a").isNull() | F.col("_b").isNull(), "llm_missing").when(none("a") & none("b"), "both_NA").otherwise("unresolved_llm")
    return rows.select(*wanted.columns, "a", "b", F.when(ok, F.col("a")).alias("filled"), by.alias("filled_by"))


def fill_summary(filled: DataFrame) -> DataFrame:
    """field, n, filled, both_NA, unresolved, missing, fill_rate."""
    n = lambda reason: F.count_if(F.col("filled_by") == reason)
    return filled.groupBy("field").agg(F.count(F.lit(1)).alias("n"), n("A=B").alias("filled"), n("both_NA").alias("both_NA"), n("unresolved_llm").alias("unresolved"), n("llm_missing").alias("missing"), (n("A=B") / F.count(F.lit(1))).alias("fill_rate"))


def hybrid(base: DataFrame, filled: DataFrame, fields: dict[str, str], key: str = "doc_id") -> DataFrame:
    """base with the gaps of its columns filled and a <column>_source (rule, llm_AB, NA) each; fields: column -> field of `filled`.

    Penalties are filled together, and only where the rule's outcome is incomplete and the fill is complete.
    """
    wide = filled.where("filled_by = 'A=B'").groupBy(F.col(key).alias("_key")).pivot("field", sorted({*fields.values(), *GAPS["penalty"]})).agg(F.first("filled"))
    rows = base.join(wide, F.col(key) == F.col("_key"), "left")
    for column, f in fields.items():
        value = F.col(f"`{f}`").try_cast(base.schema[column].dataType)
        source = F.when(F.col(column).isNotNull(), "rule").when(value.isNotNull(), "llm_AB").otherwise("NA")
        rows = rows.withColumn(f"{column}_source", source).withColumn(column, F.coalesce(F.col(column), value))
    return rows.select(*base.columns, *[f"{c}_source" for c in fields])


def complete_fill(penalty: Column, term: Column) -> Column:
    """Whether a filled sentence can stand in for an incomplete one."""
    return penalty.isNotNull() & (~penalty.isin(*WITH_TERM) | term.isNotNull())


def prefilled(labels: DataFrame) -> DataFrame:
    """labels (rule, a, b) with value and source: the rule's, else the models' where they agree, else NA."""
    none = F.coalesce(F.col("rule"), F.lit("NA")) == "NA"
    agreed = F.when(none & (F.col("a") == F.col("b")) & (F.col("a") != "NA"), F.col("a"))
    return labels.withColumn("value", F.coalesce(agreed, "rule", F.lit("NA"))).withColumn("source", F.when(agreed.isNotNull(), "llm_AB").otherwise("rule"))


def disputes(labels: DataFrame, audited: DataFrame, draw: Column, n: int, key: str = "doc_id") -> DataFrame:
    """key, fields: n documents, in drawn order, outside the audit, of whose adjudicated fields some are doubtful.

    A field is if the outcome isn't the other model's own answer, or if its confidence was low.
    """
    outcome = settled(F.col("adj_side"), F.col("rule"), F.col("a"), F.col("adj_value"))
    doubtful = labels.where(F.col("adj_side").isNotNull() & (~outcome.eqNullSafe(F.col("b")) | F.coalesce(F.col("adj_conf") == LOW, F.lit(False))))
    fields = doubtful.join(audited.select(key), key, "left_anti").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("field")), ";").alias("fields"))
    return fields.orderBy(draw, key).limit(n)


def projected_cost(calls: DataFrame, tasks: list[tuple[str, int, float, float]], prices: tuple[float, float, float]) -> DataFrame:
    """item, docs, usd of planned runs and their TOTAL, from the mean tokens of the calls made so far.

    calls: hit, miss, out (tokens); tasks: (item, documents, share of the input, share of the output).
    """
    mean = calls.agg(*[F.avg(c).alias(c) for c in ("hit", "miss", "out")])
    rows = calls.sparkSession.createDataFrame(tasks, "item string, docs long, in_share double, out_share double").crossJoin(mean)  # one row
    per = (F.col("hit") * prices[0] + F.col("miss") * F.col("in_share") * prices[1] + F.col("out") * F.col("out_share") * prices[2]) / 1e6
    priced = rows.select("item", "docs", (F.col("docs") * per).alias("usd"))
    total = priced.rollup("item").agg(F.grouping_id().alias("_g"), F.sum("docs").alias("docs"), F.sum("usd").alias("usd"))
    return total.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("item")).alias("item"), F.when(F.col("_g") == 0, F.col("docs")).alias("docs"), "usd")


# fixed values: the fields of the form, their kind and the answers allowed
FORM = (
    ("origin_text", "text", None),
    ("residence_text", "text", None),
    ("nonlocal_origin", "choice", ("1", "0", "NA")),
    ("residence_local", "choice", ("1", "0", "NA")),
    ("status_at_judgment", "choice", ("在押", "取保", "监视居住", "NA")),
    ("ever_bail", "choice", ("1", "0", "NA")),
    ("plea_formal", "choice", ("1", "0")),
    ("jiejie", "choice", ("1", "0")),
    ("procedure", "choice", ("速裁", "简易", "普通", "NA")),
    ("counsel_any", "choice", ("1", "0")),
    ("penalty_type", "choice", ("有期徒刑", "拘役", "管制", "单处罚金", "免予刑事处罚", "其他")),
    ("term_months", "number", None),
    ("probation", "choice", ("1", "0", "NA")),
)


def codebook(spark: SparkSession) -> DataFrame:
    """field, kind, allowed: the form as the table that validate() takes."""
    return spark.createDataFrame([(f, k, list(a) if a else None) for f, k, a in FORM], "field string, kind string, allowed array<string>")


def latest_prompts(prompts: DataFrame) -> DataFrame:
    """prompt, version, name, text: of each prompt the latest version; names end in _v and a number."""
    rows = prompts.where(F.col("name").rlike("_v[0-9]+$")).withColumn("prompt", F.regexp_replace("name", "_v[0-9]+$", "")).withColumn("version", F.regexp_extract("name", "_v([0-9]+)$", 1).cast("int"))
    last = rows.groupBy("prompt").agg(F.max_by(F.struct("version", "name", "text"), "version").alias("_p"))
    return last.select("prompt", "_p.version", "_p.name", "_p.text")
