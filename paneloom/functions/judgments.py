"""Segments, charges, penalties, amounts and flags of judgments, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paneloom.functions.numerals import CN, NUM, months, number
from paneloom.functions.text import has_positive, let, sentences

SEGMENTS = ("header", "charge", "facts", "reasoning", "verdict")

# fixed values: patterns of the markers
PROCEDURAL = "(?:人民检察院|检察院|公诉机关|检察分院)(?:于[0-9]{4}年[^。，]{0,12}日)?(?:以|依)[^。]{0,80}?(?:起诉书|起诉决定书|诉字|刑诉)"
CHARGE = "(?:公诉机关|人民检察院|检察院|检察分院|公诉人)(?:当庭)?(?:起诉)?指控(?:情况)?(?:称|认为)?[：:，,\\s]|起诉书(?:中)?指控[：:]|起诉书指控(?=[，,]?\\s*(?:[0-9]{4}年|[一二三四五六七八九十]+、|同年|自|被告人[^。，]{1,10}(?:于|在|伙同|先后|多次|窜至|趁)))|公诉机关指控情况"
FACTS = "(?:经|本院经?)(?:本院|法庭|依法|过)?(?:公开)?(?:开庭)?(?:审理|庭审|审查)[，,]?(?:本院)?(?:查明|认定)|(?<!另)(?:本院)?审理查明|本院查明(?:事实)?|经庭审(?:查明|认定)|法庭审理查明"
REASONING = "本院认为|本庭认为|判决理由|经本院审理，本案事实清楚"
VERDICT = "判决如下|判决结果|判处如下|判决[：:]|判�{1,3}如下|判决如�{1,3}|�{1,3}决如下"
VERDICT_ELSE = "被告(?:人|单位)?[^，。；]{1,12}?犯[^，。；]{1,20}?罪[，,](?:判处|免予|免除|单处)"


def position(text: Column, pattern: str, start: Column) -> Column:
    """0-based place of the first match from `start` on, or null."""
    at = F.regexp_instr(F.substring(text, start + 1, F.length(text)), F.lit(pattern))
    return let(at, lambda x: F.when(x > 0, x - 1 + start))


def spans(text: Column) -> Column:
    """Struct of (start, end) of each segment, null where it isn't found.

    Each marker is sought after the start of the one before; the header ends before the sentence that
    names the indictment, or at the first segment.
    """
    zero = F.lit(0)
    span = lambda s, e: F.when(e > s, F.struct(s.cast("int").alias("start"), e.cast("int").alias("end")))

    def with_charge(m):
        after = F.coalesce(m["charge"], zero)
        return let(F.struct(m["charge"].alias("charge"), after.alias("after"), position(text, FACTS, after).alias("facts")), with_facts)

    def with_facts(m):
        why = F.coalesce(position(text, REASONING, F.coalesce(F.greatest(m["charge"], m["facts"]), zero)), position(text, REASONING, m["after"]))
        return let(F.struct(m["charge"].alias("charge"), m["after"].alias("after"), m["facts"].alias("facts"), why.alias("reasoning")), with_reasoning)

    def with_reasoning(m):
        begin = F.coalesce(m["reasoning"], m["after"])
        rest = F.substring(text, begin + 1, F.length(text))
        found = F.coalesce(position(text, VERDICT, begin) + F.length(F.regexp_substr(rest, F.lit(VERDICT))), position(text, VERDICT_ELSE, begin))
        facts = F.when(m["reasoning"].isNull() | (m["facts"] <= m["reasoning"]), m["facts"])
        return let(F.struct(m["charge"].alias("charge"), facts.alias("facts"), m["reasoning"].alias("reasoning"), found.alias("verdict"), position(text, PROCEDURAL, zero).alias("indicted")), with_header)

    def with_header(m):
        head = F.substring(text, zero + 1, m["indicted"])
        # up to the last stop, from the start: a search for what follows it would run to the end from every place
        back = F.length(F.regexp_extract(head, "(?s)^.*[。；;]", 0))
        begins = F.when((back > 0) & (m["indicted"] - back < 40), back).otherwise(m["indicted"])
        return let(F.struct(*[m[k].alias(k) for k in ("charge", "facts", "reasoning", "verdict")], F.least(begins, m["charge"], m["facts"], m["reasoning"], m["verdict"]).alias("ends")), placed)

    def placed(m):
        n = F.length(text)
        header = F.when(F.substring(text, zero + 1, m["ends"]).contains("被告"), span(zero, m["ends"]))
        return F.struct(
            header.alias("header"),
            span(m["charge"], F.coalesce(m["facts"], m["reasoning"], m["verdict"], n)).alias("charge"),
            span(m["facts"], F.coalesce(m["reasoning"], m["verdict"], n)).alias("facts"),
            span(m["reasoning"], F.coalesce(m["verdict"], n)).alias("reasoning"),
            span(m["verdict"], n).alias("verdict"),
        )

    return let(F.struct(position(text, CHARGE, zero).alias("charge")), with_charge)


def segment(text: Column, span: Column) -> Column:
    return F.when(span.isNotNull(), F.substring(text, span["start"] + 1, span["end"] - span["start"]))


# fixed values: what a charge doesn't begin with
BAD_CHARGE = "^(?:罪|犯|被告|该|其|上述|本|前|所|又|数|新)"


def charges(chunk: Column) -> Column:
    """Distinct charges in order: those after 犯, then those that continue a list."""
    body = "([^罪，,。；;：:、（(0-9]{1,15}?罪)"
    found = F.concat(F.regexp_extract_all(chunk, F.lit(f"犯{body}"), F.lit(1)), F.regexp_extract_all(chunk, F.lit(f"罪[、和及]{body}"), F.lit(1)))
    return F.array_distinct(F.filter(found, lambda c: ~c.rlike(BAD_CHARGE)))


def penalty(chunk: Column) -> Column:
    """Struct of penalty_type, term_months, probation, probation_months, fine_yuan.

    Parentheses go; the part after the last 决定执行 counts, else that from the first 判处 on.
    """
    # fixed values: patterns of penalties and fines
    main = f"(死刑|无期徒刑|有期徒刑|拘役|管制)([{CN}0-9年个月零日天]*)"
    fine = f"罚金(?:人民币)?({NUM})(?:余)?元"
    some = lambda x: let(x, lambda v: F.when(v != "", v))

    def part(c):
        at = F.locate("判处", c)
        sub = F.when(c.contains("决定执行"), F.concat(F.lit("决定执行"), F.substring_index(c, "决定执行", -1))).when(at > 0, F.substring(c, at, F.length(c))).otherwise(c)
        return let(F.struct(c.alias("all"), sub.alias("sub")), lambda p: let(F.struct(p["all"].alias("all"), p["sub"].alias("sub"), F.regexp_extract(p["sub"], main, 0).alias("hit")), matched))

    def matched(p):
        # a match of main stands first where its text does
        sub, hit = p["sub"], p["hit"]
        rest = F.when(hit != "", F.substring(sub, F.position(hit, sub) + F.length(hit), F.length(sub)))
        paid = F.coalesce(some(F.regexp_extract(sub, fine, 1)), some(F.regexp_extract(p["all"], fine, 1)))
        return let(F.struct(sub.alias("sub"), some(F.regexp_extract(hit, main, 1)).alias("kind"), F.regexp_extract(hit, main, 2).alias("term"), rest.alias("rest"), some(F.regexp_extract(rest, f"缓刑([{CN}0-9年个月零日天]+)", 1)).alias("on"), paid.alias("paid")), valued)

    def valued(p):
        kind, sub = p["kind"], p["sub"]
        name = F.when((kind == "死刑") & F.substring(p["rest"], 1, 6).contains("缓期"), "死缓").when(kind.isNotNull(), kind).when(sub.rlike("免予刑事处罚|免除刑事处罚|免于刑事处罚"), "免予刑事处罚").when(sub.contains("罚金"), "单处罚金")
        return F.struct(
            name.alias("penalty_type"),
            F.when(kind.isin("有期徒刑", "拘役", "管制"), months(p["term"])).alias("term_months"),
            F.coalesce(kind.isNotNull() & p["on"].isNotNull(), F.lit(False)).alias("probation"),
            F.when(kind.isNotNull(), months(p["on"])).alias("probation_months"),
            number(p["paid"]).alias("fine_yuan"),
        )

    return let(F.regexp_replace(chunk, "[（(][^（）()]*[）)]", ""), part)


# fixed values: patterns of amounts
AMOUNT_NOT = "退赔|退赃|退还|退回|赔偿|罚金|追回|追缴|发还|返还|获利|销赃|得款|获款|卖得|售得|出售|变卖|典当|收购|卖给|抵押|谅解|担保|保证金|违法所得|挽回|赃款已|损失已|补偿|医疗|修复|维修|购买|购得|价格卖|以[^，。]{0,10}价格|退缴|缴纳|借款|工资|欠款|报酬|充值"
AMOUNT_TOTAL = f"(?:共计|合计|总计|累计|总价值|总额|总金额|共)(?:价值|金额|数额)?(?:为|达|计)?(?:人民币)?({NUM})(?:余|多)?元"
AMOUNT_ITEMS = (
    f"(?:价值|数额|金额|价格(?:为|认定为|鉴定为)|认定价格为|估价为|鉴定价值为)(?:共计|合计)?(?:为|达|计|约)?(?:人民币)?({NUM})(?:余|多)?元",
    f"(?:盗窃|窃取|窃得|盗走|盗得|扒窃|偷走|偷得|偷取|抢劫|抢得|劫得|劫取|抢走|抢夺|转走|盗刷)[^，。；]{{0,20}}?(?:现金|人民币|钱款|款)(?:人民币)?(?:\\(下同\\)|（下同）)?({NUM})(?:余|多)?元",
    f"(?:窃得|盗得|偷得|抢得|劫得|骗得|扒得)[^，。；价值]{{0,12}}?(?<![0-9.])({NUM})(?:余|多)?元(?!的)",
)
CLAUSES = "[。；;：:（）()]|(?<![0-9])[，,]|[，,](?![0-9]{3})"


def _amounts(segment_: Column, patterns: tuple[str, ...]) -> Column:
    clauses = F.filter(F.split(segment_, CLAUSES), lambda x: ~x.rlike(AMOUNT_NOT))
    found = F.flatten(F.transform(clauses, lambda x: F.concat(*[F.regexp_extract_all(x, F.lit(p), F.lit(1)) for p in patterns])))
    return F.filter(F.transform(found, lambda t: number(t)), lambda v: v > 0)


def _first_amount(name: str):
    def one(m):
        totals, items = m["totals"], m["items"]
        v = F.when(F.size(totals) > 0, F.array_max(totals)).when(F.size(items) > 0, F.aggregate(items, F.lit(0.0), lambda a, x: a + x))
        lone = name if name == "reasoning" else f"{name}_sum"
        s = F.when(F.size(totals) > 0, f"{name}_total").when(F.size(items) > 1, f"{name}_sum").when(F.size(items) == 1, lone)
        return F.struct(v.alias("value"), s.alias("source"))

    return one


def amount(reasoning: Column, facts: Column, charge: Column) -> Column:
    """Struct of value and source: of the first segment that names one, its greatest total, or the sum of its distinct items."""
    found = []
    for name, seg in (("reasoning", reasoning), ("facts", facts), ("charge", charge)):
        both = F.struct(_amounts(seg, (AMOUNT_TOTAL,)).alias("totals"), F.array_distinct(_amounts(seg, AMOUNT_ITEMS)).alias("items"))

        found.append(let(both, _first_amount(name)))
    named = F.filter(F.array(*found), lambda x: x["value"].isNotNull())
    return F.get(named, 0)


# fixed values: the statement of a procedure
PROCEDURE = "(?:(?<!不)(?<!不宜)(?<!未)(?<!不能)适用|转为(?:适用)?|转换为|变更为|改为|适用程序[：:]?)(?:刑事案件)?(速裁|简易|普通)程序"


def procedure(text: Column) -> Column:
    """The last explicit statement; else 速裁 if the case number, among the first 200 characters, is so marked."""
    found = F.regexp_extract_all(text, F.lit(PROCEDURE), F.lit(1))
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1))).when(F.substring(text, 1, 200).rlike("[（(]速[）)]|刑速"), "速裁")


def capped(value: Column, most: float = 1e7) -> tuple[Column, Column]:
    """(outlier, value without outliers)."""
    over = F.coalesce(value > most, F.lit(False))
    return over, F.when(~over, value)


def complete(penalty_type: Column, term: Column) -> Column:
    return penalty_type.isNotNull() & (~penalty_type.isin("有期徒刑", "拘役") | term.isNotNull())


# fixed values: cues of the flags and their denials
SURRENDER = ("自首", "不(?:构成|能认定|认定|属于|成立|具有|系|予认定|符合|应认定|能成立)[^，。]{0,6}自首|自首[^，。]{0,8}不(?:能|予|成立|构成|符合)|不具有自首|非自首")
FORGIVEN = ("谅解", "未(?:能)?(?:取得|获得|得到)[^，。]{0,6}谅解|没有(?:取得|获得|得到)[^，。]{0,6}谅解|不予谅解|不谅解")
RESTITUTION = "退赃|退赔|退还[^，。]{0,6}(?:赃|款|财物|被害人)|赔偿[^，。]{0,8}损失|已赔偿|积极赔偿"
DENIAL = "社区矫正|不宜宣告缓刑|不宜适用缓刑|不适用缓刑|不予适用缓刑|不宜判处缓刑|不予宣告缓刑|无固定住所|不具备[^。；]{0,20}条件"


def flags(text: Column, seg: dict[str, Column]) -> dict[str, Column]:
    """Document flags; those of the reasoning fall back to the whole text, restitution doesn't."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    why = F.coalesce(F.nullif(seg["reasoning"], F.lit("")), text)
    body = F.concat(empty(F.coalesce(F.nullif(seg["facts"], F.lit("")), seg["charge"])), empty(seg["reasoning"]))
    plea, signed = text.contains("认罪认罚"), text.contains("具结")
    # fixed values: cues of the other flags
    return {
        "plea_formal": plea,
        "jiejie": signed,
        "plea_leniency": text.rlike("认罪认罚|具结书"),
        "duty_lawyer": text.contains("值班律师"),
        "spec_burglary": body.rlike("入户|入室盗窃|入室行窃"),
        "spec_pickpocket": body.contains("扒窃"),
        "spec_multiple": body.contains("多次"),
        "spec_weapon": body.rlike("携带凶器|持刀|持械|携带刀具|持凶器"),
        "attempted": body.contains("未遂"),
        "surrender": has_positive(why, *SURRENDER),
        "confession": why.rlike("坦白|如实供述"),
        "restitution": empty(seg["reasoning"]).rlike(RESTITUTION),
        "forgiveness": has_positive(why, *FORGIVEN),
        "has_fffd": text.contains("�"),
        "probation_denial_text": F.nullif(F.array_join(F.filter(sentences(empty(seg["reasoning"])), lambda s: s.rlike(DENIAL)), " || "), F.lit("")),
    }
