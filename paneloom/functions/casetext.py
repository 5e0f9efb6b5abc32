"""What is read out of a case's text for people and models: inputs, blocks, excerpts and checks of what came back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paneloom.functions.judgments import SEGMENTS, segment
from paneloom.functions.text import let

# fixed values: titles of the segments in a model's input
TITLES = {"header": "当事人段", "charge": "指控段", "facts": "查明段", "reasoning": "本院认为段", "verdict": "判决段"}
WHOLE, OTHER, UNSEGMENTED = "全文开头", "其他", "全文（分段失败）"
#: Segments of an input and how many characters of each, by kind of input.
INPUTS = {"core": (("header", 1200), ("reasoning", 800), ("verdict", 600)), "origin": (("header", 1200), ("charge", 800), ("facts", 800))}
WHOLE_CHARS = 2000

# fixed values: cues of the fields in a text
CUES = {
    "status_at_judgment": "现[^。；]{0,20}(?:羁押|押|取保|监视居住|在家|关押)|羁押于[^。；]{0,15}|[^，。；]{0,12}被(?:监视居住|取保候审|执行逮捕|逮捕|刑事拘留|羁押)",
    "ever_bail": "取保候审",
    "plea_formal": "认罪认罚",
    "jiejie": "具结",
    "procedure": "适用[^。；]{0,8}程序",
    "counsel_any": "辩护人[^，。；]{0,12}",
    "penalty_type": "判处[^。；]{0,20}",
    "term_months": "判处[^。；]{0,20}",
    "probation": "缓刑[^。；]{0,12}",
    "origin_text": "(?:户籍|户口|出生于|生于)[^，。；]{0,20}",
    "nonlocal_origin": "(?:户籍|户口|出生于|生于)[^，。；]{0,20}",
    "residence_local": "住[^，。；]{0,20}",
}
VERDICT_FIELDS = ("penalty_type", "term_months", "probation")
PARTY_FIELDS = ("origin_text", "nonlocal_origin", "residence_local", "status_at_judgment", "ever_bail", "counsel_any")
ORIGIN_FIELDS = ("origin_text", "nonlocal_origin")
ORIGIN_LEAD = "(?:户籍|户口|出生于|生于|出生地)[^，。；]{0,6}$"
EXCERPT, PARTY_CHARS = 30, 1500

# fixed values: cues by which a model's answer is doubted
STATUS_CUES = "羁押|押于|在押|拘留|逮捕|取保|监视居住|现在家"
ORIGIN_CUES = "户籍|户口|出生|生于|籍贯"
RESIDENCE_CUES = "住"
HEADER_OF_INPUT = "(?s)【当事人段】\\n(.*?)(?:\\n\\n【|$)"

# fixed values: the marker of a verdict and the name of the charge
VERDICT_MARK, UNCLASSIFIED, THEFT, CONVICTED_OF_THEFT = "判决如下", "未分类", "盗窃罪", "犯盗窃罪"


def section(title: str, text: Column) -> Column:
    return F.concat(F.lit(f"【{title}】\n"), text)


def first_after(spans: Column) -> Column:
    """Where the header's procedural sentences end: at the next segment; null without one."""
    ends = F.coalesce(spans["header"]["end"], F.lit(0))
    return F.array_min(F.filter(F.array(*[spans[k]["start"] for k in SEGMENTS[1:]]), lambda s: s >= ends))


def party_block(text: Column, spans: Column) -> Column:
    """The header with the sentences up to the next segment; null without a header."""
    return F.when(spans["header"].isNotNull(), F.substring(text, F.lit(1), F.coalesce(first_after(spans), F.length(text))))


def model_input(text: Column, spans: Column, kind: str = "core") -> Column:
    """Titled segments, each cut to its length; the start of the text where the needed ones are missing."""
    part = {k: party_block(text, spans) if k == "header" else segment(text, spans[k]) for k, _ in INPUTS[kind]}
    titled = F.array_compact(F.array(*[F.when(part[k].isNotNull(), section(TITLES[k], F.substring(part[k], 1, n))) for k, n in INPUTS[kind]]))
    lacking = spans["header"].isNull() | spans["verdict"].isNull() if kind == "core" else F.size(titled) == 0
    return F.when(lacking, section(WHOLE, F.substring(text, 1, WHOLE_CHARS))).otherwise(F.array_join(titled, "\n\n"))


def fill_input(text: Column, spans: Column, with_verdict: Column) -> Column:
    """For filling gaps: 800 characters of the party block, and 600 of the verdict where the sentence is sought."""
    head = section(TITLES["header"], F.substring(F.coalesce(party_block(text, spans), text), 1, 800))
    verdict = segment(text, spans["verdict"])
    return F.when(with_verdict & verdict.isNotNull(), F.concat(head, F.lit("\n\n"), section(TITLES["verdict"], F.substring(verdict, 1, 600)))).otherwise(head)


def text_blocks(text: Column, spans: Column) -> Column:
    """(title, body) of the whole text in order: its segments, and what lies between them."""
    titles = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    found = F.array_sort(F.filter(F.array(*[F.struct(spans[k]["start"].alias("s"), spans[k]["end"].alias("e"), F.lit(k).alias("k")) for k in SEGMENTS]), lambda x: x["s"].isNotNull()))
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    none = F.array().cast("array<struct<title:string,body:string>>")
    block = lambda title, body: F.struct(title.alias("title"), body.alias("body"))

    def step(a: Column, x: Column) -> Column:
        gap = F.when(x["s"] > a["at"], F.array(block(F.lit(OTHER), cut(a["at"], x["s"])))).otherwise(none)
        begin = F.greatest(x["s"], a["at"])
        own = F.when(x["e"] > begin, F.array(block(F.try_element_at(titles, x["k"]), cut(begin, x["e"])))).otherwise(none)
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], gap, own).alias("out"))

    def close(a: Column) -> Column:
        rest = F.when(a["at"] < F.length(text), F.array(block(F.lit(OTHER), cut(a["at"], F.length(text))))).otherwise(none)
        return F.concat(a["out"], rest)

    walked = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), step, close)
    return F.when(F.size(found) == 0, F.array(block(F.lit(UNSEGMENTED), text))).otherwise(walked)


def occurrences(text: Column, sought: Column) -> Column:
    """Places at which a text holds another, without overlaps; none of an empty one."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), sought, F.lit("\\E")), -1)
    ends = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, p: F.struct((a["at"] + F.length(p) + F.length(sought)).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out")))["out"]
    return F.when(F.length(sought) > 0, F.slice(ends, F.lit(1), F.size(ends) - 1)).otherwise(F.array().cast("array<int>"))


def before(text: Column, at: Column, n: int) -> Column:
    """At most n characters before a place."""
    return F.substring(text, F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n)))


def excerpt(text: Column, spans: Column, field: Column, value: Column) -> Column:
    """At most EXCERPT characters of the text that speak for a field's value; empty if nothing does.

    Fields of the sentence are sought in the verdict, those of the party before the next segment. A
    place of origin is sought itself, where a word for origin stands before it or 人 after it.
    """
    starts = F.array_min(F.filter(F.array(*[spans[k]["start"] for k in SEGMENTS[1:]]), lambda s: s.isNotNull()))
    party = F.substring(text, F.lit(1), F.coalesce(starts, F.lit(PARTY_CHARS)))
    region = F.when(field.isin(*VERDICT_FIELDS), F.coalesce(segment(text, spans["verdict"]), text)).when(field.isin(*PARTY_FIELDS), party).otherwise(text)
    cued = F.coalesce(*[F.when(field == f, F.substring(F.regexp_extract(region, cue, 0), 1, EXCERPT)) for f, cue in CUES.items()], F.lit(""))
    sought = F.when(field.isin(*ORIGIN_FIELDS) & ~value.isin("NA", "0", "1"), value)

    def named(r: Column) -> Column:
        fit = F.filter(occurrences(r, sought), lambda p: before(r, p, 12).rlike(ORIGIN_LEAD) | (F.substring(r, p + F.length(sought) + 1, F.lit(1)) == "人"))
        return let(F.get(fit, F.lit(0)), lambda p: F.when(p.isNotNull(), F.substring(F.concat(before(r, p, 6), F.substring(r, p + 1, F.length(sought) + 2)), 1, EXCERPT)))

    return F.coalesce(let(region, named), cued)


def header_of(input_: Column) -> Column:
    return F.when(input_.rlike(HEADER_OF_INPUT), F.regexp_extract(input_, HEADER_OF_INPUT, 1)).otherwise(input_)


def status_without_cue(value: Column, input_: Column) -> Column:
    """Whether custody is answered although the party block tells of no measure and no state."""
    return F.coalesce((value == "在押") & ~header_of(input_).rlike(STATUS_CUES), F.lit(False))


def residence_as_origin(value: Column, input_: Column) -> Column:
    """Whether an answered origin stands in the party block after a word for residence only, never after one for origin or before 人."""
    sought = F.when(~value.isin("NA", ""), value)

    def told(h: Column) -> Column:
        def judged(places: Column) -> Column:
            origin = F.exists(places, lambda p: before(h, p, 8).rlike(ORIGIN_CUES) | (F.substring(h, p + F.length(sought) + 1, F.lit(1)) == "人"))
            return ~origin & F.exists(places, lambda p: before(h, p, 6).rlike(RESIDENCE_CUES))

        return let(occurrences(h, sought), judged)

    return F.coalesce(let(header_of(input_), told), F.lit(False))


def theft_candidate(charge: Column, text: Column) -> dict[str, Column]:
    """is_theft, is_unclassified, hint (an unclassified case whose verdict names theft) and has_verdict."""
    verdict = F.coalesce(text, F.lit(""))
    after = F.coalesce(F.try_element_at(F.split(verdict, VERDICT_MARK, 2), F.lit(2)), F.lit(""))
    unclassified = F.coalesce(charge.startswith(UNCLASSIFIED), F.lit(False))
    return {"is_theft": F.coalesce(charge == THEFT, F.lit(False)), "is_unclassified": unclassified, "hint": unclassified & after.contains(CONVICTED_OF_THEFT), "has_verdict": verdict.contains(VERDICT_MARK)}
