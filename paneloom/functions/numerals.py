"""Numbers, durations, dates and case numbers of Chinese court texts, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paneloom.functions.text import let

# fixed values: numerals and their values, in natural order
DIGITS = {"零": 0, "〇": 0, "○": 0, "Ｏ": 0, "O": 0, "一": 1, "壹": 1, "二": 2, "贰": 2, "两": 2, "三": 3, "叁": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
BIG = {"万": 10_000, "萬": 10_000, "亿": 100_000_000}
CN = "零〇○一二两三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬"
#: Arabic with separators, decimals and a big unit, or Chinese numerals; for use within patterns.
NUM = f"(?:[0-9][0-9,，]*(?:[.][0-9]+)?(?:\\s*[万亿])?(?:[{CN}]*)|[{CN}]+)"
WIDE, NARROW = "０１２３４５６７８９．，", "0123456789.,"


def _lookup(c: Column, table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def cn_integer(s: Column) -> Column:
    """Value of a Chinese numeral; a row of digits is read digit by digit, other characters give null."""
    return let(s, _cn_integer)


def _cn_integer(s: Column) -> Column:
    by_digit = F.translate(s, "".join(DIGITS), "".join(map(str, DIGITS.values()))).try_cast("double")
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("section"), F.lit(-1.0).alias("digit"))
    held = lambda a: F.greatest(a["digit"], F.lit(0.0))

    def step(a, c):
        digit, unit, big = _lookup(c, DIGITS).cast("double"), _lookup(c, UNITS).cast("double"), _lookup(c, BIG).cast("double")
        state = lambda t, s, d: F.struct(t.alias("total"), s.alias("section"), d.alias("digit"))
        section = a["section"] + held(a)
        grown = F.when(c == "亿", (a["total"] + section) * big).otherwise(a["total"] + section * big)
        by_unit = a["section"] + F.when(a["digit"] < 0, 1.0).otherwise(a["digit"]) * unit
        nothing = F.lit(-1.0)
        return F.when(digit.isNotNull(), state(a["total"], a["section"], digit)).when(unit.isNotNull(), state(a["total"], by_unit, nothing)).otherwise(state(grown, F.lit(0.0), nothing))

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    by_unit = F.aggregate(chars, zero, step, lambda a: a["total"] + a["section"] + held(a))
    return F.when(s.rlike(f"^[{''.join(DIGITS)}]+$"), by_digit).when(s.rlike(f"^[{''.join(DIGITS)}{''.join(UNITS)}{''.join(BIG)}]+$"), by_unit)


def _arabic(head: Column) -> Column:
    """Commas between groups of three digits are separators; else what follows the first is noise."""
    grouped = head.rlike("^[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$")
    return F.when(grouped, F.replace(head, F.lit(","), F.lit(""))).otherwise(F.substring_index(head, ",", 1)).try_cast("double")


def number(s: Column, _tail: bool = False) -> Column:
    """Value of a number token, or null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.translate(s, WIDE, NARROW)), "[余多]+$", ""), "(?U)\\s+", "")
    shape = f"^([0-9][0-9,]*(?:[.][0-9]+)?)([万亿]?)([0-9{CN}]*)$"

    def arabic(p):
        value, tail = _arabic(p["head"]), p["tail"]
        big = F.when(p["unit"] == "万", 1e4).when(p["unit"] == "亿", 1e8)
        rest = F.lit(0.0) if _tail else F.coalesce(F.when(tail != "", number(tail, True)), F.lit(0.0))
        scale = F.when(tail.isin("千", "仟"), 1000.0).when(tail.isin("百", "佰"), 100.0).when(tail == "十", 10.0).otherwise(1.0)
        return F.when(p["unit"] != "", value * big + rest).otherwise(value * scale)

    def whole(t):
        parts = F.struct(*[F.regexp_extract(t, shape, i).alias(n) for i, n in enumerate(("head", "unit", "tail"), 1)])
        return F.when(t.rlike(f"^[{CN}]+$"), cn_integer(t)).when(t.rlike(shape), let(parts, arabic))

    return let(bare, whole)


def months(s: Column) -> Column:
    """Months of a duration in years, months and days, rounded to 3 places; null if it names none."""
    one = f"([0-9{CN}]+)"
    patterns = (f"{one}年", f"(?:年零?|^){one}个?月", f"(?:月零?|^){one}[日天]")
    tokens = lambda t: F.array(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns])
    parts = F.transform(let(F.translate(s, WIDE, NARROW), tokens), lambda t: number(t))

    def total(v):
        y, m, d = (F.get(v, i) for i in range(3))
        zero = F.lit(0.0)
        return F.when(F.coalesce(y, m, d).isNotNull(), F.round(F.coalesce(y * 12, zero) + F.coalesce(m, zero) + F.coalesce(d / 30, zero), 3))

    return let(parts, total)


# fixed values: patterns of dates
CN_DATE = "([0-9〇○零一二三四五六七八九Ｏ]{4})\\s*年\\s*([0-9一二三四五六七八九十]{1,3})\\s*月\\s*([0-9一二三四五六七八九十]{1,3})\\s*日"
ISO_DATE = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"


def judgment_date(s: Column) -> Column:
    """An ISO date at the start, or else a Chinese date anywhere; dates that don't exist are null."""
    t = F.trim(s)

    def of(pattern):
        parts = F.array(*[F.regexp_extract(t, pattern, i) for i in (1, 2, 3)])
        ints = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), p.try_cast("int")).otherwise(cn_integer(p).cast("int")))
        return let(ints, lambda v: F.format_string("%04d-%02d-%02d", F.get(v, 0), F.get(v, 1), F.get(v, 2))).try_cast("date")

    return F.when(t.rlike(ISO_DATE), of(ISO_DATE)).when(t.rlike(CN_DATE), of(CN_DATE))


def date_kind(s: Column) -> Column:
    return F.when(s.isNull() | (F.trim(s) == ""), "missing").when(s.rlike(ISO_DATE), "iso").when(s.rlike(CN_DATE), F.when(F.regexp_extract(s, CN_DATE, 2).rlike("^[0-9]+$"), "cn_arabic").otherwise("cn_numeral")).otherwise("other")


# fixed values: abbreviations of the provinces in case numbers
PROVINCES = {
    "京": "北京市", "津": "天津市", "沪": "上海市", "渝": "重庆市", "冀": "河北省", "晋": "山西省", "辽": "辽宁省", "吉": "吉林省", "黑": "黑龙江省", "苏": "江苏省", "浙": "浙江省", "皖": "安徽省",
    "闽": "福建省", "赣": "江西省", "鲁": "山东省", "豫": "河南省", "鄂": "湖北省", "湘": "湖南省", "粤": "广东省", "琼": "海南省", "川": "四川省", "黔": "贵州省", "云": "云南省", "陕": "陕西省",
    "甘": "甘肃省", "青": "青海省", "台": "台湾省", "内": "内蒙古自治区", "桂": "广西壮族自治区", "藏": "西藏自治区", "宁": "宁夏回族自治区", "新": "新疆维吾尔自治区", "港": "香港特别行政区", "澳": "澳门特别行政区",
}
# fixed values: the case numbers that name a province
NEW_CASE = "^\\s*[(（]\\s*[0-9]{4}\\s*[)）]\\s*([^0-9])([0-9]+)"


def case_parts(s: Column) -> tuple[Column, Column, Column, Column]:
    """(abbr, code, kind, province) of a case number; abbr and code only in the format with a province."""
    abbr = F.regexp_extract(s, NEW_CASE, 1)
    known = F.coalesce(abbr.isin(*PROVINCES), F.lit(False))
    kind = F.regexp_extract(F.coalesce(s, F.lit("")), "(刑[^0-9号]*)", 1)
    named = F.when(kind.contains("终"), "刑终").when(kind.contains("更"), "刑更").when(kind.contains("初"), "刑初").otherwise("其他")
    table = F.create_map(*[F.lit(x) for kv in PROVINCES.items() for x in kv])
    return F.when(known, abbr), F.when(known, F.regexp_extract(s, NEW_CASE, 2)), named, F.when(known, F.try_element_at(table, abbr))


def case_serial(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, "([0-9]+)\\s*号\\s*$", 1), F.lit("")).try_cast("long")


def year_in(s: Column) -> Column:
    """The first 19xx or 20xx among runs of four digits."""
    return F.nullif(F.regexp_extract(s, "((?:19|20)[0-9]{2})", 1), F.lit("")).try_cast("int")


# fixed values: how a court's name begins with its city
COURT_CITY = "^(?:[一-龥]{2,8}?(?:省|自治区))?([一-龥]{2,10}?(?:市|自治州|地区|盟))"


def court_city(name: Column, known: Column) -> Column:
    """The prefecture that a court's name begins with; null unless among `known`, an array."""
    city = F.nullif(F.regexp_extract(F.trim(name), COURT_CITY, 1), F.lit(""))
    return F.when(F.array_contains(known, city), city)
