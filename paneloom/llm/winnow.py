"""Benchmark decontamination by winnowing.

Documents and items are sequences of word hashes. Of every `span - k + 1` consecutive k-grams the one
with the least hash is kept, the last of equal ones; a shared span of `span` words holds that many
k-grams, so both sides keep the same one. Kept k-grams of the items are joined with those of the
documents, and every match is extended to the windows of `span` words that hold it on both sides,
which are compared word by word (as hashes). Items shorter than `span` are one window of all their
words; for each such length the documents' grams of that length are joined. Only DataFrame functions
are used.

A passage that many items share is kept once: windows carry the number of the set of items that hold
them, and sets are laid out only for documents that hold one. Null texts have no words; items without
words never occur. Every row of the documents gives one row; rows of one id and text are looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.shared import ascii_lower, cut, maybe_broadcast

#: What stands between words: every ASCII character but digits and lower-case letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SPAN, GRAM = 8, 4
#: The bitmap has 16 bits a fingerprint of the items, within 2 to the power of these; where that is too few it passes more, and nothing is lost.
LEAST_BITS, MOST_BITS = 18, 22
#: The items' fingerprints are broadcast up to so many rows (some 100 MB), and shuffled beyond.
BROADCAST_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    """Splitting is several times faster than extracting; it leaves empty words at the ends, whose hash is taken out."""
    parts = F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN)
    return F.array_remove(F.transform(parts, lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def gram_hashes(words: Column) -> Column:
    """Hash of the four words from each place on, made of hashes of pairs; the last three places hold no gram."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(pairs, F.slice(pairs, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def is_kept(grams: Column, n_grams: Column, place: Column, width: int) -> Column:
    """Whether the gram at `place` is the least of some `width` consecutive ones, the last of equal ones; of all, if there are fewer.

    It is if the grams before it that aren't less and those after it that are greater make up a whole
    window with it.
    """
    here = F.get(grams, place)
    left = [(place >= j) & (F.get(grams, place - j) >= here) for j in range(1, width)]
    right = [(place + j < n_grams) & (F.get(grams, place + j) > here) for j in range(1, width)]

    def run(oks):
        out = F.lit(len(oks))
        for n, ok in reversed(list(enumerate(oks))):
            out = F.when(ok, out).otherwise(F.lit(n))
        return out

    return run(left) + run(right) + 1 >= F.least(F.lit(width), n_grams)


def _around(words: Column, place: Column, span: int, gram: int) -> Column:
    """The words that windows of `span` around a gram at `place` can hold."""
    return F.struct(place.alias("place"), *[F.when(place + j >= 0, F.get(words, place + j)).alias(f"w{j + span - gram}") for j in range(gram - span, span)])


def fingerprints(rows: DataFrame, keys: list[str], span: int, wanted: tuple[int, Column] | None = None, outer: bool = False) -> DataFrame:
    """keys, fp and `around` of every kept gram of the column `words`; with outer, rows without any have one row of nulls, and one row each is marked `first`.

    wanted is a bitmap of the grams that matter: others are passed over before it is asked whether
    they are kept, which changes nothing but the time.
    """
    rows = rows.select(*keys, "words", gram_hashes(F.col("words")).alias("_g")).withColumn("_n", F.greatest(F.size("words") - (GRAM - 1), F.lit(0)))
    kept = F.filter(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0))), lambda i: (F.col("_n") > 0) & (in_bitmap(wanted, F.get("_g", i)) if wanted is not None else F.lit(True)) & is_kept(F.col("_g"), F.col("_n"), i, span - GRAM + 1))
    prints = F.transform(kept, lambda i: F.struct(F.get("_g", i).alias("fp"), _around(F.col("words"), i, span, GRAM).alias("around")))
    placed = rows.select(*keys, (F.posexplode_outer if outer else F.posexplode)(prints).alias("_at", "_k"))
    return placed.select(*keys, "_k.fp", "_k.around", *([(F.coalesce("_at", F.lit(0)) == 0).alias("first")] if outer else []))


def bitmap(prints: DataFrame) -> tuple[int, Column]:
    """(bits of a place, the hashes' low bits as a bitmap)."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * prints.count()).bit_length()))
    words = prints.select(F.col("fp").bitwiseAND(F.lit((1 << bits) - 1)).alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    found = dict(words.collect())  # at most 2 ** (MOST_BITS - 6) numbers
    return bits, F.lit([found.get(i, 0) for i in range(1 << (bits - 6))]).cast("array<bigint>")


def in_bitmap(bitmap_: tuple[int, Column], h: Column) -> Column:
    bits, words = bitmap_
    low = h.bitwiseAND(F.lit((1 << bits) - 1))
    return F.call_function("shiftright", F.get(words, F.shiftright(low, 6).cast("int")), low.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def windows_of(around: Column, span: int, gram: int) -> Column:
    """(before, hash) of the windows around a kept gram, by the words they have before it."""
    return F.array(*[F.struct(F.lit(b).alias("before"), F.when(around[f"w{2 * span - gram - 1 - b}"].isNotNull() & around[f"w{span - gram - b}"].isNotNull(), F.xxhash64(*[around[f"w{span - gram - b + j}"] for j in range(span)])).alias("hash")) for b in range(span - gram + 1)])


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(id, h, n_words, copies, found) and (number, items).

    One row per id and text, whose hash is h, with how many rows of docs it stands for; found has each
    occurrence of an item's window: start, len and the number of the set of items that hold it.
    """
    item_words = items.select(F.col(item_col).cast("string").alias("item"), word_hashes(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    keys = ["id", "h", "n_words"]
    doc_words = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"), word_hashes(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    prints = cut(fingerprints(item_words.where(F.size("words") >= span), ["item"], span), "prints")
    long_windows = prints.select("fp", "item", F.explode(windows_of(F.col("around"), span, GRAM)).alias("w")).where("w.hash is not null").select("fp", F.col("w.before").alias("before"), F.col("w.hash").alias("hash"), F.lit(span).alias("len"), "item")
    short_items = item_words.where(F.size("words") < span).select(F.lit(None).cast("long").alias("fp"), F.lit(0).alias("before"), F.xxhash64(F.array_join(F.transform("words", lambda x: x.cast("string")), " ")).alias("hash"), F.size("words").alias("len"), "item")
    # a set is as large as the benchmark at most
    windows = cut(long_windows.unionByName(short_items).groupBy("fp", "before", "hash", "len").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("number", F.xxhash64("items")), "windows")
    sets = windows.select("number", "items").dropDuplicates(["number"])
    by_print = windows.where("fp is not null").groupBy("fp").agg(F.collect_list(F.struct("before", "hash", "number")).alias("theirs"))
    kept = fingerprints(doc_words, keys, span, bitmap(prints), outer=True)
    met = kept.join(maybe_broadcast(by_print, BROADCAST_ROWS), "fp", "left")
    ours = windows_of(F.col("around"), span, GRAM)
    found = F.filter(F.col("theirs"), lambda t: F.get(ours, t["before"])["hash"] == t["hash"])
    starts = F.transform(found, lambda t: F.struct((F.col("around.place") - t["before"]).cast("long").alias("start"), F.lit(span).cast("long").alias("len"), t["number"].alias("number")))
    rows = met.select(*keys, "first", F.when(F.col("theirs").isNotNull(), starts).alias("found"))

    short = windows.where("fp is null").select("hash", "len", "number")
    lengths = sorted(r[0] for r in short.select("len").distinct().limit(span).collect())  # at most span - 1 numbers
    for n in lengths:
        grams = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(i.alias("place"), F.xxhash64(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get("words", i + j).cast("string")), " ")).alias("hash")))
        placed = doc_words.where(F.size("words") >= n).select(*keys, F.explode(grams).alias("g")).select(*keys, "g.place", "g.hash")
        there = maybe_broadcast(short.where(F.col("len") == n), BROADCAST_ROWS)
        rows = rows.unionByName(placed.join(there, "hash").select(*keys, F.lit(False).alias("first"), F.array(F.struct(F.col("place").cast("long").alias("start"), F.lit(n).cast("long").alias("len"), "number")).alias("found")))
    empty = F.array().cast("array<struct<start:bigint,len:bigint,number:bigint>>")
    with_hits = rows.groupBy(*keys).agg(F.count_if("first").alias("copies"), F.collect_set(F.when(F.size("found") > 0, F.col("found"))).alias("found"))
    return with_hits.select(*keys, "copies", F.array_distinct(F.coalesce(F.flatten("found"), empty)).alias("found")), sets


def contamination(docs: DataFrame, items: DataFrame, min_items: int = 2, **names) -> DataFrame:
    """(id, h, n_words, n_hit, items, contaminated, spans): one row per row of docs; h is the hash of its text, spans are the merged word ranges that are hit."""
    found, sets = hits(docs, items, **names)
    ordered = F.array_sort(F.array_distinct(F.transform("found", lambda f: F.struct(f["start"].alias("start"), (f["start"] + f["len"]).alias("end")))))
    spans = F.aggregate(
        ordered,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    n_hit = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")), lambda a: a["n"])
    rows = cut(found.select("id", "h", "n_words", "copies", n_hit.alias("n_hit"), spans.alias("spans"), F.array_distinct(F.transform("found", lambda f: f["number"])).alias("numbers")), "hits")
    theirs = rows.where(F.size("numbers") > 0).select("id", "h", F.explode("numbers").alias("number")).join(maybe_broadcast(sets, BROADCAST_ROWS), "number").groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = rows.join(theirs, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("id", "h", "n_words", "n_hit", "items", "spans", (F.size("items") >= min_items).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of docs, whole, that aren't contaminated. Few such rows are broadcast, so that no text is shuffled for them."""
    found = contamination(docs, items, min_items, id_col=id_col, text_col=text_col, **names)
    dirty = cut(found.where("contaminated").select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct(), "dirty")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("_h"))
    return docs.join(maybe_broadcast(dirty, BROADCAST_ROWS), same, "left_anti")
