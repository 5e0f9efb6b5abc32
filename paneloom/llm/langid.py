"""Language identification by words first, then by ever shorter character n-grams.

The model holds, for each language, the log frequency of every word it has met often enough, and of
the n-grams of all words, with their ends marked. A known word adds its log frequencies; an unseen
one the mean log frequencies of its longest n-grams of which any is known. The document's language is
the one with the greatest sum; its score is that language's share after a softmax over the mean per
word times the square root of the number of words, as neighbouring words aren't independent.

The model learns from at most `docs_per_language` documents of each language, those with the least
hash of the id. Words are runs of Unicode letters, lower-cased. Null texts and texts without a letter
are `und` with score 0. Rows with null labels aren't learned from; if nothing is learned, all is `und`.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneloom.llm.shared import by_value, opened, shipped, small_batches

by_value(__name__)

WORDS = re.compile(r"[^\W\d_]+")
LONGEST, MIN_COUNT, CACHE = 5, 2, 200_000
DOCS_PER_LANGUAGE = 600


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies by language of words and n-grams."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in pairs})
        place = {lang: i for i, lang in enumerate(self.langs)}
        words: list[Counter] = [Counter() for _ in self.langs]
        for lang, text in pairs:
            words[place[lang]].update(WORDS.findall(text.lower()))
        met = Counter()
        for c in words:
            met.update(c)
        self.words = self._logs([Counter({w: n for w, n in c.items() if met[w] >= MIN_COUNT}) for c in words])
        self.grams = []
        for n in range(1, LONGEST + 1):
            counted = [Counter() for _ in self.langs]
            for i, c in enumerate(words):
                for w, k in c.items():
                    for g in grams(w, n):
                        counted[i][g] += k
            self.grams.append(self._logs(counted))
        self.default = tuple(0.0 for _ in self.langs)
        self.rows: Rows | None = None

    def _logs(self, counted: list[Counter]) -> dict[str, tuple[float, ...]]:
        known = set().union(*counted) if counted else set()
        totals = [sum(c.values()) + len(known) for c in counted]
        return {w: tuple(math.log((c[w] + 1) / max(t, 1)) for c, t in zip(counted, totals, strict=True)) for w in known}

    def unseen(self, word: str) -> tuple[float, ...]:
        for n in range(LONGEST, 0, -1):
            table = self.grams[n - 1]
            found = [v for g in grams(word, n) if (v := table.get(g))]
            if found:
                return tuple(sum(x) / len(found) for x in zip(*found, strict=True))
        return self.default

    def predict(self, text: str | None, rows: Rows) -> tuple[str, float]:
        words = WORDS.findall(text.lower()) if text else []
        if not words or not self.langs:
            return "und", 0.0
        rows.make_room()
        places = np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))
        sums = rows.table[places].sum(axis=0)
        best = int(sums.argmax())
        return self.langs[best], float(1.0 / np.exp((sums - sums[best]) / math.sqrt(len(words))).sum())


class Rows(dict):
    """Word -> row of `table`, its log frequencies; unseen words get a row when first met, and are forgotten when there are many."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.table = model, np.zeros((0, len(model.langs)))
        self.make_room()

    def make_room(self) -> None:
        if not self or len(self) > len(self.model.words) + CACHE:
            self.clear()
            self.update(zip(self.model.words, range(len(self.model.words)), strict=True))
            self.table = np.zeros((len(self) + 2 * CACHE, len(self.model.langs)))
            if self:
                self.table[: len(self)] = list(self.model.words.values())

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.model.unseen(word)
        return at


def training_pairs(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int) -> list[tuple[str, str]]:
    """At most docs_per_language documents a language: ids are chosen first, without texts."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = known.select(F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), F.md5(F.col(id_col).cast("string")).alias("_h"))
    # the least hashes of each part come first, so that one common language isn't ranked in one task
    parts = ids.withColumn("_r", F.row_number().over(W.partitionBy("_lang", F.substring("_h", 1, 2)).orderBy("_h", "_id"))).where(F.col("_r") <= docs_per_language)
    chosen = parts.withColumn("_r", F.row_number().over(W.partitionBy("_lang").orderBy("_h", "_id"))).where(F.col("_r") <= docs_per_language).select("_id").distinct()
    rows = known.join(F.broadcast(chosen), F.col(id_col) == F.col("_id"), "left_semi").select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    return [(r[0], r[1]) for r in rows.toLocalIterator()]


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(id, lang_pred, score): one row per row of docs; learns from `train`, which has the labels."""
    spark = docs.sparkSession
    small_batches(spark)
    model = shipped(spark, Model(training_pairs(train, id_col, text_col, lang_col, docs_per_language)))

    def run(batches):
        known = opened(model)
        rows = known.rows = known.rows or Rows(known)  # tasks of one process share what they have met
        for b in batches:
            got = [known.predict(t.as_py(), rows) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, lang_pred string, score double")
