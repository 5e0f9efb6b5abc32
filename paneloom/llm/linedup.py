"""Line deduplication over levelled sorted runs of line hashes.

A run holds, for each key it has met, in how many documents the key occurs and the largest id among
them, sorted by key. A new batch of documents adds one run to level 0; a level with `fanout` runs is
merged into one run of the next level, so that n batches leave about log(n) runs. Batches must not
share documents. Runs that are given a folder stay there with a manifest, so that a later job opens
them and adds its own. Only DataFrame functions are used.

A batch is anti-joined with the runs to tell its new lines (`unseen`). Which lines a whole table loses
depends on later documents too, so that `lost` joins all keys with the doomed ones when all are in.

Null and empty texts are one empty line. Rows with the same id are one document when keys are
counted; a null id counts as no document, and such rows keep all their lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm.shared import BLANKS, ascii_lower, cut, drop_cut, maybe_broadcast, small_enough

#: Keys to drop (24 bytes each), and places of lines to drop, are broadcast up to so many, and shuffled beyond.
BROADCAST_KEYS = 500_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """White space is stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Levels of sorted runs (h1, h2, n_docs, last_doc); a key is 64 and 32 bits of hash.

    With a folder, runs and manifests (version, level, run) are written there; the newest manifest
    counts, and a folder that has one is opened as it is.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, folder: str | None = None):
        self.spark, self.fanout, self.folder, self.version = spark, fanout, folder, 0
        self.levels: list[list[DataFrame]] = [[]]
        if folder and self._exists(f"{folder}/manifest"):
            rows = spark.read.json(f"{folder}/manifest", "version long, level int, run string")
            self.version = rows.agg(F.max("version")).first()[0]
            for r in rows.where(F.col("version") == self.version).orderBy("level", "run").collect():  # about log(n) rows
                while len(self.levels) <= r.level:
                    self.levels.append([])
                if r.run:
                    self.levels[r.level].append(self._open(r.run))

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, name: str) -> bool:
        at, files = self._path(name)
        return files.exists(at)

    def _open(self, name: str) -> DataFrame:
        df = self.spark.read.schema("h1 long, h2 int, n_docs long, last_doc long").parquet(f"{self.folder}/{name}")
        df._run = name
        return df

    def _write(self, df: DataFrame) -> DataFrame:
        df = df.sortWithinPartitions("h1", "h2")
        if not self.folder:
            return cut(df, "run")
        name = f"run-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self._open(name)

    def _record(self, old: list[DataFrame]) -> None:
        """A new manifest; runs that it doesn't name any more go after it is there."""
        if self.folder:
            self.version += 1
            rows = [(self.version, level, r._run) for level, runs in enumerate(self.levels) for r in runs] or [(self.version, 0, None)]
            self.spark.createDataFrame(rows, "version long, level int, run string").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
            for r in old:
                at, files = self._path(f"{self.folder}/{r._run}")
                files.delete(at, True)
        drop_cut(*old)

    @staticmethod
    def keys(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(h1, h2, doc, pos) of every line whose key has min_chars code points or more."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
        rows = rows.where(F.col("doc").isNotNull() & (F.length("line") >= min_chars)).select("doc", "pos", line_key(F.col("line")).alias("key"))
        return rows.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc", "pos")

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        df = runs[0]
        for r in runs[1:]:
            df = df.unionByName(r)
        return df.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, keys: DataFrame) -> None:
        """The batch's own run; full levels are compacted upwards."""
        own = keys.groupBy("h1", "h2", "doc").agg(F.lit(1).cast("long").alias("one"))
        self.levels[0].append(self._write(own.groupBy("h1", "h2").agg(F.sum("one").alias("n_docs"), F.max("doc").alias("last_doc"))))
        gone, level = [], 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merge(self.levels[level])))
            gone += self.levels[level]
            self.levels[level] = []
            level += 1
        self._record(gone)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def table(self) -> DataFrame:
        """All runs as one."""
        runs = self.runs()
        return self._merge(runs) if runs else self.spark.createDataFrame([], "h1 long, h2 int, n_docs long, last_doc long")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose key is in no run yet."""
        for r in self.runs():
            keys = keys.join(r.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def doomed(self, min_docs: int) -> DataFrame:
        """(r1, r2, last_doc) of the keys in so many documents."""
        return self.table().where(F.col("n_docs") >= min_docs).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "last_doc")

    def lost(self, keys: DataFrame, min_docs: int) -> DataFrame:
        """The rows that go when keys of min_docs documents stay only in their last one. Few such keys are broadcast, so that no line is shuffled."""
        doomed = maybe_broadcast(cut(self.doomed(min_docs), "doomed"), BROADCAST_KEYS)
        return keys.join(doomed, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("doc") != F.col("last_doc")), "left_semi")


def index_lines(keys: DataFrame, batches: int = 4, fanout: int = 3) -> LineRuns:
    """Adds a written table of keys to fresh runs in `batches` batches, dealt by a hash of the document."""
    runs = LineRuns(keys.sparkSession, fanout)
    for b in range(batches):
        runs.add(keys.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b))
    return runs


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `kept_text`, `n_lines` and `n_dropped` added (such columns of docs are replaced).

    Keys of at least min_chars code points in at least min_docs documents lose all their lines but
    those of the largest id that holds them. kept_text is never null.
    """
    keys = cut(LineRuns.keys(docs, min_chars, id_col, text_col), "keys")
    runs = index_lines(keys, batches)
    lost = cut(runs.lost(keys, min_docs), "lost")
    drop_cut(keys, *runs.runs())
    by_doc = lost.groupBy(F.col("doc").alias("_lost_doc")).agg(F.collect_set("pos").alias("_lost"))
    if small_enough(lost, BROADCAST_KEYS):
        by_doc = F.broadcast(by_doc)
    base = docs.drop("kept_text", "n_lines", "n_dropped")
    out = base.join(by_doc, F.col(id_col).cast("long") == F.col("_lost_doc"), "left")
    lines = lines_of(F.col(text_col))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_lost"))
    kept = F.when(F.col("_lost").isNull(), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n_lost = F.coalesce(F.size("_lost"), F.lit(0)).cast("long")
    return out.select(*base.columns, kept.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), n_lost.alias("n_dropped"))
