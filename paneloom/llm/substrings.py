"""Substring deduplication with suffix automata of reference shards.

A document loses every word that is covered by a window of `span` words which also starts in a
document with a smaller id. Each window has an anchor, the least hash among its grams of GRAM words,
which depends on nothing but its words; consecutive windows of one anchor place form a piece. Equal
windows thus lie in pieces of one anchor, and the distinct pieces of an anchor are a reference shard:
its suffix automaton, built in the order of the ids, knows for each substring the smallest id that
has it, and pieces streamed through it get matching statistics. Shards are dealt to the tasks
by anchor instead of being broadcast one after another, as each broadcast would meet all documents
again. A shard has SHARD pieces at most; an anchor with more gets several, and its pieces meet them all.

Volume: anchors travel as numbers, and those of one document only are left out; the text of a piece
leaves a map task once, whatever the number of its places, which travel as numbers. A passage that
many documents share is therefore summed within the map tasks before any shuffle, and the joins on
its pieces are ones whose large partitions Spark splits.

Null texts have no words; rows with a null id lose nothing and are nobody's reference. Rows of one id
are one document as to what is smaller, and each row gives its row. Windows are those of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.shared import by_value, cut, drop_cut, small_batches

by_value(__name__)

SPAN, GRAM, SHARD = 13, 5, 5000
#: Rows that a task hands back at once.
CHUNK = 5000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(words: list[bytes], span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of each piece."""
    n = len(words)
    if n < span:
        return (np.zeros(0, dtype=np.int64),) * 3
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    mixed = np.zeros(n - gram + 1, dtype=np.uint64)
    for j in range(gram):
        mixed = (mixed ^ h[j : n - gram + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    place = np.lib.stride_tricks.sliding_window_view(mixed, span - gram + 1).argmin(axis=1) + np.arange(n - span + 1)
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    ends = np.concatenate((starts[1:] - 1, [len(place) - 1]))
    return starts, ends, mixed[place[starts]].view(np.int64)


class SuffixAutomaton:
    """Of several sequences, added in the order of their ids; `first` is the id in which a state's strings are met first."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, first, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.first.append(first)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """A state for the strings of q no longer than those of p and one symbol."""
        clone = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list, first) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
                continue
            new = self._state(self.length[last] + 1, first, {}, 0)
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
            last = new

    def earliest(self, sequence: list, span: int) -> list:
        """For each window of `span` symbols the id that has it first, or None."""
        state, matched, out = 0, 0, []
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            if i >= span - 1:
                found = None
                if matched >= span:
                    while self.length[self.link[state]] >= span:
                        state = self.link[state]
                        matched = self.length[state]
                    found = self.first[state]
                out.append(found)
        return out


def _stream(rows: Iterator[tuple], span: int) -> Iterator[tuple[int, str, list]]:
    """rows (anchor, shard, builds, first, piece), by anchor and shard, the building ones first -> (anchor, piece, earliest ids)."""
    at, held, shard = None, [], None

    def flush():
        nonlocal shard
        if len(held) == 1:  # the automaton of one piece, met by itself
            words = held[0][4].split(" ")
            yield held[0][0], held[0][4], [held[0][3]] * (len(words) - span + 1)
        else:
            shard = SuffixAutomaton()
            for r in held:
                shard.add(r[4].split(" "), r[3])
            for r in held:
                yield r[0], r[4], shard.earliest(r[4].split(" "), span)

    for r in rows:
        if r[:2] != at:
            if held:
                yield from flush()
            at, held, shard = r[:2], [], None
        if r[2]:
            held.append(r)
            continue
        if shard is None:
            if len(held) == 1:
                shard = SuffixAutomaton()
                shard.add(held[0][4].split(" "), held[0][3])
                yield held[0][0], held[0][4], [held[0][3]] * (len(held[0][4].split(" ")) - span + 1)
            elif held:
                yield from flush()
            held = []
        if shard is not None:
            yield r[0], r[4], shard.earliest(r[4].split(" "), span)
    if held:
        yield from flush()


def _anchors(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(id, anchor): the distinct anchors of each row that has an id."""

    def run(batches):
        for b in batches:
            ids, found = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = np.unique(anchors(words_of(t.as_py()), span, gram)[2])
                ids.append(np.full(len(a), i, dtype=np.int64))
                found.append(a)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], ["id", "anchor"])

    return docs.where("id is not null").select("id", "text").mapInArrow(run, "id long, anchor long")


def key_of(piece: bytes) -> int:
    return xxhash.xxh64_intdigest(piece, 42) - (1 << 63)


def _pieces(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(id, h, text, shared) -> (id, h, anchor, start, key, piece): the pieces around the shared anchors, row by row."""
    names = ["id", "h", "anchor", "start", "key", "piece"]
    kinds = [pa.int64()] * 5 + [pa.string()]

    def run(batches):
        out = []
        for b in batches:
            for i, h, t, shared in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                words = words_of(t.as_py())
                first, last, x = anchors(words, span, gram)
                keep = np.isin(x, shared.values.to_numpy())
                for s, e, k in zip(first[keep].tolist(), last[keep].tolist(), x[keep].tolist(), strict=True):
                    piece = b" ".join(words[s : e + span])
                    out.append((i, h, k, s, key_of(piece), piece.decode("utf-8", "surrogatepass")))
                    if len(out) == CHUNK:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, "id long, h long, anchor long, start long, key long, piece string")


def _earliest(dealt: DataFrame, span: int) -> DataFrame:
    """(anchor, shard, builds, first, piece), by anchor and shard -> (anchor, key, earliest): ids by window, once for each shard that a piece meets."""

    def run(batches):
        def each():
            for b in batches:
                yield from zip(*[b.column(i).to_pylist() for i in range(5)], strict=True)

        out = []
        for x in _stream(((r[0], r[1], *r[2:]) for r in each()), span):
            out.append(x)
            if len(out) == CHUNK:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        keys = [key_of(p.encode("utf-8", "surrogatepass")) for _, p, _ in out]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _, _ in out], pa.int64()), pa.array(keys, pa.int64()), pa.array([m for _, _, m in out], pa.list_(pa.int64()))], ["anchor", "key", "earliest"])

    return dealt.mapInArrow(run, "anchor long, key long, earliest array<long>")


def _remove(docs: DataFrame, span: int) -> DataFrame:
    """(id, text, starts) -> what is left without the words that windows at `starts` cover."""

    def run(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for t, starts in zip(b.column(1), b.column(2), strict=True):
                words, starts = words_of(t.as_py()), starts.as_py()
                if starts:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.unique(np.array(starts, dtype=np.int64))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + span, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    left = words
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return docs.mapInArrow(run, "id long, n_words long, n_removed long, kept_text string")


def repeated_windows(rows: DataFrame, span: int = SPAN, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(id, h, text) -> (id, h, starts): of the rows that lose any, the starts of windows that a smaller id has, as a written table."""
    found = cut(_anchors(rows, span, gram), "anchors")
    # summed within the map tasks first: a common anchor is one row a task when it is shuffled
    common = cut(found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"), "common")
    shared = cut(found.join(common, "anchor").groupBy(F.col("id").alias("sid")).agg(F.collect_set("anchor").alias("shared")), "shared")
    drop_cut(found, common)
    placed = cut(_pieces(rows.join(shared, F.col("id") == F.col("sid")).select("id", "h", "text", "shared"), span, gram), "pieces")
    drop_cut(shared)

    distinct = cut(placed.groupBy("anchor", "piece").agg(F.min("id").alias("first")), "distinct")
    # anchors with more pieces than a shard holds; written first, so that the planner knows how few they are
    sizes = cut(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard), "sizes")
    shards = F.ceil(F.coalesce("n", F.lit(1)) / shard).cast("int")
    dealt = distinct.join(sizes, "anchor", "left").withColumn("shards", shards).withColumn("own", F.pmod(F.hash("piece"), F.col("shards")))
    dealt = dealt.select("anchor", "first", "piece", "own", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).select("anchor", "shard", (F.col("shard") == F.col("own")).alias("builds"), "first", "piece")
    ordered = dealt.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", F.desc("builds"), "first")
    earliest = cut(_earliest(ordered, span), "earliest")
    drop_cut(distinct, sizes)

    lost = F.filter(F.transform("earliest", lambda m, j: F.when(m < F.col("id"), F.col("start") + j)), lambda x: x.isNotNull())
    hits = placed.drop("piece").join(earliest, ["anchor", "key"]).select("id", "h", lost.alias("starts")).where(F.size("starts") > 0)
    out = cut(hits.groupBy("id", "h").agg(F.flatten(F.collect_list("starts")).alias("starts")), "starts")
    drop_cut(placed, earliest)
    return out


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(id, n_words, n_removed, kept_text): one row per row of docs; kept_text holds the words that stay, joined by a space."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    starts = repeated_windows(rows, span, gram, shard).withColumnsRenamed({"id": "sid", "h": "sh"})
    return _remove(rows.join(starts, (F.col("id") == F.col("sid")) & (F.col("h") == F.col("sh")), "left").select("id", "text", "starts"), span)
