"""Toxic spans by a linear-chain conditional random field.

Sequences are sentences (text between . ! ? and line ends), cut for learning into sequences of SEQUENCE
tokens at most; tokens are runs of letters, lower-cased, with two states: clean and toxic. Features of
a token are the word and its prefixes of PREFIXES letters. The labels mark documents, so tokens are
labelled from them first: a token of a toxic document is toxic if one of its features is found, by the
training documents, nearly only in toxic ones. The field then learns the weights of the features and of
the transitions by gradient ascent on these sequences. Forward-backward marginals give the offending
offsets; a document's score is a logistic function, fitted to the training documents, of the log odds of
its greatest marginal. (Expected numbers of toxic tokens grow with the length of a clean text; the
greatest marginal doesn't.)

Bounds on what is learned from, all parameters: `docs_per_class` documents of either label, those with
the least hash of the id; FEATURES features, the most frequent; SEQUENCES sequences that hold one, by
hash, each standing for as many as were found. Sequences without any differ in their length only and
all count. Texts stay on the executors: the driver gets tables of these sizes.

Null and empty texts have no tokens and get the least score, that of a document without toxic tokens. Rows whose
label is null aren't learned from; without labels of both kinds every score is near 0, or near 1 if
all are toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.shared import by_value, cut, drop_cut, opened, shipped, small_batches

by_value(__name__)

WORDS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]")
PREFIXES = (4, 5, 6, 7)
DOCS_PER_CLASS = 1000
#: A feature marks toxic tokens if it is nearly only in toxic training documents, and in too many of them for chance: the log-likelihood ratio of that is EVIDENCE or more (chance gives that to one feature in 100,000).
PURITY, EVIDENCE = 0.9, 20.0
SEQUENCE, CACHE, MOST_ODDS = 64, 50_000, 8.0
FEATURES, SEQUENCES = 20_000, 20_000


def features(word: str) -> list[str]:
    return [f"={word}"] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n]


def sequences(text: str, names: dict[str, int]) -> Iterator[list[list[int]]]:
    """Of every sentence, cut to sequences of SEQUENCE tokens, the features of each token."""
    known: dict[str, list[int]] = {}
    for s in SENTENCE.split(text.lower()):
        words = WORDS.findall(s)
        for w in words:
            if w not in known:
                known[w] = [names[f] for f in features(w) if f in names]
        for at in range(0, len(words), SEQUENCE):
            yield [known[w] for w in words[at : at + SEQUENCE]]


class Part:
    """Sequences (features by token, whether of a toxic document, how many they stand for) as padded arrays."""

    def __init__(self, rows: list[tuple[list[list[int]], bool, float]]):
        longest = max(len(own) for own, _, _ in rows)
        self.mask, self.y = np.zeros((len(rows), longest)), np.zeros((len(rows), longest))
        self.times = np.array([t for _, _, t in rows])[:, None]
        cells, feats = [], []
        for i, (own, toxic, _) in enumerate(rows):
            self.mask[i, : len(own)] = 1
            for j, o in enumerate(own):
                if o:
                    self.y[i, j] = toxic
                    cells += [i * longest + j] * len(o)
                    feats += o
        self.cells, self.feats = np.array(cells, dtype=np.int64), np.array(feats, dtype=np.int64)


class Field:
    """weights: feature -> weight of the toxic state; bias, start and stay are those of the chain."""

    def __init__(self, level: float = -20.0):
        self.weights: dict[str, float] = {}
        self.bias, self.start, self.stay = -4.0, 0.0, 0.0
        self.slope, self.level = 0.0, level
        self.cache: dict[str, float | None] = {}

    def learn(self, names: list[str], marked: list[tuple[int, list[list[int]]]], each: float, plain: dict[int, int], steps: int = 60, rate: float = 0.5, decay: float = 4.0) -> None:
        """marked: (label, features by token), each standing for `each` sequences; plain: how many sequences of a length have no feature.

        Sequences of like length are padded to one; those without features count once per length.
        """
        rows = [(own, label == 1, each) for label, own in marked] + [([[]] * n, False, float(times)) for n, times in plain.items()]
        if not rows:
            return
        parts = []
        for low, high in ((0, 8), (8, 16), (16, 32), (32, SEQUENCE)):
            some = [r for r in rows if low < len(r[0]) <= high]
            if some:
                parts.append(Part(some))
        w, chain = np.zeros(len(names)), np.array([self.bias, self.start, self.stay])
        sums = [np.full(len(w), 1e-8), np.full(3, 1e-8)]
        for _ in range(steps):
            gw, gc = -decay * w, -decay * chain
            for p in parts:
                emit = chain[0] + np.bincount(p.cells, weights=w[p.feats], minlength=p.mask.size).reshape(p.mask.shape)
                node, both = self._expected(emit, p.mask, chain)
                g = (p.y - node) * p.mask * p.times
                gw += np.bincount(p.feats, weights=g.ravel()[p.cells], minlength=len(w))
                gc += [g.sum(), g[:, 0].sum(), ((p.y[:, 1:] * p.y[:, :-1] * p.mask[:, 1:] - both) * p.times).sum()]
            for x, d, sq in ((w, gw, sums[0]), (chain, gc, sums[1])):
                sq += d * d
                x += rate * d / np.sqrt(sq)
        self.weights = {f: float(w[i]) for i, f in enumerate(names) if w[i] > 0}
        self.bias, self.start, self.stay = map(float, chain)

    @staticmethod
    def _expected(emit, mask, chain):
        """Marginals of the toxic state, and of toxic neighbours, of padded sequences; states as log odds of two columns."""
        size, longest = emit.shape
        fwd = np.zeros((longest, size, 2))
        bwd = np.zeros((longest, size, 2))
        norm = lambda x: x - np.logaddexp(x[:, 0], x[:, 1])[:, None]
        fwd[0, :, 1] = emit[:, 0] + chain[1]
        fwd[0] = norm(fwd[0])
        for t in range(1, longest):
            prev = fwd[t - 1]
            new = np.stack([np.logaddexp(prev[:, 0], prev[:, 1]), np.logaddexp(prev[:, 0], prev[:, 1] + chain[2]) + emit[:, t]], axis=1)
            fwd[t] = np.where(mask[:, t, None] > 0, norm(new), prev)
        both = np.zeros((size, max(longest - 1, 0)))
        for t in range(longest - 2, -1, -1):
            nxt = bwd[t + 1].copy()
            nxt[:, 1] += emit[:, t + 1]
            new = np.stack([np.logaddexp(nxt[:, 0], nxt[:, 1]), np.logaddexp(nxt[:, 0], nxt[:, 1] + chain[2])], axis=1)
            total = np.logaddexp(fwd[t][:, 0] + new[:, 0], fwd[t][:, 1] + new[:, 1])
            both[:, t] = np.exp(np.minimum(0, fwd[t][:, 1] + chain[2] + nxt[:, 1] - total)) * mask[:, t + 1]
            bwd[t] = np.where(mask[:, t + 1, None] > 0, norm(new), 0.0)
        post = fwd + bwd
        node = np.exp(post[:, :, 1] - np.logaddexp(post[:, :, 0], post[:, :, 1])).T
        return node * mask, both

    def emission(self, word: str) -> float | None:
        """None for tokens without a toxic feature."""
        found = [x for f in features(word) if (x := self.weights.get(f))]
        return sum(found) if found else None

    def marginals(self, extra: list[float | None]) -> list[float]:
        """P(toxic) of each token of one sentence, by forward-backward in log odds."""
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        emit = [self.bias + (x or 0.0) for x in extra]
        odds = [self.start + emit[0]]
        for e in emit[1:]:
            odds.append(add(0.0, odds[-1] + self.stay) - add(0.0, odds[-1]) + e)
        back, out = 0.0, [0.0] * len(emit)
        for t in range(len(emit) - 1, -1, -1):
            z = odds[t] + back
            out[t] = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            ahead = back + emit[t]
            back = add(0.0, ahead + self.stay) - add(0.0, ahead)
        return out

    def spans(self, text: str | None, cache: dict, floor: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The greatest marginal of a token with a toxic feature, and (start, end, marginal) of tokens of `floor` or more."""
        low = (text or "").lower()
        most, found, at = 0.0, [], 0
        for s in SENTENCE.split(low):
            words = WORDS.findall(s)
            extra = []
            hot = False
            for w in words:
                x = cache.get(w, cache)
                if x is cache:
                    if len(cache) >= CACHE:
                        cache.clear()
                    x = cache[w] = self.emission(w)
                extra.append(x)
                hot = hot or x is not None
            if hot:
                probs = self.marginals(extra)
                most = max(most, max(p for p, x in zip(probs, extra, strict=True) if x is not None))
                if max(probs) >= floor:
                    for m, p in zip(WORDS.finditer(s), probs, strict=True):
                        if p >= floor:
                            found.append((at + m.start(), at + m.end(), p))
            at += len(s) + 1
        return most, found

    @staticmethod
    def odds(marginal: float) -> float:
        """Log odds, within MOST_ODDS."""
        p = min(max(marginal, 1e-9), 1 - 1e-9)
        return max(-MOST_ODDS, min(MOST_ODDS, math.log(p / (1 - p))))

    def score(self, marginal: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.level + self.slope * self.odds(marginal)))))

    def calibrate(self, seen: list[tuple[int, float]], share: float) -> None:
        """Logistic regression of (label, greatest marginal) by Newton steps; the classes count by their shares among all labels, as either is sampled by itself."""
        x = np.array([self.odds(m) for _, m in seen])
        y = np.array([float(v) for v, _ in seen])
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        a = np.array([0.0, 0.0])
        design = np.stack([np.ones_like(x), x], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
            h = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            a += np.clip(np.linalg.solve(h, design.T @ (weight * (y - p)) - 1e-3 * a), -2, 2)
        self.level, self.slope = map(float, a)


def training_docs(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, docs_per_class: int) -> tuple[DataFrame, float]:
    """(y, text) of at most docs_per_class documents of either label, and the share of label 1 among all labels."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = dict(known.groupBy("y").count().collect())  # two numbers
    picked = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(docs_per_class)
        picked = one if picked is None else picked.unionByName(one)
    rows = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(picked), F.col(id_col) == F.col("_id")).select("y", F.col(text_col).cast("string").alias("text"))
    return cut(rows, "training"), n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))


def marking_features(train: DataFrame, most: int = FEATURES) -> list[str]:
    """The features that are found nearly only in toxic documents, and too often for chance; the most frequent of them."""

    def run(batches):
        for b in batches:
            y, found = [], []
            for label, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = {f for w in set(WORDS.findall(t.as_py().lower())) for f in features(w)}
                found += own
                y += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(found, pa.string())], ["y", "feature"])

    n = dict(train.groupBy("y").count().collect())  # two numbers
    if not n.get(0) or not n.get(1):
        return []
    met = train.mapInArrow(run, "y int, feature string").groupBy("feature").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    a, b, base = F.col("a"), F.col("b"), n[1] / (n[0] + n[1])
    part = lambda seen, share: F.when(seen > 0, seen * F.ln(seen / ((a + b) * share))).otherwise(0.0)
    pure = met.where((a >= PURITY * (a + b * (n[1] / n[0]))) & (2 * (part(a, base) + part(b, 1 - base)) >= EVIDENCE))
    return sorted(r.feature for r in pure.orderBy(F.desc("a"), "feature").limit(most).collect())


def training_sequences(train: DataFrame, names: list[str], most: int = SEQUENCES) -> tuple[list[tuple[int, list[list[int]]]], float, dict[int, int]]:
    """What Field.learn takes: at most `most` sequences with a feature, how many each stands for, and the numbers of others by length."""
    kind = pa.list_(pa.list_(pa.int32()))
    places = train.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(batches):
        for b in batches:
            plain: Counter = Counter()
            y, own = [], []
            for label, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for s in sequences(t.as_py(), places.value):
                    if any(s):
                        y.append(label), own.append(s)
                    else:
                        plain[len(s)] += 1
            lengths = [None] * len(y) + list(plain)
            yield pa.RecordBatch.from_arrays([pa.array(y + [0] * len(plain), pa.int32()), pa.array(own + [None] * len(plain), kind), pa.array(lengths, pa.int32()), pa.array([1] * len(y) + list(plain.values()), pa.int64())], ["y", "own", "length", "n"])

    found = cut(train.mapInArrow(run, "y int, own array<array<int>>, length int, n long"), "sequences")
    marked = found.where("own is not null")
    total = marked.count()
    chosen = [(r.y, r.own) for r in marked.select("y", "own").orderBy(F.xxhash64("own"), "y").limit(most).collect()]
    plain = {r.length: r.n for r in found.where("own is null").groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most SEQUENCE rows
    drop_cut(found)
    return sorted(chosen, key=lambda r: (r[0], r[1])), total / max(1, len(chosen)), dict(sorted(plain.items()))


def trained(train: DataFrame, share: float) -> Field:
    """A field that has learned from (y, text); share is that of label 1 among all labels."""
    names = marking_features(train)
    if not names:
        n = {r.y for r in train.select("y").distinct().collect()}  # two numbers
        field = Field(20.0 if n == {1} else -20.0)
        if len(n) < 2:
            return field
    else:
        field = Field()
        field.learn(names, *training_sequences(train, names))
    known = shipped(train.sparkSession, field)

    def run(batches):
        for b in batches:
            cache: dict = {}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([opened(known).spans(t.as_py(), cache)[0] for t in b.column(1)], pa.float64())], ["y", "most"])

    # at most two numbers a training document
    field.calibrate(sorted((r.y, r.most) for r in train.mapInArrow(run, "y int, most double").collect()), share)
    return field


def learned(train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_per_class: int = DOCS_PER_CLASS) -> Field:
    """A field that has learned from the documents of train, whose labels are in labels."""
    small_batches(train.sparkSession)
    rows, share = training_docs(train, labels, id_col, text_col, label_col, docs_per_class)
    field = trained(rows, share)
    drop_cut(rows)
    return field


def tag(docs: DataFrame, train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_per_class: int = DOCS_PER_CLASS) -> DataFrame:
    """(id, score, spans): one row per row of docs; spans are (start, end, marginal) of tokens more likely toxic than not,
    by code points of the lower-cased text.

    train: documents that may be learned from; labels: their labels.
    """
    field = shipped(docs.sparkSession, learned(train, labels, id_col, text_col, label_col, docs_per_class))

    def run(batches):
        known = opened(field)
        cache = known.cache  # tasks of one process share what they have met
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for b in batches:
            got = [known.spans(t.as_py(), cache) for t in b.column(1)]
            spans = [[{"start": s, "end": e, "marginal": p} for s, e, p in f] for _, f in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([known.score(x) for x, _ in got], pa.float64()), pa.array(spans, kind)], ["id", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, score double, spans array<struct<start:int,end:int,marginal:double>>")


def clean(docs: DataFrame, field: Field, below: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, whose score is below a bound: one pass, so that no text is shuffled."""
    small_batches(docs.sparkSession)
    model, at = shipped(docs.sparkSession, field), docs.columns.index(text_col)

    def run(batches):
        known = opened(model)
        for b in batches:
            keep = pa.array([known.score(known.spans(t.as_py(), known.cache)[0]) < below for t in b.column(at)], pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(run, docs.schema)
