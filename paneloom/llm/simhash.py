"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

Two fingerprints are offered. `classic_fingerprints` is the 64-bit majority of the shingles' XXH64
bits. `wide_fingerprints` is the parity of 512 bits that the shingle set turns over: it rules pairs
out for a Jaccard similarity, and the shingle sets themselves decide what is left.

Nulls and texts without words have fingerprint zero and link like any other; texts of fewer words
than a shingle are one shingle. Copies share a fingerprint and take part once, under their smallest
id. Rows whose id is null keep their fingerprint and belong to the component of their fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneloom.llm.graph import components
from paneloom.llm.shared import by_value, cut, drop_cut, maybe_broadcast, small_batches

by_value(__name__)

SEED = 42
#: Words hashed at once, so that the memory for one long text stays bounded.
PIECE = 1 << 18
WIDE_BITS, SKETCH_BITS = 512, 1 << 14
#: How many documents tell which shingles are common, and how many of those are kept. Both only set the order of shingles, not what is found.
COMMON_DOCS, COMMON_SHINGLES = 20_000, 1 << 18


def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of k words, repeats included, in pieces. bytes.lower() and bytes.split() know ASCII only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return
    hashed = xxhash.xxh64_intdigest
    if n <= k:
        yield np.array([hashed(b" ".join(words), SEED)], dtype=np.uint64)
        return
    for at in range(0, n - k + 1, PIECE):
        part = words[at : at + PIECE + k - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        m = len(part) - k + 1
        yield np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts[:m].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype=np.uint64, count=m)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit; eight bits at a time in the bytes of a word."""
    out, lanes = np.zeros(64, dtype=np.int64), np.uint64(0x0101010101010101)
    padded = np.zeros(-(-len(h) // 255) * 255, dtype=np.uint64)
    padded[: len(h)] = h
    for i in range(8):
        sums = ((padded >> np.uint64(i)) & lanes).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        out[i::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def majority(text: str | None, k: int) -> int:
    """The 64-bit fingerprint as a signed long."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, k):
        counts += bit_counts(h)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0]) if n else 0


def classic_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per input row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = [majority(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, fp long")


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    seen = list(shingle_hashes(text, k))
    return np.unique(np.concatenate(seen)) if seen else np.empty(0, dtype=np.uint64)


def common_shingles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the commonest shingles of about COMMON_DOCS documents, sorted by hash."""
    small_batches(docs.sparkSession)
    every = max(1, docs.count() // COMMON_DOCS)

    def run(batches):
        for b in batches:
            got = [shingle_set(t.as_py(), shingle) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64) if got else [], pa.int64())], ["h"])

    some = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(every)) == 0).select(F.col(text_col).cast("string"))
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], p: int, q: int) -> np.ndarray:
    """The rarest shingles of a set, of which two sets of Jaccard similarity p/q or more share at least one.

    Such sets share ceil(p/q n) shingles of either's n or more, so all but that many and one more,
    in an order that is the same for every set, can't miss all that are shared.
    """
    n = len(hashes)
    take = n + (-p * n) // q + 1 if n else 0
    known, counts = common
    if not n or not len(known):
        return hashes[:take]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return hashes[np.lexsort((hashes, np.where(known[at] == hashes, counts[at], 0)))[:take]]


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    """One list of longs a row."""
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int64()))


def ratio(similarity: float) -> tuple[int, int]:
    """The similarity as the fraction that its decimal digits say, so that no bound depends on rounding."""
    return Fraction(str(similarity)).as_integer_ratio()


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, digest, n, fp array of 8 longs, keys array of the prefix's shingles): one row per input row.

    digest tells sets of shingles apart and n is their size. Each distinct shingle turns over one of
    WIDE_BITS bits, so two fingerprints never differ in more bits than the sets differ in shingles.
    """
    common, (p, q) = common_shingles(docs, id_col, text_col, shingle), ratio(similarity)
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            digests, sizes, keys, fps = [], [], [], []
            for text in b.column(1):
                h = shingle_set(text.as_py(), shingle)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                keys.append(prefix(h, common, p, q).view(np.int64))
                fps.append(parity(h, WIDE_BITS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists(fps), lists(keys)], ["id", "digest", "n", "fp", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, digest binary, n long, fp array<long>, keys array<long>")


#: Documents whose shingle sets are wanted are broadcast, by their ids, up to so many, and joined beyond.
BROADCAST_IDS = 500_000


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits, as longs, that a set turns over: two sets differ in no fewer members than these differ in bits."""
    odd = np.bincount(((hashes >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def similar_pairs(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The rows of a written table (a, b, ...) whose shingle sets have the Jaccard similarity or more, told from the sets themselves.

    The sets of long texts are large, so SKETCH_BITS parity bits of each text rule most other pairs out
    before, without error; sets are made and joined for what is left.
    """
    p, q = ratio(similarity)

    def of(pairs: DataFrame, what: Callable[[np.ndarray], np.ndarray], label: str) -> DataFrame:
        """(id, n, x) of the documents of pairs: the size of the set, and what is made of it."""
        wanted = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(maybe_broadcast(wanted, BROADCAST_IDS), "id", "left_semi")

        def run(batches):
            for b in batches:
                sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), lists([what(h) for h in sets])], ["id", "n", "x"])

        out = cut(texts.mapInArrow(run, "id long, n long, x array<long>"), label)
        drop_cut(wanted)
        return out

    def kept(pairs: DataFrame, made: DataFrame, cond: Column) -> DataFrame:
        side = lambda name: made.select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.col("x").alias(f"x{name}"))
        out = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(cond).select(*pairs.columns).distinct(), "similar")
        drop_cut(made)
        return out

    differ = F.aggregate(F.zip_with("xa", "xb", lambda l, r: F.bit_count(l.bitwiseXOR(r))), F.lit(0), lambda n, x: n + x)
    near = kept(pairs, of(pairs, lambda h: parity(h, SKETCH_BITS), "sketches"), differ * (p + q) <= (F.col("na") + F.col("nb")) * (q - p))
    out = kept(near, of(near, lambda h: h.view(np.int64), "sets"), F.size(F.array_intersect("xa", "xb")) * (p + q) >= (F.col("na") + F.col("nb")) * p)
    drop_cut(near)
    return out


def pigeonhole_keys(fp: Column, distance: int, share: int = 2) -> Column:
    """Keys of which two fingerprints at most `distance` bits apart share at least one.

    The 64 bits are cut into distance + share blocks; differing bits touch at most `distance` of
    them, so `share` blocks agree. Every choice of `share` blocks is one key, tagged with its number.
    """
    n = distance + share
    edges = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(n)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), share)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(block[i])
        keys.append(key)
    return F.array(*keys)


def share_for(nodes: int, distance: int, in_a_block: int = 8) -> int:
    """How many blocks a key takes, so that few of so many unrelated fingerprints share one: 2 for some 16 million at distance 4, 3 for a thousand million."""
    share = 2
    while share < 6 and nodes > in_a_block << (64 * share // (distance + share)):
        share += 1
    return share


#: Rows of one block that are put in order in one task.
ORDERED_ROWS = 50_000


def linked(nodes: DataFrame, blocks: DataFrame, close: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], payload: list[str], verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of all nodes that have a link, as a written table; two nodes link if they share a block and are close.

    nodes: node and payload columns, one row each. blocks: (key, node, by), by being what rows of a
    block are ordered by. close(l, r) says from the payload whether two rows link. Pairs within a group
    aren't listed: a first pass links each row of a block with the row before it and with the block's
    first one, its hub; rows that share most blocks with others come first, as those are what the others
    are copies of. That leaves no pair of a block of three rows. Of larger blocks, only rows outside the
    largest component so far are then compared with the rows of other components in the block, which
    finds every link that joins two components. verify(pairs) keeps the rows (a, b, ...) of a written
    table that do link, where close can only rule pairs out.

    Blocks travel as numbers until the second pass; one of many rows is dealt to several tasks to be
    ordered.
    """
    made: list[DataFrame] = []

    def written(df: DataFrame, label: str) -> DataFrame:
        made.append(cut(df, label))
        return made[-1]

    shared = cut(blocks.withColumn("n_rows", F.count(F.lit(1)).over(W.partitionBy("key"))).where("n_rows > 1"), "keys")
    part = F.pmod(F.hash("node"), F.ceil(F.col("n_rows") / ORDERED_ROWS).cast("int"))
    ordered = shared.withColumn("n_keys", F.count(F.lit(1)).over(W.partitionBy("node"))).withColumn("part", part)
    order = W.partitionBy("key", "part").orderBy(F.desc("n_keys"), "by", "node")
    table = cut(ordered.select("key", "node", "n_rows", F.first("node").over(order).alias("hub"), F.lag("node").over(order).alias("before")), "blocks")
    drop_cut(shared)
    near = table.select("node", F.explode(F.array("before", "hub")).alias("b")).where("b <> node").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    side = lambda name: nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in payload])
    get = lambda prefix: lambda name: F.col(f"{prefix}_{name}")
    pairs = written(near.join(side("a"), "a").join(side("b"), "b").where(close(get("a"), get("b"))).select("a", "b"), "pairs")
    if verify:
        pairs = verify(pairs)
    first = components(pairs)
    made += [pairs, first]

    placed = table.where("n_rows > 3").select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("at"))
    most = placed.groupBy("key", "at").count().groupBy("key").agg(F.max_by("at", F.struct("count", "at")).alias("top"), F.count(F.lit(1)).alias("n_at")).where("n_at > 1").drop("n_at")
    open_ = cut(placed.join(most, "key").join(nodes.select("node", *payload), "node"), "open")
    drop_cut(table)
    left = open_.where("at <> top").select("key", *[F.col(c).alias(f"l_{c}") for c in ("node", "at", *payload)])
    right = open_.select("key", *[F.col(c).alias(f"r_{c}") for c in ("node", "at", "top", *payload)])
    cond = (F.col("l_at") != F.col("r_at")) & ((F.col("r_at") == F.col("r_top")) | (F.col("l_node") < F.col("r_node"))) & close(get("l"), get("r"))
    found = written(left.join(right, "key").where(cond).select(F.col("l_node").alias("a"), F.col("r_node").alias("b"), "l_at", "r_at").distinct(), "pairs")
    drop_cut(open_)
    if verify:
        found = verify(found)
        made.append(found)
    second = components(found.select(F.col("l_at").alias("a"), F.col("r_at").alias("b")).distinct())
    made.append(second)
    out = first.unionByName(second.select("node", F.col("node").alias("component")).join(first.select("node"), "node", "left_anti"))
    out = cut(out.join(second.select(F.col("node").alias("component"), F.col("component").alias("final")), "component", "left").select("node", F.coalesce("final", "component").alias("component")), "linked")
    drop_cut(*made)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component), as a written table: documents whose 64-bit fingerprints are connected by links of at most `distance` bits."""
    prints = cut(classic_fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("node")), "classes")
    nodes = classes.where("node is not null")
    blocks = nodes.select(F.explode(pigeonhole_keys(F.col("fp"), distance, share_for(classes.count(), distance))).alias("key"), "node", F.col("fp").alias("by"))
    links = linked(nodes, blocks, lambda l, r: F.bit_count(l("fp").bitwiseXOR(r("fp"))) <= distance, ["fp"])
    known = classes.join(links, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = cut(prints.join(known, "fp", "left"), "components")
    drop_cut(prints, classes, links)
    return out


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component), as a written table: documents connected by links of Jaccard similarity `similarity` or more; exact.

    Pairs that share a shingle of their prefixes are candidates, as all pairs of that similarity are.
    Sizes and fingerprints rule most others out without error: the sets may differ in no more than
    (1-s)/(1+s) of their sizes' sum. What remains is decided by the sets themselves.
    """
    p, q = ratio(similarity)
    wide = cut(wide_fingerprints(docs, id_col, text_col, shingle, similarity), "wide")
    classes = cut(wide.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
    prints = cut(wide.select("id", "digest"), "digests")
    drop_cut(wide)
    words = [f"f{i}" for i in range(WIDE_BITS // 64)]
    nodes = classes.where("node is not null").select("node", "n", *[F.col("fp")[i].alias(w) for i, w in enumerate(words)])
    blocks = classes.where("node is not null").select(F.explode("keys").alias("key"), "node", F.col("n").alias("by"))

    def close(l, r):
        differ = F.bit_count(l(words[0]).bitwiseXOR(r(words[0])))
        for w in words[1:]:
            differ = differ + F.bit_count(l(w).bitwiseXOR(r(w)))
        sizes = F.least(l("n"), r("n")) * q >= F.greatest(l("n"), r("n")) * p
        return sizes & (differ * (p + q) <= (l("n") + r("n")) * (q - p))

    links = linked(nodes, blocks, close, ["n", *words], lambda pairs: similar_pairs(docs, pairs, id_col, text_col, shingle, similarity))
    known = classes.select("digest", "node").join(links, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = cut(prints.join(known, "digest", "left").drop("digest"), "components")
    drop_cut(prints, classes, links)
    return out
