"""Each operator against a plain version, over edge cases and empty tables."""

import gzip
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from paneloom.llm import crf, graph, langid, licenses, linedup, mixing, simhash, sphere, substrings, warc, winnow

WORD8 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fp(text, k=4):
    w = blank_words((text or "").translate(UP))
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_graph_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 180)] + [(5, i) for i in range(20, 60)] + [(7, 7), (None, 3)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(100, 181)) and all(got[i] == 5 for i in range(20, 60)) and 7 not in got


def test_simhash(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    want_fp = [plain_fp(t) if len(t or "") < 9000 else None for _, t in rows]
    got = simhash.simhash_components(edge).collect()
    assert len(got) == len(rows)
    fps = {r.id: r.fp & (2**64 - 1) for r in got}
    for (i, _), f in zip(rows, want_fp, strict=True):
        if f is not None and i is not None:
            assert fps[i] == f
    ids = sorted(i for i in fps if i is not None)
    up = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 4])
    want = {i: ids[up[k]] for k, i in enumerate(ids)}
    assert {r.id: r.component for r in got if r.id is not None} == want


def test_simhash_random_fingerprints(spark):
    """The block join finds every link, within one large group of near copies too."""
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 2**62))
    fps = {int(rng.integers(0, 2**62)) for _ in range(300)} | {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 62, (300, 3))}
    fps = sorted(fps)
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    from pyspark.sql import functions as F

    blocks = nodes.select(F.explode(simhash.pigeonhole_keys(F.col("fp"), 4)).alias("key"), "node", F.col("fp").alias("by"))
    got = dict(simhash.linked(nodes, blocks, lambda l, r: F.bit_count(l("fp").bitwiseXOR(r("fp"))) <= 4, ["fp"]).select("node", "component").collect())
    up = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert all(got.get(i, i) == up[i] for i in range(len(fps)))


def test_near_duplicates(edge, none):
    got = {r.id: r.component for r in simhash.near_duplicate_components(edge).collect() if r.id is not None}
    assert got[1] == got[2] == 1 and got[7] == 7 and got[15] == 15 and got[4] == got[5] == got[6] == 4
    assert simhash.near_duplicate_components(none).count() == 0


def near_copies():
    """Ids to texts: pairs whose five-word sets have every similarity around 0.8, a chain, and a common passage."""
    rng, texts = np.random.default_rng(3), {}
    common = [f"c{i}" for i in range(60)]
    for i in range(120):
        n = int(rng.integers(40, 400))
        base = [f"w{i}x{j}" for j in range(n)] + (common if i % 2 else [])
        changed = list(base)
        for at in rng.choice(n, max(1, round(n * rng.uniform(0.01, 0.04))), replace=False):
            changed[at] = f"new{i}x{at}"
        texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join(changed)
    return texts


def five_word_sets(texts):
    w = {i: t.lower().split() for i, t in texts.items()}
    return {i: {tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))} for i, x in w.items()}


def test_near_duplicate_candidates(spark):
    """Every pair of similarity 0.8 or more shares a key."""
    texts = near_copies()
    sets = five_word_sets(texts)
    keys = {r.id: set(r["keys"]) for r in simhash.wide_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    near = [(i, i + 1) for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(near) > 30 and all(keys[a] & keys[b] for a, b in near)


def test_near_duplicates_are_exact(spark):
    """Groups are those of the exact Jaccard similarity: no pair of 0.8 or more apart, none below it joined."""
    texts = near_copies()
    sets = five_word_sets(texts)
    up = roots(len(texts), [(a, b) for a in texts for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    got = dict(simhash.near_duplicate_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert 30 < sum(up[i] != i for i in texts) < 90 and all(got[i] == up[i] for i in texts)


def test_line_dedup(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                docs[key(x)].add(i)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(docs[key(x)]) >= 3 and max(docs[key(x)]) != i)]
        want[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    got = linedup.drop_repeated_lines(edge, min_docs=3, batches=5)
    assert got.columns[: len(edge.columns)] == edge.columns
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want


def test_line_runs_compact_and_find_unseen(spark):
    runs = linedup.LineRuns(spark, fanout=2)
    texts = [(1, "a" * 50), (2, "b" * 50), (3, "a" * 50), (4, "c" * 50)]
    for t in texts:
        keys = linedup.LineRuns.keys(spark.createDataFrame([t], "doc_id long, text string"), 40)
        assert runs.unseen(keys).count() == (t[0] != 3)
        runs.add(keys)
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert sorted(r.n_docs for r in runs.table().collect()) == [1, 1, 2]


def test_line_runs_stay_in_a_folder(spark, tmp_path):
    """A later job opens the runs and adds its own; merged runs go once the manifest no longer names them."""
    folder = f"file://{tmp_path}/runs"
    keys = lambda i, t: linedup.LineRuns.keys(spark.createDataFrame([(i, t * 50)], "doc_id long, text string"), 40)
    for i, t in enumerate("abacaab"):
        runs = linedup.LineRuns(spark, fanout=2, folder=folder)
        assert runs.unseen(keys(i, t)).count() == (t not in "abacaab"[:i])
        runs.add(keys(i, t))
    runs = linedup.LineRuns(spark, fanout=2, folder=folder)
    assert [len(x) for x in runs.levels] == [1, 1, 1] and len([p for p in (tmp_path / "runs").iterdir() if p.name.startswith("run-")]) == 3
    assert sorted((r.n_docs, r.last_doc) for r in runs.table().collect()) == [(1, 3), (2, 6), (4, 5)]
    assert [(r.last_doc) for r in runs.doomed(3).collect()] == [5]


def test_mixing(edge, none, spark):
    got = mixing.mixed(edge).collect()
    assert len(got) == edge.count() and mixing.mixed(none).count() == 0
    sizes = Counter()
    for r in got:
        assert r.size == len(blank_words(r.text)) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
    total, cap, w = sum(sizes.values()), {}, {}
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        w[s], cap[s] = (5, 2, 1)[i % 3], 3 * sizes[s]
    target, open_ = {}, set(sizes)
    while True:  # what is above its cap stops there, and the rest is shared anew
        left = total - sum(target.values())
        over = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) > cap[s]]
        if not over:
            target |= {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
            break
        target |= {s: cap[s] for s in over}
        open_ -= set(over)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
    docs = spark.createDataFrame([(i, "w " * (1 + i * i % 97), f"s{i % 4}") for i in range(2000)], "doc_id long, text string, source string")
    a, b = mixing.mixed(docs).orderBy("doc_id").collect(), mixing.mixed(docs.repartition(13)).orderBy("doc_id").collect()
    assert a == b
    for s in {r.source for r in a}:
        mine = [r for r in a if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 50


def plain_hits(text, items):
    words = WORD8.findall((text or "").translate(UP))
    hit, found = set(), set()
    for item, t in items:
        iw = WORD8.findall((t or "").translate(UP))
        n = min(8, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_winnowing(edge, none, spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    items = [(10, base), (9, "GAMMA delta, epsilon zeta eta theta iota kappa!"), (8, "tau upsilon"), (7, None), (6, " . "), (5, "mit license"), (4, "one two three four five six seven eight nine"), (3, "東京")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = winnow.contamination(edge, bench).collect()
    assert Counter(r.id for r in rows) == Counter(r.doc_id for r in edge.collect())
    got = {r.id: r for r in rows}
    null = Counter((r.n_words, r.n_hit, tuple(r["items"])) for r in rows if r.id is None)
    assert null == Counter((n, h, tuple(i)) for r in edge.where("doc_id is null").collect() for n, h, i in [plain_hits(r.text, items)])
    kept = winnow.without_contaminated(edge, bench, 1)
    assert kept.columns == edge.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in edge.collect() if not plain_hits(r.text, items)[2])
    for r in edge.where("doc_id is not null").collect():
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g["items"]) == plain_hits(r.text, items), r.doc_id
        assert g.contaminated == (len(g["items"]) >= 2) and sum(s.end - s.start for s in g.spans) == g.n_hit
    assert winnow.contamination(none, bench).count() == 0
    assert all(r.n_hit == 0 for r in winnow.contamination(edge, bench.where("false")).collect())


def test_winnowing_random(spark):
    rng = np.random.default_rng(3)
    word = lambda: "abcdefghij"[rng.integers(0, 10)]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(20)]
    docs = []
    for i in range(40):
        w = [word() for _ in range(60)]
        own = items[rng.integers(0, 20)][1].split()
        at, n = rng.integers(0, 40), rng.integers(6, 13)
        w[at : at + n] = own[:n]
        docs.append((i, " ".join(w)))
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: plain_hits(t, items) for i, t in docs}


def test_substrings(edge, none):
    rows = [(r.doc_id, blank_words(r.text)) for r in edge.collect()]
    first = {}
    for i, w in rows:
        for j in range(len(w) - 12):
            if i is not None:
                k = tuple(w[j : j + 13])
                first[k] = min(first.get(k, i), i)
    want = Counter()
    for i, w in rows:
        gone = {p for j in range(len(w) - 12) if i is not None and first[tuple(w[j : j + 13])] < i for p in range(j, j + 13)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        want[(i, len(w), len(gone), " ".join(kept))] += 1
    for shard in (5000, 1):
        assert Counter((r.id, r.n_words, r.n_removed, r.kept_text) for r in substrings.drop_repeated_spans(edge, shard=shard).collect()) == want
    assert substrings.drop_repeated_spans(none).count() == 0


def test_suffix_automaton():
    rng = np.random.default_rng(1)
    for _ in range(200):
        seqs = [["abc"[k] for k in rng.integers(0, 3, rng.integers(4, 14))] for _ in range(4)]
        auto = substrings.SuffixAutomaton()
        for i, s in enumerate(seqs):
            auto.add(s, i)
        query = ["abc"[k] for k in rng.integers(0, 3, 15)]
        for q in [query, *seqs]:
            want = [next((i for i, s in enumerate(seqs) if any(s[a : a + 4] == q[j : j + 4] for a in range(len(s) - 3))), None) for j in range(len(q) - 3)]
            assert auto.earliest(q, 4) == want


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((6, 16))
    rows = [(i, (centre[i % 6] + 0.12 * rng.standard_normal(16)).tolist()) for i in range(90)]
    rows += [(90, rows[3][1]), (91, None), (92, [0.0] * 16), (93, [float("nan")] * 16), (94, [None] + [1.0] * 15), (95, [1.0, 2.0]), (96, [2.0, 4.0]), (97, [x * 3 for x in rows[4][1]]), (3, rows[3][1]), (98, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("none", "n")
    use = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    close = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    links = [(a, b) for a in range(len(use)) for b in range(len(use)) if a != b and close(use[a][1], use[b][1])]
    up = roots(len(use), links)
    least = {}
    for k, (i, _) in enumerate(use):
        least[up[k]] = min(least.get(up[k], i), i)
    want = Counter((i, sum(a == k for a, _ in links), least[up[k]]) for k, (i, _) in enumerate(use)) + Counter((i, 0, i) for i in (91, 92, 93, 94, 98))
    for bucket in (1000, 7):
        assert Counter((r.id, r.n_links, r.component) for r in sphere.linked_vectors(df, bucket=bucket).collect()) == want
    assert sphere.linked_vectors(df.where("false")).count() == 0


def meeting(a, b, code=sphere.CODE):
    """The share of the pairs (a[i], b[i]) that meet in a filter."""
    halves = sphere.code_of(a.shape[1], code)
    n = sphere.filters_for(halves, 0.9)
    return np.mean([not set(x.tolist()).isdisjoint(y.tolist()) for x, y in zip(sphere.decode(a, halves, n), sphere.decode(b, halves, n), strict=True)])


@pytest.mark.parametrize("dim, code", [(16, 512), (64, 512), (768, 512), (64, 2048)])
def test_cap_recall(dim, code):
    """Pairs of cosine 0.9, other ones than the number of filters was found with."""
    assert meeting(*sphere.pairs_at(0.9, dim, 1000), code) >= 0.96


def test_codes_grow_with_the_table():
    assert [sphere.code_size(n) for n in (0, 10**5, 10**6, 10**8, 10**12)] == [512, 512, 1024, 8192, sphere.MOST_CODE]


@pytest.mark.parametrize("dim", [64, 256])
@pytest.mark.parametrize("second", [0.3, 0.1, 0.0])
def test_cap_recall_of_uneven_halves(dim, second):
    """Pairs of cosine 0.9 whose second half carries little or nothing meet as often."""
    rng = np.random.default_rng(5)
    scale = np.where(np.arange(dim) < dim // 2, 1.0, second)
    a, n = rng.standard_normal((2, 500, dim)) * scale
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n -= (n * a).sum(1, keepdims=True) * a
    assert meeting(a, 0.9 * a + 0.19**0.5 * n / np.linalg.norm(n, axis=1, keepdims=True)) >= 0.95


def test_recall_of_the_whole_join(spark):
    """1,000 pairs just above the bound among 4,000 other vectors, in single precision: at least 0.95 are linked, and nothing else is."""
    rng = np.random.default_rng(11)
    a, b = sphere.pairs_at(0.9005, 48, 1000)
    rest = rng.standard_normal((4000, 48))
    vectors = np.concatenate((a, b, rest)).astype(np.float32).tolist()
    got = {r.id: (r.n_links, r.component) for r in sphere.linked_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")).collect()}
    assert len(got) == 6000 and np.mean([got[i] == (1, i) and got[1000 + i] == (1, i) for i in range(1000)]) >= 0.95
    assert all(got[i] == (0, i) for i in range(2000, 6000))


def test_double_vectors(spark):
    """The bound is kept in double precision, and neither great nor small numbers overflow."""
    side = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(1, [1.0, 0.0]), (2, side(0.900000002)), (3, side(-0.899999998)), (4, [-1.0, 0.0]), (5, [1e300, 0.0, 1e300]), (6, [1e300, 0.0, 1e300]), (7, [1e-60, 0.0, 1e-60, 0.0]), (8, [3e-60, 0.0, 3e-60, 0.0])]
    got = {r.id: (r.n_links, r.component) for r in sphere.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7)}


def test_one_group_of_near_copies(spark):
    """All links of a group count once, though its vectors share many filters and their buckets are cut into chunks."""
    rng = np.random.default_rng(4)
    rows = (rng.standard_normal(32) + 0.05 * rng.standard_normal((500, 32))).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    for bucket in (1000, 60):
        assert {(r.n_links, r.component) for r in sphere.linked_vectors(df, bucket=bucket).collect()} == {(499, 0)}


def test_tied_filters_are_kept():
    halves = [np.tile([[1.0, 0.0]], (40, 1)), np.tile([[0.0, 1.0]], (3, 1))]
    assert [len(x) for x in sphere.decode(np.array([[0.6, 0.8]]), halves, 24)] == [120]


def plain_blocks(text, templates, threshold=0.8):
    """Labels of the templates that some group of lines holds, and the greatest share, without any index."""
    lines = [set(WORD8.findall(x.translate(UP))) for x in (text or "").split("\n")]
    labels, most = set(), 0.0
    for label, t in templates:
        own = set(WORD8.findall(t.translate(UP)))
        size = licenses.LONG_LINES if len(own) >= licenses.LONG_FROM else licenses.SHORT_LINES
        for i in range(len(lines)):
            share = len(own & set().union(*lines[i : i + size])) / len(own)
            if share >= threshold - 1e-9:
                labels.add(label)
                most = max(most, share)
    return labels, most


def test_licenses(edge, none, spark):
    rng = np.random.default_rng(9)
    wrapped = []
    for i, (_, t) in enumerate(licenses.TEMPLATES * 3):  # wrapped at every few words, with some words changed
        w = t.split()
        for _ in range(int(rng.integers(0, 1 + len(w) // 6))):
            w[rng.integers(0, len(w))] = "zzz"
        n = int(rng.integers(3, 9))
        wrapped.append((100 + i, "intro words\n\n" + "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n)) + "\nmore\nwords here", "en", "a", 0))
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(wrapped, "doc_id long, text string, lang string, source string, n_chars long")).where("doc_id is not null").distinct()
    own = [("x", "alpha beta gamma"), ("x", "iota kappa lambda mu nu xi"), ("y", "quick brown lazy dog zzz"), ("z", ""), (None, "alpha")]
    for table, templates in ((None, licenses.TEMPLATES), (spark.createDataFrame(own, "label string, text string"), own[:3])):
        got = {r.id: r for r in licenses.scan(docs, templates=table).collect()}
        for r in docs.collect():
            words = WORD8.findall((r.text or "").translate(UP))
            want = sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
            g = got[r.doc_id]
            assert g.n_words == len(words) and [(p.word, p.label) for p in g.places] == want
            labels, most = plain_blocks(r.text, templates)
            assert {b.label for b in g.blocks} == labels and max([b.containment for b in g.blocks], default=0.0) == pytest.approx(most), r.text
            assert all(0 <= b.line and 1 <= b.lines <= licenses.LONG_LINES for b in g.blocks)
    assert licenses.scan(none).count() == 0


def test_license_join_is_exact():
    rng = np.random.default_rng(7)
    templates = [(f"t{i}", frozenset(f"w{k}".encode() for k in rng.choice(40, rng.integers(2, 12), replace=False))) for i in range(30)]
    counts = {f"w{k}".encode(): int(rng.integers(0, 100)) for k in range(40)}
    index = licenses.Index(templates, counts, 0.8)
    for _ in range(300):
        block = {f"w{k}".encode() for k in rng.choice(50, rng.integers(0, 30), replace=False)}
        assert sorted((index.templates[at][0], share) for at, share in index.found(block)) == sorted((k, len(t & block) / len(t)) for k, t in templates if len(t & block) / len(t) >= 0.8 - 1e-12)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.where("doc_id % 4 <> 2")
    got = {r.id: r for r in langid.identify(docs.withColumnRenamed("n_chars", "id"), train).collect()}
    test = docs.where("doc_id % 4 = 2").collect()
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in test]) >= 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "zzqx")], "doc_id long, text string")
    got = {r.id: r for r in langid.identify(odd, train).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und" and 0 <= got[4].score <= 1
    assert langid.identify(odd, train.where("false")).where("lang_pred <> 'und'").count() == 0


def plain_language(pairs, text):
    """The documented rule, word by word with loops: (log scores by language, number of words)."""
    letters = lambda t: [w for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    langs = sorted({lang for lang, _ in pairs})
    counts = {lang: Counter(w for x, t in pairs if x == lang for w in letters(t)) for lang in langs}
    met = sum(counts.values(), Counter())

    def logs(tables):
        known = set().union(*tables.values())
        return {k: [np.log((tables[x][k] + 1) / (sum(tables[x].values()) + len(known))) for x in langs] for k in known}

    words = logs({x: Counter({w: n for w, n in counts[x].items() if met[w] >= 2}) for x in langs})
    parts = []
    for n in range(1, 6):
        tables = {x: Counter() for x in langs}
        for x in langs:
            for w, k in counts[x].items():
                for g in [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]:
                    tables[x][g] += k
        parts.append(logs(tables))
    sums, own = np.zeros(len(langs)), letters(text)
    for w in own:
        if w in words:
            sums += words[w]
            continue
        for n in range(5, 0, -1):
            hit = [parts[n - 1][g] for g in [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] if g in parts[n - 1]]
            if hit:
                sums += np.mean(hit, axis=0)
                break
    return langs, sums, len(own)


def test_language_id_equals_the_plain_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    train = docs.where("doc_id < 60 and lang is not null")
    pairs = [(r.lang, r.text) for r in train.collect()]
    odd = spark.createDataFrame([(900, "zzqx vvv", None), (901, "12 ! 3", None), (902, None, None), (903, "the zzzzthe", None)], docs.schema)
    tested = docs.where("doc_id >= 150").unionByName(odd)
    got = {r.id: r for r in langid.identify(tested, train).collect()}
    for r in tested.collect():
        langs, sums, n = plain_language(pairs, r.text)
        if not n:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        assert got[r.doc_id].lang_pred == langs[int(sums.argmax())]
        assert got[r.doc_id].score == pytest.approx(1 / np.exp((sums - sums.max()) / n**0.5).sum(), rel=1e-9)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").where("doc_id < 6000") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.where("doc_id % 4 = 2").collect()}
    got = {r.id: r for r in crf.tag(docs.where("doc_id % 4 = 2"), docs.where("doc_id % 4 <> 2"), labels.where("doc_id % 4 <> 2")).collect()}
    hit = Counter((got[i].score >= 0.3, y) for i, y in known.items())
    assert hit[True, 1] / (hit[True, 1] + hit[False, 1]) > 0.75 and hit[True, 0] / (hit[True, 0] + hit[False, 0]) < 0.05
    text = docs.where("doc_id = 6").collect()
    assert text and all(0 <= s.start < s.end for r in got.values() for s in r.spans)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    assert {0 <= r.score < 0.3 for r in crf.tag(odd, docs, labels).collect()} == {True}
    assert crf.tag(odd, docs, labels.where("false")).count() == 3


def test_toxicity_score_equals_the_plain_rule(spark):
    """Scores are those of a field whose marginals are sums over all labellings of each sentence."""
    toxic = ["you scum talk trash", "what a scum. fine day", "trash trash scum", "scum here"] * 15
    clean = ["you talk of the day", "what a fine day. here we are", "we are here", "the day is fine"] * 15
    rows = [(i, t) for i, t in enumerate(toxic + clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i, _ in rows], "doc_id long, toxic int")
    field = crf.learned(docs, labels)
    assert {"=scum", "4scum", "=trash"} <= set(field.weights) and not {"=the", "=fine", "=day"} & set(field.weights)
    tested = spark.createDataFrame([(1, "Scum of the day. We talk"), (2, "we are fine"), (3, "a trash scum a scum\nscum"), (4, None), (5, "trashes here")], "doc_id long, text string")
    got = {r.id: r for r in crf.tag(tested, docs, labels).collect()}
    for r in tested.collect():
        most, spans = 0.0, []
        for s in re.split(r"[.!?\n]", (r.text or "").lower()):
            words = re.findall(r"[^\W\d_]+", s)
            own = [sum(field.weights.get(f, 0.0) for f in crf.features(w)) for w in words]
            z = {m: np.exp(sum((m >> k & 1) * (field.bias + own[k] + (field.start if k == 0 else 0)) for k in range(len(words))) + field.stay * sum((m >> k & 1) * (m >> k + 1 & 1) for k in range(len(words) - 1))) for m in range(1 << len(words))}
            for k in range(len(words)):
                p = sum(v for m, v in z.items() if m >> k & 1) / sum(z.values())
                if any(own):
                    most = max(most, p if own[k] else 0.0)
                    spans += [(words[k], p)] if p >= 0.5 else []
        odds = min(8.0, max(-8.0, np.log(max(most, 1e-9) / (1 - min(most, 1 - 1e-9)))))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-(field.level + field.slope * odds))), rel=1e-9)
        assert [(r.text.lower()[s.start : s.end], s.marginal) for s in got[r.doc_id].spans] == [(w, pytest.approx(p)) for w, p in spans]
    assert got[1].score > 0.5 > got[2].score and got[3].score > 0.5 and got[4].score == got[2].score
    kept = crf.clean(tested.withColumn("more", tested.doc_id * 2), field, 0.5)
    assert kept.columns == ["doc_id", "text", "more"] and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_learning_bounds(spark):
    """Long sentences are cut into sequences and none of their words is lost; bounds on features and sequences hold."""
    names = {"=x": 0}
    text = " ".join(["word"] * 70 + ["x"] * 3 + ["word"] * 60)
    got = list(crf.sequences(text, names))
    assert [len(s) for s in got] == [64, 64, 5] and sum(o == [0] for s in got for o in s) == 3
    train = spark.createDataFrame([(1, f"scum number {'abcdefgh'[i % 8] * 3}") for i in range(40)] + [(0, "fine day of it") for _ in range(40)], "y int, text string")
    assert len(crf.marking_features(train)) > 2 == len(crf.marking_features(train, 2))
    marked, each, plain = crf.training_sequences(train, ["=scum"], 10)
    assert len(marked) == 10 and each == 4.0 and plain == {4: 40}


def test_chain_marginals():
    f = crf.Field()
    f.bias, f.start, f.stay = -1.0, 0.3, 0.9
    extra = [None, 2.0, None, 1.0]
    emit = [f.bias + (x or 0) for x in extra]
    weights = {}
    for m in range(16):
        s = [m >> k & 1 for k in range(4)]
        weights[m] = np.exp(s[0] * f.start + sum(a * e for a, e in zip(s, emit, strict=True)) + f.stay * sum(a * b for a, b in zip(s, s[1:], strict=False)))
    total = sum(weights.values())
    assert f.marginals(extra) == pytest.approx([sum(w for m, w in weights.items() if m >> k & 1) / total for k in range(4)])


def test_warc_files_and_revisits(spark, tmp_path):
    rec = lambda i, kind, url, t, headers, body, digest="d": {"record_id": i, "kind": kind, "url": url, "time": t, "headers": headers, "digest": digest, "body": body}
    records = [
        rec("a", "response", "http://www.X.org:80/p/?b=2&utm_x=1&a=1#f", 20200101000000, {"etag": '"1"', "content-type": "text/html", "server": "s"}, b"one"),
        rec("b", "response", "https://x.org/p?a=1&b=2", 20200102000000, {"etag": '"2"', "content-type": "text/html"}, b"two"),
        rec("c", "revisit", "https://x.org/p?b=2&a=1", 20200101120000, {"etag": 'W/"1"', "content-type": "none", "age": "3"}, b""),
        rec("d", "revisit", "https://x.org/p?b=2&a=1", 20200103000000, {"etag": '"1"'}, b""),
        rec("e", "revisit", "https://y.org/", 20200103000000, {}, b"", None),
        rec("f", "revisit", "https://x.org/p?a=1&b=2", 20200101000000, {"etag": '"1"'}, b""),
    ]
    (tmp_path / "x.warc").write_bytes(b"".join(map(warc.format_warc, records)))
    back = warc.read_warc(spark, f"file://{tmp_path}/x.warc")
    assert sorted((r.record_id, r.kind, r.url, r.time, dict(r.headers), r.digest, bytes(r.body)) for r in back.collect()) == sorted(tuple(r.values()) for r in records)
    for bucket in (4096, 10**12):
        got = {r.record_id: (r.status, r.response_id, r.headers) for r in warc.resolve_revisits(back, bucket).collect()}
        assert got["c"] == ("resolved", "a", {"etag": 'W/"1"', "content-type": "text/html", "server": "s", "age": "3"})
        assert got["d"][:2] == ("mismatch", "b") and got["e"][:2] == ("none", None) and got["f"][:2] == ("none", None)
    odd = spark.createDataFrame([("1", "revisit", None, None, None, None), ("2", "response", "http://a/", None, {}, None), ("3", "revisit", "http://a", 5, None, None)], "record_id string, kind string, url string, time long, headers map<string,string>, digest string")
    got = {r.record_id: r.status for r in warc.resolve_revisits(odd).collect()}
    assert got == {"1": "none", "3": "unverified"}
    assert warc.resolve_revisits(odd.where("false")).count() == 0


def test_damaged_warc_files(spark, tmp_path):
    rec = lambda i, body=b"body", **more: {"record_id": i, "kind": "response", "url": "http://a/é", "time": 20200101000000, "headers": {"x-name": "näïve"}, "digest": None, "body": body} | more
    good = [warc.format_warc(rec(str(i), bytes([65 + i]) * 5000)) for i in range(5)]
    ids = lambda data: [r["record_id"] for r in warc.parse_warc(data)]
    assert ids(b"".join(good)) == ids(b"junk" + b"".join(good)) == list("01234")
    packed = [gzip.compress(g) for g in good]
    assert ids(b"".join(packed)) == list("01234") and ids(gzip.compress(b"".join(good))) == list("01234")
    assert ids(b"".join(packed)[:-40]) == list("0123")  # cut off
    assert ids(packed[0] + packed[1][:30] + b"\xff" * 40 + packed[2] + packed[3]) == ["0", "2", "3"]  # a broken member
    assert ids(good[0] + good[1].replace(b"Content-Length: ", b"Content-Length: x") + good[2]) == ["0", "2"]
    assert ids(good[0] + good[1][:-2000]) == ["0"] and ids(b"") == ids(b"\x1f\x8b") == ids(b"WARC/1.1") == ids(b"\x1f\x8b\x08") == []
    odd = next(warc.parse_warc(warc.format_warc(rec(None, time=None, url=None, headers=None, body=None))))
    assert (odd["record_id"], odd["time"], odd["url"], odd["headers"], odd["body"]) == (None, None, None, {}, b"")
    assert next(warc.parse_warc(good[0].replace(b"WARC-Date: 2020", b"WARC-Date: soon")))["time"] is None
    back = next(warc.parse_warc(good[0]))
    assert (back["url"], back["headers"], back["body"]) == ("http://a/é", {"x-name": "näïve"}, b"A" * 5000)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(packed)[:-40])
    (tmp_path / "b.warc").write_bytes(b"")
    assert sorted(r.record_id for r in warc.read_warc(spark, f"file://{tmp_path}").collect()) == list("0123")
