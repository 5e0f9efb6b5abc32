"""The pipeline's stages, each on what the one before kept, against plain versions."""

from collections import defaultdict

import corpus_pipeline
import pytest
from paneloom.llm import crf
from paneloom.llm.shared import cut
from test_operators import UP, blank_words, five_word_sets, plain_hits, roots

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def plain_lines(docs):
    """Lines with a key of 40 characters in 5 documents stay in the last of these; documents that only held such go."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    held = defaultdict(set)
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 5 or max(held[key(x)]) == i]
        if len(kept) == len(lines):
            out[i] = t
        elif blank_words("\n".join(kept)):
            out[i] = "\n".join(kept)
    return out


def plain_near(docs):
    ids = sorted(docs)
    sets = five_word_sets({i: docs[i] or "" for i in ids})
    near = [(a, b) for a in range(len(ids)) for b in range(a) if min(len(sets[ids[a]]), len(sets[ids[b]])) >= 0.8 * max(len(sets[ids[a]]), len(sets[ids[b]])) and len(sets[ids[a]] & sets[ids[b]]) >= 0.8 * len(sets[ids[a]] | sets[ids[b]])]
    up = roots(len(ids), near)
    return {i: docs[i] for k, i in enumerate(ids) if up[k] == k}


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    field = crf.learned(docs, labels)
    plain = {
        "drop_toxic": lambda d: {i: t for i, t in d.items() if field.score(field.spans(t, {})[0]) < 0.5},
        "line_dedup": plain_lines,
        "near_dedup": plain_near,
        "decontaminate": lambda d: {i: t for i, t in d.items() if not plain_hits(t, bench)[2]},
    }
    for name, stage in corpus_pipeline.STAGES:
        before = texts(docs)
        out = cut(stage(spark, docs, SF), name)
        if name == "mix":
            got = out.collect()
            assert {r.doc_id for r in got} == set(before) and all(r.size == len(blank_words(before[r.doc_id])) and r.taken == r.copies * r.size <= 3 * r.size for r in got)
            for s in {r.source for r in got}:
                mine = [r for r in got if r.source == s]
                assert abs(sum(r.taken for r in mine) - mine[0].target) <= max([r.size for r in mine])
        else:
            assert out.columns == docs.columns and texts(out) == plain[name](before)
            # later stages need documents with a benchmark passage and near copies to tell anything
            assert len(before) * 0.6 < out.count() <= len(before)
        docs = out
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


@pytest.mark.parametrize("copies", [7])
def test_planted_rows(spark, copies):
    """Near copies, repeated lines and a passage go; what isn't one stays."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 120").limit(1).collect()[0].text
    line = "a line of more than forty characters that many documents share"
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(80)) + f"\n{line}", "en", "s", 1) for i in range(copies)]
    rows += [(100 + i, " ".join(f"b{k}" for k in range(100)) + f" end{i}", "en", "s", 1) for i in range(3)] + [(200, f"before {bench} after", "en", "s", 1), (201, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lined = STAGE["line_dedup"](spark, docs, SF)
    assert {i for i, t in texts(lined).items() if t and line in t} == {copies - 1}
    near = STAGE["near_dedup"](spark, lined, SF)
    assert set(texts(near)) == {*range(copies), 100, 200, 201}
    assert set(texts(STAGE["decontaminate"](spark, near, SF))) == {*range(copies), 100, 201}


def test_edge_rows(spark, edge):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.count() > 0
    empty = edge.select("doc_id", "text", "lang", "source", "n_chars").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
