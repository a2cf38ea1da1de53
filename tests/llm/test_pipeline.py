import re

from pyspark.sql import functions as F

import corpus_pipeline
from tabula.llm import mixing
from tabula.llm.queries import MIX_SHARE, MIX_TARGETS, mix_dimensions
from tests.conftest import SF_SMALL
from tests.llm.test_bottomk import brute
from tests.llm.test_packing import check_layout
from tests.llm.test_pii import KINDS

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_against_brute_force(spark, documents):
    cols = documents.columns
    first = STAGES["language_id"](spark, documents, SF_SMALL)
    assert first.columns == cols
    rows = {r.doc_id: r for r in documents.collect()}
    kept = {r.doc_id: r for r in first.collect()}
    assert set(kept) == {i for i, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    known = [i for i in kept if rows[i].lang]
    assert sum(kept[i].lang == rows[i].lang for i in known) > 0.98 * len(known)

    second = STAGES["minhash_near_dedup"](spark, first, SF_SMALL)
    want = brute([(i, r.text) for i, r in kept.items()], 5)
    left = {r.doc_id: r for r in second.collect()}
    assert second.columns == cols and set(left) == {i for i, (_, c) in want.items() if i == c}

    third = STAGES["surrogates"](spark, second, SF_SMALL)
    new = {r.doc_id: r for r in third.collect()}
    assert third.columns == cols and set(new) == set(left)
    for i, r in left.items():
        found = [m for p in KINDS.values() for m in re.findall(p, r.text)]
        assert not any(m in new[i].text for m in found)
        assert found or (new[i].text == r.text)
        assert new[i].n_chars == (len(new[i].text) if found else r.n_chars)

    fourth = STAGES["source_mixture"](spark, third, SF_SMALL)
    marks = {r.doc_id: r.mix.drawn for r in mixing.mix(third, mix_dimensions(), MIX_TARGETS, MIX_SHARE).collect()}
    drawn = {r.doc_id for r in fourth.collect()}
    assert fourth.columns == cols and drawn == {i for i, d in marks.items() if d} and drawn

    last = STAGES["harmonic_packing"](spark, fourth, SF_SMALL).toPandas()
    assert set(last.doc_id) == drawn
    check_layout(last)
    per_doc = last.groupby("doc_id").agg(own=("length", "sum"), all=("doc_tokens", "first"))
    assert (per_doc.own == per_doc["all"]).all()


def test_odd_documents_pass_all_stages(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "123", "en", "s", 3), (4, "Some words of mine, a.bc1@d.example.com", None, None, 40), (None, "Words without an id", "en", "s", 19), (4, "Some words of mine, a.bc1@d.example.com", None, None, 40), (5, "x " * 50_000, "en", "src1", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "harmonic_packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            if name == "language_id":
                assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 4, 4, 5]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0


def test_documents_without_any_label_stay(spark):
    rows = [(1, "Some words", None, "s", 10), (2, "été", "", "s", 3), (3, "12 3", None, "s", 4), (4, None, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("lang", F.lit(None).cast("string"))
    out = STAGES["language_id"](spark, docs, SF_SMALL)
    assert out.columns == docs.columns and sorted((r.doc_id, r.lang) for r in out.collect()) == [(1, None), (2, None)]


def test_dedup_of_repeated_ids(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    near = text("a") + " end"
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (6, near), (6, text("c")), (7, text("d")), (7, text("d")), (8, None), (8, None), (None, text("a")), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = STAGES["minhash_near_dedup"](spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0, (r.text or "-")[0]) for r in out.collect()))
    assert got == [(0, "a"), (0, "a"), (1, "a"), (5, "b"), (6, "c"), (7, "d"), (8, "-")]
