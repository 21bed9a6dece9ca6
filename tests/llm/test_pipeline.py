"""Stages of the corpus pipeline on odd rows: nulls, empty texts, repeated rows, clashing names, empty tables."""

from __future__ import annotations

import random
import re
import zlib

import compare
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeside.llm import quality_gam
from lakeside.llm.oracles import ORACLES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, score double, bucket int, component_id long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    shared = prose(99, 30)
    texts = [(1, prose(1, 60)), (2, None), (3, ""), (4, prose(1, 60)), (5, "short"), (6, prose(6, 40) + " " + shared), (7, prose(7, 40) + " " + shared), (8, "é" * 30_000), (None, prose(9, 50)), (6, prose(6, 40) + " " + shared), (10, prose(10, 5000))]
    rows = [(i, t, None if i == 7 else "en", None if i == 4 else "s", None if t is None else len(t), True, "r", 0.0, i, 5) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def ids(df) -> list:
    return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is not None, i or 0))


def test_empty_table(spark, sf, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_quality_rules_stage(spark, sf, docs):
    out = corpus_pipeline.quality_rules_stage(spark, docs, sf)
    assert out.columns == docs.columns
    assert ids(out) == [None, 1, 4, 6, 6, 7, 10]


def test_classifier_stage(spark, sf, docs):
    out = corpus_pipeline.quality_classifier_stage(spark, docs, sf)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} <= {(r.doc_id, r.text) for r in docs.collect()}


def test_ngram_join_stage(spark, sf, docs):
    out = corpus_pipeline.ngram_join_stage(spark, docs, sf)
    assert out.columns == docs.columns
    assert ids(out) == [None, 1, 2, 3, 5, 6, 6, 7, 8, 10]  # 4 is a copy of 1


def test_suffix_dedup_stage(spark, sf, docs):
    out = corpus_pipeline.suffix_dedup_stage(spark, docs, sf)
    assert out.columns == docs.columns and ids(out) == ids(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert got[4].text == "" and got[4].n_chars == 0 and got[4].source is None
    assert got[8].text == "é" * 30_000 and got[10].text == prose(10, 5000)
    # the full stop before the shared passage is repeated with it
    assert got[7].text == prose(7, 40)[:-1] and got[6].text.endswith(prose(99, 30)) and got[7].n_chars == len(got[7].text)


def test_packing_stage(spark, sf, docs):
    rows = corpus_pipeline.packing_stage(spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    for doc in (2, 3):
        assert [(r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == doc] == [(0, 1, 1)]


def test_verdicts_and_copies_without_ids(spark, sf):
    shared = prose(98, 30)
    texts = [(None, prose(1, 60)), (None, prose(1, 60)), (None, "short"), (None, prose(2, 40) + " " + shared), (None, prose(3, 40) + " " + shared), (None, ""), (None, None), (5, prose(5, 60)), (5, "short"), (None, prose(5, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), True, "r", 0.0, 0, 0) for i, t in texts], COLUMNS).repartition(3)
    ruled = corpus_pipeline.quality_rules_stage(spark, docs, sf).collect()
    assert len(ruled) == 6 and all(r.text and len(r.text) > 100 for r in ruled)
    joined = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_join_stage(spark, docs, sf).collect()]
    # the first copies the second, the third and the last copy rows of document 5; null and empty texts are in no group
    assert sorted(joined, key=repr) == sorted([texts[1], *texts[3:9]], key=repr)
    cut = [r.text for r in corpus_pipeline.suffix_dedup_stage(spark, docs.filter(f"text like '%{shared}'"), sf).collect()]
    assert sum(t.endswith(shared) for t in cut) == 1 and len(cut) == 2


def test_run_equals_a_plain_pipeline(spark, sf):
    """All stages on a whole table against loops over its rows; the classifier's verdicts are its own, on its stage's input."""
    path = public_tokenizers.path("word_bpe_49k.json")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    passed = {i for i, kept in compare.connect(sf).execute(f"select doc_id, kept from ({ORACLES['op6_quality_rules']})").fetchall() if kept}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality_gam.classify(table.filter(table.doc_id.isin(*passed)), labels).collect() if r.predicted == 1}
    texts = {r.doc_id: r.text for r in table.collect() if r.doc_id in good}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and group[a] != group[b] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    stay = {i for i, g in group.items() if i == g}
    assert len(stay) < len(texts) < table.count()
    raw = {i: texts[i].encode() for i in stay}
    first: dict[bytes, int] = {}
    for i in sorted(stay):
        for k in range(len(raw[i]) - 49):
            first.setdefault(raw[i][k : k + 50], i)
    lib = Tokenizer.from_file(path)
    want = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        want[i] = [*lib.encode(text, add_special_tokens=False).ids, 1]
    pieces: dict = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert pieces.keys() == want.keys()
    for i, have in pieces.items():
        at = 0
        for start, n, crc, total in sorted(have):
            assert start == at and total == len(want[i]) and crc == zlib.crc32(np.array(want[i][at : at + n], "<u4").tobytes())
            at += n
        assert at == len(want[i])
