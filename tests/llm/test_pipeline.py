import os

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowloom.llm.queries import BYTE_BPE
from tests.llm.test_components_by_hand import roots_of
from tests.llm.test_decontamination import plain as plain_contaminations
from tests.llm.test_near_documents import plain_links
from tests.llm.test_simhash import plain as plain_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_stages_do_what_their_operators_find(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash near-dedup", "benchmark decontamination", "source mixing", "token output"]
    text = {r.doc_id: r for r in docs.collect()}

    civil = stages["toxicity"](spark, docs, SF)
    assert civil.columns == docs.columns and 0 < civil.count() <= docs.count()
    assert all(text[r.doc_id] == r for r in civil.collect())

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    single = stages["simhash near-dedup"](spark, docs, SF)
    assert single.columns == docs.columns
    links = [(int(a), int(root)) for a, _, root in plain_groups(rows, width=5) if a != root] + plain_links(rows)
    roots = roots_of(links)
    assert sorted(r.doc_id for r in single.collect()) == sorted(a for a, _ in rows if roots.get(a, a) == a)

    clean = stages["benchmark decontamination"](spark, docs, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = [r for r in rows if len(r[1] or "") < 2500]
    dirty = {a for a, *_ in plain_contaminations(short, items)}
    kept = {str(r.doc_id) for r in clean.collect()}
    assert {str(a) for a, _ in short} - kept == dirty and clean.columns == docs.columns

    mixed = stages["source mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} == set(text)

    out = stages["token output"](spark, docs, SF).orderBy("start").collect()
    model, start = Tokenizer.from_file(BYTE_BPE), 0
    assert [r.doc_id for r in out] == sorted(text)
    for r in out:
        n = len(model.encode(text[r.doc_id].text or "", add_special_tokens=False).ids) + 1
        assert (r.start, r.n_tokens) == (start, n)
        start += n


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns)
