"""The pipeline against a brute-force version, stage by stage, on the smallest tables."""

from collections import Counter

import pytest

import corpus_pipeline
from riskloom.llm import mixing, quality, queries, simhash
from riskloom.llm.common import table
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_hits, brute_mix

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = {r.doc_id: r for r in table(spark, SMALL, "documents").collect()}
    model = quality.fit(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    kept = []
    for i, r in sorted(docs.items()):
        n, *_, repeats = quality.rules(r.text)
        if not quality.base_failed(n, repeats) and model.score(r.text) >= model.threshold:
            kept.append(i)
    prints = [brute_fingerprint(docs[i].text) for i in kept]
    first = {}
    for i, c in zip(kept, brute_components(prints), strict=True):
        first[c] = min(first.get(c, i), i)
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    clean = [i for i in sorted(first.values()) if not brute_hits(docs[i].text, items)[-1]]
    copies = Counter()
    for (_, i, _, _), n in brute_mix([(i, docs[i].text, docs[i].lang, docs[i].source, docs[i].n_chars) for i in clean], mixing.SHARD_WORDS).items():
        copies[i] += n
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r.doc_id for r in got) == copies
    assert all(r.text == docs[r.doc_id].text for r in got)
    assert corpus_pipeline.STAGES[-1][0] == "sharding" and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL)
        assert after.count() == 0
        if name != "sharding":
            assert after.columns == docs.columns


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"pipeline"}))
def test_queries_run(spark, name):
    """One row for each row of the query's table; for each conversation, and the one that is added, of op11."""
    found = queries.queries()[name](spark, SMALL)
    read = table(spark, SMALL, {"op5_html": "pages", "op11_chat": "conversations", "op12_codes": "embeddings"}.get(name, "documents"))
    rows = read.select("conv_id").distinct().count() + 1 if name == "op11_chat" else read.count()
    assert found.count() == rows


def test_fingerprints_of_the_tables(spark):
    for r in table(spark, SMALL, "documents").limit(30).collect():
        assert simhash.fingerprint(r.text) == brute_fingerprint(r.text)
