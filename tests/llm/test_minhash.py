import random

import pytest
from made_up_texts import prose

from loomline.llm import common, components, minhash


def sets_of(rows):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out.setdefault(d, set()).update([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    return out


def brute_force(sets):
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: root(d) for d in ids}


def family(n, seed=5):
    """Copies of one text with more and more words changed, so that links form chains."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    out = []
    for k in range(n):
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(200)] = f"c{rng.randrange(10**6)}"
        if rng.random() < 0.1:
            words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        out.append((1000 - k, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [7, 1024])
def test_components_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = family(120) + [(5000, "a b c"), (5001, "A  B\tc"), (5002, "a b"), (5003, ""), (5004, None), (5005, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = sets_of(rows)
    want = brute_force(sets)
    got = minhash.near_duplicates(docs, common.work_dir(spark)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(d, len(sets[d]), want[d], want[d] == d) for d in sets}


def test_small_table_against_brute_force(spark, small):
    docs = common.table(spark, small, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = sets_of(rows)
    want = brute_force(sets)
    got = minhash.near_duplicates(docs, common.work_dir(spark)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(s), want[d]) for d, s in sets.items()}


def test_odd_documents(spark, odd_docs):
    got = minhash.near_duplicates(odd_docs, common.work_dir(spark)).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[7].component_id == 6 and by[8].component_id == 6 and not by[8].kept and by[14].component_id == 9
    assert by[2].n_shingles == 0 and by[2].kept and by[4].n_shingles == 1 and by[5].n_shingles == 1
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert minhash.near_duplicates(odd_docs.limit(0), common.work_dir(spark)).count() == 0


def test_texts_of_one_id_keep_all_their_links(spark):
    a, b = prose(21, 90), prose(22, 90)
    rows = [(6, a), (6, b), (7, a + " more"), (8, b + " more"), (9, prose(23, 90))] + [(6, a)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(docs, common.work_dir(spark)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(6, 6), (7, 6), (8, 6), (9, 9)}


def test_chains_of_links(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 100), (201, 200), (200, 201)]
    got = components.components(spark.createDataFrame(links, "a long, b long"), common.work_dir(spark)).collect()
    assert sorted((r.id, r.component) for r in got) == sorted([(k, 0) for k in range(61)] + [(200, 200), (201, 200)])
    assert components.components(spark.createDataFrame([], "a long, b long"), common.work_dir(spark)).count() == 0
