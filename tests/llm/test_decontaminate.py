import random

from made_up_texts import prose

from loomline.llm import common, decontaminate


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_common_subsequence(monkeypatch):
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(1, 90))], [rng.randrange(6) for _ in range(rng.randrange(90))]
        for limit in (4096, 10):
            monkeypatch.setattr(decontaminate, "LONG_ITEM", limit)
            assert decontaminate.Masks(np.array(a)).subsequence(b) == lcs(a, b)


def words(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfgklmnprstvz')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprstvz')}{rng.randrange(200)}" for _ in range(n)]


def test_planted_items_are_found_and_others_are_not(spark):
    items = [words(k, 25) for k in range(30)]
    rows = []
    for k, w in enumerate(items):
        body = words(1000 + k, 400)
        changed = list(w)
        for at in (3, 11, 17):
            changed[at] = "other"
        half = w[:12] + words(5000 + k, 30)
        for j, part in enumerate((w, [x.upper() for x in w], changed, half, [])):
            rows.append((k * 10 + j, " ".join(body[: 37 * (j + 1)] + part + body[37 * (j + 1) :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, common.work_dir(spark)).collect()}
    assert got == {(k * 10 + j, k) for k in range(30) for j in (0, 1, 2)}


def test_items_of_common_words_are_searched_too(spark):
    text = prose(77, 30)
    docs = spark.createDataFrame([(k, prose(500 + k, 200) + (" " + text if k == 3 else "")) for k in range(40)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, text)], "item_id long, text string"), common.work_dir(spark)).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(3, 1)]


def test_small_table(spark, small):
    import re

    docs, bench = common.table(spark, small, "documents"), common.table(spark, small, "benchmark")
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in plain(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, common.work_dir(spark)).collect()}
    assert want and got == want


def test_odd_documents(spark, odd_docs):
    bench = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "one two", "x"), (3, prose(1, 80), "x"), (4, prose(1, 80), "x"), (5, "!!", "x")], "item_id long, text string, doc_id string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd_docs, bench, common.work_dir(spark)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(d, i) for d in (None, 6, 6, 7, 8) for i in (3, 4)]))
    assert decontaminate.contaminated(odd_docs.limit(0), bench, common.work_dir(spark)).count() == 0
    assert decontaminate.contaminated(odd_docs, bench.limit(0), common.work_dir(spark)).count() == 0


def test_altered_items_in_many_copies_are_found(spark):
    items = [words(k, 50) for k in range(40)]
    rng = random.Random(7)
    places = set(rng.sample(range(50), 10))
    changed = [words(90, 50)[k] if k in places else w for k, w in enumerate(items[0])]
    others = [w for k, w in enumerate(items[0]) if k in places]
    for copies in (40, 100, 285):
        rows = [(k, " ".join(words(2000 + k, 60) + (changed if k < copies else []) + words(5000 + k, 80) + ([others[k % 10]] if k >= copies else []))) for k in range(300)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, common.work_dir(spark)).collect()}
        assert got == {(k, 0) for k in range(copies)}


def test_a_benchmark_of_very_many_words(spark):
    """More distinct words than two bytes number, in one item and over all."""
    item = [f"w{k}" for k in range(70_000)]
    rows = [(1, "begin " + " ".join(item) + " end"), (2, " ".join(words(3, 500) + [f"s{k}" for k in range(30)])), (3, " ".join(words(4, 300)))]
    bench = [(1, " ".join(item)), (2, " ".join(f"s{k}" for k in range(30))), (3, " ".join(f"a-{k}" for k in range(70_000)))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, common.work_dir(spark)).collect()}
    assert got == {(1, 1), (2, 2)}


def test_cosines_in_latent_space_against_plain_matrices(spark):
    """The product that Spark sums up, and the candidates' cosines, from dense matrices of the same passages."""
    import numpy as np

    docs = [words(k, 20 + 7 * k) for k in range(30)]
    known = sorted({w for d in docs[:10] for w in d[:12]})
    place = {w: k for k, w in enumerate(known)}
    ids = [np.array([place.get(w, len(known)) for w in d], np.uint32) for d in docs]
    weight = np.append(np.linspace(1, 3, len(known)), 0.0)
    dense = []
    for d in ids:
        halves = [set(d[a : a + decontaminate.HALF].tolist()) - {len(known)} for a in range(0, len(d), decontaminate.HALF)]
        for k in range(max(1, len(halves) - 1)):
            row = np.zeros(len(known))
            for half in halves[k : k + 2]:
                row[list(half)] += weight[list(half)]
            dense.append(row)
    a = np.array(dense)
    p = decontaminate.Passages(ids, weight)
    vectors = np.random.RandomState(1).standard_normal((len(known) + 1, 5))
    vectors[-1] = 0
    assert np.allclose(p.project(vectors), a @ vectors[:-1])
    assert np.allclose(p.spread(p.project(vectors), len(known)), a.T @ a @ vectors[:-1])
    held = np.random.RandomState(2).randint(0, 2, (len(known) + 1, 9)).astype(np.uint8)
    held[-1] = 0
    window, item = map(np.ravel, np.meshgrid(range(len(p.start)), range(9), indexing="ij"))
    reach = np.arange(9) % 4
    want = []
    for w, i in zip(window, item, strict=True):
        doc = p.doc[w]
        at = (p.start[w] - p.first[doc]) * decontaminate.HALF
        low, high = max(0, at - reach[i] * decontaminate.HALF), at + (2 + reach[i]) * decontaminate.HALF
        d = ids[doc]
        want.append(sum(held[x, i] for b in range(low, min(high, len(d)), decontaminate.HALF) for x in set(d[b : b + decontaminate.HALF].tolist())))
    for sums in (1 << 22, 50):
        decontaminate.SUMS, before = sums, decontaminate.SUMS
        assert p.shared_terms(window, item, reach, held).tolist() == want
        decontaminate.SUMS = before
