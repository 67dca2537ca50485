import re

from loomline.llm import common, licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p)
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


TEXTS = ["mit license mit  License", "License", "GNU General Public License, version 3. apache-license", "the İmit license", "Licensed under CC BY-NC 4.0.", "x " * 500 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "general license public license mit", "Licensed under the Apache License, Version 2.0.", "license " * 3000]


def test_base_columns(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string"))
    got = licenses.scan_licenses(docs, common.work_dir(spark)).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(repr((r.doc_id, *expected(r.text))) for r in docs.collect())
    labels = {r.doc_id: r.labels for r in got}
    assert labels[104] == "cc-by-nc-4.0" and labels[105] == "mit-text" and labels[107] == "apache,apache-2.0" and labels[101] == "" and labels[102] == "apache,gpl,gpl-3.0"
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    assert licenses.scan_licenses(odd_docs, common.work_dir(spark)).count() == odd_docs.count()
    assert licenses.scan_licenses(odd_docs.limit(0), common.work_dir(spark)).count() == 0


def test_small_table(spark, small):
    docs = common.table(spark, small, "documents")
    got = licenses.scan_licenses(docs, common.work_dir(spark)).collect()
    assert {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {(r.doc_id, *expected(r.text)) for r in docs.collect()}


def test_only_files_with_a_whole_key_word_are_looked_up(spark):
    texts = ["asado licensedness unlicensed", "a public thing", "the License of it"] + ["of the and to"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = common.work_dir(spark)
    assert licenses.scan_licenses(docs, folder).count() == len(texts)
    assert [r.doc_id for r in spark.read.parquet(f"{folder}/files").collect()] == [2]


def test_every_license_of_a_bundle_is_found(spark):
    whole = {label: text for label, _, text in reversed(licenses.TEMPLATES)}
    bundle = " ".join(whole[k] for k in ("mit-text", "apache-2.0", "gpl-3.0")) + " " + whole["cc-by-4.0"] + " " + whole["mit-notice"]
    docs = spark.createDataFrame([(0, bundle), (1, "x " * 900 + " ".join(whole.values()))] + [(k, "plain words") for k in range(2, 9)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, common.work_dir(spark)).collect()}
    assert {"mit-text", "apache-2.0", "gpl-3.0", "cc-by-4.0", "mit-notice"} <= set(got[0].labels.split(","))
    assert set(whole) <= set(got[1].labels.split(",")) and got[0].score == got[1].score == 1 and got[2].labels == ""


def test_labels_and_scores_by_brute_force(spark, small):
    """Every phrase looked for at every place of every text, with frequencies and shares computed apart."""
    import math

    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    whole = " ".join(text for _, _, text in licenses.TEMPLATES)
    more = TEXTS + [whole, "free software foundation " + whole[200:], " ".join(p for _, p, _ in licenses.TEMPLATES), "redistribution and use in source or binary forms"]
    docs = common.table(spark, small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    vocabulary = {w for _, _, t in licenses.TEMPLATES for w in t.split()}
    idf = {w: math.log((len(texts) + 1) / (sum(w in t for t in map(set, texts.values())) + 0.5)) for w in vocabulary}
    seen = set()
    for r in licenses.scan_licenses(docs, common.work_dir(spark)).collect():
        w, labels, score = texts[r.doc_id], set(), 0.0
        for phrase, label in licenses.BASE.items():
            if any(tuple(w[k : k + len(phrase)]) == phrase for k in range(len(w))):
                labels.add(label)
                score = max(score, 0.5)
        for label, phrase, text in licenses.TEMPLATES:
            key, body = phrase.split(), text.split()
            at = next(p for p in range(len(body)) if body[p : p + len(key)] == key)
            for k in range(len(w) - len(key) + 1):
                if w[k : k + len(key)] == key:
                    labels.add(label)
                    stands = sum(idf[x] for p, x in enumerate(body) if 0 <= k - at + p < len(w) and w[k - at + p] == x)
                    score = max(score, stands / sum(idf[x] for x in body))
        seen |= labels
        assert r.labels == ",".join(sorted(labels)) and math.isclose(r.score, min(1.0, score), abs_tol=1e-9)
    assert {label for label, _, _ in licenses.TEMPLATES} <= seen
