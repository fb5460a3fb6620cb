"""Secrets without digits, trees without empty leaves, batches of the substring index that run twice."""

import numpy as np

from quarrymeter.llm import secrets, substrings

CASES = {
    "my token kQzVtRbNpLmWxYcDfGhJsAoE here": "kQzVtRbNpLmWxYcDfGhJsAoE",
    "Authorization: Bearer abcdEFGHijklMNOPqrstUVWXabKd": "abcdEFGHijklMNOPqrstUVWXabKd",
    "password = \"correct horse battery staple\" next": "correct horse battery staple",
    "api_key=QwErTyPlMnBvCxZaSdFg": "QwErTyPlMnBvCxZaSdFg",
    "the token internationalization of words is said": None,
    "see the ConfigurationManagerFactory class": None,
}


def test_secrets_without_digits(spark):
    texts = list(CASES)
    found = {t: [t.encode()[s:e].decode() for s, e in secrets.candidates(t.encode())] for t in texts}
    assert all(want in found[t] for t, want in CASES.items() if want)
    words = ["correct", "horse", "battery", "staple", "internationalization", "words", "configuration", "manager", "factory", "class", "next", "said", "here"] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, " ".join(words))], "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id].encode()[s.start : s.stop].decode() for s in r.spans] for r in secrets.scan(docs, secrets.model(docs)).collect() if r.doc_id < 100}
    assert got == {i: [want] if want else [] for i, want in enumerate(CASES.values())}


def test_no_tree_has_an_empty_side():
    low = 0.1
    x = np.array([[low]] * 10 + [[np.nextafter(low, 1)]] * 10)
    forest = secrets.grow(x, np.array([0.0] * 10 + [1.0] * 10))
    assert not np.isnan(forest.value).any() and forest.cut[forest.feature >= 0].max() == low
    many = secrets.train(secrets.labelled(2000))
    assert not np.isnan(many.value).any()


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    path = str(tmp_path / "index")
    text = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda df, **o: sorted(tuple(r) for r in substrings.remove_known(df, path, window=10, max_runs=2, **o).collect())
    one, two = frame((1, text(1)), (2, text(2))), frame((3, text(2)), (4, text(4)))
    assert [r[2] for r in run(one)] == [0, 0] and [r[2] for r in run(one)] == [0, 0]
    first = run(two, batch="two")
    assert [r[2] for r in first] == [30, 0] and run(two, batch="two") == first
    assert [r[2] for r in run(frame((5, text(5))), batch="three")] == [0]  # compacts
    assert run(two, batch="two") == first
    assert [r[2] for r in run(frame((6, text(4))), batch="four")] == [30]
    assert [r[2] for r in run(frame((1, text(1)), (2, text(2))), batch="other")] == [30, 30]  # another batch of the same rows
    assert substrings.FingerprintIndex(spark, path=path, keys=("h", "g")).batches[1:] == ["two", "three", "four", "other"]
    assert run(frame()) == []
