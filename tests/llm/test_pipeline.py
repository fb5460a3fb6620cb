"""The pipeline against a plain run of its rules on one machine."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice(("th", "er", "ing", "and")) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, prose(80) if i % 3 else (prose(2).upper() + "!! ") * 30) for i in range(240)]
    item = prose(40)
    rows += [(1000, rows[1][1]), (1001, rows[1][1] + " end"), (1002, prose(50) + " " + item + " " + prose(50)), (1003, prose(60) + " password=7602ad27cf5550de1c " + prose(20)), (1004, None), (1005, "")]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    after = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        after[name] = {x.doc_id: x.text for x in docs.collect()}
    good = {i for i in range(240) if i % 3}
    assert len(good - set(after["quality"])) <= 2 and not {i for i in range(240) if i % 3 == 0} & set(after["quality"])
    assert not {1000, 1001} & set(after["near_dedup"]) and 1 in after["near_dedup"]
    assert set(after["near_dedup"]) - set(after["decontaminate"]) == {1002}
    assert set(after["secrets"]) == set(after["decontaminate"]) and "[SECRET]" in after["secrets"][1003]
    assert {x.doc_id for x in pipeline.run(spark, d).collect()} == set(after["secrets"])


def _write(spark, d, rows, columns, labels, items):
    spark.createDataFrame(rows, columns).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def test_stages_keep_clashing_columns_and_repeated_ids(spark, tmp_path):
    """Columns named like results of the operators keep names, types and values; rows that share an id are decided each on its own."""
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice(("th", "er", "ing", "and")) for _ in range(r.randint(1, 4))) for _ in range(n))
    a, b = prose(60), prose(60)
    texts = [(1, a), (1, b), (2, a), (3, None), (4, ""), (None, prose(30)), (5, "password=hunter2 " + prose(30)), (6, prose(30_000))]
    extra = ("score", "predicted", "key", "component_id", "kept", "train", "marks", "flags", "spans", "n")
    rows = [(i, t, *(f"{c}-{k}" for c in extra)) for k, (i, t) in enumerate(texts)]
    d = str(tmp_path / "clash")
    _write(spark, d, rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra), [], [(9, "none of these words")])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.dtypes == docs.dtypes, name
        got = out.collect()
        assert all(x[c] == f"{c}-{x['n'][2:]}" for x in got for c in extra), name
        docs = spark.createDataFrame(got, out.schema)
        if name == "quality":
            assert len(got) == len(rows)  # no labels: all score 0.5
        if name == "near_dedup":
            assert sorted((x.doc_id or 0, x.text or "") for x in got) == sorted((i or 0, t or "") for i, t in texts if (i, t) != (2, a))
    assert {x.doc_id: x.text for x in docs.collect()}[5].startswith("password=[SECRET] ")
    assert pipeline.tokenised(spark, docs, d).count() == len(texts) - 1


def test_stages_take_empty_tables(spark, tmp_path):
    d = str(tmp_path / "none")
    _write(spark, d, [], "doc_id long, text string, lang string, source string, n_chars long", [], [])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0
