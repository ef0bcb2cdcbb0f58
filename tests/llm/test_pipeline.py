"""The corpus pipeline keeps clean documents once, and drops or cleans the others."""

import os
import random

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1.5, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, label string")


def made_up(tmp_path, spark, rows):
    """A folder with the tables that stages read beside their documents."""
    spark.createDataFrame([(0, "Which river crosses the border of the two old kingdoms in the north? The third one does so."), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(s != "junk"), 0) for i, _, s in rows if i is not None] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_with_nulls_ties_and_further_columns(spark, tmp_path):
    r = random.Random(1)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)).capitalize() + "."
    rows = [(i, prose(60), "good") for i in range(150)] + [(200 + i, "### $$$ %%% " * 20 + str(i), "junk") for i in range(60)]
    copy = rows[3][1]
    rows += [(300, copy), (301, copy + " x"), (302, rows[4][1] + " Which river crosses the border of the two old kingdoms in the north? The third one does so."), (303, "Write to ann.b@example.org or 10.0.0.1. " + prose(50))]
    rows = [(*x, "good") if len(x) == 2 else x for x in rows] + [(None, prose(60), "good"), (None, None, "good"), (7, rows[7][1], "good")]
    sf = made_up(tmp_path, spark, rows)
    docs = table_of(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "label"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = {x.doc_id: x for x in docs.collect()}
    assert {i for i in left if i is not None} == (set(range(150)) | {303})  # copies, junk and the benchmark's text are gone, clean documents stay
    assert left[303].text.startswith("Write to [EMAIL] or [IP].") and left[303].n_chars == len(left[303].text)
    assert left[None].text is None or left[None].text
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {x.doc_id for x in packed.select("doc_id").collect()} == set(left)


def test_stages_of_an_empty_table(spark, tmp_path):
    sf = made_up(tmp_path, spark, [])
    docs = table_of(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0 and len(docs.columns) == 7
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        ids, had = [r.doc_id for r in after.select("doc_id").collect()], {r.doc_id for r in before.select("doc_id").collect()}
        assert len(ids) == len(set(ids)) and set(ids) <= had and len(ids) > 0.5 * len(had), name
        path = f"{os.environ.get('TMPDIR', '/tmp')}/stage-{os.getpid()}-{name.split()[0]}"
        after.write.mode("overwrite").parquet(path)
        before = spark.read.parquet(path)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in before.collect()}
