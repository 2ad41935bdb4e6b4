import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm.packing import tokenizer_path
from tests.llm import test_ngram_join, test_suffix_dedup
from tests.llm.helpers import WORD, docs, empty, lower_az, odd_rows, sentence


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """Odd rows, near copies, repeats, leaks and toxic documents with their tables."""
    d = str(tmp_path_factory.mktemp("pipeline"))
    rows = odd_rows()
    base = [sentence(40 + k, 120).split() for k in range(4)]
    for i in range(40):
        w = base[i % 4][:]
        w[i % 120] = "changed"
        rows.append((100 + i, " ".join(w), "en", "s", 1))
    shared = sentence(77, 70)
    rows += [(200 + i, f"{sentence(600 + i, 40)} {shared} {sentence(900 + i, 40)}", "en", "s", 1) for i in range(10)]
    items = [(i, sentence(300 + i, 30) + ".\n" + sentence(350 + i, 6)) for i in range(10)]
    rows += [(300 + i, f"{sentence(400 + i, 50)} {items[i][1]} {sentence(450 + i, 50)}", "en", "s", 1) for i in range(5)]
    for i in range(240):
        text = sentence(2000 + i, 60)
        rows.append((1000 + i, text + (" grubzam" if i % 6 == 0 else ""), "en", "s", 1))
    labels = [(1000 + i, 1, int(i % 6 == 0)) for i in range(200)]
    df = docs(spark, rows).drop("key").withColumn("a.b", F.lit(1))
    df.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, inputs):
    docs_, steps = spark.read.parquet(f"{inputs}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs_.collect()
        out = stage(spark, docs_, inputs)
        assert out.columns == docs_.columns and out.dtypes == docs_.dtypes
        docs_ = corpus_pipeline.write_stage(out, name)
        steps[name] = (before, docs_.collect())
    before, after = steps["toxicity"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {1000 + i for i in range(0, 240, 6)}
    before, after = steps["ngram_jaccard"]
    groups = test_ngram_join.brute([(i, r.text) for i, r in enumerate(before)], 5, 80)
    assert len(after) == len({g for _, _, g, _ in groups})
    assert sum(r.text is None for r in after) == sum(r.text is None for r in before)
    before, after = steps["suffix_dedup"]
    want = {}
    for _, _, _, spans, _, kept in test_suffix_dedup.brute([(i, r.text) for i, r in enumerate(before)], corpus_pipeline.REPEAT_BYTES):
        want.setdefault(bool(spans), []).append(kept)
    texts = sorted((r.text or "").encode() for r in after)
    assert len(before) == len(after) and set(want[False]) <= set(texts) and len(want[True]) >= 10
    assert sorted(want[False] + want[True]) == texts  # no cut falls into a character here
    assert all(r.n_chars is None or r.n_chars == len(r.text or "") for r in after)
    before, after = steps["decontamination"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {300 + i for i in range(5)}


def test_run_packs_what_is_left(spark, inputs):
    pieces = corpus_pipeline.run(spark, inputs).collect()
    ids = {r.doc_id for r in pieces}
    assert not ids & ({1000 + i for i in range(0, 240, 6)} | {300 + i for i in range(5)})
    assert {1001, 10, 12} <= ids
    t = Tokenizer.from_file(tokenizer_path())
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{inputs}/documents.parquet").collect()}
    for r in pieces:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        if r.doc_id in (12, 1001):
            assert r.ids == (t.encode(source[r.doc_id], add_special_tokens=False).ids + [1])[r.start:r.start + r.length]


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        empty(spark, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_cut_keeps_whole_characters(spark):
    from cairn.llm.suffix_dedup import cut_repeats
    shared = "é漢" * 30
    rows = [(1, "aé" + shared + "x", "", "", 1), (2, "bï" + shared + "y", "", "", 1)]
    out = {r.doc_id: r.text for r in cut_repeats(docs(spark, rows), 41).collect()}
    assert out[1].startswith("a") and out[1].endswith("x") and len(out[1].encode()) < 12 and "�" not in out[1] + out[2]
    assert WORD.findall(lower_az("A b")) == ["a", "b"]


def test_rows_keep_their_numbers_when_splits_change(spark, tmp_path, monkeypatch):
    """Files are packed into one task by the job that finds copies, leaks and
    repeats, and into several by the job that removes them."""
    from cairn.llm import suffix_dedup
    passage = sentence(5, 80)
    rows = [(i, f"{sentence(5000 + i, 70)} {passage if i % 10 == 3 else ''}", "en", "s", 1) for i in range(90)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(0, 30, 10)]
    item = sentence(321, 30) + ".\n" + sentence(322, 6)
    rows += [(200 + i, f"{sentence(7000 + i, 40)} {item}", "en", "s", 1) for i in range(2)]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    conf = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}

    def split_anew(df, *args, write=corpus_pipeline.write_stage, **options):
        out = write(df, *args, **options)
        if args[0] in ("pipeline-near", "pipeline-leaks", "op5-spans"):
            for k in conf:
                spark.conf.unset(k)
        return out
    for module in (corpus_pipeline, suffix_dedup):
        monkeypatch.setattr(module, "write_stage", split_anew)

    def run(stage):
        for k, v in conf.items():
            spark.conf.set(k, v)
        try:
            return {r.doc_id: r.text for r in stage(spark, table, str(tmp_path)).collect()}
        finally:
            for k in conf:
                spark.conf.unset(k)
    source = {r[0]: r[1] for r in rows}
    left = run(corpus_pipeline.drop_near_copies)
    assert len(left) == 92 and set(left.values()) == set(source.values())
    assert set(source) - set(run(corpus_pipeline.drop_contaminated)) == {200, 201}
    cut = run(corpus_pipeline.cut_repeated)
    changed = {i for i in source if cut[i] != source[i]} - {200, 201}
    assert changed == {*range(3, 90, 10), 0, 10, 20, 100, 110, 120}
