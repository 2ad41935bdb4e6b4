import os

import pytest
from pyspark.sql import functions as F

from cairn.plans import derive as D
from cairn.session import staging_path
from cairn.sources import files as FS
from cairn.sources import kb as KB
from cairn.sources.clusters import cluster_names
from cairn.sources.kb_index import CaseIndex
from cairn.sources.sheet import read_sheet


def test_kb_budget(spark, sf_small):
    docs = spark.read.parquet(os.path.join(sf_small, "documents.parquet"))
    ok = staging_path(spark, "kb-ok")
    FS.write_text_parts(D.kb_sheet_lines(docs), ok, "line", header=D.KB_HEADER, suffix=".csv")
    cases = KB.kb_sheet_scan(spark, ok)
    assert cases.count() == docs.count() - 1
    r3 = cases.join(docs.where("doc_id = 3").select(F.col("n_chars").cast("string").alias("solution")), "solution")
    assert r3.count() >= 1                                   # extra column ignored
    assert cases.where("solution IS NULL").count() == 1      # short row padded
    long_ = docs.where("text like '%\n%'").select("text").first().text
    assert cases.where(F.col("explanation") == long_).count() >= 1   # a multi-line cell
    over = staging_path(spark, "kb-over")
    FS.write_text_parts(D.kb_sheet_lines(docs, bad_ids=(7, 11)), over, "line", header=D.KB_HEADER, suffix=".csv")
    with pytest.raises(KB.BadRecordBudgetExceeded):
        KB.kb_sheet_scan(spark, over)


def test_one_sheet_file_is_read_by_several_tasks(spark):
    import random
    rnd = random.Random(2)
    words = ["alpha", 'say ""hi""', "line\nbreak", "crlf\r\nbreak", "\n\n", "comma, here", '""', "é漢😀", ""]
    rows = [",".join(f'"{" ".join(rnd.choices(words, k=rnd.randint(0, 6)))}"' for _ in range(rnd.choice([5, 5, 5, 4, 6]))) for _ in range(3000)]
    rows[70], rows[71], rows[72] = "plain,2024-01-01,,x,", "", "one"
    rows[1000] = '"' + "long\n" * 30_000 + '",2024-01-01,c,e,s'  # a cell over several blocks
    files = [("a.csv", ",".join(KB.KB_COLUMNS) + "\n" + "\n".join(rows) + "\n"), ("b.csv", "h\r\n" + "\r\n".join(rows[:500])),
             ("c.csv", "only,a,header,row,here"), ("d.csv", "")]
    root = staging_path(spark, "sheet")
    FS.write_named_files(spark.createDataFrame(files, "name string, content string"), root, "name", "content")
    schema = ", ".join(f"{c} string" for c in KB.KB_COLUMNS)
    want = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(root)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        assert spark.read.text(root, lineSep="\n").select(F.spark_partition_id()).distinct().count() > 10
        got = read_sheet(spark, root, KB.T.StructType.fromDDL(schema)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)

    def plain(found):  # Spark's reader keeps or changes line breaks in cells by those that end the file's lines
        return sorted((tuple(c and c.replace("\r\n", "\n") for c in r) for r in found), key=str)
    assert plain(got) == plain(want.collect()) and len(got) > 3400
    assert not any("\r" in c for r in got for c in r if c)


def _cases(spark, rows):
    return spark.createDataFrame(rows, "case_id long, explanation string")


def test_updated_index_equals_a_rebuilt_one(spark):
    from cairn.operators.search import case_tokens, counted
    index = CaseIndex(spark, staging_path(spark, "index"))
    states = [[(i, f"text {i % 7} of case {i}") for i in range(200)]]
    states.append(states[0][3:] + [(500, "new one"), (500, "new one"), (501, None), (502, "")])   # 3 gone, 3 new
    states.append(states[1][1:] + [(0, "text 0 of case 0")])                                      # one gone, one back again
    states.append(states[2])                                                                      # no change
    states.append(states[2][150:])                                                                # most are gone: merged
    done = []
    for s in states:
        done.append(index.update(_cases(spark, s)))
        want = counted(case_tokens(_cases(spark, list(dict(s).items())), "case_id", "explanation"))
        assert sorted(map(tuple, index.index().collect()), key=str) == sorted(map(tuple, want.select("case_id", "dl", "term", "tf").collect()), key=str)
    assert [(d["added"], d["removed"]) for d in done] == [(200, 0), (3, 3), (1, 1), (0, 0), (0, 150)]
    assert [k for _, k in index.versions()] == ["full"]


def test_a_version_that_was_not_written_to_the_end_does_not_count(spark):
    index = CaseIndex(spark, staging_path(spark, "index"))
    assert index.index().count() == 0
    index.update(_cases(spark, [(1, "a b")]))
    before = sorted(map(tuple, index.index().collect()), key=str)
    _cases(spark, [(1, "")]).select("case_id").write.parquet(f"{index.root}/part-1/gone")
    assert sorted(map(tuple, index.index().collect()), key=str) == before
    assert index.update(_cases(spark, [(1, "a b"), (2, "c")])) == {"added": 1, "removed": 0}


def test_files_and_driver_logs(spark):
    root = staging_path(spark, "files")
    files = spark.createDataFrame(
        [("a.pdf", b"%PDF"), ("b.png", b"\x89PNG"), ("c.txt", b"skip"),
         ("job-1/driveroutput.000000010", b"C"), ("job-1/driveroutput.000000000", b"A"),
         ("job-1/driveroutput.000000001", b"B"), ("job-1/other.log", b"x"),
         ("job-2/other.log", b"x"), ("job-1/sub/driveroutput.000000002", b"nested")],
        "name string, content binary")
    assert FS.write_named_files(files, root, "name", "content") == 9
    blobs = sorted((r.artifact_name, r.length) for r in FS.binary_files(spark, root).collect())
    assert blobs == [("a.pdf", 4), ("b.png", 4)]
    spaced = spark.createDataFrame([("job 4+é/driveroutput.000000000", b"D")], "name string, content binary")
    FS.write_named_files(spaced, root, "name", "content")
    jobs = spark.createDataFrame([(1, f"{root}/job-1/driveroutput"), (2, f"{root}/job-2/driveroutput"), (3, None),
                                  (4, f"{root}/job 4+é/driveroutput"), (5, "file:/elsewhere/job-5/driveroutput"),
                                  (6, f"{root}/job-6/driveroutput"), (7, f"{root}/job-1/sub/driveroutput"), (8, f"{root}/driveroutput")],
                                 "job_id long, output_uri string")
    got = {r.job_id: r.text for r in FS.driver_log_text(spark, jobs, root).collect()}
    assert got == {1: "ABC", 2: "", 3: None, 4: "D", 5: None, 6: None, 7: "nested", 8: ""}
    # a chunk that cannot be read: its job has no text, the others do
    import shutil
    path = f"{root.removeprefix('file:')}/job-1/driveroutput.000000001"
    shutil.copy(path, f"{path}.kept")
    broken = FS.DriverLogReader(root, 1)

    class Failing:
        def __init__(self, filesystem):
            self.inner = filesystem

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def open_input_stream(self, p):
            if p.endswith("000000001"):
                raise OSError("no permission")
            return self.inner.open_input_stream(p)
    filesystem, base = FS._filesystem(root)
    rows = list(broken._folder(Failing(filesystem), f"{base}/job-1", True))
    assert [(r[1], r[3]) for r in rows if r[3]] == [("driveroutput.000000001", "no permission")]
    assert list(broken._folder(filesystem, f"{base}/nowhere", True))[0][3]


def test_cluster_names_without_clusters_key(spark):
    listings = spark.createDataFrame([("p1", '{"clusters":[{"clusterName":"a"},{"clusterName":"b"}]}'),
                                      ("p2", "{}")], "listing_id string, body string")
    assert sorted(tuple(r) for r in cluster_names(listings).collect()) == [("p1", "a"), ("p1", "b")]


def test_records_go_across_groups_of_lines(spark, tmp_path, monkeypatch):
    from cairn.sources import sheet
    rows = [f'"p{i}","' + "\n".join(f'l{j} ""q""' for j in range(i % 7)) + '"' for i in range(200)]
    (tmp_path / "a.csv").write_text("\n".join(["h,t", *rows]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(["h,t", *reversed(rows)]) + "\n")
    monkeypatch.setattr(sheet, "LINES_PER_GROUP", 3)
    got = sorted(r.value for r in sheet.sheet_records(spark, str(tmp_path)).collect())
    assert got == sorted(2 * rows)


def _staged(spark):
    """Bytes of every folder staged so far."""
    from pathlib import Path
    root = Path(staging_path(spark, "x").removeprefix("file:")).parent
    return {f.name: sum(x.stat().st_size for x in f.rglob("*") if x.is_file()) for f in root.glob("*")}


def test_a_sheet_is_put_together_without_copies_of_it(spark, tmp_path):
    from cairn.sources.sheet import sheet_records
    rows = [f'"p{i}","' + "\n".join(f"line {i * j} of this text" for j in range(9)) + '"' for i in range(3000)]
    (tmp_path / "a.csv").write_text("\n".join(["h,t", *rows]) + "\n")
    before = _staged(spark)
    records = sheet_records(spark, str(tmp_path))
    assert sorted(r.value for r in records.collect()) == sorted(rows)
    assert sum(n for f, n in _staged(spark).items() if f not in before) < (tmp_path / "a.csv").stat().st_size / 10
    # only the pieces of records that lie in several blocks are shuffled: here none
    assert records._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


def test_reindexing_leaves_one_native_copy_and_the_index(spark, sf_small):
    from cairn import catalog
    before = _staged(spark)
    index = catalog._reindexed(spark, sf_small)
    left = sorted(f.rpartition("-")[0] for f in _staged(spark) if f not in before)
    assert [f for f in left if f.startswith("kb-") and f not in ("kb-ids", "kb-live")] == ["kb-index", "kb-native"]
    assert not [f for f in left if f.startswith("sheet-") and f not in ("sheet-blocks", "sheet-entered")]
    assert index.index().where("term IS NULL").count() > 100


def test_texts_are_found_alike_by_either_list_of_ids(spark, monkeypatch):
    from cairn.sources import kb_index
    rows = _cases(spark, [(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, None)])
    wanted, others = spark.createDataFrame([(1,), (3,), (None,)], "case_id long"), spark.createDataFrame([(2,)], "case_id long")
    for small in ((), (0,), (1,), (0, 1)):
        monkeypatch.setattr(kb_index, "fits", lambda df: any(df is (wanted, others)[i] for i in small))
        assert sorted(map(tuple, kb_index._rows_of(rows, wanted, others).collect())) == [(1, "a"), (3, None)], small
