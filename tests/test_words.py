from pyspark.sql import functions as F

from cairn.operators import words as W
from cairn.plans import wordcount_job
from cairn.sources.text import document_lines


def _words(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return [r.word for r in W.tokenize(df).collect()]


def test_tokenize_keeps_empties_case_and_punctuation(spark):
    assert _words(spark, [""]) == [""]
    assert _words(spark, [",a,,b "]) == ["", "a", "b", ""]
    assert _words(spark, ["Hi hi! x\x0by\tz"]) == ["Hi", "hi!", "x", "y", "z"]
    # no length filter, despite the comment in the reference job
    assert _words(spark, ["a bb ccc"]) == ["a", "bb", "ccc"]


def test_document_lines_like_the_text_source(spark):
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, "a\r\nb\rc"), (3, "x\n\n\n"), (4, "")],
                                 "doc_id long, text string")
    got = {}
    for r in document_lines(docs).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.value))
    assert got[1] == [(1, "a"), (2, "b")]
    assert got[2] == [(1, "a"), (2, "b"), (3, "c")]
    assert got[3] == [(1, "x"), (2, ""), (3, "")]
    assert got[4] == [(1, "")]


def test_counts_sum_to_tokens_and_threshold_is_strict(spark):
    lines = spark.createDataFrame([("a a b",), ("a, c",)], "value string")
    words = W.tokenize(lines)
    counts = W.word_count(words)
    assert counts.agg(F.sum("count")).first()[0] == words.count()
    assert [r.word for r in W.frequent_words(counts, 2).collect()] == ["a"]
    assert W.frequent_word_count(counts, 3).first()[0] == 0
    assert W.distinct_word_count(counts).first()[0] == 3


def test_top_words_ties_break_by_word(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "word string, count long")
    assert [r.word for r in W.top_words(counts, 3).collect()] == ["c", "a", "b"]


def test_wordcount_job_end_to_end(spark, capsys):
    lines = spark.createDataFrame([("x y x",), ("y x",)], "value string")
    res = wordcount_job.run(spark, lines, threshold=2, log=lambda s: None)
    assert res["distinct_words"] == 2 and res["frequent_words"] == 1 and res["partitions"] >= 1
    assert wordcount_job.main(["wordcount_job"]) == -1
    assert "cairn.plans.wordcount_job" in capsys.readouterr().err


def test_partition_report_counts_empty_partitions(spark):
    assert tuple(W.partition_report(spark.range(3).repartition(6)).first()) == (6, 3)
