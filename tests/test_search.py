import math
import re
from collections import Counter

from cairn.operators import search as SE


def _terms(t):
    return [w for w in re.split(r"[^\w]+|_", t.lower()) if w]


def test_bm25_matches_brute_force(spark):
    cases = [(1, "spark ui is on the history server"), (2, "executor logs are in cloud logging logs"),
             (3, "the driver log is in the jobs page"), (4, "nothing relevant here at all")]
    questions = [(10, "where are executor logs"), (11, "where is the spark ui")]
    got = {(r.question_id, r.case_id): (r.rank, r.score) for r in SE.kb_search(
        spark.createDataFrame(questions, "question_id long, text string"),
        spark.createDataFrame(cases, "case_id long, text string"), k=10).collect()}
    docs = {i: _terms(t) for i, t in cases}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    for qid, q in questions:
        scores = {}
        for term in set(_terms(q)):
            df = sum(term in d for d in docs.values())
            if not df:
                continue
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            for cid, d in docs.items():
                tf = Counter(d)[term]
                if tf:
                    scores[cid] = scores.get(cid, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avgdl))
        ranked = sorted(scores.items(), key=lambda kv: (-round(kv[1], 6), kv[0]))
        for rank, (cid, s) in enumerate(ranked, 1):
            assert got[(qid, cid)] == (rank, round(s, 6))


def test_fallback_origin_partitions_questions(spark):
    q = spark.createDataFrame([(1, "spark ui"), (2, "composer dag")], "question_id long, text string")
    expert = spark.createDataFrame([(1, "spark ui history server")], "case_id long, text string")
    general = spark.createDataFrame([(2, "composer dag failed"), (3, "spark")], "case_id long, text string")
    rows = SE.kb_search_with_fallback(q, expert, general, min_score=0.1).collect()
    origin = {}
    for r in rows:
        origin.setdefault(r.question_id, set()).add(r.origin)
    assert origin == {1: {"expert"}, 2: {"general"}}


def test_config_findings_and_log_filter(spark):
    facts = SE.unpivot_facts(spark.createDataFrame([(1, 50, 10.0), (2, 3, 999.0)], "id long, size int, price double"),
                             "id", ["size", "price"])
    rules = spark.createDataFrame([("A", "size", ">", 45.0, "big"), ("B", "price", ">=", 999.0, "dear")],
                                  "rule_id string, property string, op string, threshold double, advice string")
    assert sorted((r.entity, r.rule_id) for r in SE.config_findings(facts, rules).collect()) == [(1, "A"), (2, "B")]
    logs = spark.createDataFrame([(1, '{"k": 7}', "error"), (2, '{"k": 8}', "error"), (3, '{"k": 7}', "view")],
                                 "id long, props string, event_type string")
    assert [r.id for r in SE.log_field_filter(logs, "props", {"k": 7}, {"event_type": "error"}).collect()] == [1]


def test_bm25_corpus_stats_count_empty_and_null_texts(spark):
    # n counts every case; avgdl averages the cases that have a text ('' has length 0)
    cases = [(1, "spark ui is on the history server"), (2, "executor logs are in logs"),
             (3, "..."), (4, ""), (5, None)]
    questions = [(10, "executor logs"), (11, "spark history")]
    got = {(r.question_id, r.case_id): (r.rank, r.score) for r in SE.kb_search(
        spark.createDataFrame(questions, "question_id long, text string"),
        spark.createDataFrame(cases, "case_id long, text string"), k=10).collect()}
    docs = {i: _terms(t) for i, t in cases if t is not None}
    n, avgdl = len(cases), sum(map(len, docs.values())) / len(docs)
    want = {}
    for qid, q in questions:
        scores = {}
        for term in set(_terms(q)):
            df = sum(term in d for d in docs.values())
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            for cid, d in docs.items():
                tf = Counter(d)[term]
                if tf:
                    scores[cid] = scores.get(cid, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avgdl))
        ranked = sorted(scores.items(), key=lambda kv: (-round(kv[1], 6), kv[0]))
        want.update({(qid, cid): (rank, round(s, 6)) for rank, (cid, s) in enumerate(ranked, 1)})
    assert got == want


def test_bounds_leave_few_pairs_and_the_same_answers(spark):
    import random

    from cairn.session import write_stage
    rnd = random.Random(6)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    cases = [(i, " ".join(rnd.choices(common, k=rnd.randint(5, 60)) + rnd.choices(rare, k=rnd.randint(0, 6)))) for i in range(800)]
    cases += [(900 + i, "w1 w2 r7") for i in range(30)] + [(950, ""), (951, None)]  # ties
    questions = [(q, " ".join(rnd.sample(common, 6) + rnd.sample(rare, 5))) for q in range(20)] + [(30, "w1 w2"), (31, "r7"), (32, "zz"), (33, None)]
    qs = spark.createDataFrame(questions, "question_id long, text string")
    cs = spark.createDataFrame(cases, "case_id long, text string")
    got = sorted((r.question_id, r["rank"], r.case_id, r.score) for r in SE.kb_search(qs, cs, k=5).collect())
    docs = {i: _terms(t) for i, t in cases if t is not None}
    n, avgdl = len(cases), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    want, pairs = [], 0
    for qid, q in questions:
        scores = {}
        for term in set(_terms(q or "")):
            idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
            for cid, d in docs.items():
                tf = d.count(term)
                if tf:
                    scores[cid] = scores.get(cid, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avgdl))
        pairs += len(scores)
        ranked = sorted(scores.items(), key=lambda kv: (-round(kv[1], 6), kv[0]))[:5]
        want += [(qid, i, cid, round(s, 6)) for i, (cid, s) in enumerate(ranked, 1)]
    assert got == sorted(want)
    terms = SE.question_terms(qs)
    postings, stats = SE.index_cases(cs, vocabulary=terms.select("term").distinct(), broadcast_vocabulary=True)
    weights = write_stage(SE.weigh(postings, stats, SE.BM25_K1, SE.BM25_B, True), "weights")
    scored = SE.pairs_to_score(weights, terms, 5)
    assert scored.count() == scored.distinct().count() < pairs / 5


def test_terms_are_counted_case_by_case_without_gathering_them(spark):
    from cairn.operators.search import case_counts, case_tokens, counted
    rows = [(1, "b a B c a, a"), (2, None), (3, ""), (4, "..."), (5, "x"), (6, "Ünï ünï 7 07 7 " * 50), (None, "z z")]
    cases = spark.createDataFrame(rows, "case_id long, text string")
    got = case_counts(cases)
    want = counted(case_tokens(cases))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Sort" not in plan.replace("sort_array", "")
