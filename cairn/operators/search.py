"""Knowledge-base search (J2, J3), configuration findings (J4) and log
field filters (P5).

The reference hands search to a managed index; ranking is therefore our
choice: Okapi BM25 over lower-cased letter/digit terms.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import search_terms
from cairn.plans.guard import DEFAULT_MAX_BROADCAST_ROWS, broadcast_if_small, fits
from cairn.plans.partitioning import evaluate_once, spread
from cairn.session import write_stage

BM25_K1 = 1.2
BM25_B = 0.75
TOP_K = 10
SCORE_DIGITS = 6
MAX_BROADCAST_QUESTION_TERMS = 2_000_000
SEED_CASES = 4
"""Cases looked at for a question's lower bound, times k."""
SLACK = 1e-5
"""Above the rounding of scores."""


def case_tokens(cases: DataFrame, id_col: str = "case_id", text_col: str = "text") -> DataFrame:
    """One row ``(case_id, dl, term)`` per term of every case, and one with a NULL
    term per case, so lengths and the number of cases come out of the same counts."""
    # tokenising is the heavy step: spread a narrow scan over the cluster first
    docs = spread(cases.select(F.col(id_col).alias("case_id"), F.col(text_col)))
    docs = docs.select("case_id", search_terms(F.col(text_col)).alias("_terms"))
    docs = docs.withColumn("dl", F.when(F.col("_terms").isNotNull(), F.size("_terms")).cast("long"))
    marker = F.array(F.lit(None).cast("string"))
    terms = F.concat(F.coalesce(F.col("_terms"), F.array().cast("array<string>")), marker)
    return docs.select("case_id", "dl", F.explode(terms).alias("term"))


def case_counts(cases: DataFrame, id_col: str = "case_id", text_col: str = "text") -> DataFrame:
    """``counted(case_tokens(cases))`` of cases that all have different ids. A case's terms are
    sorted and counted in its own row, so a task holds one case at a time and not the terms of all of its cases."""
    docs = spread(cases.select(F.col(id_col).alias("case_id"), F.col(text_col)))
    docs = evaluate_once(docs, ["case_id"], {"terms": F.sort_array(search_terms(F.col(text_col)))})
    n = F.size("terms")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    docs = evaluate_once(docs, ["case_id", "terms"], {"starts": F.when(n > 0, first).otherwise(F.array().cast("array<int>"))})
    terms = F.transform("starts", lambda i, at: F.struct(
        F.get("terms", i).alias("term"), (F.coalesce(F.get("starts", at + 1), n) - i).cast("long").alias("tf")))
    marker = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf")))
    return docs.select("case_id", F.when(F.col("terms").isNotNull(), n).cast("long").alias("dl"), F.inline(F.concat(terms, marker)))


def counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("case_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(index: DataFrame) -> dict:
    """``{n, avgdl}`` from the NULL-term rows of an index."""
    known = F.when(F.col("dl").isNotNull(), F.col("tf"))
    row = index.where(F.col("term").isNull()).agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum(known)).alias("avgdl")).first()
    return {"n": int(row["n"] or 0), "avgdl": float(row["avgdl"] or 0.0)}


def index_cases(cases: DataFrame, id_col: str = "case_id", text_col: str = "text",
                vocabulary: DataFrame | None = None, broadcast_vocabulary: bool = False) -> tuple[DataFrame, dict]:
    """Postings ``(term, case_id, dl, tf)`` and corpus stats ``{n, avgdl}``.

    The text is read and tokenised once. With a ``vocabulary``
    (a ``term`` column), tokens outside it are dropped, map-side if it can be
    broadcast; the marker rows take no part in that join, so no key of it
    holds a row per document. The index is a table in the shared checkpoint
    folder that stats and scoring read instead of the text.
    """
    tokens = case_tokens(cases, id_col, text_col)
    if vocabulary is None:
        index = counted(tokens)
    elif broadcast_vocabulary:
        v = F.broadcast(vocabulary.select("term", F.lit(True).alias("_v")))
        index = counted(tokens.join(v, "term", "left").where(F.col("_v") | F.col("term").isNull()).drop("_v"))
    else:  # terms are counted per case first, so a frequent term is one row per case
        all_terms = write_stage(counted(tokens), "search-terms")
        known = all_terms.where(F.col("term").isNotNull()).join(vocabulary.select("term"), "term")
        index = known.unionByName(all_terms.where(F.col("term").isNull()))
    index = write_stage(index, "search-index")
    return index.where(F.col("term").isNotNull()), corpus_stats(index)


def question_terms(questions: DataFrame, id_col: str = "question_id", text_col: str = "text") -> DataFrame:
    """Distinct terms per question: ``(question_id, term)``."""
    return questions.select(F.col(id_col).alias("question_id"),
                            F.explode(F.array_distinct(search_terms(F.col(text_col)))).alias("term"))


def weigh(postings: DataFrame, stats: dict, k1: float, b: float, small_vocabulary: bool) -> DataFrame:
    """The contribution ``c`` of every posting to a score, ``(term, case_id, block, c)``.
    A block is the class of cases of about the same length (quarters of octaves): they
    share the length norm, so the largest contribution of a term in a block is close to all of them."""
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    df_q = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df_q.select("term", F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    # idf has one row per vocabulary term, so the check of the vocabulary bounds it too
    weighted = postings.join(F.broadcast(idf) if small_vocabulary else idf, "term")
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    c = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl)))
    return weighted.select("term", "case_id", F.floor(4 * F.log2(dl + 1)).cast("int").alias("block"), c.alias("c"))


def full_scores(pairs: DataFrame, weights: DataFrame, terms: DataFrame) -> DataFrame:
    """Whole scores of ``pairs`` (question_id, case_id). A broadcast hint on them holds."""
    found = weights.join(pairs, "case_id").join(broadcast_if_small(terms.select("question_id", "term")), ["question_id", "term"])
    return (found.groupBy("question_id", "case_id").agg(F.sum("c").alias("_s"))
            .withColumn("score", F.round("_s", SCORE_DIGITS)).drop("_s"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("case_id").asc())
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def pairs_to_score(weights: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """The pairs (question_id, case_id) that can be among a question's best ``k``:
    all others are proven to score less.

    1. Block maxima: the largest contribution of every question term per block.
    2. A lower bound of the k-th score: the cases that a question's strongest terms
       find are scored whole, and the k-th best of them counts.
    3. Per question and block, terms are taken from the weakest on; as long as their maxima add
       up to less than the bound, a case that has only these cannot reach it. Only postings of the
       other terms are read, and a pair stays if what they give, with the maxima of
       the weak ones, reaches the bound.
    4. The pairs that reach furthest are scored whole: their k-th best score is a
       better bound, which drops most of the others.
    """
    few = terms.select("question_id").distinct().count() * SEED_CASES * k <= DEFAULT_MAX_BROADCAST_ROWS

    def hint(df: DataFrame) -> DataFrame:  # for at most SEED_CASES * k narrow rows a question
        return F.broadcast(df) if few else df
    peaks = weights.groupBy("term", "block").agg(F.max("c").alias("peak"), F.count(F.lit(1)).alias("df"))
    peaks = write_stage(terms.join(broadcast_if_small(peaks), "term"), "search-peaks")
    strongest = peaks.groupBy("question_id", "term").agg(F.max("peak").alias("peak"), F.sum("df").alias("df"))
    down = Window.partitionBy("question_id").orderBy(F.desc("peak"), "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = strongest.withColumn("_found", F.coalesce(F.sum("df").over(down), F.lit(0))).where(F.col("_found") < SEED_CASES * k)
    first = weights.join(hint(seeds.select("question_id", "term")), "term")  # SEED_CASES * k terms at most, each found once
    first = first.groupBy("question_id", "case_id").agg(F.sum("c").alias("score"))
    first = _best(first, SEED_CASES * k).select("question_id", "case_id")
    bound = _best(full_scores(hint(first), weights, terms), k).where(F.col("rank") == k)
    bound = bound.select("question_id", (F.col("score") - SLACK).alias("bound"))
    up = Window.partitionBy("question_id", "block").orderBy("peak", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = peaks.join(hint(bound), "question_id", "left").withColumn("_sum", F.sum("peak").over(up))
    weak = F.coalesce(F.col("_sum") < F.col("bound"), F.lit(False))
    cut = write_stage(cut.select("question_id", "term", "block", "peak", "bound", weak.alias("weak")), "search-cut")
    rest = cut.where("weak").groupBy("question_id", "block").agg(F.sum("peak").alias("rest"))
    strong = cut.where("NOT weak").select("question_id", "term", "block", "bound").join(rest, ["question_id", "block"], "left")
    part = weights.join(broadcast_if_small(strong), ["term", "block"]).groupBy("question_id", "case_id").agg(
        F.sum("c").alias("part"), F.first("rest").alias("rest"), F.first("bound").alias("bound"))
    reach = (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("reach")
    part = part.select("question_id", "case_id", reach, F.coalesce("bound", F.lit(0.0)).alias("bound")).where("reach >= bound")
    part = write_stage(part, "search-reach", compression="zstd")
    # the pairs that reach furthest give a better bound for the others
    top = _best(part.select("question_id", "case_id", F.col("reach").alias("score")), SEED_CASES * k)
    better = _best(full_scores(hint(top.select("question_id", "case_id")), weights, terms), k).where(F.col("rank") == k)
    better = better.select("question_id", (F.col("score") - SLACK).alias("better"))
    part = part.join(hint(better), "question_id", "left")
    return part.where(F.col("better").isNull() | (F.col("reach") >= F.col("better"))).select("question_id", "case_id")


def kb_search(questions: DataFrame, cases: DataFrame, k: int = TOP_K, k1: float = BM25_K1,
              b: float = BM25_B, q_id: str = "question_id", c_id: str = "case_id") -> DataFrame:
    """Top ``k`` cases per question by BM25: ``(question_id, rank, case_id, score)``.

    The question vocabulary is broadcast (size-checked) into the document
    tokens, so postings are built only for question terms and are never
    shuffled by term alone: a term found in every document costs no skew.
    Only pairs that bounds leave (:func:`pairs_to_score`) are scored whole.
    Scores are rounded to 6 digits and ranked by (score
    desc, case_id asc); ``row_number() <= k`` is planned with a
    per-partition group limit before the final shuffle.
    """
    qt = question_terms(questions, q_id)
    vocab = qt.select("term").distinct()
    small_vocab = fits(vocab, MAX_BROADCAST_QUESTION_TERMS)
    postings, stats = index_cases(cases, c_id, vocabulary=vocab, broadcast_vocabulary=small_vocab)
    return _search(qt, postings, stats, k, k1, b, small_vocab)


def search_index(questions: DataFrame, index: DataFrame, k: int = TOP_K, k1: float = BM25_K1, b: float = BM25_B,
                 q_id: str = "question_id") -> DataFrame:
    """:func:`kb_search` over a stored index (case_id, dl, term, tf) instead of texts."""
    qt = question_terms(questions, q_id)
    vocab = qt.select("term").distinct()
    small_vocab = fits(vocab, MAX_BROADCAST_QUESTION_TERMS)
    postings = index.join(F.broadcast(vocab) if small_vocab else vocab, "term")
    return _search(qt, postings, corpus_stats(index), k, k1, b, small_vocab)


def _search(qt: DataFrame, postings: DataFrame, stats: dict, k: int, k1: float, b: float, small_vocab: bool) -> DataFrame:
    weights = write_stage(weigh(postings, stats, k1, b, small_vocab), "search-weights", compression="zstd")
    terms = write_stage(qt, "search-questions")
    pairs = write_stage(pairs_to_score(weights, terms, k), "search-pairs")
    return _best(full_scores(broadcast_if_small(pairs), weights, terms), k).select("question_id", "rank", "case_id", "score")


def kb_search_with_fallback(questions: DataFrame, expert: DataFrame, general: DataFrame,
                            min_score: float, k: int = TOP_K) -> DataFrame:
    """Search the expert corpus; questions without a hit scoring at least
    ``min_score`` are searched in the general corpus instead.
    Output: question_id, origin ('expert' | 'general'), rank, case_id, score."""
    # read three times below: computed once
    exp = write_stage(kb_search(questions, expert, k), "search-expert")
    answered = exp.where(F.col("score") >= min_score).select("question_id").distinct()
    unanswered = questions.join(answered, "question_id", "left_anti")
    gen = kb_search(unanswered, general, k)
    return (exp.join(answered, "question_id", "left_semi").withColumn("origin", F.lit("expert"))
            .unionByName(gen.withColumn("origin", F.lit("general")))
            .select("question_id", "origin", "rank", "case_id", "score"))


# --- J4 -----------------------------------------------------------------------

_OPS = {
    ">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t,
    "<=": lambda v, t: v <= t, "=": lambda v, t: v == t, "!=": lambda v, t: v != t,
}


def unpivot_facts(df: DataFrame, entity: str, properties: Sequence[str]) -> DataFrame:
    """Wide facts -> ``(entity, property, value double)``."""
    wide = df.select(F.col(entity).alias("entity"), *[F.col(p).cast("double").alias(p) for p in properties])
    return wide.unpivot("entity", list(properties), "property", "value")


def config_findings(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts checked against rules ``(rule_id, property, op, threshold, advice)``;
    a finding for every fact where ``value op threshold`` holds. The rules
    table is broadcast after a bounded size check.
    Output: entity, property, value, rule_id, advice."""
    r = broadcast_if_small(rules)
    j = facts.join(r, "property")
    v, t = F.col("value"), F.col("threshold")
    cond: Column = F.lit(False)
    for op, fn in _OPS.items():
        cond = F.when(F.col("op") == op, fn(v, t)).otherwise(cond)
    return j.where(cond).select("entity", "property", "value", "rule_id", "advice")


# --- P5 -----------------------------------------------------------------------

def log_field_filter(logs: DataFrame, json_col: str, fields: Mapping[str, object],
                     columns: Mapping[str, object] | None = None) -> DataFrame:
    """Keep log rows whose JSON fields (and plain columns) equal the given
    values. JSON values compare as their text (``{"k": 7}`` matches 7 and "7";
    ``true`` matches True and "true"); a field name is one key, dots included."""
    cond = F.lit(True)
    for name, value in fields.items():
        text = value if isinstance(value, str) else json.dumps(value)
        cond = cond & (F.get_json_object(F.col(json_col), f"$['{name}']") == F.lit(text))
    for name, value in (columns or {}).items():
        cond = cond & (F.col(name) == F.lit(value))
    return logs.where(cond)
