"""Properties on generated texts: the narrowed plan is the full plan, and ranking needs no snippet."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import grams, search

from .test_functions import python_score

WORDS = st.lists(st.sampled_from(["the", "cat", "été", "ÉTÉ", "a", "concat", "ca t", "x.y", "the-cat", "\n", ""]), max_size=12).map(" ".join)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(texts=st.lists(WORDS, min_size=1, max_size=8), query=st.sampled_from(["the cat", "été", "cat concat", "a", "x.y the", "the the"]))
def test_narrowed_is_full(spark, texts, query):
    df = spark.createDataFrame([(k % 3, t) for k, t in enumerate(texts)], "path long, text string")
    full = search.score_texts(df, query, ["path"])
    fast = search.score_texts(grams.narrowed(df, grams.build(df, ["path"]), query, ["path"]), query, ["path"])
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, fast.collect()))


@FEW
@given(texts=st.lists(WORDS, min_size=1, max_size=8), query=st.sampled_from(["the cat", "été", "a"]))
def test_score_is_the_sum_over_snippets(spark, texts, query):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "path long, text string")
    by_snippet = search.matching_texts(df, query).select("path", F.aggregate("matches", F.lit(0.0), lambda a, m: a + m["score"]).alias("s"), F.size("matches").alias("n"))
    want = {r["path"]: (r["s"], r["n"]) for r in by_snippet.where("n > 0").collect()}
    got = {r["path"]: (r["text_score"], r["n_matches"]) for r in search.score_texts(df, query, ["path"]).collect()}
    assert got == want
    scores = [r["s"] for r in df.select(T.score_match(F.col("text"), query).alias("s")).collect()]
    assert scores == [python_score(t, query) for t in texts]
