import pytest

from hashlode import api
from hashlode.operators import postings as P
from hashlode.operators import registry as R
from hashlode.operators import search as S
from hashlode.plans.query_language import QueryError, parse, parse_leniently, terms

COLUMNS = "info_hash string, title string, magnet string, seeders long"


def index(spark, *rows):
    return spark.createDataFrame([(h, t, "", s) for h, t, s in rows], COLUMNS)


def titles(df):
    return [r.title for r in df.collect()]


def test_all_words_beat_popularity(spark):
    i = index(spark, ("a" * 40, "Matrix 1080p", 10000), ("b" * 40, "The Matrix 1999 1080p", 5))
    assert titles(S.search(i, "matrix 1999", 0, 10)) == ["The Matrix 1999 1080p"]


def test_typo(spark):
    i = index(spark, ("c" * 40, "The Matrix 1999", 1))
    assert titles(S.search(i, "matrx 1999", 0, 10)) == ["The Matrix 1999"]


def test_hash_queries_come_first(spark):
    i = index(spark, ("deadbeef" + "0" * 32, "x", 2), ("1" * 40, "deadbeef", 2))
    assert titles(S.search(i, "DEADBEEF")) == ["x"] and titles(S.search(i, "1" * 40)) == ["deadbeef"] and not titles(S.search(i, "20240101"))


def test_empty_queries(spark):
    i = index(spark, ("1" * 40, "a b", 2))
    assert not titles(S.search(i, "  ")) and not titles(S.search(i, "a", 0, 0)) and not titles(S.search(i, "..."))


def test_grammar(spark):
    i = index(spark, ("1" * 40, "the matrix reloaded", 2), ("2" * 40, "matrix the", 2), ("3" * 40, "other reloaded", 2))
    get = lambda q: sorted(titles(S.search(i, q)))
    assert get('"the matrix"') == ["the matrix reloaded"] == get("the.matrix") == get("+matrix +reloaded") == get("matrix -\"matrix the\"")
    assert get("matrix OR other") == ["matrix the", "other reloaded", "the matrix reloaded"]
    assert get("(matrix OR other) AND reloaded") == ["other reloaded", "the matrix reloaded"]
    assert get("NOT matrix other") == ["other reloaded"] and get("title:other^2") == ["other reloaded"]
    assert get('"the reloaded"~1') == ["the matrix reloaded"] and get('"the mat"*') == ["the matrix reloaded"] and len(get("*")) == 3
    assert get("info_hash:" + "3" * 40) == ["other reloaded"]


def test_grammar_tiers():
    for bad in ("(a", "a)", "a AND", "seeders:3", "OR a"):
        with pytest.raises(QueryError):
            parse(bad)
    assert terms(parse_leniently("seeders:3")) == ["seeders", "3"] and terms(parse_leniently("(a AND")) == ["a", "and"] and parse_leniently("()") is None


def test_pages_are_cut_from_the_pool(spark):
    i = index(spark, *((f"{k:040x}", "same", k) for k in range(2, 60)))
    first, second = S.search(i, "same", 0, 10), S.search(i, "same", 10, 10)
    assert not {r.info_hash for r in first.collect()} & {r.info_hash for r in second.collect()}
    assert S.search(i, "same", 1990, 10).count() == S.search(i, "same", 1991, 10).count() == 0
    assert S.query_plan_pool(1991, 10) == 2001 and S.query_plan_pool(0, 10) == 100 and S.query_plan_pool(0, 300) == 2000
    assert S.page_limit(None) == 25 and S.page_limit(500) == 200 and S.page_limit(0) == 1 and S.more_limit(190) == 200
    hits, more = api.search_page(i, "same", 20)
    assert len(hits) == 20 and more


def test_only_active_rows_are_searched(spark):
    rows = [("1" * 40, "a", None, 1, None, 0, 0), ("2" * 40, None, " ", 2, None, 0, 0)]
    reg = spark.createDataFrame(rows, "info_hash string, title string, magnet string, seeders long, info_b64 string, first_seen_ms long, last_seen_ms long")
    assert [tuple(r) for r in R.index_rows(reg).collect()] == [("2" * 40, "Torrent " + "2" * 40, "magnet:?xt=urn:btih:" + "2" * 40, 2)]
    assert api.search_api(reg, "a") == [] and api.search_api(reg, None) == [] and len(api.search_api(reg, "torrent")) == 1


def test_postings_answer_as_the_scan_does(spark):
    i = index(spark, ("1" * 40, "the matrix reloaded the end", 2), ("2" * 40, "matrix the", 9), ("3" * 40, "other reloaded", 2), ("4" * 40, None, 5), ("5" * 40, "", 5), ("abcdef12" + "0" * 32, "matrx", 3), ("6" * 40, "a a a", 2))
    post, stats = S.build_postings(i).cache(), S.corpus_stats(i)
    for q in ("the", '"the matrix"', '"the end"', '"a a"', "matrix -reloaded", "reloaded OR matrix^4", "-the", "matrixx", "abcdef13 matrx", "abcdef12", "*", '"matrix reloa"*', '"matrix end"~3', "...", " ", "nothing like it", "a matrx"):
        want = [(r.info_hash, round(r.score, 9)) for r in S.search(i, q, with_score=True).collect()] if q.strip() else []
        page = P.search_postings(post, i, stats, q, with_score=bool(q.strip()))
        assert [(r.info_hash, round(r.score, 9)) for r in page.collect()] == want, q


def test_only_postings_of_the_words_are_read(spark, tmp_path):
    S.build_postings(index(spark, ("1" * 40, "the matrix", 2))).write.parquet(f"{tmp_path}/postings")
    post = spark.read.parquet(f"{tmp_path}/postings")
    stats = spark.createDataFrame([(1, 2.0)], "n_docs long, avg_len double")
    plan = P.word_matches(post, stats, parse('"the matrix" other'))._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan and "tf:" not in plan


def test_upsert_replaces_and_removes(spark):
    i = index(spark, ("1" * 40, "old words", 2), ("2" * 40, "gone", 2), ("3" * 40, "stays", 2))
    new = index(spark, ("1" * 40, "new words", 2), ("9" * 40, "added", 2))
    out = P.upsert_postings(S.build_postings(i), new, spark.createDataFrame([("2" * 40,), ("8" * 40,)], "info_hash string"))
    assert sorted((r.term, r.info_hash[0]) for r in out.collect()) == [("added", "9"), ("new", "1"), ("stays", "3"), ("words", "1")]
    assert P.upsert_postings(out, new).count() == 4
