"""Search answered from stored postings (term, info_hash, tf, positions, dl), and their upkeep.

Only the postings of the query's words are read (``term IN (...)`` on term-clustered files); titles are not. Words of
one row meet in a map of at most as many entries as the query has words, phrases are checked on positions, and the
index rows of the pool alone are fetched at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashlode.functions.text import hex_query, text_tokens
from hashlode.operators import search as S
from hashlode.plans.query_language import Combined, Words, parse_leniently, terms

BROADCAST_POOL = 100_000


def upsert_postings(postings: DataFrame, changes: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Postings after ``changes(info_hash, title)``, a row per hash, took the place of what was there, and after the
    hashes of ``gone`` went; a hash in both stays with its new title (B9, B10, G7, M4)."""
    touched = changes.select("info_hash")
    if gone is not None:
        touched = touched.unionByName(gone.select("info_hash"))
    return postings.join(touched, "info_hash", "left_anti").unionByName(S.build_postings(changes))


def _from_words(node) -> bool:
    """Whether whole words alone decide the query."""
    if isinstance(node, Words):
        return node.field != "info_hash" and not node.prefix and not node.slop
    return isinstance(node, Combined) and all(map(_from_words, (*node.must, *node.should, *node.must_not)))


def _words(node) -> list[str]:
    if isinstance(node, Words):
        return list(node.tokens)
    return [t for x in (*node.must, *node.should, *node.must_not) for t in _words(x)]


def _places(at: Column, word: str) -> Column:
    return F.coalesce(F.try_element_at(at, F.lit(word)), F.array().cast("array<int>"))


def _follows(at: Column, tokens: tuple[str, ...]):
    def check(p: Column) -> Column:
        return reduce(lambda a, b: a & b, (F.array_contains(_places(at, t), p + i) for i, t in enumerate(tokens)))

    return check


def _holds(node, at: Column) -> Column:
    if isinstance(node, Words):
        first = _places(at, node.tokens[0])
        return F.size(first) > 0 if len(node.tokens) == 1 else F.exists(first, _follows(at, node.tokens))
    both, either = lambda a, b: a & b, lambda a, b: a | b
    if not node.must and not node.should:
        return F.lit(False)
    out = reduce(both, (_holds(x, at) for x in node.must)) if node.must else reduce(either, (_holds(x, at) for x in node.should))
    return reduce(both, (~_holds(x, at) for x in node.must_not), out)


def _score(rows: DataFrame, facts: DataFrame, scoring: list[tuple[str, float]]) -> DataFrame:
    """rows(info_hash, dl, tf0, tf1, ...) with bm25 by facts(n_docs, avg_len, df0, df1, ...), which is one row."""
    joined = rows.crossJoin(F.broadcast(facts))
    score = F.lit(0.0)
    for i, (_, boost) in enumerate(scoring):
        score = score + boost * S.bm25(F.col(f"tf{i}").cast("double"), F.col("dl"), F.col("avg_len"), S.idf(F.col("n_docs"), F.col(f"df{i}")))
    return joined.select("info_hash", score.alias("bm25"))


def _facts(hits: DataFrame, stats: DataFrame, words: list[str], same: Column | None = None) -> DataFrame:
    counted = (F.count_if((F.col("term") == w) if same is None else (F.col("term") == w) & same).alias(f"df{i}") for i, w in enumerate(words))
    return stats.crossJoin(hits.agg(F.count("*").alias("n_hits"), *counted))  # one row each


def word_matches(postings: DataFrame, stats: DataFrame, node) -> DataFrame:
    """(info_hash, bm25) of the rows that satisfy a query of whole words and phrases."""
    hits = postings.where(F.col("term").isin(*set(_words(node))))
    rows = hits.groupBy("info_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("dl").alias("dl"))
    boosts = S._boosts(node)
    scoring = [(t, boosts[t]) for t in terms(node)]
    found = rows.where(_holds(node, F.col("at"))).select("info_hash", "dl", *(F.size(_places(F.col("at"), t)).alias(f"tf{i}") for i, (t, _) in enumerate(scoring)))
    return _score(found, _facts(hits, stats, [t for t, _ in scoring]), scoring)


def fuzzy_word_matches(postings: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """(info_hash, bm25) as ``fuzzy_matches`` gives: the query's words meet the vocabulary, never the rows."""
    words = list(dict.fromkeys(text_tokens(query)))
    exact = [w for w in words if len(w.encode()) <= 3]
    near = S.fuzzy_vocabulary(postings.select("term").distinct(), words)
    hits = postings.join(near, "term")
    tfs = (F.max(F.when(F.col("term") == w, F.col("tf"))).alias(f"tf{i}") for i, w in enumerate(exact))
    rows = hits.groupBy("info_hash").agg(F.count_distinct("word").alias("n_words"), F.first("dl").alias("dl"), *tfs).where(F.col("n_words") == len(words))
    out = _score(rows, _facts(hits, stats, exact, F.col("term") == F.col("word")), [(w, 1.0) for w in exact])
    extra = F.lit(float(len(words) - len(exact)))
    for w in words:
        if hex_query(w):
            extra = extra + F.when(F.startswith(F.col("info_hash"), F.lit(w)), 1.0).otherwise(0.0)
    return out.withColumn("bm25", F.col("bm25") + extra)


def search_postings(postings: DataFrame, index: DataFrame, stats: DataFrame, query: str, offset: int = 0, limit: int = 25, with_score: bool = False) -> DataFrame:
    """The page that ``search`` gives over ``index``, answered from its postings and its ``corpus_stats``.

    Queries by hash, ``*``, prefixes and phrases with slop go to ``search``.
    """
    node = None if hex_query(query) or not query.strip() or limit <= 0 else parse_leniently(query.strip())
    if node is None or not _from_words(node):
        return S.search(index, query, offset, limit, with_score)
    matches = word_matches(postings, stats, node)
    if not matches.limit(1).count():
        if not text_tokens(query):
            return S.search(index, query, offset, limit, with_score)
        matches = fuzzy_word_matches(postings, stats, query)
    page = S.ranked(matches, offset, limit, lambda best, n: index.join(F.broadcast(best) if n <= BROADCAST_POOL else best, "info_hash"))
    return page.select(*S.HITS, "score") if with_score else page.select(*S.HITS)
