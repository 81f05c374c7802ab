"""Search over index rows (info_hash, title, magnet, seeders): strict, by hash, and typo-tolerant.

A query is one scan: tokens are computed once per row, frequencies of the few query terms are counted in the row's
own array, the corpus statistics are one aggregate of one row that is broadcast, and top-k keeps bounded heaps per
task. For many queries over one corpus, ``build_postings`` makes term-clustered postings, which ``postings`` searches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashlode.functions.text import hex_query, popularity_boost, text_tokens, tokens, within_one_edit
from hashlode.plans.query_language import Combined, Everything, Words, parse_leniently, terms

K1, B, TITLE_BOOST = 1.2, 0.75, 2.0
POOL = 2000
HITS = ("info_hash", "title", "magnet", "seeders")


def corpus_stats(index: DataFrame) -> DataFrame:
    """N and the average number of tokens (F8)."""
    n = F.size(tokens(F.col("title")))
    return index.agg(F.count("*").alias("n_docs"), F.avg(n.cast("double")).alias("avg_len"))


def build_postings(index: DataFrame, id_col: str = "info_hash", title: str = "title") -> DataFrame:
    """(term, info_hash, tf, positions, dl), clustered by term so that ``term IN (...)`` prunes row groups."""
    toks = index.select(id_col, tokens(F.col(title)).alias("toks")).select(id_col, F.size("toks").alias("dl"), F.posexplode("toks").alias("pos", "term"))
    out = toks.groupBy("term", id_col).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.first("dl").alias("dl"))
    return out.repartitionByRange(F.col("term"), F.col(id_col)).sortWithinPartitions("term", id_col)


def term_counts(index: DataFrame, id_col: str = "info_hash", title: str = "title") -> DataFrame:
    """(info_hash, term, tf) without positions, in no order: one aggregate, combined before its shuffle."""
    return index.select(id_col, F.explode(tokens(F.col(title))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def doc_freq(index: DataFrame, title: str = "title") -> DataFrame:
    return index.select(F.explode(F.array_distinct(tokens(F.col(title)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, avg_len: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_len))


def _equals(word: str):
    return lambda token: token == word


def _near(word: str):
    return lambda token: within_one_edit(token, word)


def _predicate(node, toks: Column) -> Column:
    if isinstance(node, Everything):
        return F.lit(True)
    if isinstance(node, Words):
        if node.field == "info_hash":
            return F.col("info_hash") == node.tokens[0]
        if len(node.tokens) == 1 and not node.prefix:
            return F.array_contains(toks, node.tokens[0])
        if node.slop:
            return _within_slop(node, toks)
        text = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
        return F.contains(text, F.lit(" " + " ".join(node.tokens) + ("" if node.prefix else " ")))
    out = F.lit(True)
    for x in node.must:
        out = out & _predicate(x, toks)
    if node.should and not node.must:
        any_ = F.lit(False)
        for x in node.should:
            any_ = any_ | _predicate(x, toks)
        out = out & any_
    for x in node.must_not:
        out = out & ~_predicate(x, toks)
    return out if node.must or node.should else F.lit(False)


def _within_slop(node: Words, toks: Column) -> Column:
    """The words in order with at most ``slop`` others between them: a window of words + slop tokens holds them."""
    out = F.lit(True)
    for word in node.tokens:
        out = out & F.array_contains(toks, word)
    wide = len(node.tokens) + node.slop
    pattern = " " + r" (\S+ )*".join(node.tokens) + " "
    starts = F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1)))
    return out & F.exists(starts, lambda i: F.concat(F.lit(" "), F.array_join(F.slice(toks, i, wide), " "), F.lit(" ")).rlike(pattern))


def _scored(index: DataFrame, scoring: list[tuple[str, float]], predicate) -> DataFrame:
    """Matching rows with column bm25; the statistics are of all index rows."""
    rows = index.withColumn("__toks", tokens(F.col("title")))
    toks = F.col("__toks")
    if not scoring:
        return rows.where(predicate(toks)).withColumn("bm25", F.lit(0.0)).drop("__toks")
    counts = [F.count_if(F.array_contains(toks, t)).alias(f"df{i}") for i, (t, _) in enumerate(scoring)]
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg(F.size(toks).cast("double")).alias("avg_len"), *counts)
    joined = rows.where(predicate(toks)).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, (t, boost) in enumerate(scoring):
        tf = F.size(F.filter(toks, _equals(t))).cast("double")
        score = score + boost * bm25(tf, F.size(toks), F.col("avg_len"), idf(F.col("n_docs"), F.col(f"df{i}")))
    return joined.withColumn("bm25", score).select(*index.columns, "bm25")


def _boosts(node, outer: float = 1.0) -> dict[str, float]:
    if isinstance(node, Words):
        return {t: outer * node.boost * TITLE_BOOST for t in node.tokens} if node.field != "info_hash" else {}
    if isinstance(node, Combined):
        return {t: b for x in (*node.must, *node.should) for t, b in _boosts(x, outer).items()}
    return {}


def strict_matches(index: DataFrame, query: str) -> DataFrame:
    """Rows that satisfy the query, with bm25; a hash query is exact at 40 digits, a prefix from 8."""
    digits = hex_query(query)
    if digits:
        test = F.col("info_hash") == digits if len(digits) == 40 else F.startswith(F.col("info_hash"), F.lit(digits))
        return index.where(test).withColumn("bm25", F.lit(1.0))
    node = parse_leniently(query)
    if node is None:
        return index.limit(0).withColumn("bm25", F.lit(0.0))
    boosts = _boosts(node)
    return _scored(index, [(t, boosts[t]) for t in terms(node)], lambda toks: _predicate(node, toks))


def fuzzy_matches(index: DataFrame, query: str) -> DataFrame:
    """Every word within one edit of a title token: 1 each; words of up to 3 bytes exact, by bm25; a word of hash
    digits only adds to the score of hashes it begins (J6, T6, T7)."""
    words = list(dict.fromkeys(text_tokens(query)))
    if not words:
        return index.limit(0).withColumn("bm25", F.lit(0.0))
    exact = [w for w in words if len(w.encode()) <= 3]
    loose = [w for w in words if w not in exact]

    def all_of(toks: Column) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & F.exists(toks, _near(w))
        return out

    out = _scored(index, [(w, 1.0) for w in exact], all_of)
    extra = F.lit(float(len(loose)))
    for w in words:
        if hex_query(w):
            extra = extra + F.when(F.startswith(F.col("info_hash"), F.lit(w)), 1.0).otherwise(0.0)
    return out.withColumn("bm25", F.col("bm25") + extra)


def ranked(matches: DataFrame, offset: int, limit: int, with_fields=None) -> DataFrame:
    """Pool by bm25, then by bm25 with the popularity boost, seeders and hash; then the page (H1 to H4). With
    ``with_fields(rows, most)`` matches need only hash and bm25: it adds the fields of the pool's rows.

    The pool is max(requested, min(10 * requested, 2000)), so a far page is never an error.
    """
    requested = offset + limit
    pool = max(requested, min(10 * requested, POOL))
    best = matches.orderBy(F.round("bm25", 9).desc(), "info_hash").limit(pool)
    if with_fields is not None:
        best = with_fields(best, pool)
    score = F.round(F.col("bm25") + popularity_boost(F.col("seeders")), 9)
    return best.withColumn("score", score).orderBy(F.desc("score"), F.desc("seeders"), "info_hash").limit(requested).offset(offset)


def search(index: DataFrame, query: str, offset: int = 0, limit: int = 25, with_score: bool = False) -> DataFrame:
    """Ranked hits of a page. Fuzzy matching runs only if nothing matches strictly."""
    if not query.strip() or limit <= 0:
        return index.select(*HITS).limit(0)
    matches = strict_matches(index, query.strip())
    if not hex_query(query) and not matches.limit(1).count():
        matches = fuzzy_matches(index, query)
    page = ranked(matches, offset, limit)
    return page.select(*HITS, "score") if with_score else page.select(*HITS)


def page_limit(limit: int | None) -> int:
    """1 to 200, 25 unless told (H6)."""
    return 25 if limit is None else max(1, min(limit, 200))


def more_limit(limit: int) -> int:
    return min(limit + 25, 200)  # H7


def fuzzy_vocabulary(vocabulary: DataFrame, words: list[str]) -> DataFrame:
    """vocabulary(term) with the query words within one edit of it: over distinct terms, never documents."""
    near = F.array(*(F.when(within_one_edit(F.col("term"), w), F.lit(w)) for w in words))
    return vocabulary.select("term", F.explode(F.array_compact(near)).alias("word"))


def query_plan_pool(offset: int, limit: int) -> int:
    return max(offset + limit, min(10 * (offset + limit), POOL))


def boost_of(seeders: int) -> float:
    return math.log1p(max(seeders, 0)) / 4
