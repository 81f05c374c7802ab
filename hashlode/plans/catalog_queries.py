"""The queries over the catalog, its observations and its packets, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashlode import api
from hashlode.functions import bencode as B
from hashlode.functions import net as N
from hashlode.functions import text as T
from hashlode.operators import dedupe, enrich, lookup
from hashlode.operators import postings as P
from hashlode.operators import registry as R
from hashlode.operators import retention as K
from hashlode.operators import search as S
from hashlode.sources import views as V
from hashlode.sources.scratch import scratch_path
from hashlode.streaming import flows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW_MS = 946684800000  # 2000-01-01, inside the life of lineitem
TTL_SECS, GRACE_SECS = 30 * 86400, 4 * 365 * 86400
ROUND = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _index(spark, d):
    return R.index_rows(V.catalog(spark, d))


INDEX = V.CATALOG + """, idx AS (
  SELECT p_partkey, info_hash, title, CASE WHEN NOT regexp_matches(coalesce(magnet, ''), '[^\\s]') THEN 'magnet:?xt=urn:btih:' || info_hash ELSE magnet END AS magnet, seeders,
         list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'), lambda t: strlen(t) < 40) AS toks
  FROM catalog WHERE seeders >= 2)"""


# registry

@query(f"WITH {V.OBSERVED} SELECT info_hash, min(ms) AS first_seen_ms, max(ms) AS last_seen_ms, max(seeders) AS seeders FROM obs GROUP BY info_hash")
def registry_fold(spark, d):
    return R.touch_fold(V.observed(spark, d))


@query(ORACLE_SQL["registry_fold"])
def registry_merge(spark, d):
    obs = V.observed(spark, d)
    halves = [R.touch_fold(obs.where(F.col("event_id") % 2 == i)) for i in (0, 1)]
    empty = {c: F.lit(None).cast("string") for c in ("title", "magnet", "info_b64")}
    return R.merge(*(h.withColumns(empty) for h in halves)).select("info_hash", "first_seen_ms", "last_seen_ms", "seeders")


@query(f"""WITH {V.CATALOG} SELECT info_hash, arg_max(title, p_partkey) AS title, max(seeders) AS seeders, min(p_partkey) AS first_seen_ms, max(p_partkey) AS last_seen_ms
FROM (SELECT CAST(p_partkey % 50 AS VARCHAR) AS info_hash, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE title END AS title, seeders, p_partkey FROM catalog) GROUP BY info_hash""")
def registry_metadata(spark, d):
    c = V.catalog(spark, d).withColumns({"info_hash": (F.col("p_partkey") % 50).cast("string"), "first_seen_ms": F.col("p_partkey"), "last_seen_ms": F.col("p_partkey")})
    c = c.withColumn("title", F.when(F.col("p_partkey") % 4 == 0, F.lit(" ")).otherwise(F.col("title"))).drop("p_partkey")
    return R.merge(c.where("first_seen_ms % 3 = 0"), c.where("first_seen_ms % 3 <> 0")).select("info_hash", "title", "seeders", "first_seen_ms", "last_seen_ms")


@query(f"WITH {V.CATALOG} SELECT info_hash, title, magnet, seeders FROM catalog WHERE info_hash = sha1('7')")
def registry_point_get(spark, d):
    return R.point_get(V.catalog(spark, d), "902ba3cda1883801594b6e1b452790cc53948fda").select("info_hash", "title", "magnet", "seeders")


@query(f"""WITH {V.CATALOG}, keys AS (SELECT info_hash FROM catalog UNION ALL SELECT 'absent')
SELECT k.info_hash, coalesce(title, 'Unknown Title') AS title, coalesce(magnet, '') AS magnet, coalesce(seeders, 0) AS seeders FROM keys k LEFT JOIN catalog c ON k.info_hash = c.info_hash""")
def detail_missing_defaults(spark, d):
    c = V.catalog(spark, d)
    return R.detail(c, c.select("info_hash").union(spark.createDataFrame([("absent",)], "info_hash string")))


@query(f"WITH {V.CATALOG} SELECT info_hash, title FROM catalog WHERE NOT regexp_matches(coalesce(info_b64, ''), '[^\\s]') ORDER BY info_hash LIMIT 200")
def worklist_missing_info(spark, d):
    return R.worklist(V.catalog(spark, d)).select("info_hash", "title")


@query(f"WITH {V.CATALOG} SELECT count(*) AS total, count(*) FILTER (NOT regexp_matches(coalesce(info_b64, ''), '[^\\s]')) AS missing_info, count(*) FILTER (seeders < 2) AS low_seed FROM catalog")
def backfill_counters(spark, d):
    return R.backfill_counters(V.catalog(spark, d))


@query(f"WITH {INDEX} SELECT info_hash, title, magnet, seeders FROM idx")
def index_projection(spark, d):
    return _index(spark, d)


@query(f"WITH {V.CATALOG} SELECT info_hash FROM catalog WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphan_index_entries(spark, d):
    kept = V.table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey").distinct()
    c = V.catalog(spark, d)
    return R.missing_entries(c.select("info_hash"), c.join(kept, F.col("p_partkey") == F.col("l_partkey"), "left_semi"))


@query(f"WITH {V.OBSERVED} SELECT event_id, CASE WHEN event_id % 3 < 2 THEN info_hash END AS info_hash, CASE WHEN event_id % 3 < 2 THEN seeders END AS seeders, CASE WHEN event_id % 3 < 2 THEN ms END AS first_seen_ms, CASE WHEN event_id % 3 < 2 THEN ms END AS last_seen_ms FROM obs")
def legacy_decode(spark, d):
    o = V.observed(spark, d)
    new = F.concat_ws("|", F.lit("SRM1"), "info_hash", "seeders", "ms", "ms")
    old = F.to_json(F.struct("info_hash", "seeders", F.col("ms").alias("first_seen_ms"), F.col("ms").alias("last_seen_ms")))
    kind = F.col("event_id") % 3
    return R.decode_values(o.select("event_id", F.when(kind == 0, new).when(kind == 1, old).otherwise(F.lit("?")).alias("value")))


@query(f"WITH {V.OBSERVED} SELECT info_hash, 'SRM1|' || info_hash || '|' || max(seeders) || '|' || min(ms) || '|' || max(ms) AS value FROM obs GROUP BY info_hash")
def encode_registry(spark, d):
    return R.encode_values(R.touch_fold(V.observed(spark, d)))


# text and statistics

@query(f"WITH {INDEX} SELECT count(*) AS n_docs, round(avg(CAST(len(toks) AS DOUBLE)), {ROUND}) AS avg_len FROM idx")
def corpus_stats(spark, d):
    return S.corpus_stats(_index(spark, d)).withColumn("avg_len", F.round("avg_len", ROUND))


TOKENS = V.CORPUS + """, t AS (
  SELECT info_hash, unnest(list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'), lambda t: strlen(t) < 40)) AS term FROM corpus)"""


@query(f"WITH {TOKENS} SELECT term, count(DISTINCT info_hash) AS df FROM t GROUP BY term")
def doc_freq(spark, d):
    return S.doc_freq(V.corpus(spark, d))


@query(f"WITH {TOKENS} SELECT info_hash, term, count(*) AS tf FROM t GROUP BY info_hash, term")
def token_freq(spark, d):
    return S.term_counts(V.corpus(spark, d))


@query(f"WITH {V.CATALOG} SELECT info_hash, round(ln(greatest(seeders - 2, 0) + 1) / 4, {ROUND}) AS boost FROM catalog")
def popularity_boost(spark, d):
    return V.catalog(spark, d).select("info_hash", F.round(T.popularity_boost(F.col("seeders") - 2), ROUND).alias("boost"))


@query("SELECT doc_id, translate(text, ':^~*?\\()[]{}!+-|', '                 ') AS clean FROM documents")
def sanitize_query(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.sanitize(F.col("text")).alias("clean"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe FROM pages""")
def html_escape(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("safe"))


@query("SELECT doc_id, url_encode(text) AS coded FROM documents")
def url_encode(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.percent_encode(F.col("text")).alias("coded"))


@query(f"WITH {V.CORPUS} SELECT info_hash, to_base64(encode(title)) AS info_b64 FROM corpus")
def metadata_base64(spark, d):
    return V.corpus(spark, d).select("info_hash", T.base64_line(F.col("title").cast("binary")).alias("info_b64"))


@query(f"WITH {V.MAGNETS} SELECT info_hash, url AS tracker FROM magnets UNION ALL SELECT info_hash, 'udp://t:80' FROM magnets")
def magnet_trackers(spark, d):
    return V.magnets(spark, d).select("info_hash", F.explode(T.trackers(F.col("magnet"))).alias("tracker"))


@query(f"WITH {V.CATALOG} SELECT info_hash, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE title END, '(untitled)') AS title, substr(info_hash, 1, 12) AS short_hash, coalesce(magnet, '') <> '' AS has_actions, seeders FROM catalog")
def result_card(spark, d):
    c = V.catalog(spark, d)
    return R.result_card(c.withColumn("title", F.when(F.col("p_partkey") % 3 != 0, F.col("title"))))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Catalog' ELSE url || ' / Catalog' END AS title FROM pages")
def page_title(spark, d):
    p = V.table(spark, d, "pages")
    return p.select("page_id", T.page_title(F.when(F.col("page_id") % 2 == 1, F.col("url")), "Catalog").alias("title"))


@query(f"WITH {V.CATALOG} SELECT p_partkey, p_partkey % 4 <= 1 AS ok FROM catalog")
def valid_hashes(spark, d):
    k = F.col("p_partkey") % 4
    h = F.when(k == 0, F.col("info_hash")).when(k == 1, F.upper("info_hash")).when(k == 2, F.substring("info_hash", 1, 39))
    return V.catalog(spark, d).select("p_partkey", T.valid_hash(h).alias("ok"))


# search

def _search_sql(words: dict[str, float], where: str, offset: int, limit: int, source: str = INDEX, rows: str = "idx") -> str:
    pool = S.query_plan_pool(offset, limit)
    tf = {w: f"CAST(len(list_filter(toks, lambda t: t = '{w}')) AS DOUBLE)" for w in words}
    dfs = ", ".join(f"count(*) FILTER (list_contains(toks, '{w}')) AS df{i}" for i, w in enumerate(words))
    score = " + ".join(f"{b} * ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * {tf[w]} * 2.2 / ({tf[w]} + 1.2 * (0.25 + 0.75 * len(toks) / avg_len))" for i, (w, b) in enumerate(words.items()))
    return f"""WITH {source}, stats AS (SELECT count(*) AS n, avg(CAST(len(toks) AS DOUBLE)) AS avg_len, {dfs} FROM {rows}),
m AS (SELECT i.*, {score} AS bm25 FROM {rows} i, stats WHERE {where}),
pool AS (SELECT * FROM m ORDER BY round(bm25, 9) DESC, info_hash LIMIT {pool})
SELECT info_hash, title, magnet, seeders, round(bm25 + ln(greatest(seeders, 0) + 1) / 4, {ROUND}) AS score FROM pool
ORDER BY round(bm25 + ln(greatest(seeders, 0) + 1) / 4, 9) DESC, seeders DESC, info_hash LIMIT {limit} OFFSET {offset}"""


def _search(q: str, offset: int = 0, limit: int = 25):
    def run(spark, d):
        return S.search(_index(spark, d), q, offset, limit, with_score=True).withColumn("score", F.round("score", ROUND))

    return run


def _has(*words: str) -> str:
    return " AND ".join(f"list_contains(toks, '{w}')" for w in words)


def _add(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


_add("search_strict_and", _search("blue bolt"), _search_sql({"blue": 2.0, "bolt": 2.0}, _has("blue", "bolt"), 0, 25))
_add("search_page_offset", _search("red promo", 20, 15), _search_sql({"red": 2.0, "promo": 2.0}, _has("red", "promo"), 20, 15))
_add("search_phrase", _search('"hot gear" economy'), _search_sql({"hot": 2.0, "gear": 2.0, "economy": 2.0}, "contains(' ' || array_to_string(toks, ' ') || ' ', ' hot gear ') AND " + _has("economy"), 0, 25))
_add("search_boolean_or_not", _search("(widget OR gizmo) -red NOT small large"), _search_sql({"widget": 2.0, "gizmo": 2.0, "large": 2.0}, f"({_has('widget')} OR {_has('gizmo')}) AND NOT {_has('red')} AND NOT {_has('small')} AND {_has('large')}", 0, 25))
_add("search_boost", _search("title:widget^3 cold"), _search_sql({"widget": 6.0, "cold": 2.0}, _has("widget", "cold"), 0, 25))
_add("search_sanitized", _search("blue:* bolt?"), _search_sql({"blue": 2.0, "bolt": 2.0}, _has("blue", "bolt"), 0, 25))
_add("search_far_page", _search("red", 60, 5), _search_sql({"red": 2.0}, _has("red"), 60, 5))


@query(f"WITH {INDEX} SELECT info_hash, title, magnet, seeders FROM idx WHERE info_hash = sha1('11')")
def search_hash_exact(spark, d):
    return S.search(_index(spark, d), "17BA0791499DB908433B80F37C5FBC89B870084B")


@query(f"WITH {INDEX} SELECT info_hash, title, magnet, seeders FROM idx WHERE starts_with(info_hash, '17ba0791') ORDER BY seeders DESC, info_hash LIMIT 25")
def search_hash_prefix(spark, d):
    return S.search(_index(spark, d), "17ba0791")


@query(f"""WITH {INDEX}, m AS (SELECT *, 2.0 AS bm25 FROM idx WHERE len(list_filter(toks, lambda t: damerau_levenshtein(t, 'widgte') <= 1)) > 0 AND len(list_filter(toks, lambda t: damerau_levenshtein(t, 'larg') <= 1)) > 0)
SELECT info_hash, title, magnet, seeders, round(2.0 + ln(seeders + 1) / 4, {ROUND}) AS score FROM (SELECT * FROM m ORDER BY info_hash LIMIT 250) ORDER BY score DESC, seeders DESC, info_hash LIMIT 25""")
def search_fuzzy_fallback(spark, d):
    return _search("widgte larg")(spark, d)


@query(f"""WITH {TOKENS}, v AS (SELECT DISTINCT term FROM t WHERE regexp_full_match(term, '[a-z0-9]+')), w AS (SELECT unnest(['that', 'thond', 'widget', 'wiht', 'the']) AS word)
SELECT term, word FROM v, w WHERE CASE WHEN strlen(word) <= 3 THEN term = word ELSE damerau_levenshtein(term, word) <= 1 END""")
def fuzzy_vocabulary_join(spark, d):
    return S.fuzzy_vocabulary(S.doc_freq(V.corpus(spark, d)), ["that", "thond", "widget", "wiht", "the"])


DOCS = V.CORPUS + """, idx AS (
  SELECT info_hash, title, 'magnet:?xt=urn:btih:' || info_hash AS magnet, seeders, list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'), lambda t: strlen(t) < 40) AS toks FROM corpus WHERE seeders >= 2)"""


@query(_search_sql({"that": 2.0, "was": 2.0}, _has("that", "was"), 0, 25, DOCS))
def search_documents_bm25(spark, d):
    return S.search(R.index_rows(V.corpus(spark, d)), "that was", with_score=True).withColumn("score", F.round("score", ROUND))


@query(f"SELECT count(*) > 25 AS has_more FROM ({_search_sql({'red': 2.0}, _has('red'), 0, 26)}) x")
def search_has_more(spark, d):
    return S.search(_index(spark, d), "red", 0, 26).agg((F.count("*") > 25).alias("has_more"))


@query(None)
def search_json(spark, d):
    return api.search_json(_index(spark, d), "blue bolt")


@query(f"WITH {INDEX} SELECT count(*) AS total FROM idx WHERE {_has('blue')}")
def search_total(spark, d):
    return api.count_matches(_index(spark, d), "blue")


@query(f"WITH {INDEX} SELECT info_hash FROM idx WHERE {_has('blue', 'bolt')}")
def postings_intersection(spark, d):
    hits = S.build_postings(_index(spark, d)).where(F.col("term").isin("blue", "bolt"))
    return hits.groupBy("info_hash").agg(F.count("*").alias("n")).where("n = 2").select("info_hash")


def _stored_postings(spark, index):
    path = scratch_path(spark, "postings")
    S.build_postings(index).write.parquet(path)
    return spark.read.parquet(path)


def _by_postings(q: str, offset: int = 0, limit: int = 25, rows=_index):
    def run(spark, d):
        i = rows(spark, d)
        return P.search_postings(_stored_postings(spark, i), i, S.corpus_stats(i), q, offset, limit, with_score=True).withColumn("score", F.round("score", ROUND))

    return run


_add("postings_search_and", _by_postings("blue bolt"), ORACLE_SQL["search_strict_and"])
_add("postings_search_page", _by_postings("red promo", 20, 15), ORACLE_SQL["search_page_offset"])
_add("postings_search_phrase", _by_postings('"hot gear" economy'), ORACLE_SQL["search_phrase"])
_add("postings_search_boolean", _by_postings("(widget OR gizmo) -red NOT small large"), ORACLE_SQL["search_boolean_or_not"])
_add("postings_search_fuzzy", _by_postings("widgte larg"), ORACLE_SQL["search_fuzzy_fallback"])
_add("postings_search_documents", _by_postings("that was", rows=lambda spark, d: R.index_rows(V.corpus(spark, d))), ORACLE_SQL["search_documents_bm25"])


@query(f"""WITH {INDEX}, now AS (
  SELECT info_hash, CASE WHEN p_partkey % 5 = 1 THEN lower(title) || ' fresh blue' ELSE title END AS title FROM idx WHERE p_partkey % 5 <> 2),
t AS (SELECT info_hash, list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) < 40) AS toks FROM now)
SELECT info_hash, term, count(*) AS tf, array_to_string(list_sort(list(pos)), ' ') AS positions, CAST(any_value(dl) AS INTEGER) AS dl
FROM (SELECT info_hash, len(toks) AS dl, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM t) GROUP BY info_hash, term""")
def postings_upsert(spark, d):
    """Every fifth part with a new title, every fifth gone."""
    c, i = V.catalog(spark, d), _index(spark, d)
    turn = lambda k: i.join(c.where(F.col("p_partkey") % 5 == k).select("info_hash"), "info_hash", "left_semi")
    changes = turn(1).withColumn("title", F.concat(F.lower("title"), F.lit(" fresh blue")))
    out = P.upsert_postings(_stored_postings(spark, i), changes, turn(2))
    return out.select("info_hash", "term", "tf", F.array_join("positions", " ").alias("positions"), "dl")


def _answer(h: str) -> bytes | None:
    """Stands for the network: some hashes have no answer, some fail, the others have a name."""
    if h[0] in "0123":
        return None
    if h[0] == "4":
        raise TimeoutError(h)
    return b"d4:name12:" + h[:12].encode() + b"e"


@query(f"""WITH {V.CATALOG}, w AS (SELECT info_hash FROM catalog WHERE NOT regexp_matches(coalesce(info_b64, ''), '[^\\s]') ORDER BY info_hash LIMIT 1000),
f AS (SELECT info_hash FROM w WHERE substr(info_hash, 1, 1) NOT IN ('0', '1', '2', '3', '4'))
SELECT c.info_hash, CASE WHEN f.info_hash IS NULL THEN c.info_b64 ELSE to_base64(encode('d4:name12:' || substr(c.info_hash, 1, 12) || 'e')) END AS info_b64,
       CASE WHEN f.info_hash IS NULL THEN c.title ELSE substr(c.info_hash, 1, 12) END AS title FROM catalog c LEFT JOIN f ON c.info_hash = f.info_hash""")
def enrich_worklist(spark, d):
    c = V.catalog(spark, d)
    return enrich.apply_enriched(c, enrich.enrich(R.worklist(c, 1000), _answer, 8)).select("info_hash", "info_b64", "title")


# retention

_TTL = f"last_seen_ms <= {NOW_MS - TTL_SECS * 1000}"
_LOW = f"seeders < 2 AND {NOW_MS} - first_seen_ms > {GRACE_SECS * 1000}"


LATER_MS, HALF_YEAR = NOW_MS + 2 * 366 * 86_400_000, 180 * 86400  # when some rows have not been seen for long


@query(f"WITH {V.LIFECYCLE} SELECT info_hash, last_seen_ms FROM lifecycle WHERE last_seen_ms <= {LATER_MS - HALF_YEAR * 1000} ORDER BY greatest(last_seen_ms, 0), info_hash LIMIT 500")
def retention_ttl(spark, d):
    return K.ttl_expired(V.lifecycle(spark, d), LATER_MS, HALF_YEAR, 500).select("info_hash", "last_seen_ms")


@query(f"WITH {V.LIFECYCLE} SELECT info_hash, first_seen_ms FROM lifecycle WHERE {_LOW}")
def retention_low_seed(spark, d):
    return K.low_seed_expired(V.lifecycle(spark, d), NOW_MS, GRACE_SECS).select("info_hash", "first_seen_ms")


@query(f"WITH {V.LIFECYCLE} SELECT info_hash FROM (SELECT *, row_number() OVER (ORDER BY greatest(last_seen_ms, 0) DESC, info_hash DESC) AS n FROM lifecycle) WHERE n > 100")
def retention_cap(spark, d):
    return K.over_cap(V.lifecycle(spark, d), 100).select("info_hash")


_SWEEP = f"""WITH {V.LIFECYCLE}, a AS (SELECT *, CASE WHEN {_TTL} THEN 'ttl' WHEN {_LOW} THEN 'low_seed' ELSE 'keep' END AS action FROM lifecycle),
s AS (SELECT info_hash, CASE WHEN action = 'keep' AND row_number() OVER (PARTITION BY action ORDER BY greatest(last_seen_ms, 0) DESC, info_hash DESC) > 100 THEN 'cap' ELSE action END AS action FROM a) """


@query(_SWEEP + "SELECT * FROM s")
def retention_sweep(spark, d):
    return K.sweep(V.lifecycle(spark, d), NOW_MS, TTL_SECS, GRACE_SECS, 100).select("info_hash", "action")


@query(_SWEEP + "SELECT count(*) AS scanned, count(*) FILTER (action <> 'keep') AS deleted, count(*) FILTER (action = 'keep') AS kept FROM s")
def retention_counters(spark, d):
    return K.sweep_counters(K.sweep(V.lifecycle(spark, d), NOW_MS, TTL_SECS, GRACE_SECS, 100))


# discovery

_ISLANDS = f"""WITH {V.OBSERVED}, b AS (SELECT info_hash, CAST(floor(ms / 900000) AS BIGINT) AS bucket, min(ms) AS ms FROM obs GROUP BY ALL),
r AS (SELECT *, bucket - row_number() OVER (PARTITION BY info_hash ORDER BY bucket) AS run FROM b)
SELECT info_hash, bucket, ms FROM (SELECT *, row_number() OVER (PARTITION BY info_hash, run ORDER BY bucket) AS n FROM r) WHERE n % 2 = 1"""


@query(_ISLANDS)
def rolling_dedup(spark, d):
    return dedupe.rolling_dedup(V.observed(spark, d))


@query(f"""WITH {V.CATALOG}, h AS (SELECT p_partkey, p_partkey % 8 AS kind, info_hash FROM catalog)
SELECT p_partkey, info_hash AS harvested FROM h WHERE kind IN (0, 1, 2, 4) UNION ALL
SELECT p_partkey, array_to_string(list_reverse(regexp_extract_all(info_hash, '..')), '') FROM h WHERE kind = 2""")
def harvest_samples(spark, d):
    return flows.harvest(V.packets(spark, d), ["p_partkey"])


@query(f"WITH {V.CATALOG} SELECT p_partkey, p_partkey % 8 NOT IN (3, 6) AS ok, CASE WHEN p_partkey % 8 IN (0, 1, 4) THEN upper(info_hash) END AS info_hash, CASE p_partkey % 8 WHEN 0 THEN 'get_peers' WHEN 1 THEN 'announce_peer' WHEN 4 THEN 'get_peers' WHEN 5 THEN 'get_peers' WHEN 7 THEN 'find_node' END AS q FROM catalog")
def bencode_roundtrip(spark, d):
    p = V.packets(spark, d).withColumn("m", B.message(F.col("payload")))
    return p.select("p_partkey", "m.ok", F.hex("m.info_hash").alias("info_hash"), "m.q")


@query(f"WITH {V.NODES} SELECT event_id, id, CAST(('0x' || substr(v4_hex, 1, 2)) AS INTEGER) || '.' || CAST(('0x' || substr(v4_hex, 3, 2)) AS INTEGER) || '.' || CAST(('0x' || substr(v4_hex, 5, 2)) AS INTEGER) || '.' || CAST(('0x' || substr(v4_hex, 7, 2)) AS INTEGER) AS ip, port FROM nodes")
def compact_nodes_v4(spark, d):
    return _compact(spark, d, 4)


@query(f"WITH {V.NODES} SELECT event_id, id, v6_hex AS ip, port FROM nodes")
def compact_nodes_v6(spark, d):
    return _compact(spark, d, 6)


def _compact(spark, d, family: int):
    """Records written out with a partial one behind, and read back."""
    n = V.nodes(spark, d)
    address = F.col("v4_hex" if family == 4 else "v6_hex")
    record = F.concat("id", address, F.lpad(F.lower(F.hex("port")), 4, "0"), F.lit("abcd"))
    cut = F.explode(N.chunks(record, 26 if family == 4 else 38))
    return n.select("event_id", cut.alias("r")).select("event_id", N.compact_node(F.col("r"), family).alias("n")).select("event_id", "n.id", "n.ip", "n.port")


@query(f"WITH {V.NODES} SELECT event_id, CAST(('0x' || substr(v4_hex, 1, 2)) AS INTEGER) || '.0.0.1' AS ip, port FROM nodes WHERE event_id % 3 <> 2")
def compact_peers(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k != 2, F.concat(F.substring("v4_hex", 1, 2), F.lit("000001"), F.lpad(F.lower(F.hex("port")), 4, "0"))).otherwise(F.lit("00"))
    return V.nodes(spark, d).select("event_id", N.compact_peer(raw).alias("p")).where("p IS NOT NULL").select("event_id", "p.ip", "p.port")


_V4 = "CAST(('0x' || v4_hex) AS BIGINT)"


def _range(*spans: tuple[str, int]) -> str:
    return " OR ".join(f"{_V4} >> {32 - n} = {sum(int(x) << s for x, s in zip(a.split('.'), (24, 16, 8, 0))) >> (32 - n)}" for a, n in spans)


_PRIVATE = _range(("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), ("0.0.0.0", 32))
_SPECIAL = _range(("169.254.0.0", 16), ("224.0.0.0", 4), ("192.0.2.0", 24), ("198.51.100.0", 24), ("203.0.113.0", 24), ("198.18.0.0", 15))
_LOCAL6 = "v6_hex IN ('00000000000000000000000000000001', '00000000000000000000000000000000') OR substr(v6_hex, 1, 2) IN ('fc', 'fd')"
_SPECIAL6 = "substr(v6_hex, 1, 2) = 'ff' OR substr(v6_hex, 1, 3) IN ('fe8', 'fe9', 'fea', 'feb') OR substr(v6_hex, 1, 8) = '20010db8'"


@query(f"WITH {V.NODES} SELECT event_id, NOT ({_PRIVATE} OR {_SPECIAL}) AS ok4, NOT ({_LOCAL6} OR {_SPECIAL6}) AS ok6 FROM nodes")
def routable_ips(spark, d):
    none = F.lit(None)
    v4 = N.number(F.col("v4_hex"))
    return V.nodes(spark, d).select("event_id", N.routable(v4, none.cast("string")).alias("ok4"), N.routable(none.cast("long"), F.col("v6_hex")).alias("ok6"))


@query(f"WITH {V.NODES} SELECT event_id, port <> 0 AND NOT ({_PRIVATE}) AS ok4, port <> 0 AND NOT ({_LOCAL6}) AS ok6 FROM nodes")
def enrich_addr_filter(spark, d):
    none = F.lit(None)
    v4 = N.number(F.col("v4_hex"))
    return V.nodes(spark, d).select("event_id", N.reachable_peer(v4, none.cast("string"), F.col("port")).alias("ok4"), N.reachable_peer(none.cast("long"), F.col("v6_hex"), F.col("port")).alias("ok6"))


@query(f"WITH {V.NODES}, f AS (SELECT substr(v4_hex, 1, 3) AS ip, port, min(struct_pack(a := ms, b := event_id)) AS first_at FROM nodes GROUP BY ALL) SELECT ip, port FROM f ORDER BY first_at DESC LIMIT 200")
def known_nodes_ring(spark, d):
    n = V.nodes(spark, d).withColumn("ip", F.substring("v4_hex", 1, 3))
    return K.newest(n, 200, ["ip", "port"], ["ms", "event_id"]).select("ip", "port")


@query(f"WITH {V.NODES}, n AS (SELECT event_id % 3 AS family, id, (row_number() OVER (PARTITION BY event_id % 3 ORDER BY ms, event_id) - 1) // 12 AS turn FROM nodes WHERE event_id >= 0) SELECT family, id, CAST(turn AS INTEGER) AS turn FROM n")
def node_rotation(spark, d):
    n = V.nodes(spark, d).where("event_id >= 0").withColumn("family", F.col("event_id") % 3)
    return K.rotation(n, "family", ["ms", "event_id"], 12).select("family", "id", "turn")


_LANES = " || ".join(f"printf('%08x', xor(CAST(('0x' || substr(id, {1 + 8 * i}, 8)) AS BIGINT), CAST(('0x' || substr(sha1('target'), {1 + 8 * i}, 8)) AS BIGINT)))" for i in range(5))


@query(f"WITH {V.NODES} SELECT event_id, {_LANES} AS distance FROM nodes ORDER BY distance, {_V4} DESC, port DESC LIMIT 64")
def xor_frontier(spark, d):
    n = V.nodes(spark, d).withColumn("ip_num", N.number(F.col("v4_hex")))
    return lookup.frontier(n, "0e8a3ad980ec179856012b7eecf4327e99cd44cd", 64).select("event_id", "distance")


@query("SELECT event_type AS info_hash, least(count(DISTINCT user_id), 50) AS popularity FROM events GROUP BY event_type")
def peer_popularity(spark, d):
    return R.peer_popularity(V.table(spark, d, "events").select(F.col("event_type").alias("info_hash"), F.col("user_id").alias("peer")))


@query("SELECT event_type, user_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first_at, user_id) AS place FROM (SELECT event_type, user_id, min(event_id) AS first_at FROM events GROUP BY ALL)) WHERE place <= 64")
def first_peers(spark, d):
    return lookup.first_arrivals(V.table(spark, d, "events"), "event_type", "user_id", "event_id", 64).select("event_type", "user_id", "place")


@query("SELECT event_type AS info_hash, max(CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) END) AS seeders FROM events GROUP BY event_type")
def tracker_seeders(spark, d):
    e = V.table(spark, d, "events")
    return R.tracker_seeders(e.select(F.col("event_type").alias("info_hash"), F.when(F.col("event_id") % 2 == 0, F.floor("value").cast("long")).alias("complete")))


@query("SELECT CAST(user_id AS VARCHAR) AS info_hash, arg_min(event_type, struct_pack(a := epoch_us(ts) // 1000, b := event_type)) AS result FROM events WHERE value > 20 GROUP BY user_id")
def first_success(spark, d):
    e = V.table(spark, d, "events")
    return R.first_success(e.select(F.col("user_id").cast("string").alias("info_hash"), (F.col("value") > 20).alias("ok"), T.millis(F.col("ts")).alias("done_ms"), F.col("event_type").alias("result")))


@query("""WITH e AS (SELECT user_id AS tx, epoch_us(ts) // 1000 AS ms, event_type FROM events)
SELECT r.tx, r.ms AS sent_ms, min(a.ms) AS got_ms
FROM (SELECT tx, ms, lead(ms) OVER (PARTITION BY tx ORDER BY ms) AS after FROM (SELECT DISTINCT tx, ms FROM e WHERE event_type = 'click')) r
JOIN e a ON a.tx = r.tx AND a.event_type = 'view' AND a.ms BETWEEN r.ms AND r.ms + 90000000 AND (r.after IS NULL OR a.ms < r.after) GROUP BY ALL""")
def inflight_match(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("tx"), T.millis(F.col("ts")).alias("ms"), "event_type")
    sent = e.where("event_type = 'click'").select("tx", F.col("ms").alias("sent_ms")).distinct()
    return lookup.match_inflight(sent, e.where("event_type = 'view'").select("tx", F.col("ms").alias("got_ms")), 90_000_000)


@query(f"WITH {V.LIFECYCLE} SELECT info_hash, printf('%016x', last_seen_ms) || info_hash AS key, last_seen_ms AS ms FROM lifecycle")
def ts_key_roundtrip(spark, d):
    k = V.lifecycle(spark, d).withColumn("key", N.time_key(F.col("last_seen_ms"), F.col("info_hash")))
    return k.select("info_hash", "key", N.time_of_key(F.col("key")).alias("ms"))


@query("SELECT doc_id AS key, sha1(text) AS digest FROM documents WHERE text IS NOT NULL")
def piece_assembly(spark, d):
    size = 256
    docs = V.table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("b"))
    totals = docs.select("key", F.octet_length("b").cast("long").alias("total"))
    n = F.greatest(F.ceil(F.octet_length("b") / size).cast("int"), F.lit(1))
    pieces = docs.select("key", "b", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    pieces = pieces.select("key", "idx", F.lit(1).alias("seq"), F.substring("b", F.col("idx") * size + 1, F.lit(size)).alias("data"))
    stale = pieces.where("idx = 0").select("key", "idx", F.lit(0).alias("seq"), F.lit(b"stale").alias("data"))
    return R.assemble_pieces(pieces.union(stale), totals, size).select("key", F.sha1("payload").alias("digest"))


# streams

@query(ORACLE_SQL["registry_fold"])
def stream_registry(spark, d):
    return flows.replay_registry(spark, d)


@query(_ISLANDS)
def stream_rolling_dedup(spark, d):
    return flows.replay_rolling_dedup(spark, d)


DAY = 86400


@query(f"""WITH {V.OBSERVED}, r AS (SELECT info_hash, min(ms) AS first_seen_ms, max(ms) AS last_seen_ms, max(seeders) AS seeders FROM obs GROUP BY info_hash),
k AS (SELECT *, row_number() OVER (ORDER BY last_seen_ms DESC, info_hash DESC) AS n FROM r WHERE NOT last_seen_ms <= (SELECT max(last_seen_ms) FROM r) - {5 * DAY * 1000}
  AND NOT (seeders < 2 AND (SELECT max(last_seen_ms) FROM r) - first_seen_ms > {DAY * 1000}))
SELECT info_hash, first_seen_ms, last_seen_ms, seeders FROM k WHERE n <= 400""")
def stream_sweep(spark, d):
    return flows.replay_maintained(spark, d, 5 * DAY, DAY, 400)


@query(f"""WITH {V.NODES} SELECT 4 AS family, id || v4_hex || printf('%04x', port) AS record FROM nodes UNION ALL SELECT 6, id || v6_hex || printf('%04x', port) FROM nodes""")
def stream_nodes(spark, d):
    port = F.lpad(F.lower(F.hex("port")), 4, "0")
    told = lambda address: B.byte_string(F.unhex(F.concat("id", F.col(address), port)))
    answer = B.dictionary(("r", B.dictionary(("id", B.byte_string(F.unhex("id"))), ("nodes", told("v4_hex")), ("nodes6", told("v6_hex")))), ("t", B.byte_string(F.lit(b"aa"))), ("y", B.text("r")))
    return flows.replay_nodes(spark, V.nodes(spark, d).select(answer.alias("payload")))
