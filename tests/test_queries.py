import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
CORE = entry._core()


def plain(x):
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in ("part", "lineitem", "events", "documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(CORE[1]))
def test_matches_sql(spark, con, name):
    got = CORE[0][name](spark, SMALL)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    cursor = con.execute(CORE[1][name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    assert rows == sorted(tuple(plain(r[named.index(c)]) for c in columns) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["info_hash", "title", "magnet", "seeders", "score"]


def test_whole_texts_are_sanitized(spark, con):
    got = {r.doc_id: r.clean for r in CORE[0]["sanitize_query"](spark, SMALL).collect()}
    text = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert got == {i: None if t is None else "".join(" " if c in ":^~*?\\()[]{}!+-|" else c for c in t) for i, t in text.items()}
    assert any("\n" in t for t in got.values() if t)


def test_every_catalog_row_has_a_detail(spark, con):
    got = [r.info_hash for r in CORE[0]["detail_missing_defaults"](spark, SMALL).collect()]
    assert sorted(got) == sorted([h for h, in con.execute("SELECT sha1(CAST(p_partkey AS VARCHAR)) FROM part").fetchall()] + ["absent"])


def one_edit(a, b):
    cuts = [(b[:i], b[i:]) for i in range(len(b) + 1)]
    return a == b or any(a in (x + y[1:], x + y[1:2] + y[:1] + y[2:]) or (a.startswith(x) and (a[len(x) + 1 :] in (y, y[1:]))) for x, y in cuts)


def test_fuzzy_vocabulary_takes_terms_of_any_script(spark, tmp_path):
    terms = ["that", "th\u00e4t", "that\u00f1", "\u0442hat", "ht\u00e4t", "wigdet", "w\u00efdget", "w\u00efdg\u00ebt", "the", "th\u00e9", "tha", "\u0436\u0436\u0436\u0436"]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(terms)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.term, r.word) for r in CORE[0]["fuzzy_vocabulary_join"](spark, str(tmp_path)).collect()}
    words = ["that", "thond", "widget", "wiht", "the"]
    assert got == {(t, w) for t in terms for w in words if (t == w if len(w) <= 3 else one_edit(t, w))}
    assert ("th\u00e4t", "that") in got and ("w\u00efdget", "widget") in got
