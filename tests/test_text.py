from pyspark.sql import functions as F

from hashlode.config import Config, listed, switch, whole
from hashlode.functions import bencode as B
from hashlode.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("The.Matrix_1999 " + "x" * 40))) == ["the", "matrix", "1999"] == T.text_tokens("The.Matrix_1999 " + "x" * 40)
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_sanitize_and_hex(spark):
    assert one(spark, T.sanitize(F.lit('a:b^c~d*e?f\\g(h)"i"[j]{k}!l+m-n|o'))) == 'a b c d e f g h "i" j  k  l m n o' == T.sanitize_text('a:b^c~d*e?f\\g(h)"i"[j]{k}!l+m-n|o')
    assert T.hex_query("DEADBEEF") == "deadbeef" and T.hex_query("deadbee") is None and T.hex_query("g" * 8) is None and T.hex_query("a" * 41) is None


def test_escapes(spark):
    assert one(spark, T.html_escape(F.lit("<a href=\"x\">'&'</a>"))) == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"
    assert one(spark, T.percent_encode(F.lit("a b~c*d/é"))) == "a%20b~c%2Ad%2F%C3%A9"


def test_one_edit_counts_characters(spark):
    near = lambda t, w: one(spark, T.within_one_edit(F.lit(t), w))
    assert near("widget", "wdiget") and near("widget", "widge") and near("überein", "berein") and near("verein", "vorein")
    assert not near("widget", "wigdte") and not near("abc", "abd") and near("abc", "abc")
    assert not near("éa", "éb") and near("éab", "éac")  # up to 3 bytes exactly, 4 bytes loosely


def test_blank_and_magnets(spark):
    assert one(spark, T.blank(F.lit(None).cast("string"))) and one(spark, T.blank(F.lit("  "))) and not one(spark, T.blank(F.lit("x")))
    assert one(spark, T.trackers(F.lit("magnet:?xt=u&tr=udp%3A%2F%2Fa&tr=b"))) == ["udp://a", "b"]


def test_proxy():
    assert T.parse_proxy("socks5h://u:p@w@[::1]:1080/x") == {"host": "::1", "port": 1080, "user": "u", "password": "p@w"}
    assert T.parse_proxy("host:1") == {"host": "host", "port": 1, "user": None, "password": None}
    assert T.parse_proxy("host") is None


def test_config(tmp_path):
    assert switch(" OFF ", True) is False and switch("maybe", True) is True and switch(None, False) is False
    assert whole("x", 3) == 3 and listed(" a, ,b ", ("z",)) == ("a", "b") and listed(" , ", ("z",)) == ("z",)
    f = tmp_path / ".env"
    f.write_text("HASHLODE_WEB_PORT=81\nHASHLODE_CLEANUP_BATCH=7\n")
    c = Config.load(str(f), {"HASHLODE_WEB_PORT": "82", "HASHLODE_TTL_SECS": "bad"})
    assert (c.web_port, c.cleanup_batch, c.ttl_secs) == (82, 7, 86400)


def test_bencode_cases():
    parse = B.parse_message
    good = b"d1:ad2:id20:" + b"0" * 20 + b"9:info_hash20:" + b"h" * 20 + b"e1:q9:get_peers1:t2:aa1:y1:qe"
    assert parse(good)["info_hash"] == b"h" * 20 and parse(good + b"junk")["ok"]
    assert not parse(good[:-1])["ok"] and not parse(b"i1e")["ok"] and not parse(None)["ok"] and not parse(b"")["ok"]
    assert parse(b"d1:y001:qe")["y"] == "q"
    assert parse(b"d1:yi-e1:y1:qe")["y"] is None and parse(b"d1:yi-e1:y1:qe", strict_first=False)["y"] == "q"
    assert parse(b"d1:rd6:valuesl6:aaaaaai1e6:bbbbbbee1:y1:re")["peers"] == [b"aaaaaa", b"bbbbbb"]
    assert parse(b"d4:name1:a10:name.utf-82:\xc3\xa9e")["name"] == "é"
    assert not parse(b"l" * 100 + b"e" * 100)["ok"] and not parse(b"d1:x" + b"l" * 100 + b"e" * 101)["ok"]


def test_bencode_columns(spark):
    p = spark.range(1).select(B.message(B.get_peers(F.lit(b"aa"), F.lit(b"0" * 20), F.lit(b"h" * 20))).alias("m")).first().m
    assert p.ok and p.q == "get_peers" and bytes(p.info_hash) == b"h" * 20 and bytes(p.tx) == b"aa"
