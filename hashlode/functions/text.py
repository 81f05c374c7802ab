"""Column functions on titles, queries and links."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the query sanitiser turns to spaces; quotes stay (fixed values).
RESERVED = ":^~*?\\()[]{}!+-|"
LONGEST_TOKEN = 40


def tokens(title: Column) -> Column:
    """Lower-cased runs of letters and digits, those of 40 bytes or more dropped."""
    found = F.regexp_extract_all(F.lower(title), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.octet_length(t) < LONGEST_TOKEN)


def text_tokens(text: str) -> list[str]:
    """The same on the driver, for query strings."""
    import regex

    return [t for t in regex.findall(r"[\p{L}\p{N}]+", text.lower()) if len(t.encode()) < LONGEST_TOKEN]


def sanitize(query: Column) -> Column:
    """Reserved characters to spaces."""
    return F.translate(query, RESERVED, " " * len(RESERVED))


def sanitize_text(query: str) -> str:
    return query.translate({ord(c): " " for c in RESERVED})


def hex_query(query: str) -> str | None:
    """A query of 8 to 40 hex digits, lower-cased; else None."""
    q = query.strip()
    return q.lower() if re.fullmatch(r"[0-9a-fA-F]{8,40}", q) else None


def html_escape(s: Column) -> Column:
    """& < > " ' in this order."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def percent_encode(s: Column) -> Column:
    """All but A-Z a-z 0-9 - _ . ~."""
    coded = F.url_encode(s)
    for raw, safe in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(raw), F.lit(safe))
    return coded


def base64_line(b: Column) -> Column:
    """Base64 on one line whatever the session's chunking."""
    return F.regexp_replace(F.base64(b), "[\\r\\n]", "")


def blank(s: Column) -> Column:
    """Null or white space only, of any kind; never null."""
    return ~F.coalesce(s.rlike(r"(?U)\S"), F.lit(False))


def short_hash(h: Column) -> Column:
    """The first 12 characters."""
    return F.substring(h, 1, 12)


def valid_hash(h: Column) -> Column:
    """40 hex digits in either case."""
    return F.coalesce(h.rlike("^[0-9a-fA-F]{40}$"), F.lit(False))


def popularity_boost(seeders: Column) -> Column:
    """ln(max(seeders, 0) + 1) / 4."""
    return F.log1p(F.greatest(seeders, F.lit(0)).cast("double")) / 4


def within_one_edit(token: Column, word: str) -> Column:
    """Insert, delete, replace or swap neighbours once at most, by characters; words of up to 3 bytes exactly."""
    if len(word.encode()) <= 3:
        return token == word
    swaps = sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)})
    return (F.levenshtein(token, F.lit(word), 1) >= 0) | token.isin(swaps)


def trackers(magnet: Column) -> Column:
    """Decoded ``tr`` parameters of a magnet link."""
    raw = F.regexp_extract_all(magnet, F.lit("[?&]tr=([^&]+)"), F.lit(1))
    return F.transform(raw, lambda t: F.try_url_decode(t))


def synthetic_magnet(info_hash: Column) -> Column:
    return F.concat(F.lit("magnet:?xt=urn:btih:"), info_hash)


def millis(ts_ntz: Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ, floored, whatever the session's time zone."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts_ntz)
    return F.floor(micros / 1000).cast("long")


def page_title(title: Column, app: str) -> Column:
    """The app's name if blank, else title / app."""
    return F.when(blank(title), F.lit(app)).otherwise(F.concat(title, F.lit(f" / {app}")))


def parse_proxy(proxy: str) -> dict[str, object] | None:
    """host, port and credentials of a proxy address: scheme and path optional, last @ ends the credentials."""
    rest = re.sub(r"^socks5h?://", "", proxy.strip()).split("/", 1)[0]
    login, at, place = rest.rpartition("@")
    found = re.fullmatch(r"(?:\[([^\]]+)\]|([^:\[\]]+)):(\d{1,5})", place)
    if not found or not 0 < int(found[3]) < 65536:
        return None
    user, _, password = login.partition(":")
    return {"host": found[1] or found[2], "port": int(found[3]), "user": user if at else None, "password": password if at else None}
