"""Names, urls, html and numbers in text: JVM functions, and Arrow batches where Unicode forms need Python."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TRACKING = r"^(utm_.*|gclid|fbclid|ref|mc_cid|mc_eid)$"


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " "))


def name_key(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one space, without leading articles."""
    key = squeeze(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "))
    return F.regexp_replace(key, "^(the )+", "")


def compact_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    """a-b-c, or unknown."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "unknown").otherwise(out)


def digest_key(*parts: Column) -> Column:
    """sha256 of the parts joined by |, missing ones as empty text, first 32 digits."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def first_number(c: Column) -> Column:
    """The first number in a text, thousands separators dropped; NULL if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, r"(?<=\d),(?=\d{3})", ""), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def html_lines(c: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, block ends as line breaks, tags stripped, common entities written out."""
    text = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|title|ul|article|nav)\s*>", "\n"), r"(?s)<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    lines = F.transform(F.split(text, "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def url_key(c: Column) -> Column:
    """Scheme and host in lower case, without credentials, default port, fragment, query or trailing slash."""
    parts = F.regexp_extract_all(c, F.lit(r"^(https?)://(?:[^/@?#]*@)?([^/:?#]+)(?::\d+)?([^?#]*)"), F.lit(0))
    whole = F.try_element_at(parts, F.lit(1))
    get = lambda k: F.regexp_extract(whole, r"^(https?)://(?:[^/@?#]*@)?([^/:?#]+)(?::\d+)?([^?#]*)", k)
    return F.concat(F.lower(get(1)), F.lit("://"), F.lower(get(2)), F.regexp_replace(get(3), "/+$", ""))


def canonical_url(value: str | None) -> str | None:
    """WHATWG-like form of a web address: sorted query without tracking keys; NULL for other schemes."""
    try:
        parts = urlsplit((value or "").strip())
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in ("http", "https") or not parts.hostname:
        return None
    host = parts.hostname.lower()
    if port and port != {"http": 80, "https": 443}[scheme]:
        host += f":{port}"
    query = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not re.match(TRACKING, k.lower()))
    return urlunsplit((scheme, host, parts.path or "/", urlencode(query), ""))


@F.pandas_udf(StringType())
def canonical_urls(urls: pd.Series) -> pd.Series:
    return urls.map(canonical_url)


@F.pandas_udf(StringType())
def unicode_text(texts: pd.Series) -> pd.Series:
    """NFKC, without zero-width characters, white space collapsed; case stays."""
    tidy = lambda t: None if t is None else " ".join(re.sub("[\u200b\ufeff]", "", unicodedata.normalize("NFKC", t)).split())
    return texts.map(tidy)


@F.pandas_udf(StringType())
def plain_letters(texts: pd.Series) -> pd.Series:
    """NFKD without combining marks, lower case, & as and, all else as single spaces."""

    def fold(t):
        if t is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFKD", t.replace("&", " and ")) if not unicodedata.combining(c))
        return " ".join(re.sub("[^a-z0-9]+", " ", t.lower()).split())

    return texts.map(fold)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; NULL if either has none."""
    x, y = (F.filter(F.array_distinct(F.split(t, " ")), lambda w: w != "") for t in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


POSITIVE, NEGATIVE = ("good", "great", "love", "best", "the"), ("bad", "worst", "hate", "idiot", "moron")


def word_sentiment(c: Column, positive: tuple = POSITIVE, negative: tuple = NEGATIVE) -> Column:
    """(positive - negative) / words; NULL without words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z ]", " "), " "), lambda w: w != "")
    count = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed)))
    return F.when(F.size(words) > 0, (count(positive) - count(negative)) / F.size(words))
