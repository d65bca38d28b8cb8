"""Names, keys, numbers and dates as they stand in raw text, in JVM functions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no number, a seller's codes and their states, month and weekday names, keys of credentials.
NO_NUMBER = ("", "-", "n/a", "N/A", "null")
SALE_STATES = {"onsale": "ONSALE", "offsale": "OFFSALE", "canceled": "CANCELED", "cancelled": "CANCELED", "postponed": "POSTPONED", "rescheduled": "RESCHEDULED"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
SECRET_KEYS = "key|access_token|token|api_key|apikey|client_id|client_secret"


def words(c: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def place_name(c: Column) -> Column:
    """``words`` without one leading article."""
    return F.regexp_replace(words(c), "^the ", "")


def without_prefix(c: Column, prefixes: Sequence[str]) -> Column:
    """The name behind the first listed prefix that it starts with."""
    name = place_name(c)
    hits = F.filter(F.array(*map(F.lit, prefixes)), lambda p: name.startswith(F.concat(p, F.lit(" "))))
    cut = F.length(F.get(hits, F.lit(0)))
    return F.when(cut.isNull(), name).otherwise(F.substr(name, cut + 2))


def person_name(c: Column) -> Column:
    """Lower case, only letters, digits, apostrophes, hyphens and single spaces."""
    return words(F.regexp_replace(F.lower(c), "[^a-z0-9'\\- ]", ""))


def contained(a: Column, b: Column) -> Column:
    """Equal, or one within the other; texts without letters match nothing."""
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a)), F.lit(False))


def observation_id(platform: Column, key: Column) -> Column:
    return F.concat(F.lit("canon_"), F.substring(F.sha1(F.concat_ws("|", platform, key)), 1, 24))


def event_key(entity: Column, place: Column, day: Column) -> Column:
    """boxoffice_entity_place_day in lower case with dashes for spaces; missing parts are empty."""
    parts = [F.coalesce(p.cast("string"), F.lit("")) for p in (entity, place, day)]
    return F.replace(F.lower(F.concat_ws("_", F.lit("boxoffice"), *parts)), F.lit(" "), F.lit("-"))


def to_number(c: Column) -> Column:
    """A number with currency sign and separators; NULL for texts that stand for none."""
    text = F.regexp_replace(F.trim(c), "[$,]", "")
    return F.when(~text.isin(*NO_NUMBER), text.try_cast("double"))


def price_range(c: Column) -> tuple[Column, Column]:
    """The least and the greatest number of a text; NULL without one."""
    pieces = F.filter(F.split(F.replace(c, F.lit(","), F.lit("")), "[^0-9.]+"), lambda x: x != "")
    numbers = F.array_compact(F.transform(pieces, lambda x: F.rtrim(x, F.lit(".")).try_cast("double")))
    return F.array_min(numbers), F.array_max(numbers)


def city_and_state(c: Column) -> tuple[Column, Column]:
    part = lambda k: F.nullif(F.trim(F.coalesce(F.try_element_at(F.split(c, ","), F.lit(k)), F.lit(""))), F.lit(""))
    return part(1), part(2)


def sale_state(c: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    known = F.create_map(*(F.lit(x) for kv in SALE_STATES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, raw), F.when(raw == "", "UNKNOWN").otherwise(F.upper(raw)))


def without_secrets(url: Column) -> Column:
    """The values of credential keys in a query replaced by ***."""
    return F.regexp_replace(url, rf"(?i)([?&](?:{SECRET_KEYS})=)[^&#]*", "$1***")


def _folded(text: Column, opening: str, closing: str, inner) -> Column:
    """The text with each balanced pair of brackets replaced by inner(what it holds), innermost first, at any depth.

    One pass over the pieces between brackets keeps a stack of open texts; brackets without a partner go.
    """
    for mark in (opening, closing):
        text = F.replace(text, F.lit(mark), F.lit(f"\x01{mark}\x01"))
    pieces = F.split(text, "\x01")
    top = lambda stack: F.element_at(stack, -1)
    under = lambda stack, n: F.slice(stack, F.lit(1), F.size(stack) - n)

    def step(stack, piece):
        closed = F.concat(under(stack, 2), F.array(F.concat(F.element_at(stack, -2), inner(top(stack)))))
        added = F.concat(under(stack, 1), F.array(F.concat(top(stack), piece)))
        return F.when(piece == opening, F.concat(stack, F.array(F.lit("")))).when(piece != closing, added).when(F.size(stack) > 1, closed).otherwise(stack)

    return F.aggregate(pieces, F.array(F.lit("")), step, lambda stack: F.array_join(stack, ""))


def _after_each(text: Column, mark: str, rest) -> Column:
    """The text with every part behind a mark replaced by rest(part)."""
    parts = F.split(text, re.escape(mark))
    return F.array_join(F.transform(parts, lambda part, k: F.when(k == 0, part).otherwise(rest(part))), " ")


def wikitext(c: Column) -> Column:
    """Prose of wikitext: comments, references, templates and files dropped at any depth, links by their text, bare urls, headings' and quotes' signs gone."""
    behind = lambda part, mark: F.when(F.instr(part, mark) > 0, F.substr(part, F.instr(part, mark) + len(mark))).otherwise("")
    tag = lambda part: F.substring_index(part, ">", 1)
    text = _after_each(c, "<!--", lambda part: behind(part, "-->"))
    text = _after_each(text, "<ref", lambda part: F.when(tag(part).endswith("/"), behind(part, ">")).otherwise(behind(part, "</ref>")))
    text = _folded(text, "{{", "}}", lambda body: F.lit(" "))
    is_file = lambda body: F.lower(F.trim(F.substring_index(body, ":", 1))).isin("file", "image", "media") & body.contains(":")
    text = _folded(text, "[[", "]]", lambda body: F.when(is_file(body), " ").otherwise(F.substring_index(body, "|", -1)))
    words = F.split(F.translate(_unquoted(text), "|", " "), r"\s+")
    kept = F.filter(F.transform(words, lambda w: F.trim(w, F.lit("="))), lambda w: (w != "") & ~w.contains("://"))
    return F.array_join(F.transform(kept, lambda w: F.when(w.endswith("]") & ~w.contains("["), F.rtrim(w, F.lit("]"))).otherwise(w)), " ")


def _unquoted(text: Column) -> Column:
    """Without runs of two or more apostrophes, which mark bold and italic."""
    return F.regexp_replace(text, "'{2,}", "")


def channel_id(url: Column) -> Column:
    """UC..., @handle or user name of a channel's address, as the last part of its path says; NULL for other pages."""
    parts = F.filter(F.split(F.substring_index(F.substring_index(url, "#", 1), "?", 1), "/"), lambda p: p != "")
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    named = ~last.rlike(r"[^A-Za-z0-9_.-]") & (F.length(last) >= 2)
    channel = (before == "channel") & last.startswith("UC") & (F.length(last) >= 12) & ~last.rlike(r"[^A-Za-z0-9_-]")
    handle = last.startswith("@") & (F.length(last) >= 3) & ~F.substr(last, F.lit(2)).rlike(r"[^A-Za-z0-9_.-]")
    return F.when(channel | handle | ((before == "user") & named), last)


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The day, or NULL if there is none such."""
    return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")  # a NULL is written as such, which is no date


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters; NULL if they are no month's."""
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.lower(name), 1, 3)), F.lit(0).cast("long"))


def _named_day(names: str, year: str = r"(?:\s+[0-9]{4}(?!\S))?") -> str:
    """The pattern of a month name, a number of one or two digits and a year (as it says: optional) as whole words of ``_day_words``."""
    return rf"(?<!\S)(?:{names})\s+[0-9]{{1,2}}(?!\S){year}"


def _day_words(text: Column) -> Column:
    """Lower case, without the dots and commas behind words."""
    return F.translate(F.lower(text), ".,", "  ")


def _day_in(found: Column, year_hint: Column) -> Column:
    """The day of what ``_named_day`` found; NULL for NULL."""
    part = F.split(found, r"\s+")
    return day_of(F.coalesce(F.get(part, F.lit(2)).try_cast("int"), year_hint), month_number(F.get(part, F.lit(0))), F.get(part, F.lit(1)).try_cast("int"))


#: Words that begin as a month's name does, and month names as they are written.
_LIKE_MONTHS, _MONTHS = rf"(?:{'|'.join(MONTHS)})[a-z]*", "|".join((*MONTH_NAMES, *MONTHS, "sept"))


def single_date(raw: Column, year_hint: Column) -> Column:
    """The day of a text that holds one date (month, day, year); where no year stands in the text, the hint's. NULL for none or several.

    Each text is searched by patterns as a whole: functions over its words would cut it anew for each of them.
    """
    every = lambda pattern: F.regexp_extract_all(_day_words(raw), F.lit(pattern), F.lit(0))
    has_year = raw.rlike("(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")
    found = F.when(has_year, every(_named_day(_LIKE_MONTHS, r"\s+[0-9]{4}(?!\S)"))).otherwise(every(_named_day(_LIKE_MONTHS)))
    return _day_in(F.when(F.size(found) == 1, F.get(found, F.lit(0))), year_hint)


def date_phrase(phrase: Column, published: Column) -> Column:
    """Month and day (with a year, else the publication's), an ISO day, or a weekday: the next one after publication, never its own day."""
    low = F.rtrim(F.lower(F.trim(phrase)), F.lit(","))
    named = F.nullif(F.regexp_extract(_day_words(low), _named_day(_MONTHS), 0), F.lit(""))
    iso = F.when(low.rlike(r"\A[^-]{4}-[^-]{2}-[^-]{2}\z"), low.try_cast("date"))
    weekday = F.when(low.isin(*WEEKDAYS), F.call_function("next_day", published, low))
    return F.coalesce(_day_in(named, F.year(published)), iso, weekday)


def compact_time(c: Column) -> Column:
    """YYYYMMDD with or without a time, of which all but digits is dropped; NULL if it is none."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.coalesce(F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")))
