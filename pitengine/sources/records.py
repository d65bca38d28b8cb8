"""Records out of the lines of raw pages: parsers that keep a small state while a page's lines go by.

Spark deals the lines by page and sorts them; a parser sees one page's lines in order and holds no more than the record it is in, so
pages of any length stream. Lines come and records go as Arrow batches (``mapInArrow``). What can't be read leaves a row with a
``reason`` instead of vanishing.

- ``PairedLines``: a head (``3) Name``) and a line of ``Key: value;`` fields; the tiers that a page lists first hold five records each.
- ``Blocks``: seven lines from a date on: date, name, place, city, gross, headcount, shows.
- ``Inline``: ``date: place, city (headcount - gross) (n shows)``; a line with a total says whether what follows is estimated.
- ``TableCells``: rows of a page's tables, cells by the headers above them.

``auto_records`` runs blocks and inline lines side by side and keeps the inline ones of pages without any block that was read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitengine.functions.forms import MONTHS

RECORD = (
    "page long, line long, layout string, rank int, name string, place string, city string, tier string, headcount double, gross double, "
    "low double, high double, promoter string, shows int, first_day date, last_day date, sell_through double, estimated boolean, reason string"
)
FIELDS = [f.split()[0] for f in RECORD.split(", ")]
#: Records of a tier, lines of a block, and the text that stands for an open number.
TIER_RECORDS, BLOCK_LINES, OPEN = 5, 7, "TBA"
DASHES = "-–—"
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+")


def number(text: str | None) -> float | None:
    """The number of a text with currency sign, thousands separators or a tilde; None if it is none."""
    try:
        return float((text or "").strip().lstrip("~$ ").replace(",", "").strip())
    except ValueError:
        return None


def month_of(word: str) -> int | None:
    short = word.lower()[:3]
    return MONTHS.index(short) + 1 if short in MONTHS else None


def days_in(text: str | None, year: int | None = None) -> tuple[date | None, date | None]:
    """First and last day that a text of months, days and one year names (``Oct. 27-28, 2013``, ``May 30 - June 2, 2024``)."""
    found, month = [], None
    for token in _TOKEN.findall(text or ""):
        if token.isalpha():
            month = month_of(token)
        elif len(token) == 4:
            year = int(token)
        elif month and len(token) < 3:
            found.append((month, int(token)))
    try:
        days = [date(year, *found[0]), date(year, *found[-1])] if found and year else [None, None]
    except ValueError:
        return None, None
    return days[0], days[1]


def is_day_line(text: str) -> bool:
    """Whether a line is nothing but a day or a range of days with its year."""
    tokens = _TOKEN.findall(text)
    if len(tokens) < 3 or not tokens[0].isalpha() or len(tokens[-1]) != 4 or tokens[-1][:2] not in ("19", "20"):
        return False
    rest = _TOKEN.sub("", text).strip()
    return all(month_of(t) if t.isalpha() else len(t) < 3 for t in tokens[:-1]) and not set(rest) - set(" .," + DASHES)


def record(page: int, line: int, layout: str, **known) -> tuple:
    return tuple(({"page": page, "line": line, "layout": layout, "estimated": False} | known).get(f) for f in FIELDS)


class PairedLines:
    def __init__(self):
        self.tiers, self.number_line, self.head, self.n = [], None, None, 0

    def eval(self, page: int, at: int, text: str) -> Iterator[tuple]:
        rank, bracket, name = text.partition(")")
        if bracket and rank.isdigit() and name.strip():
            if self.head:
                yield record(page, self.head[0], "pair", rank=self.head[1], name=self.head[2], reason="NO_BODY")
            self.head = (at, int(rank), name.strip(), page)
        elif "tickets sold:" in text.lower():
            yield self._body(page, at, text)
        elif not self.head and not self.n:
            self._tier(text)

    def _tier(self, text: str) -> None:
        """A tier is a range of numbers and the word capacity, on the same line or the next."""
        low = text.lower()
        size = low.removesuffix("capacity").strip()
        is_size = size.startswith("more than ") or size.endswith(" or less") or bool(size) and not size.strip("0123456789, " + DASHES)
        if low == "capacity":
            self.tiers += [f"{self.number_line} Capacity"] if self.number_line else []
            self.number_line = None
        elif is_size and any(map(str.isdigit, size)):
            if low.endswith("capacity"):
                self.tiers.append(text)
            self.number_line = None if low.endswith("capacity") else text

    def _body(self, page: int, at: int, text: str) -> tuple:
        if not self.head:
            return record(page, at, "pair", reason="NO_HEAD")
        pairs = (part.partition(":") for part in text.split(";"))
        fields = {key.strip().lower(): value.strip() for key, colon, value in pairs if colon}
        low, _, high = fields.get("ticket range", "").partition("-")
        place, comma, city = fields.get("venue", "").rpartition(",")
        first, last = days_in(fields.get("dates"))
        shows = number(fields.get("no. of shows"))
        tier = self.n // TIER_RECORDS
        line, rank, name, _ = self.head
        self.head, self.n = None, self.n + 1
        return record(
            page, line, "pair", rank=rank, name=name, place=(place if comma else city).strip() or None, city=city.strip() if comma else None,
            tier=self.tiers[tier] if tier < len(self.tiers) else None, headcount=number(fields["tickets sold"]), gross=number(fields.get("gross")), low=number(low),
            high=number(high), promoter=fields.get("promoter"), shows=None if shows is None else int(shows), first_day=first, last_day=last,
        )

    def terminate(self) -> Iterator[tuple]:
        if self.head:
            yield record(self.head[3], self.head[0], "pair", rank=self.head[1], name=self.head[2], reason="NO_BODY")


class Blocks:
    def __init__(self):
        self.lines: list[str] = []
        self.start = None

    def eval(self, page: int, at: int, text: str) -> Iterator[tuple]:
        if not self.lines and is_day_line(text):
            self.start = (page, at)
            self.lines = [text]
        elif self.lines:
            self.lines.append(text)
        if len(self.lines) == BLOCK_LINES:
            yield self._block()
            self.lines = []

    def _block(self) -> tuple:
        days, name, place, city, gross, heads, shows = self.lines
        first, last = days_in(days)
        known = {"name": name or None, "place": place, "city": city, "first_day": first, "last_day": last}
        count, bracket, share = heads.partition("(")
        numbers = number(gross), number(count)
        if OPEN in (gross.upper(), heads.upper()):
            return record(*self.start, "block", **known, reason="UNREPORTED")
        if None in numbers:
            return record(*self.start, "block", **known, reason="MALFORMED")
        words = f"{gross} {heads}".lower().replace(".", " ").split()
        guess = any("~" in w or w in ("est", "estimated") for w in words)
        n = shows.lower().removesuffix("s").removesuffix("show").strip()
        through = number(share.rstrip(")% ")) if bracket else None
        return record(*self.start, "block", **known, gross=numbers[0], headcount=numbers[1], sell_through=through, shows=int(n) if n.isdigit() else None, estimated=guess)

    def terminate(self) -> Iterator[tuple]:
        if self.lines:
            yield record(*self.start, "block", name=(self.lines + [None])[1], first_day=days_in(self.lines[0])[0], last_day=days_in(self.lines[0])[1], reason="INCOMPLETE")


class Inline:
    def __init__(self):
        self.estimated = False

    def eval(self, page: int, at: int, text: str) -> Iterator[tuple]:
        low = text.lower()
        totals = [f"total {kind} {what}" for kind in ("reported", "estimated") for what in ("gross", "attendance")]
        if any(t in low for t in totals):
            self.estimated = "estimated" in low and "reported" not in low
            return
        days, colon, rest = text.partition(":")
        where, bracket, numbers = rest.partition("(")
        place, comma, city = where.partition(",")
        if not (colon and bracket and comma and is_day_line(days.strip())):
            return
        groups = [g.strip(" )") for g in numbers.split("(")]
        parts = re.split(f"[{DASHES}]", groups[0], maxsplit=1)
        heads, gross = (number(p) for p in (parts + [None])[:2])
        first, last = days_in(days)
        if heads is None or gross is None:
            yield record(page, at, "inline", place=place.strip(), city=city.strip(), first_day=first, last_day=last, reason="MALFORMED")
            return
        shows = next((int(g.split()[0]) for g in groups[1:] if g.lower().endswith(("show", "shows")) and g.split()[0].isdigit()), None)
        guess = self.estimated or "~" in text or "estimated" in low.split()
        shows = shows or (1 if first == last else None)
        yield record(page, at, "inline", place=place.strip(), city=city.strip(), headcount=heads, gross=gross, shows=shows, first_day=first, last_day=last, estimated=guess)

    def terminate(self) -> Iterator[tuple]:
        return iter(())


class Both:
    def __init__(self):
        self.parsers = (Blocks(), Inline())

    def eval(self, page: int, at: int, text: str) -> Iterator[tuple]:
        for p in self.parsers:
            yield from p.eval(page, at, text)

    def terminate(self) -> Iterator[tuple]:
        for p in self.parsers:
            yield from p.terminate()


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "date": pa.date32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in RECORD.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Records as a batch; a whole number that its column can't hold is NULL."""
    fits = lambda v: [None if x is None or not -(1 << 31) <= x < 1 << 31 else x for x in v]
    return pa.RecordBatch.from_arrays([pa.array(fits(v) if f.type == pa.int32() else v, f.type) for f, v in zip(_SCHEMA, zip(*rows))], schema=_SCHEMA)


def records(lines: DataFrame, parser: type) -> DataFrame:
    """What a parser reads from lines (page, line, text)."""

    def run(batches):
        state = page = None
        for batch in batches:
            out = []
            for own, at, text in zip(*(batch.column(c).to_pylist() for c in ("page", "line", "text"))):
                if state is None or own != page:
                    out += state.terminate() if state else ()
                    state, page = parser(), own
                out += state.eval(own, at, (text or "").strip())
            if out:
                yield _batch(out)
        if state and (out := list(state.terminate())):
            yield _batch(out)

    dealt = lines.select(F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line"), F.col("text").cast("string").alias("text"))
    return dealt.repartition("page").sortWithinPartitions("page", "line").mapInArrow(run, RECORD)


def auto_records(lines: DataFrame) -> DataFrame:
    """Blocks where a page has any that was read, else its inline lines; blocks that were not read stay with their reason."""
    found = records(lines, Both)
    has_block = F.max((F.col("layout") == "block") & F.col("reason").isNull())
    pages = found.groupBy("page").agg(has_block.alias("_blocks"))
    return found.join(pages, "page").where((F.col("layout") == "block") | ~F.col("_blocks")).drop("_blocks")


#: What the headers of a chart's table are called, by field.
TABLE_HEADERS = {
    "rank": ("rank",), "name": ("artist/event", "artist"), "place": ("venue",), "city": ("city/state", "city"), "days": ("event dates", "dates"), "gross": ("gross sales", "gross"),
    "heads": ("attend/capacity", "attendance"), "shows": ("shows/sellouts", "shows"), "prices": ("prices",), "promoter": ("promoters", "promoter"),
}


def table_records(pages: DataFrame) -> DataFrame:
    """(page, row and the fields of TABLE_HEADERS as text) of the tables in pages (page, html); a row's cells go by the header row before it.

    Rows and cells are split in the JVM; a header row is one whose cells name three fields or more.
    """
    rows = pages.select("page", F.posexplode(F.split("html", r"(?i)<tr[^>]*>")).alias("row", "cells")).where("row > 0")
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
    cells = F.transform(F.regexp_extract_all("cells", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), tidy)
    rows = rows.select("page", "row", cells.alias("cells"))
    known = F.array(*(F.lit(h) for names in TABLE_HEADERS.values() for h in names))
    is_header = F.size(F.array_intersect(F.transform("cells", F.lower), known)) >= 3
    header = F.last(F.when(is_header, F.transform("cells", F.lower)), True).over(Window.partitionBy("page").orderBy("row"))
    rows = rows.withColumn("header", header).where(~is_header & F.col("header").isNotNull() & (F.size("cells") > 0))

    def field(names):
        places = [F.array_position("header", n) for n in names]
        at = F.greatest(*places) if len(places) > 1 else places[0]
        return F.when(at > 0, F.nullif(F.get(F.col("cells"), at.cast("int") - 1), F.lit("")))

    return rows.select("page", "row", *(field(names).alias(f) for f, names in TABLE_HEADERS.items()))
