"""Verification of claims: accepted, or rejected with the first reason that holds, as one expression over a claim's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitengine.operators.pit import waterfall

#: Sources that may state a booking day exactly, classes of exact knowledge, kinds of sale days, precisions, and rights that permit research.
BOOKING_SOURCES = ("OBSERVED_BOOKING_DATE", "OBSERVED_OFFER_DATE", "CONTRACT_DATE", "INTERNAL_FIRST_PARTY_BOOKING_DATE")
EXACT_CLASSES = ("OBSERVED_EXACT", "OBSERVED_DAY")
SALE_KINDS = ("GENERAL_ONSALE", "PRESALE", "ANNOUNCEMENT")
PRECISIONS = ("EXACT", "DAY", "MONTH")
RESEARCH_RIGHTS = ("RESEARCH_ONLY", "TERMS_REVIEW_REQUIRED", "OPEN_COMMERCIAL_OK")


def _reasons() -> list[tuple[str, Column]]:
    c = F.col
    value, low, high = (F.nullif(c(n), F.lit("")) for n in ("value", "lower_bound", "upper_bound"))
    stated = F.coalesce(value, high, low)
    moment = stated.contains("T") | stated.contains(":")
    zoned = stated.endswith("Z") | F.substr(stated, F.lit(11)).rlike("[+-][0-9]{2}:?[0-9]{2}$")
    named = F.exists(F.array(*map(F.lit, BOOKING_SOURCES)), lambda m: F.upper(F.coalesce(c("interpretation"), F.lit(""))).contains(m))
    return [
        ("claim_without_source_document", F.coalesce(c("document"), F.lit("")) == ""),
        ("claim_without_evidence_span", c("span_start").isNull() | c("span_end").isNull()),
        ("wrong_artist_venue_city_or_date", F.coalesce(c("contradicted"), F.lit(False))),
        ("estimated_research_only_never_admissible", c("evidence_class").eqNullSafe("ESTIMATED_RESEARCH_ONLY")),
        ("unknown_never_admissible", c("evidence_class").eqNullSafe("UNKNOWN")),
        ("archive_upper_bound_must_set_upper_bound_not_exact", c("evidence_class").eqNullSafe("ARCHIVE_CAPTURE_UPPER_BOUND") & value.isNotNull() & (c("kind") != "BOOKING_OR_OFFER") & high.isNull()),
        ("announcement_interpreted_as_booking_exact", (c("kind") == "BOOKING_OR_OFFER") & F.coalesce(c("evidence_class"), F.lit("")).isin(*EXACT_CLASSES) & ~named),
        ("relative_date_without_anchor", c("kind").isin(*SALE_KINDS) & stated.isNull()),
        ("interval_collapsed_to_midpoint", (low == high) & (low == value)),
        ("unsupported_granularity", ~F.coalesce(c("granularity"), F.lit("")).isin(*PRECISIONS)),
        ("unsupported_timezone_precision", (c("granularity") == "EXACT") & moment & ~zoned),
        ("source_rights_failure", ~F.coalesce(c("rights"), F.lit("")).isin(*RESEARCH_RIGHTS)),
    ]


def verified(claims: DataFrame) -> DataFrame:
    """claims with reason (of the first check that fails, NULL: none) and status. Columns: document, span_start, span_end, contradicted, kind,
    evidence_class, value, lower_bound, upper_bound, granularity, interpretation, rights."""
    checks = [(name, F.coalesce(condition, F.lit(False))) for name, condition in _reasons()]
    return waterfall(claims, checks).withColumn("status", F.when(F.col("reason").isNull(), "ACCEPTED").otherwise("REJECTED"))
