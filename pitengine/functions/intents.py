"""Intents of texts by keyword patterns: a baseline that says what was found, never a probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODEL, VERSION = "intent-keyword-baseline", "EXPERIMENTAL_HEURISTIC_NOT_VALIDATED-v1"
#: The patterns of each intent.
INTENTS = {
    "ATTEND_INTENT": (
        r"\bbought?\s+(a\s+)?ticket", r"\bgot?\s+my\s+ticket", r"\btickets?\s+secured", r"\bsee\s+(him|her|them|this)\s+live", r"\bcatch\s+(him|her|them)\b", r"\bgoing\s+to\s+the\s+(show|gig|concert|festival)",
        r"\bcan'?t\s+wait\s+to\s+(see|watch|hear)", r"\bwho'?s\s+going\b", r"\bim\s+going\b", r"\bfomo\b",
    ),
    "PURCHASE_INTENT": (
        r"\bbought?\s+ticket", r"\bcopped?\s+ticket", r"\bticket\s+prices?\b", r"\bhow\s+much\s+(are|is)\s+(the\s+)?tickets?", r"\bpresale\b", r"\bon\s*sale\b", r"\bface\s+value\b", r"\bresale\b", r"\bscalpers?\b",
    ),
    "PRICE_SENSITIVITY": (r"\btoo\s+expensive\b", r"\boverpriced\b", r"\bcan'?t\s+afford\b", r"\bexpensive\b", r"\bcheap\b", r"\bprices?\s+are\s+(crazy|insane|high|low)", r"\bworth\s+it\b"),
    "RECOMMENDATION_INTENT": (r"\byou\s+should\s+(see|go|check)", r"\bdon'?t\s+miss\b", r"\bmust\s+see\b", r"\bhighly\s+recommend\b", r"\bgo\s+see\b", r"\bcheck\s+(him|her|them|this)\s+out\b"),
}


def intents(text: Column) -> Column:
    """An array with a struct per intent: task, label (the task, or no_signal) and the places of the patterns that fit."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def one(task: str, patterns: tuple[str, ...]) -> Column:
        hits = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(k)) for k, p in enumerate(patterns))))
        return F.struct(F.lit(task).alias("task"), F.when(F.size(hits) > 0, task).otherwise("no_signal").alias("label"), hits.alias("hits"))

    return F.array(*(one(task, patterns) for task, patterns in INTENTS.items()))
