"""Delimiters, headers and verification at their edges."""

from pitengine.operators import verify
from pitengine.sources import delimited as S


def test_delimiters_and_quoted_cells(spark):
    files = {
        1: ["a;b,c;d", "1;2,5;3", '2;"x;y";4'], 2: ["a\tb", "1\t2,3,4", "5\t6;7"], 3: ["only one column", "x"], 4: ['Customer Key,"Gross, total",Tour', '7,"1,5",say ""hi""', '8,"say ""hi""",z', "9"], 5: ["a,b;c", "1,2;3"],
    }
    lines = spark.createDataFrame([(f, k, t) for f, rows in files.items() for k, t in enumerate(rows)], "file int, line long, text string")
    assert {r.file: r.delimiter for r in S.delimiters(lines).collect()} == {1: ";", 2: "\t", 3: ",", 4: ",", 5: ","}
    fields = {"customer_key": ("id",), "gross_total": ("gross",), "tour_name": ("tour",), "seats": ()}
    rows = S.table_rows(lines.where("file = 4"), fields).orderBy("line").collect()
    assert [(r.customer_key, r.gross_total, r.seats) for r in rows] == [("7", "1,5", None), ("8", 'say "hi"', None), ("9", None, None)] and rows[1].tour_name == "z"


def test_headers_map_once(spark):
    headers = spark.createDataFrame([(1, 0, "Tour Nmae"), (1, 1, "tour_name"), (1, 2, "GROSS"), (1, 3, "zzz"), (1, 4, "")], "file int, at int, header string")
    got = sorted((r.at, r.field, r.score) for r in S.mapped_headers(headers, {"tour_name": ("tour",), "gross_total": ("gross",)}).collect())
    assert got == [(1, "tour_name", 1.0), (2, "gross_total", 0.95)]


def test_verification_names_the_first_reason(spark):
    good = dict(document="d", span_start=1, span_end=2, contradicted=False, kind="EVENT_DATE", evidence_class="OBSERVED_DAY", value="2024-01-02", lower_bound=None, upper_bound=None, granularity="DAY", interpretation=None, rights="RESEARCH_ONLY")
    cases = [
        ({}, None), ({"document": ""}, "claim_without_source_document"), ({"span_end": None, "rights": None}, "claim_without_evidence_span"), ({"contradicted": None}, None), ({"evidence_class": None}, None),
        ({"kind": "BOOKING_OR_OFFER"}, "announcement_interpreted_as_booking_exact"), ({"kind": "BOOKING_OR_OFFER", "interpretation": "the contract_date"}, None),
        ({"kind": "PRESALE", "value": None}, "relative_date_without_anchor"), ({"kind": "PRESALE", "value": None, "upper_bound": "2024-01-05"}, None),
        ({"granularity": "EXACT", "value": "2024-01-02T10:00"}, "unsupported_timezone_precision"), ({"granularity": "EXACT", "value": "2024-01-02T10:00+01:00"}, None), ({"granularity": "EXACT", "value": "2024-01-02"}, None),
        ({"granularity": None}, "unsupported_granularity"), ({"rights": None}, "source_rights_failure"), ({"lower_bound": "2024-01-02", "upper_bound": "2024-01-02"}, "interval_collapsed_to_midpoint"),
    ]
    rows = [{"nr": k} | good | change for k, (change, _) in enumerate(cases)]
    schema = "nr int, document string, span_start int, span_end int, contradicted boolean, kind string, evidence_class string, value string, lower_bound string, upper_bound string, granularity string, interpretation string, rights string"
    got = [r.reason for r in verify.verified(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).orderBy("nr").collect()]
    assert got == [reason for _, reason in cases]
