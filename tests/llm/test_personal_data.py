import hashlib
import random
import re
import time

from pitengine.llm import personal_data as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_base(text):
    """The four rules as they are written, with the plain patterns."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_base_spans_match_the_plain_patterns():
    rnd = random.Random(1)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@b.c", "a@b", "a@b..c", "a@b.c@d.e", ".", "@", "-", "+", " ", "  ", "(", ")", "7", "12", "255", "256", "1.2.3.4", "001.02.3.0004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+49 30 123456", "\n", "é", "\U0001f600", "mail", "visa", "٣٤"]
    for _ in range(4000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))
        got = [(s.kind, s.start, s.end) for s in P.spans_of(text) if s.base]
        assert got == plain_base(text), text


def test_query_over_whole_documents(spark, sf):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = P.query(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_base(rows[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in P.BASE_KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if x.split(":")[0] in P.BASE_KINDS) == joined
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 5


def added(text):
    return [(s.kind, text[s.start : s.end]) for s in P.spans_of(text) if not s.base]


def test_checksums_and_context_decide_on_added_spans():
    assert added("pay to DE89 3704 0044 0532 0130 00 NOW") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("pay to DE88 3704 0044 0532 0130 00 NOW") == []
    assert added("GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]
    assert added("nir 1 84 12 76 451 089 46") == [("nir", "1 84 12 76 451 089 46")]
    assert added("nir 1 84 12 76 451 089 47") == []
    assert added("su DNI es 12345678Z hoy") == [("dni", "12345678Z")]
    assert added("part 12345678Z in stock") == [] and added("su DNI es 12345678A hoy") == []
    assert added("his SSN: 219-09-9999.") == [("ssn", "219-09-9999")]
    assert added("code 219-09-9999.") == [] and added("SSN 666-09-9999") == []
    assert added("at 2001:db8:85a3::8a2e:370:7334 now") == [("ip6", "2001:db8:85a3::8a2e:370:7334")]
    assert added("at 12:30:45 and std::map::at") == []
    assert added("Visa 4111 1111 1111 1111 0042 on file") == [("pan", "4111 1111 1111 1111")]
    assert added("Visa 4111 1111 1111 1112 0042 on file") == []
    assert added("card 4222222222222 ok") == [("pan", "4222222222222")]
    assert added("call (212) 555-0123 today") == [("tel", "(212) 555-0123")]
    assert added("rows (212) 555-0123 today") == [] and added("call about invoice 212 555 0123") == []


def test_scores_rise_with_context():
    plain, near = (P.spans_of(t)[0].score for t in ("see 4111 1111 1111 1111", "credit card 4111 1111 1111 1111"))
    against = P.spans_of("invoice 4111 1111 1111 1111")[0]
    assert against.base and against.score < plain < near


def test_long_runs_take_time_in_proportion():
    began = time.perf_counter()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "+1 " * 100_000, "a@" * 150_000, "a.b@c-" * 50_000, "1 " * 150_000, "AB12" + "A" * 300_000, "12-" * 100_000, ":" * 200_000, "(12) " * 60_000):
        P.spans_of(text)
    assert time.perf_counter() - began < 20


def test_odd_rows(spark, odd_docs, clashing_docs, no_docs):
    by_row = lambda df: sorted(map(str, df.collect()))
    assert by_row(P.find(odd_docs)) == by_row(P.find(clashing_docs))
    assert P.find(odd_docs).count() == odd_docs.count() and P.find(no_docs).count() == 0
    mails = spark.createDataFrame([(1, "\U0001f600 to a@b.c"), (1, "\U0001f600 to a@b.c"), (None, None), (2, "ip 1.2.3.4, +1 (212) 555-0100!")], "doc_id long, text string")
    got = P.find(mails).collect()
    assert [[(s.start, s.end, s.value) for s in r.spans] for r in got] == [[(5, 10, "a@b.c")]] * 2 + [[], [(3, 10, "1.2.3.4"), (12, 29, "+1 (212) 555-0100")]]
    assert [r.text for r in P.redact(mails).collect()] == ["\U0001f600 to <EMAIL>"] * 2 + [None, "ip <IP>, <PHONE>!"]
