import math
import re

import pytest
from pyspark.sql import functions as F

from pitengine.llm import curriculum_mix as C


def fill(sizes, weights=(5, 2, 1), ratio=1.5, cap=2):
    """Targets as the rule is worded: share by weight, stop, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), ratio * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_.discard(s)
    return target


def test_targets_and_takes(spark, sf, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = docs.collect()
        count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes = {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
        want, got = fill(sizes), C.mix(docs).collect()
        assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), count(r.text)) for r in rows)
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        found, named = sorted({(r.source_size, r.target) for r in got}), sorted({(sizes[s], want[s]) for s in sizes})
        assert len(found) == len(named) and all(a == b and math.isclose(x, y, abs_tol=1e-6) for (a, x), (b, y) in zip(found, named))
        assert abs(sum(r.taken for r in got) - sum(want.values())) <= len(sizes)
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, C.mix(docs).collect()), key=str)


def test_bucket_number_does_not_matter(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = sorted(map(tuple, C.mix(docs).collect()), key=str)
    monkeypatch.setattr(C, "LEAST_BUCKETS", 4)
    assert one == sorted(map(tuple, C.mix(docs).collect()), key=str)


@pytest.mark.parametrize("schedule", C.SCHEDULES)
def test_due_inverts_the_integral(spark, schedule):
    def area(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            x = min(max(t - t0, 0.0), t1 - t0)
            out += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return out

    rows = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", C.due(F.col("u"), schedule).alias("t")).collect()
    assert all(math.isclose(area(r.t) / area(1.0), r.u, abs_tol=1e-9) for r in rows)


def test_training_stream_is_sorted_and_keeps_columns(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {r.doc_id: r for r in C.mix(docs).collect()}
    rows = C.training_stream(docs).collect()
    for i, r in plan.items():
        assert sum(x.doc_id == i for x in rows) == sum(2 * p >= r.size > 0 for p in (r.pass_1, r.pass_2) if p)
    at, seen = -1.0, {}
    for r in rows:
        k = seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
        p = plan[r.doc_id]
        due = [p[f"position_{j}"] for j in (1, 2) if p[f"pass_{j}"] and 2 * p[f"pass_{j}"] >= p.size][k - 1]
        assert due >= at
        at = due
    assert C.training_stream(odd_docs).columns == odd_docs.columns
    assert C.training_stream(no_docs).count() == 0 == C.mix(no_docs).count()


def test_each_row_of_a_repeated_id_has_its_own_plan(spark, clashing_docs):
    texts = ["a b c d e f", "g h i j k l m n", "o p q", "o p q"]
    rows = [(1, texts[0], "s1"), (1, texts[1], "s2"), (1, texts[2], "s1"), (1, texts[3], "s1"), (None, texts[0], "s1"), (2, " ".join("x" * 9), "s3"), (3, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = C._plan(docs).collect()
    want = sum(2 * p >= r.size > 0 for r in plan for p in (r.pass_1, r.pass_2) if p)
    got = C.training_stream(docs).collect()
    assert len(got) == want and {tuple(r) for r in got} <= set(rows)
    for k, (i, text, source) in enumerate(rows):
        if k in (0, 1, 4, 5, 6):
            own = [r for r in plan if r.doc_id == i and r.size == len(text.split()) and r.source == (source or "")]
            times = sum(2 * p >= r.size > 0 for r in own[:1] for p in (r.pass_1, r.pass_2) if p)
            assert len(own) == 1 and sum(tuple(r) == (i, text, source) for r in got) == times
    assert C.training_stream(clashing_docs).columns == clashing_docs.columns


def test_result_is_sorted_by_position(spark, sf):
    at = [r.position_1 for r in C.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    known = [x for x in at if x is not None]
    assert known == sorted(known) and at[: len(known)] == known
