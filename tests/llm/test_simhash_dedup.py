import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pitengine.llm import simhash_dedup as S
from pitengine.llm._shared import materialize


def plain_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), 42) for k in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(rows):
    """Component by brute force over all pairs of (id, fingerprint)."""
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, f in rows:
            for j, g in rows:
                if (f ^ g).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints(spark, sf, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in S.fingerprints(docs).collect())
        assert got == sorted((str(r.doc_id), plain_fingerprint(r.text)) for r in docs.collect())


def test_spark_hashes_the_same(spark):
    assert spark.sql("select xxhash64('a b c d')").first()[0] & (1 << 64) - 1 == S.fingerprint("a B c d")


def test_components_match_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.simhash_components(docs).collect()}
    assert {i: c for i, (_, c) in got.items()} == roots([(i, f) for i, (f, _) in got.items()])


def test_drop_with_clashing_names(clashing_docs):
    left = S.drop_near_copies(clashing_docs)
    assert left.schema == clashing_docs.schema and {r.doc_id for r in left.collect()} == {1, 5, 7, 9, 10, None}


@pytest.mark.parametrize("segments", [S.SEGMENTS, S.WIDE_SEGMENTS])
@pytest.mark.parametrize("hot", [2048, 3])
def test_links_of_chains_and_dense_groups(spark, monkeypatch, hot, segments):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "BLOCK_ROWS", 40)
    monkeypatch.setattr(S, "BLOCK_PAIRS", 50)
    rnd, fps = random.Random(5), set()
    for _ in range(12):
        f = rnd.getrandbits(64)
        for _ in range(8):
            fps.add(f)
            for b in rnd.sample(range(64), rnd.choice((1, 3, 4, 4, 5))):
                f ^= 1 << b
    base = rnd.getrandbits(64)
    fps |= {base ^ (1 << b) for b in range(64)} | {0}
    rows = list(enumerate(rnd.sample(sorted(fps), len(fps))))
    classes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in rows], "fp long, node long")
    got = {r.node: r.root for r in S.components(S.links(classes, segments)).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == roots(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = S.simhash_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {1, 2, 3, 4} and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    left = S.drop_near_copies(odd_docs)
    assert left.columns == odd_docs.columns and {r.doc_id for r in left.collect()} == {1, 5, 7, 9, 10, None}
    assert S.simhash_components(no_docs).count() == 0 == S.drop_near_copies(no_docs).count()


def test_null_and_repeated_ids_join_nothing(spark):
    rnd = random.Random(8)
    texts = [[f"w{rnd.randrange(10**6)}" for _ in range(2000)] for _ in range(4)]
    near = lambda k: " ".join(texts[k][:-1] + ["other"])
    own = lambda k: " ".join(texts[k])
    # null ids near to 1 and 2; the repeated id 5 near to 3 in one row and unrelated in the next
    rows = [(1, own(0)), (None, near(0)), (2, own(1)), (None, near(1)), (3, own(2)), (5, near(2)), (5, own(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in S.simhash_components(docs).collect()) == [("1", 1), ("2", 2), ("3", 3), ("5", 3), ("5", 5), ("None", 1), ("None", 2)]
    assert sorted((str(r.doc_id), r.text) for r in S.drop_near_copies(docs).collect()) == sorted((str(i), t) for i, t in rows if t != near(2))


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def test_pairs_from_similarity_of_four_fifths_go(spark):
    rnd, rows = random.Random(21), []
    for k in range(200):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        other = list(words)
        for at in rnd.sample(range(300), 1 + k % 9):  # each changed word takes up to five shingles
            other[at] = "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    want = {2 * k + 1 for k in range(200) if similar(plain_set(rows[2 * k][1]), plain_set(rows[2 * k + 1][1]))}
    left = {r.doc_id for r in S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {i for i, _ in rows} - left
    assert 100 < len(want) < 200 and gone <= want and len(gone) >= 0.97 * len(want)


def test_forests_join_what_all_pairs_join():
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 60, 3000), rnd.integers(0, 60, 3000)
    a, b = a[a != b], b[a != b]
    d = rnd.integers(0, 18, len(a))
    x, y, _ = S._nearest(a, b, d)
    assert len(x) <= 59 and {*map(tuple, np.stack([x, y], 1))} <= {(min(p), max(p)) for p in zip(a, b)}
    assert len(S._forest(x, y)[0]) == len(S._forest(a, b)[0])


def dense_groups(groups, size, words, changes, seed):
    """Groups of texts near a common one: neighbours are similar, others a little less so."""
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            other = list(base)
            for at in rnd.sample(range(words), rnd.randrange(changes + 1)):
                other[at] = f"x{rnd.randrange(1000)}"
            rows.append((len(rows), " ".join(other)))
    return rows


def plain_left(rows):
    """Ids that stay, by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    of = {}
    for k, x in enumerate(sets):
        for e in x:
            of.setdefault(e, []).append(k)
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for k, x in enumerate(sets):
        seen = set()
        for e in x:
            seen.update(j for j in of[e] if j > k)
        for j in seen:
            if root(j) != root(k) and similar(x, sets[j]):
                label[max(root(j), root(k))] = min(root(j), root(k))
    return {rows[k][0] for k in range(len(rows)) if root(k) == k}


def test_dense_groups_lose_no_link(spark):
    rows = dense_groups(4, 150, 150, 7, 11)
    want = plain_left(rows)
    got = {r.doc_id for r in S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # what the bits of the fingerprints miss at similarities near 0.8 is all that may be left over
    assert 4 < len(want) < 400 and got >= want and len(got - want) <= 0.01 * (len(rows) - len(want))


def test_crowded_values_stay_marked():
    """A crowded value's forest is handed on with the value, also after the forests of several blocks were merged."""
    rnd = np.random.default_rng(5)
    words = np.full(300, 7, np.int64) ^ (1 << rnd.integers(0, 40, 300))
    node = np.arange(300)
    for pairs in (10**6, 4000):
        compare = S._Candidates(4)
        key = np.concatenate([np.full(300, 5), np.full(300, 5), [9, 9]])
        probe = np.concatenate([np.zeros(300, bool), np.ones(300, bool), [False, True]])
        fp, own = np.concatenate([words, words, words[:2]]), np.concatenate([node, node, node[:2]])
        before, S.BLOCK_PAIRS = S.BLOCK_PAIRS, pairs
        try:
            out = compare.block(key, probe, fp, own)
        finally:
            S.BLOCK_PAIRS = before
        found = out.column("key").to_numpy()
        assert set(found.tolist()) == {5, -1} and (found == 5).sum() == 299 and 1 <= (found == -1).sum() <= 4 * 301 + 1


def test_crowds_give_the_same_as_pairs(spark):
    """With every table value taken for crowded, both rounds and the task on the sets themselves give the same rows."""
    rows = dense_groups(3, 60, 120, 6, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id for r in S.drop_near_copies(docs, few=10**6).collect()}
    assert {r.doc_id for r in S.drop_near_copies(docs, few=0).collect()} == plain


@pytest.mark.parametrize("hot", [2048, 3])
def test_second_round_takes_a_text_once_a_value(spark, monkeypatch, hot):
    """A value's members carry their root and come once; who meets whom is what the first round compares, in grids as well."""
    monkeypatch.setattr(S, "HOT", hot)
    rows = []
    for k, text in enumerate(t for _, t in dense_groups(2, 12, 60, 3, 14)):
        words, doubtful = S.wide_fingerprint(S.shingle_set(text))
        rows.append((k, k % 5, words.tolist(), doubtful.reshape(-1).tolist()))
    classes = spark.createDataFrame(rows, "node long, root long, words array<long>, doubtful array<byte>")
    entries = classes.select("node", "words", "doubtful").mapInArrow(S._wide_entries, "segment int, value long, probe boolean, fp long, node long")
    grids = S._grids(entries)
    assert (grids is not None) == (hot == 3)
    dealt = S._dealt(entries, grids)
    keys = materialize(dealt.where("node % 3 = 0").select("key").distinct(), "keys")
    members = S._members(classes, keys, grids).collect()
    assert len({(r.key, r.node) for r in members}) == len(members) and all(r.root == r.node % 5 and r.words == rows[r.node][2] for r in members)
    want = {(r.key, r.probe, r.node) for r in dealt.join(keys, "key", "left_semi").collect()}
    got = [(r.key, p, r.node) for r in members for p, has in ((False, r.stored), (True, r.probe)) if has]
    assert len(got) == len(set(got)) and set(got) == want


def test_dense_groups_hand_on_few_pairs(spark, monkeypatch):
    """Candidates that tasks hand on, and links that components are found from, stay few for each text of a dense group."""
    made, own = {}, S.materialize

    def counted(df, name):
        out = own(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(S, "materialize", counted)
    rows = dense_groups(1, 400, 150, 3, 15)
    left = S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert left < 20 and made["pairs"] <= 10 * len(rows) and made["similar_sets"] <= 5 * len(rows), made


@pytest.mark.parametrize("few", [0, 10**6])
def test_each_pair_between_components_once(few):
    """Members cut into batches anywhere: all candidates between different components, a pair once (as two nodes of a value, if crowded)."""
    rnd = random.Random(16)
    rows, want = [], set()
    for k, (_, text) in enumerate(dense_groups(3, 25, 80, 4, 17)):
        rows.append((k, k % 4, *S.wide_fingerprint(S.shingle_set(text))))
    classes = pa.record_batch({"node": [k for k, *_ in rows], "root": [r for _, r, *_ in rows], "words": [w.tolist() for *_, w, _ in rows], "doubtful": [d.reshape(-1).tolist() for *_, d in rows]}, schema=pa.schema([("node", pa.int64()), ("root", pa.int64()), ("words", pa.list_(pa.int64())), ("doubtful", pa.list_(pa.int8()))]))
    members = pa.Table.from_batches(S._wide_members([classes])).rename_columns(["segment", "key", "stored", "probe", "fp", "node", "root", "words", "doubtful"]).sort_by("key")
    of = {}
    for key, stored, node in zip(*(members.column(c).to_pylist() for c in ("key", "stored", "node"))):
        of.setdefault(key, []).append((stored, node))
    for group in of.values():
        for stored, a in group:
            for _, b in group:
                if stored and a % 4 != b % 4 and sum(int(x).bit_count() for x in (rows[a][2] ^ rows[b][2]).view(np.uint64)) <= S.WIDE_DISTANCE:
                    want.add((min(a, b), max(a, b)))
    cuts = [0, *sorted(rnd.sample(range(1, members.num_rows), 60)), members.num_rows]
    batches = [b for x, y in zip(cuts, cuts[1:]) for b in members.slice(x, y - x).combine_chunks().to_batches()]
    out = pa.Table.from_batches(S._across(batches, few)).to_pylist()
    if few:
        got = [(r["a"], r["b"]) for r in out]
        assert len(want) > 300 and {r["key"] for r in out} == {-1} and set(got) == want and len(got) < 1.5 * len(want)
    else:
        crowds = {}
        for r in out:
            assert r["a"] == r["b"] and r["root"] == r["a"] % 4 and r["words"] == rows[r["a"]][2].tolist()
            crowds.setdefault(r["key"], set()).add(r["a"])
        assert want <= {(a, b) for c in crowds.values() for a in c for b in c} and sum(map(len, crowds.values())) == len(out)
