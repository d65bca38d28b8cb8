import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from pitengine.llm import curriculum_mix, simhash_dedup, toxicity
from pitengine.llm._shared import materialize

from .test_simhash_dedup import plain_set, similar
from .test_toxicity import plain_score


@pytest.mark.parametrize("name", ["sf0.001", "odd"])
def test_stages_match_brute_force(spark, sf, odd_docs, name):
    docs = odd_docs if name == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, None
    for k, (stage, run) in enumerate(P.STAGES):
        rows = docs.collect()
        out = materialize(run(spark, docs, sf), stage)
        got = out.collect()
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
        ids = Counter((r.doc_id, r.text) for r in got) if k < len(P.STAGES) - 1 else None
        if stage == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            short = [r for r in rows if len(r.text or "") < 3000]
            clean = {(r.doc_id, r.text) for r in short if plain_score(r.text, model.toxic, model.ordinary, model.tau, model.base, model.slope) < 0.5}
            assert {k for k in ids if len(k[1] or "") < 3000} == clean and not set(ids) - {(r.doc_id, r.text) for r in rows}
        elif stage == "exact_dedup":
            best = {}
            for r in rows:
                best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
            assert sorted((-1 if i is None else i) for i, _ in ids.elements()) == sorted(best.values())
        elif stage == "simhash_near_dedup":
            # all pairs of 5-word shingle sets; a row goes if a smaller id is in its component
            sets = [(r.doc_id, plain_set(r.text)) for r in rows if r.doc_id is not None]
            label = {i: i for i, _ in sets}
            changed = True
            near = [(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[k + 1 :] if (similar(x, y) if x or y else True)]
            while changed:
                changed = False
                for i, j in near:
                    low = min(label[i], label[j])
                    if (label[i], label[j]) != (low, low):
                        label[i] = label[j] = low
                        changed = True
            assert ids == Counter((r.doc_id, r.text) for r in rows if r.doc_id is None or label[r.doc_id] == r.doc_id)
        elif stage == "mix_sources":
            plan = {}
            for r in curriculum_mix.mix(docs).collect():
                plan[r.doc_id] = plan.get(r.doc_id, 0) + sum(2 * p >= r.size > 0 for p in (r.pass_1, r.pass_2) if p)
            assert Counter(i for i, _ in ids.elements()) == Counter({i: n for i, n in plan.items() if n})
            assert set(ids) <= {(r.doc_id, r.text) for r in rows}
        else:
            tok = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
            want = []
            for r in rows:
                own = tok.encode(r.text or "", add_special_tokens=False).ids
                want.append((str(r.doc_id), r.source, own, hashlib.sha256(tok.decode(own, skip_special_tokens=False).encode()).hexdigest()))
            assert sorted((str(r.doc_id), r.source, r.ids, r.decoded_sha256) for r in got) == sorted(want)
        docs, before = out, rows


def test_no_group_of_copies_is_left(spark, sf):
    docs = P.run(spark, sf)
    assert docs.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"] and docs.count() > 0
    assert simhash_dedup.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
