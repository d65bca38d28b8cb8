import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pitengine.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
OWN = B.load(PATH)


def test_same_as_the_library(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        want = []
        for r in docs.collect():
            ids = TOK.encode(r.text or "", add_special_tokens=False).ids
            text = TOK.decode(ids, skip_special_tokens=False)
            want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        encoded = B.encode_decode(docs, PATH)
        got = B.digests(encoded).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
        again = B.decode(encoded, PATH).collect()
        assert sorted(r.text for r in again) == sorted(r.decoded for r in encoded.collect())
    assert B.encode_decode(no_docs, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aab  's\tt\u0301\u03a3\u00e9\u2003\x1c\x85<|>")), max_size=60))
def test_any_text(text):
    ids = np.frombuffer(OWN.encode_batch([text])[0], "<i4")
    assert ids.tolist() == TOK.encode(text, add_special_tokens=False).ids
    assert OWN.decode(ids) == TOK.decode(ids.tolist(), skip_special_tokens=False)


def test_overlaps_and_long_words():
    for text in ("a" * 5001, "ha" * 3000 + "h", "=" * 777 + "-" * 1000, "ab" * 9 + " aaa aaaa aaaaa"):
        assert np.frombuffer(OWN.encode_batch([text])[0], "<i4").tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(B, "CACHE_PIECES", 4)
    own = B.Bpe(PATH)
    for texts in (["one two three four five six", "one"], ["seven", "one seven"]):
        assert [np.frombuffer(x, "<i4").tolist() for x in own.encode_batch(texts)] == [TOK.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_files_are_refused():
    with pytest.raises((ValueError, TypeError, KeyError)):
        B.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
