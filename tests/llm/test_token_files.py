import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pitengine.llm import token_files as T
from pitengine.llm._shared import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("seq_len, batch_rows", [(2048, 64), (7, 3)])
def test_round_trip(spark, sf, odd_docs, seq_len, batch_rows):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        manifest = T.write_tokens(docs, new_path(spark, "t"), PATH, seq_len=seq_len, batch_rows=batch_rows)
        want = brute([(r.doc_id, r.text) for r in docs.collect()])
        got = T.read_documents(manifest).collect()
        assert sorted((r.start, str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((s, str(i), n, c) for i, s, n, c in want)
        assert all(zlib.crc32(np.array(r.input_ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
        stream = []
        for m in sorted(manifest.collect(), key=lambda m: m.shard):
            shard = T.Shard(m.path)
            for k in range(len(shard)):
                ids, mask = shard.sequence(k)
                assert len(ids) == len(mask) == seq_len and not ids.flags.owndata
                assert mask.all() or k == len(shard) - 1
                stream += ids[mask].tolist()
        assert len(stream) == sum(w[2] for w in want)
        assert all(zlib.crc32(np.array(stream[s : s + n], "<u4").tobytes()) == c for _, s, n, c in want)


def test_empty_table(spark, no_docs):
    manifest = T.write_tokens(no_docs, new_path(spark, "t"), PATH)
    assert manifest.count() == 0 == T.read_documents(manifest).count()


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(T, "CACHE_PIECES", 5)
    encode, tok = T.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ("a b c d e f g", "  lead\n\ntrail \t", "x\u00a0y \u2003z", "a b h", "a  b   c", "a \n  b \n \n c ", " d", "e  ", "!\x1c! \x1f ?", "  ", ""):
        assert np.frombuffer(encode.encode_batch([text])[0], "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_ranges(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 9, 50):
        cuts = list(range(0, 10 * n, 10))
        rows = spark.range(-5, 510).select(T.range_of(F.col("id"), cuts).alias("k"), "id").collect()
        assert [r.k for r in rows] == [sum(c < r.id for c in cuts) for r in rows]


def test_pieces_agree_with_whole_texts():
    import random

    encode, tok, rnd = T.Encoder(PATH), Tokenizer.from_file(PATH), random.Random(5)
    for _ in range(40):
        texts = ["".join(rnd.choice(["a", "bc", "Ü", "1", "!", " ", " ", " ", "\n", "\t", "\u00a0", "'s", "<|endoftext|>" if rnd.random() < 0.02 else "x"]) for _ in range(rnd.randrange(40))) for _ in range(50)]
        got = [np.frombuffer(x, "<u2").tolist() for x in encode.encode_batch(texts)]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
