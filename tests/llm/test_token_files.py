import glob
import os
import zlib

import numpy as np
import pytest
from cases import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leakscope.llm import token_files
from leakscope.llm.queries import op13_token_files, tokenizer_path
from leakscope.session import shared_folder

PATH = tokenizer_path("word_bpe_49k.json")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


WHOLE = Tokenizer.from_file(PATH)


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [token_files.END_ID]


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
@pytest.mark.parametrize("count", [0, 1, 63, 64, 65, 1000])
def test_packing_gives_the_ids_back(bits, count):
    ids = np.random.default_rng(bits).integers(0, 2**bits, count, dtype=np.uint64).astype("<u4")
    packed = token_files.pack_ids(ids, bits)
    assert len(packed) == -(-count // 64) * bits * 8
    assert token_files.unpack_ids(packed, bits, count).tolist() == ids.tolist()


def test_width_is_the_least():
    assert [token_files.width(n) for n in (3, 4, 5, 49408, 65536, 65537)] == [2, 2, 3, 16, 16, 17]


def test_shards_are_read_at_any_place():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 2**17, n).astype("<u4") for n in (1, 300, 5, 1, 777)]
    shard = token_files.Shard(token_files.shard_bytes([7, None, 9, -3, 2**62], docs, 17, 3, 10, block_ids=128))
    assert (shard.doc_ids, shard.part, shard.first) == ([7, None, 9, -3, 2**62], 3, 10)
    assert [shard.document(k).tolist() for k in range(5)] == [x.tolist() for x in docs]
    every = np.concatenate(docs).tolist()
    for start, count in ((0, 0), (0, 1084), (127, 2), (128, 128), (1083, 1), (250, 700)):
        assert shard.ids(start, count).tolist() == every[start : start + count]
    with pytest.raises(IndexError):
        shard.ids(1084, 1)
    with pytest.raises(ValueError):
        token_files.Shard(b"something else" * 10)


def same_ids(texts):
    import pyarrow as pa

    ids, bounds = token_files.word_coder(PATH).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == whole(text)[:-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n\x0b\x0c\r\x85\xa0 aAzIK.,;:!?ß'sé́İ1<|>endoftx"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_words_have_the_ids_of_whole_texts(texts):
    texts = [*texts, "It's, We'LL. ÀB;c İI\u0307! (K\u030a?x)"]
    for texts in (texts, [*texts, "It's <|endoftext|>a<|startoftext|> we'll", "<|ENDOFTEXT|>A"]):
        same_ids(texts)


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "KNOWN_WORDS", 5)
    coder = token_files.WordCoder(PATH)
    for k in range(40):
        texts = [f"word{k} word{k // 3} the same words again {j}" for j in range(4)]
        ids, bounds = coder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [whole(t)[:-1] for t in texts]
        assert len(coder.known) < 30


def test_letters_go_to_the_model_at_once():
    import pyarrow as pa

    class Seen:
        def __init__(self, whole):
            self.whole, self.words = whole, []

        def encode_batch_fast(self, words, **options):
            self.words += words
            return self.whole.encode_batch_fast(words, **options)

    coder = token_files.WordCoder(PATH)
    coder.whole = Seen(coder.whole)
    texts = ["Plain words, in small Letters. été x1 it's " + "long" * 500, "plain words again"]
    ids, bounds = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [whole(t)[:-1] for t in texts]
    assert {w for w in coder.whole.words if w.isascii() and w.isalpha()} == set() and "été" in coder.whole.words


def read(spark, path):
    rows = token_files.read_token_files(spark, path).cache()
    return sorted(token_files.with_starts(rows).collect(), key=lambda r: r.start)


@pytest.mark.parametrize("shard_ids", [1, 500, 4_000_000])
def test_files_hold_every_document_in_order(spark, shard_ids):
    path = shared_folder(spark, "test-token-files")
    rows = [*awkward(), (-5, "Ünïcode ñ 漢字"), (9, "<|endoftext|> x")]
    token_files.write_token_files(documents(spark, rows).repartition(5), path, PATH, block_ids=64, shard_ids=shard_ids)
    found, at = read(spark, path), 0
    for row in found:
        assert row.start == at and row.n_tokens == len(row.ids) // 4
        at += row.n_tokens
    ids = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found]
    keyed = lambda x: (x[0] is not None, x[0] or 0, len(x[1]), x[1])
    assert sorted(ids, key=keyed) == sorted(((d, whole(t)) for d, t in rows), key=keyed)
    # Rows of one id may come in any order, but the ids ascend.
    assert [i for i, _ in ids] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    # The files alone, by name, are the same sequence; numpy needs no Spark.
    files = [open(f, "rb").read() for f in sorted(glob.glob(path.removeprefix("file:") + "/part-*"))]
    shards = [token_files.Shard(f) for f in files if f.strip()]
    assert [x for s in shards for x in s.ids(0, s.n_ids).tolist()] == [x for _, d in ids for x in d]
    assert {s.bits for s in shards} == {16}


def test_an_empty_table_gives_no_shard(spark):
    path = shared_folder(spark, "test-token-files")
    token_files.write_token_files(documents(spark, []), path, PATH)
    assert read(spark, path) == []


def test_blocks_are_whole_words(spark):
    with pytest.raises(ValueError):
        token_files.write_token_files(documents(spark, []), "unused", PATH, block_ids=100)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query_equals_the_tokenizer(spark):
    docs = sorted(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    expected, at = [], 0
    for doc_id, text in docs:
        ids = np.array(whole(text), dtype="<u4")
        expected.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op13_token_files(spark, SF_DIR).collect())) == expected
