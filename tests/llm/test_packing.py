import random
from collections import defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leakscope.llm import packing
from leakscope.llm.queries import tokenizer_path


@given(st.integers(1, 50_000), st.integers(0, 12).map(lambda k: 1 << k))
def test_lengths_are_powers_of_two_that_add_up(total, most):
    lengths = packing.piece_lengths(total, most)
    assert sum(lengths) == total and all(x & (x - 1) == 0 and 0 < x <= most for x in lengths)
    rest = [x for x in lengths if x < most]
    assert rest == sorted(set(rest), reverse=True)


FILES = (tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_both_encoders_give_equal_ids():
    whole, coder = Tokenizer.from_file(FILES[0]), packing.Coder(*FILES)
    r = random.Random(3)
    parts = [*"ab1 .,'\n\t  é€  　 \x1c\x85!ß😀", "'s", "<|endoftext|>", "  ", " a", "the "]
    texts = ["", " ", *("".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(3000))]
    for text in texts:
        assert coder.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_code_point_is_cut_alike():
    # Words are cut by the class of each character, so every one is tried in each place.
    whole, coder = Tokenizer.from_file(FILES[0]), packing.Coder(*FILES)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 64):
        text = "".join(f"a{c}a 1{c}1 .{c}. {c} \n{c}{c}" for c in points[at : at + 64])
        assert coder.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, at


def test_every_id_lies_in_one_piece(spark):
    whole = Tokenizer.from_file(tokenizer_path())
    rows = [(i, t) for i, (_, t) in enumerate(cases.awkward())] + [(None, "no id")]
    found = packing.pack(cases.documents(spark, rows), *FILES[:1], ranks=FILES[1], pattern=FILES[2]).collect()
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
    for doc, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[doc], key=lambda r: r.start)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert {r.doc_tokens for r in own} == {len(ids)} and {r.offset for r in own} == {0}
    assert len({r.sequence_id for r in found}) == len(found)


def test_empty_table_and_wrong_length(spark):
    docs = cases.documents(spark, cases.awkward())
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer_path(), max_length=1000)


def test_buckets_hold_one_length_each(spark, tmp_path):
    pieces = packing.pack(cases.documents(spark, cases.awkward()), tokenizer_path())
    packing.write_buckets(pieces, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert back.where("octet_length(ids) <> 4 * length").count() == 0 and back.count() == pieces.count()
