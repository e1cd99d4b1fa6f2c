import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from shapes import awkward, empty
from spotloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def expected(text):
    return np.array(LIBRARY.encode_ordinary(text), dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab é\n.1", max_size=80) | st.lists(st.sampled_from(["the ", "ing", "aa", " aaaa", "日本", "🙂", "\r\n", "  ", "==="])).map("".join))
def test_same_ids_as_the_library(text):
    ids = bpe.codec(PATH, PATTERN).encode(text)
    assert ids == expected(text)
    assert "".join(bpe.decode_stream(ids, bpe.codec(PATH, PATTERN), chunk=1)) == text


def test_long_piece_takes_linear_time_and_bounded_tables(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 500)
    coder = bpe.Codec(PATH, PATTERN)
    text = "".join(np.random.default_rng(0).choice(list("abcdefgh"), 20_000))
    assert coder.encode(text) == expected(text)
    assert len(coder.pieces.transducer.states) <= 2 * 500 + 2


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=20), st.integers(1, 5))
def test_utf8_machine_agrees_with_a_whole_decode(data, step):
    machine = bpe.Utf8Machine()
    out = "".join(machine.push(data[i:i + step]) for i in range(0, len(data), step)) + machine.finish()
    assert out == data.decode("utf-8", "replace")


def test_awkward_rows(spark):
    rows = bpe.round_trip(awkward(spark), PATH, PATTERN).collect()
    texts = sorted(r.text or "" for r in awkward(spark).collect())
    assert sorted(r.decoded for r in rows) == texts
    assert sorted(hashlib.sha256(bytes(r.ids)).hexdigest() for r in rows) == sorted(hashlib.sha256(expected(t)).hexdigest() for t in texts)
    assert all(r.n_tokens == len(r.ids) // 4 for r in rows)
    assert bpe.round_trip(empty(spark), PATH, PATTERN).count() == 0
