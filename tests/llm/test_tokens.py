import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gridweave.llm import binary as B
from gridweave.llm.packing import BestFit, best_fit_packing
from gridweave.llm.shared import new_path
from gridweave.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = list(" \n\t\r\x1c\x85\xa0 ​'sdtaZé.,É漢Ω!?|") + ["<|endoftext|>", "<|STARTOFTEXT|>", "<|EndOfText|>", "'ll", "́"]


@pytest.mark.parametrize("path, spaces", [(WORD, False), (BYTE, True)])
@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(ODD), max_size=14))
def test_units_encode_like_whole_texts(path, spaces, parts):
    text = "".join(parts)
    whole = _tokenizer(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(Encoder.of(path, spaces)([text])[0], "<u4").tolist() == whole


@pytest.mark.parametrize("path, spaces", [(WORD, False), (BYTE, True)])
def test_many_units_encoded_as_one_text(path, spaces):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdEé.,'9漢"), rng.integers(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(300)] + ["a <|STARTOFTEXT|> z", "<|startoftext|>x <|endoftext|>"]
    got = Encoder(path, spaces)(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == _tokenizer(path).encode(text, add_special_tokens=False).ids


_open = {}


def _tokenizer(path):
    return _open.setdefault(path, Tokenizer.from_file(path))


def test_packing(docs, corpus):
    rows = best_fit_packing(docs, WORD, capacity=64).collect()
    want, total = defaultdict(int), 0
    for r in corpus:
        ids = np.array([*_tokenizer(WORD).encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[r[0], k // 64, k, len(part), zlib.crc32(part.tobytes())] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-total // 64) + 1


def test_packing_of_nothing(empty):
    assert best_fit_packing(empty, WORD).count() == 0


def test_fullest_bin_closes_first():
    fit = BestFit(10, limit=2)
    assert [fit.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 was fuller than bin 0 and closed
    assert fit.place(4) == (0, 6) and fit.place(2) == (2, 8)
    with pytest.raises(ValueError):
        fit.place(11)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    data = B.pack(ids, 64, bits)
    assert (B.unpack(data) == ids).all()
    assert (B.unpack(data, 2, 3) == ids[128:192]).all()


@pytest.mark.parametrize("bits", [False, True])
def test_files_hold_all_documents(spark, docs, corpus, bits):
    path = new_path(spark, "ids")
    B.write_ids(docs, path, BYTE, bits=bits, block=100, stretch=1000)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in B.read_ids(spark, path).collect()))
    want, start = [], 0
    for r in sorted(corpus, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = np.array([*_tokenizer(BYTE).encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((start, r[0], len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_files_of_nothing(spark, empty):
    path = new_path(spark, "ids")
    B.write_ids(empty, path, BYTE)
    assert B.read_ids(spark, path).count() == 0
