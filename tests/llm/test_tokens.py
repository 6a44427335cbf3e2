import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402

from inkmeter.llm.tokens import END, Encoder, pack, token_output, unpack  # noqa: E402

FILE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.sampled_from([1, 7, 128]))
def test_round_trip(ids, block):
    data = pack(np.array(ids, np.uint32), block)
    assert unpack(data).tolist() == ids
    assert unpack(data, 1, 3).tolist() == ids[block : 3 * block]


def test_outliers_are_exceptions_and_take_little_room():
    ids = np.arange(1280, dtype=np.uint32) % 16 + 1000
    plain = len(pack(ids))
    ids[::128] = 4_000_000_000
    assert unpack(pack(ids)).tolist() == ids.tolist()
    assert len(pack(ids)) <= plain + 10 * 6


WHOLE = Tokenizer.from_file(FILE)
PIECES = Encoder(FILE)


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("aBcdıİſσΣς'sStrevmlld.,;!? \n\t 　​́̀é1２<|>endoftx½ﬁ中") | st.characters(codec="utf-8"), max_size=60))
def test_pieces_encode_like_the_whole_text(text):
    want = [*WHOLE.encode(text, add_special_tokens=False).ids, END]
    assert np.frombuffer(PIECES.ids(text), "<u4").tolist() == want


@pytest.mark.parametrize("text", ["<|endoftext|>", "A<|endoftext|>b <|StartOfText|>", "İ. İ, aİ. İstanbul, İİ,", "don't 'tis IT'S we'll. x.'s", "á ́b"])
def test_special_strings_encode_like_the_whole_text(text):
    want = [*WHOLE.encode(text, add_special_tokens=False).ids, END]
    assert np.frombuffer(PIECES.ids(text), "<u4").tolist() == want


def test_files_hold_all_documents_in_order(spark, tmp_path):
    rows = [(i * 7 % 50, prose(i, 5 + i)) for i in range(50)] + ODD + [(60, prose(9, 3_000))]
    got = token_output(table(spark, rows), FILE, str(tmp_path / "t")).collect()
    start = 0
    want = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, END], "<u4")
        want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert known == sorted(known, key=lambda x: (x is not None, x or 0))


def test_empty_table(spark, tmp_path):
    assert token_output(table(spark, []).select("text", "doc_id"), FILE, str(tmp_path / "t")).collect() == []
