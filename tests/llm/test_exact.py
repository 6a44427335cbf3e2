import hashlib
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402

from inkmeter.llm import exact  # noqa: E402
from inkmeter.llm.exact import Trie, exact_duplicates  # noqa: E402


def lower(text):
    return (text or "").encode().lower()


def brute(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, sorted."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=40))
def test_trie_holds_what_was_placed(keys):
    trie = Trie()
    for i, key in enumerate(keys):
        trie.place(key).take(i, 1, i, i, True)
    found = {text: (node.owner, node.n, node.best) for text, node in trie.texts()}
    assert found == {k: (keys.index(k), keys.count(k), len(keys) - 1 - keys[::-1].index(k)) for k in keys}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=8).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=60, unique=True))
def test_a_cut_subtree_and_the_rest_are_all(keys):
    trie = Trie()
    for i, key in enumerate(keys):
        trie.place(key).take(i, 1, i, i, True)
    before = trie.size
    prefix, top = trie.cut_heaviest()
    cut, left = [t for t, _ in trie.texts(prefix, top)], [t for t, _ in trie.texts()]
    assert sorted(cut + left) == sorted(keys) and cut and trie.size < before
    assert all(t.startswith(prefix) for t in cut) and not any(t.startswith(prefix) for t in left)


@pytest.fixture(scope="module")
def rows():
    long = prose(1, 20_000)
    texts = [prose(i, 40) for i in range(30)]
    plain = [(i, t) for i, t in enumerate(texts)]
    copies = [(100 + i, texts[i % 7].upper()) for i in range(60)] + [(200 + i, texts[3]) for i in range(120)]
    near = [(400, long), (401, long + "x"), (402, long[:-1]), (403, long), (404, "É"), (405, "é"), (406, texts[3] + " "), (407, texts[3] + " ")]
    return plain + copies + near + [r[:2] for r in ODD] + [(5, texts[5])]


def test_equals_brute_force(spark, rows):
    docs = table(spark, rows).repartition(5, F.xxhash64("text", "doc_id"))
    out = exact_duplicates(docs)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert result(out) == brute(rows)
    kept = out.where("kept").collect()
    assert len(kept) == len({lower(t) for _, t in rows})  # one row of each group, of repeated rows too
    assert all(r.doc_id == r.keep_id for r in kept)


def test_tries_without_room_and_classes_of_many_owners(spark, rows, monkeypatch):
    monkeypatch.setattr(exact, "FEW_OWNERS", 2)
    docs = table(spark, rows).repartition(9)
    assert result(exact_duplicates(docs, limit=2_000)) == brute(rows)


def test_text_of_equal_hash_is_not_equal_text(spark, rows, monkeypatch):
    """With one hash for all, the bytes alone decide."""
    docs = table(spark, [(i, c) for i, c in enumerate("abcabcaABC" * 3)]).repartition(3)

    class OneHash:
        @staticmethod
        def xxh3_64_intdigest(_):
            return 7

    monkeypatch.setattr(exact, "xxhash", OneHash)
    sizes = {r.text_sha256: r.group_size for r in exact_duplicates(docs).collect()}
    assert sorted(sizes.values()) == [9, 9, 12]


def test_empty_table_and_clashing_names(spark):
    docs = table(spark, [])
    assert exact_duplicates(docs).collect() == []
    named = table(spark, [(1, "a"), (2, "A"), (None, "a")]).withColumns({c: F.lit(0) for c in ("id", "row", "owner", "n", "hash", "length", "kept", "keep_id")})
    assert result(exact_duplicates(named)) == brute([(1, "a"), (2, "A"), (None, "a")])
