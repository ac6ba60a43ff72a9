import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartolith.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


CASES = ["", " ", "the&&& héllo don't ½x", "<|endoftext|>a<|startoftext|> b<|endoftext|>", "ΑΣ ΣΑΣ", "é  x y", "x" * 300 + "ab" * 100, "I'LL we've they'd 'tis", "日本語 тест 🙂🙂", "a\x1cb\x85c", "aa" * 5000, "THERHAOU!! 1234 <|endoftext"]
CASES += ["a\0b", "\0", "a \0\0 b", "".join(map(chr, range(32))) + "x" + "".join(map(chr, range(127, 160)))]
# two words for which a polynomial modulo 2 ** 64 has one value, whatever its base
THUE = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(2048)) for k in (0, 1)]
CASES += [" ".join(THUE), THUE[0], THUE[1], "a1b22c don't 'll x'ly ''s 1's a<b <|x|> A--B__9.9%%", "é1 1é é'll É", "x" * 65 + "," + "y" * 64 + "!?" * 40]


@pytest.mark.parametrize("text", CASES)
def test_like_the_library(library, text):
    enc = bpe.encoder(PATH)
    ids = library.encode(text, add_special_tokens=False).ids
    assert enc.encode(text) == ids
    assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abth ein'sdlt.!é½1\n\tÉß&<|>"), max_size=80))
def test_like_the_library_on_any_text(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_like_the_library_on_any_text, "t") else test_like_the_library_on_any_text.t
    test_like_the_library_on_any_text.t = t
    assert bpe.encoder(PATH).encode(text) == t.encode(text, add_special_tokens=False).ids


def test_tree_of_its_own_equals_rows():
    enc = bpe.encoder(PATH)
    pieces = [b"thththinging", b"a", b"zz", b"q" * 64, "éèéèeaux".encode(), b"international"]
    assert [bpe.unpacked(x) for x in enc.encode_pieces(pieces)] == [enc.encode_long(p) for p in pieces]


def test_leftmost_minimum():
    t = bpe.SegmentTree([5, 3, 9, 3])
    assert t.root() == (3, 1)
    t.set(1, 10)
    assert t.root() == (3, 3)


def test_query_rows(spark, library):
    rows = [(1, c) for c in CASES] + [(2, None), (None, "x"), (1, CASES[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digest(df, PATH).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.bpe_digest(df.limit(0), PATH).count() == 0
    assert bpe.bpe_encode(df, PATH).filter("doc_id = 2").first().ids == []


def test_words_that_hash_alike_are_told_apart(monkeypatch):
    import numpy as np

    from cartolith.llm import common

    texts = [b"aa bb  aa", b"", b"cc \0 cc " + b"x" * 600 + b" " + b"x" * 601, b"aa" + b"\t" + b"longer-than-eight longer-than-eighT"]
    for same in (False, True):
        if same:  # as if all hashes were equal
            monkeypatch.setattr(common.Words, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
        words, codes, at = common.distinct_words(texts)
        assert [[words[i] for i in codes[a:z]] for a, z in zip(at, at[1:])] == [t.split() for t in texts]
        assert len(set(words)) == len(words)


def test_files_with_other_rules_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"] = {"type": "NFKC"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Encoder(str(tmp_path / "t.json"))
