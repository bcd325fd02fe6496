import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from galerna.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
V = bpe.vocabulary(PATH, P.PATTERN)
KNOWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=V.ranks, special_tokens={})
texts = st.text(max_size=80) | st.lists(st.sampled_from(["a", " the", "'re", "'", "  ", "\n", "é", "漢", "1", "ing", "!", "tion"]), max_size=40).map("".join)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_encodes_as_the_library_does_and_decodes_back(text):
    ids = V.encode(text)
    assert ids == KNOWN.encode_ordinary(text)
    assert V.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(0, 100), st.integers(0, 100), texts)
def test_edits_and_appends_are_exact(text, start, length, new):
    e = bpe.Encoded(V, text)
    start = min(start, len(text))
    end = min(start + length, len(text))
    e.edit(start, end, new)
    assert e.text == text[:start] + new + text[end:]
    assert e.ids() == KNOWN.encode_ordinary(e.text)
    assert e.append(new).ids() == KNOWN.encode_ordinary(e.text)


def test_pairs_agree_with_merging_from_scratch():
    for word in ("the", "tion", "ation", "heat", "inging"):
        left, right = V.encode(word)[-1], V.encode("ing")[0]
        assert V.compatible(left, right) == (V.merge(V.bytes_of[left] + V.bytes_of[right]) == [left, right])


def test_edge_texts(edges, nothing):
    out = bpe.round_trip(edges, PATH, P.PATTERN)
    assert set(out.columns) == {*edges.columns, "decoded"} and dict(out.dtypes)["ids"] == "array<int>"
    rows = out.withColumn("digest", bpe.ids_digest()).collect()
    assert len(rows) == edges.count()
    for r in rows:
        ids = KNOWN.encode_ordinary(r.text or "")
        assert r.ids == ids and bytes(r.decoded) == (r.text or "").encode()
        assert r.digest == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.round_trip(nothing, PATH, P.PATTERN).count() == 0
    again = bpe.decode(bpe.encode(edges, PATH, P.PATTERN), PATH, P.PATTERN).select("decoded").collect()
    assert sorted(bytes(r[0]) for r in again) == sorted((r.text or "").encode() for r in edges.collect())


def test_reencode_frames(spark):
    df = spark.createDataFrame([("hello world", 5, 5, " big"), ("abc", 0, 3, ""), (None, 0, 0, "x"), ("same", None, None, None)], "text string, start long, end long, new string")
    got = [(r.edited, r.ids) for r in bpe.reencode(df, PATH, P.PATTERN).collect()]
    assert got == [(t, KNOWN.encode_ordinary(t)) for t in ("hello big world", "", "x", "same")]
