"""Alignment of two tokenizers against a two-pointer merge in plain Python, with the libraries named by the contract."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from galerna.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_groups(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = align._byte_of_sign()
    out = []
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        groups, i, j, end_a, end_b, own = [], 0, 0, 0, 0, ([], [])
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            while i < len(ids_a) or j < len(ids_b):
                if end_a <= end_b:
                    own[0].append(ids_a[i])
                    end_a, i = end_a + len(bytes_a[i]), i + 1
                else:
                    own[1].append(ids_b[j])
                    end_b, j = end_b + len(bytes_b[j]), j + 1
                if end_a == end_b and own[0] and own[1]:
                    groups.append(own)
                    own = ([], [])
        out.append(groups)
    return out


def brute(texts):
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in brute_groups(texts)]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int), defaultdict(int)
    for p, n in count.items():
        for k in (0, 1):
            best[k][p[k]] = max(best[k][p[k]], n)
    out = []
    for g, own in zip(brute_groups(texts), links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()),
            *(sum(n for p, n in own.items() if count[p] == best[k][p[k]]) for k in (0, 1)), sum(n * count[p] for p, n in own.items()), text,
        ))
    return out


ODD = [
    "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "▁", " ", "\n\n  x", "naïve café ½ ﬁ", "日本語のテキスト", "👩‍👩‍👧 flags 🇫🇷", "\x00", "don't we'll 12345 %$#@!",
    "repeated repeated repeated", "repeated repeated repeated", "Donaudampfschifffahrtsgesellschaft " * 20, "x" * 3000 + "é" * 500,
]


def test_statistics(spark, edges, nothing):
    more = [(100 + k, t) for k, t in enumerate(ODD)]
    df = edges.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = align.statistics(df, A, B, public_tokenizers.PATTERN).collect()
    texts = [r.text for r in df.collect()]
    want = sorted(map(repr, zip([r.doc_id for r in df.collect()], brute(texts))))
    assert sorted(repr((r.doc_id, tuple(r[1:]))) for r in got) == want
    assert align.statistics(nothing, A, B, public_tokenizers.PATTERN).count() == 0
    assert nothing.schema["doc_id"].dataType == align.statistics(nothing, A, B, public_tokenizers.PATTERN).schema["doc_id"].dataType


def test_small_blocks_and_pieces_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(40))) for _ in range(120)]
    t = align.tokenizers(A, B, public_tokenizers.PATTERN)
    whole = [x.texts() for _, _, x in align._pieces(texts, t)]
    links = [tuple(map(list, x.links())) for _, _, x in align._pieces(texts, t)]
    monkeypatch.setattr(align, "LINKS", 7)
    assert [tuple(map(list, x.links())) for _, _, x in align._pieces(texts, t)] == links
    monkeypatch.setattr(align, "PIECE_BYTES", 50)
    assert [y for _, _, x in align._pieces(texts, t) for y in x.texts()] == [y for x in whole for y in x]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = align.statistics(df, A, B, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == dict(enumerate(brute(texts)))


def test_merge():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(n) < 0.4) + 1, n + 1) for _ in range(2))
        cuts = sorted({*a.tolist()} & {*b.tolist()})
        for ends, group in zip((a, b), align.merge(a, b)):
            assert group.tolist() == [sum(c < e for c in cuts) for e in ends.tolist()]


def test_alignments_and_long_white_space(spark):
    texts = ["the cat", None, " " * 120_000 + "end", "one two two"]
    got = {r.key: r for r in align.alignments(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), A, B, public_tokenizers.PATTERN).collect()}
    groups = brute_groups(texts)
    assert [[(x.a, x.b) for x in got[k].groups] for k in range(4)] == groups
    for k in range(4):
        assert {(x.a, x.b): x.n for x in got[k].links} == Counter((a, b) for x, y in groups[k] for a in x for b in y)


def test_query(spark):
    rows = queries.queries()["op11_alignment"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: x for d, x in zip(docs, brute([d.text for d in docs]))}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.n_best_b, r.count_sum, r.groups_sha256) for r in rows} == {
        d: (*x[:7], digest(x[7])) for d, x in want.items()
    }
