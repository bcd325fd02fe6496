"""The whole pipeline against plain Python: rules, all pairs of texts, alignment with every item, tiktoken."""

import re
from collections import Counter

import public_tokenizers as P
import tiktoken
from test_bpe import V

import corpus_pipeline as C
from galerna.llm import copies, pii, quality
from galerna.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
KNOWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=V.ranks, special_tokens={})


def clean(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, n = sum(map(len, w)), len(w)
    q = quality
    return not (
        n < q.MIN_WORDS or 100 * len(repeated) > q.MAX_REPEAT_PERCENT * n or len(re.findall(q.SYMBOLS, t)) > q.MAX_SYMBOLS_PER_WORD * n
        or len(re.findall("[!?]", t)) > q.MAX_MARKS_PER_WORD * n or len(re.findall("[A-Z]", t)) > q.MAX_CAPITALS * chars
        or len(lines) - len(set(lines)) > q.MAX_DUPLICATE_LINES * len(lines) or chars > q.MAX_CHARS_PER_WORD * n
    )


def heads(rows):
    """The smallest id of each component of the similarity graph."""
    sets, of = [set(copies.shingles(t).tolist()) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * len(sets[i] | sets[j]) and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = [low if c == high else c for c in of]
    return [r for k, r in enumerate(rows) if r[0] == min(rows[m][0] for m in range(len(rows)) if of[m] == of[k])]


def test_rows_of_the_whole_pipeline(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [D.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = heads([r for r in docs if clean(r[1])])
    assert 50 < len(kept) < len(docs)
    left = [r for r in kept if not any(D.align(i, D.words(r[1]))[0] >= D.MIN_SCORE for i in items if len(set(i) & set(D.words(r[1]))) * 4 >= len(set(i)))]
    assert len(left) < len(kept)
    want = {d: KNOWN.encode_ordinary(pii.mask_text(t) or "") for d, t in left}
    got = C.run(spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: r.ids for r in got} == want and all(r.exact and r.n_tokens == len(r.ids) for r in got)


def test_columns_named_like_results_and_long_texts_pass_unchanged(spark):
    text = " ".join(f"word{k}" for k in range(80))
    long = " ".join(f"long{k}" for k in range(60_000))
    rows = [(1, text, "en", "s", 1, "mine", "yes"), (2, long, "en", "s", 2, "own", "no"), (3, "a" * 300_000, "en", "s", 3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted((r.doc_id, r.n_words, r.kept) for r in docs.collect()) == [(1, "mine", "yes"), (2, "own", "no")]
    assert sorted(r.doc_id for r in C.encoding(spark, docs, SF).collect()) == [1, 2]
