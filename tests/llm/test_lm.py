import math
import re
from collections import Counter

from pyspark.sql import functions as F

from galerna.llm import lm
from galerna.llm.common import held_out


def toks(t):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))] + [lm.END]


def model(texts, order):
    """The smoothed probabilities by their definition."""
    grams = [Counter() for _ in range(order)]
    for t in texts:
        w = [lm.END, *toks(t)]
        grams[0].update((x,) for x in w[1:])
        for n in range(2, order + 1):
            grams[n - 1].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    n, v = sum(grams[0].values()), len(grams[0])

    def p(w, h):
        if not h:
            return (grams[0][w,] + 1) / (n + v + 1)
        k = lm.STRENGTH[len(h) - 1]
        return (grams[len(h)][h + (w,)] + k * p(w, h[1:])) / (grams[len(h) - 1][h] + k)

    def score(t):
        w = [lm.END, *toks(t)]
        return sum(math.log10(p(w[i], tuple(w[max(0, i - order + 1) : i]))) for i in range(1, len(w)))

    return n, v, {g: c for (g,), c in grams[0].items()}, p, score


def texts_of(spark, edges):
    texts = [(100 + k, f"the cat sat on the mat number {k % 5} and THE dog ran to the cat {'again' * (k % 3)}") for k in range(60)]
    return spark.createDataFrame(texts, "doc_id long, text string").unionByName(edges.select("doc_id", "text"))


def rounded(rows):
    return Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)


def test_scores_by_the_definition(spark, edges):
    df = texts_of(spark, edges)
    held = held_out(F.col("doc_id"), 7, 2)
    train = [r.text for r in df.filter(~held).collect()]
    for order in (1, 2, 3):
        rows = lm.score(df, ~held, order=order).collect()
        n, v, counts, p, score = model(train, order)
        assert len(rows) == df.count()
        want = Counter()
        for d, t in df.collect():
            w = toks(t)
            base = sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)
            want[d, len(w), sum(x in counts for x in w), round(base, 6), round(score(t), 6)] += 1
        assert rounded(rows) == want
        assert {r.train_tokens for r in rows} == {n}
    # probabilities after a history sum to one, the unseen word included
    for h in ((lm.END,), (b"the",), (b"the", b"cat")):
        assert abs(sum(p(x, h) for x in counts) + p(b"never-seen", h) - 1) < 1e-9


def test_many_blocks_shards_and_parts_of_blocks_change_nothing(spark, edges, monkeypatch):
    df = texts_of(spark, edges)
    held = held_out(F.col("doc_id"), 7, 2)
    want = rounded(lm.score(df, ~held).collect())
    monkeypatch.setattr(lm, "BLOCK_BYTES", 500)
    monkeypatch.setattr(lm, "SHARD_BYTES", 20_000)
    assert rounded(lm.score(df, ~held).collect()) == want
    # rows of a block that do not stand together, in several tasks
    assert rounded(lm.score(df, ~held, F.pmod(F.xxhash64("text"), F.lit(3)).cast("long")).collect()) == want


def test_blocks_do_not_depend_on_the_plan_of_the_scan(spark, edges, tmp_path, monkeypatch):
    path, held = str(tmp_path / "t.parquet"), held_out(F.col("doc_id"), 7, 2)
    texts_of(spark, edges).coalesce(1).write.option("parquet.block.size", 4096).parquet(path)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    materialize, was = lm.materialize, spark.conf.get("spark.sql.files.maxPartitionBytes")

    def replanned(df, name):
        out = materialize(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        return out

    docs = spark.read.parquet(path)
    want = rounded(lm.score(docs, ~held).collect())
    monkeypatch.setattr(lm, "materialize", replanned)
    try:
        assert rounded(lm.score(docs, ~held, lm.split_block(docs)).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_no_training_and_nothing(spark, edges, nothing):
    df = edges.select("doc_id", "text")
    rows = lm.score(df, F.lit(False)).collect()
    assert len(rows) == df.count() and all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score for r in rows)
    assert lm.score(nothing, F.lit(True)).count() == 0
