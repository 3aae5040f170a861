import random

import numpy as np
from pyspark.sql import functions as F

from clinmill.llm import packing as K
from clinmill.llm.tokens import with_token_counts


def test_hilbert_is_a_walk():
    for n, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * n, indexing="ij"), -1).reshape(-1, n)
        key = K.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(side**n))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_stream():
    r = random.Random(1)
    items = [(k, 0, r.choice([5, 50, 100, 130, 250, 700])) for k in range(3000)]
    bins = list(K.pack_stream(iter(items), 256, block=256))
    assert all(sum(h[2] for h in b) <= 256 for b in bins)
    total = {}
    for b in bins:
        for d, p, s in b:
            total[d] = total.get(d, 0) + s
    assert total == {d: s for d, _, s in items}
    whole = {d for b in bins for d, p, _ in b if p > 0}
    assert whole == {d for d, _, s in items if s > 256}
    assert sum(s for _, _, s in items) / (256 * len(bins)) > 0.95
    assert list(K.pack_stream(iter([]), 10)) == [] and list(K.pack_stream(iter([(1, 0, 10)]), 10)) == [[(1, 0, 10)]]


def test_pack(spark):
    r = random.Random(2)
    docs = [(k, " ".join(r.choice(["fièvre", "toux", "mal", "bras"]) for _ in range(r.choice([1, 30, 200, 900]))), "x") for k in range(300)]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, docs[0][1], "x"), (1003, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, conteneur string")
    kinds = spark.createDataFrame([(1, 128), (2, 1024)], "conteneur_no int, capacite_jetons int")
    out = K.pack(df, kinds).cache()
    tokens = {x["doc_id"]: x["jetons"] for x in with_token_counts(df).collect()}
    for no in (1, 2):
        got = {x["doc_id"]: x["s"] for x in out.where(F.col("conteneur_no") == no).groupBy("doc_id").agg(F.sum("jetons").alias("s")).collect()}
        assert got == {d: n for d, n in tokens.items() if n}
    assert K.rooms(out, kinds).where("vide < 0").count() == 0
    assert min(x["rempli"] for x in K.report(out, kinds).collect()) > 0.85
    assert K.pack(df.limit(0), kinds).count() == 0


def test_both_kinds_of_vocabulary_count_alike():
    from pathlib import Path

    from clinmill.llm import tokens

    texts = ["", "L'été, 12,5 mg  de\n\n\tParacétamol…", "don't <|endoftext|> stop", "a" * 20_000, "日本語 � é"]
    ranks, merges = (tokens.load(Path(p).read_text(encoding="utf-8")) for p in (tokens.TOKENIZER, "/opt/tokenizers/byte_bpe_50k.json"))
    assert tokens.counts(ranks, texts) == tokens.counts(merges, texts)
