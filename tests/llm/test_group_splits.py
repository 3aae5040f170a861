import random

from clinmill.llm import group_splits as G

SCHEMA = "id string, cas_id string, ids_questions array<string>, split string, specialite string, root string"


def brute(rows):
    ids = {r[0] for r in rows}
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    keys = {}
    for r in rows:
        if r[1]:
            k = "".join(c for c in r[1].lower() if c.isalnum()).removeprefix("cas")
            if len(k) == 12 and all(c in "0123456789abcdef" for c in k):
                keys.setdefault(k, []).append(r[0])
        for o in r[2] or ():
            if o in ids:
                par[find(r[0])] = find(o)
    for v in keys.values():
        for x in v:
            par[find(x)] = find(v[0])
    groups = {}
    for i in ids:
        groups.setdefault(find(i), set()).add(i)
    return list(groups.values())


def sample(seed=1, n=400):
    r = random.Random(seed)
    out = []
    for k in range(n):
        hexa = f"{r.choice([7, *range(60)]) if r.random() < 0.7 else 7:012x}"
        case = r.choice([f"cas_{hexa}", f" CAS-{hexa.upper()} ", hexa, None, f"sans_contexte_{k}"])
        named = [f"i{r.randrange(n)}" for _ in range(r.choice([0, 0, 0, 0, 1]))] or None
        if k % 50 == 0:
            named = [f"i{k}", "inconnu", None]
        out.append((f"i{k}", case, named, r.choice(["train", "TEST ", "dev", None, "train", "train"]), r.choice("abc") if k % 9 else None, "x"))
    return out + out[:20]


def test_divided(spark):
    rows = sample()
    name = {r[0]: r[3] for r in rows}
    norm = {"train": "t", "TEST ": "e", "dev": "v", None: None}
    want = set()
    for g in brute(rows):
        if len({norm[name[i]] for i in g} - {None}) > 1:
            want |= {(i, min(g)) for i in g}
    assert {tuple(r) for r in G.divided(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_assign(spark):
    rows = sample(2, 600)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r for r in G.assign(df, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert set(got) == {r[0] for r in rows}
    for g in brute(rows):
        assert len({got[i]["split_nouveau"] for i in g}) == 1 and {got[i]["groupe_id"] for i in g} == {min(g)}
    per = {r["split_nouveau"]: r for r in G.balance(G.assign(df, {"train": 0.8, "validation": 0.1, "test": 0.1}), ["train", "validation", "test"]).collect()}
    assert sum(r["n_fiches"] for r in per.values()) == len(got)
    again = {r["id"]: r["split_nouveau"] for r in G.assign(df.repartition(5), {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert again == {k: v["split_nouveau"] for k, v in got.items()}


def test_balanced_singles(spark):
    rows = [(f"i{k}", None, None, None, "ab"[k % 2], "x") for k in range(1000)]
    out = G.assign(spark.createDataFrame(rows, SCHEMA), {"train": 8, "test": 2})
    per = {r["split_nouveau"]: r for r in G.balance(out, ["train", "test"]).collect()}
    assert abs(per["train"]["part"] - 0.8) < 0.005 and per["test"]["ecart_max"] < 0.01


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert G.divided(df).count() == 0 and G.assign(df, {"train": 1.0}).count() == 0
