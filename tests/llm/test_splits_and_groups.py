import random

import pytest
from pyspark.sql import functions as F

from spanmill.llm import components, groups, splits


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("cell, blocks", [(50, 3), (10**6, 4), (10**6, 1)])
def test_components_match_brute_force(spark, cell, blocks):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2200)]
    df = spark.createDataFrame(pairs + [(7, 7), (9999, 9999)] + pairs[:20], "src long, dst long").unionByName(spark.createDataFrame([(None, 3)], "src long, dst long"))
    got = {r["vertex"]: r["component"] for r in components.connected_components(df, cell, blocks).collect()}
    assert got == brute([p for p in pairs if p[0] != p[1]])


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


MENTIONS = "mention_id long, doc_id string, set_id int, antecedent long, mention_idx int, loaded_at int, extra string"


def test_mention_groups(spark):
    rows = [
        (1, "d", None, None, 0, 0, ""), (2, "d", 0, None, 1, 0, ""), (3, "d", 0, 1, 2, 0, ""), (4, "d", None, 3, 3, 0, ""), (4, "d", None, 3, 3, 9, ""),
        (5, "e", 0, 5, 1, 0, ""), (6, "e", None, 77, 2, 0, ""), (7, None, 0, None, 3, 0, ""), (8, "e", None, None, 4, 0, ""), (9, "f", None, 8, 1, 0, ""),
    ]
    df = spark.createDataFrame(rows, MENTIONS)
    assert {tuple(r) for r in groups.linked_mentions(df).collect()} == {(2, 2), (3, 2), (4, 2), (8, 8), (9, 8)}
    every = {r["mention_id"]: r["group_id"] for r in groups.mention_groups(df).collect()}
    assert every == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8}
    assert groups.mention_groups(spark.createDataFrame([], MENTIONS)).count() == 0


@pytest.mark.parametrize(
    "identifier",
    ["(tc/marrow/55/marrow_0002555); part 000", "(TC/MARROW/55/MARROW_0002555); part 003", "(tc/marrow/55/marrow_0002555_part_001)", "(tc\\marrow\\55\\marrow_0002555); Part 000", "/tc/marrow/55/marrow_0002555; part 000",
     "(./tc//marrow/55/marrow_0002555) ; part 001", "(tc/marrow/55/marrow_0002555.v4_gold_conll); part 0"],
)
def test_source_key(spark, identifier):
    assert spark.createDataFrame([(identifier,)], "i string").select(splits.source_key(F.col("i")).alias("s")).first()["s"] == "tcmarrow55marrow0002555"


def test_author_key(spark):
    authors = ["  E. Pubenumo", "e_pubenumo", "@e-pubenumo", "E.PUBENUMO", "n/a", " - ", "", "Unknown", None]
    got = [r["a"] for r in spark.createDataFrame([(i, a) for i, a in enumerate(authors)], "i int, x string").orderBy("i").select(splits.author_key(F.col("x")).alias("a")).collect()]
    assert got == ["epubenumo"] * 4 + [None] * 5


DOCS = "doc_key long, doc_id string, author string, topic_entity long, genre string, split string, group_key string"


def docs(spark, n=400):
    rng = random.Random(3)
    rows = [(i, f"(x/{i}); part 0", f"a.{rng.choice('bcdefghij')}x{rng.randrange(60)}" if i % 3 else "n/a", rng.randrange(500) if i % 2 else None, rng.choice(["n", "b", None]), None, "clash") for i in range(n)]
    return spark.createDataFrame(rows + rows[:5], DOCS), rows


def test_related_documents(spark):
    df, rows = docs(spark)
    edges = []
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if (a[2] != "n/a" and a[2] == b[2]) or (a[3] is not None and a[3] == b[3]):
                edges.append((b[0], a[0]))
    assert {r["doc_key"]: r["group_key"] for r in splits.related(df).select("doc_key", "group_key").collect()} == brute(edges)


def test_splits_keep_groups_and_shares(spark):
    df, rows = docs(spark)
    out = splits.split_related(df).collect()
    assert sorted(r["doc_key"] for r in out) == [r[0] for r in rows]
    per = {}
    for r in out:
        per.setdefault(r["group_key"], set()).add(r["split"])
    assert all(len(s) == 1 for s in per.values())
    share = {s: sum(r["split"] == s for r in out) / len(out) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["validation"] - 0.1) < 0.02
    assert splits.split_related(spark.createDataFrame([], DOCS)).count() == 0


def test_a_hot_group_goes_to_train(spark):
    rows = [(i, f"(h/{i}); part 0", "same.author" if i < 40 else None, None, "n", None, "") for i in range(120)]
    out = splits.split_related(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["split"] for r in out if r["doc_key"] < 40} == {"train"}
    assert sum(r["split"] == "test" for r in out) == 12


def test_min_cost_flow_is_cheapest():
    from itertools import product

    rng = random.Random(1)
    for _ in range(20):
        supply, sinks = [rng.randrange(1, 4) for _ in range(3)], [rng.randrange(0, 4) for _ in range(3)]
        cost = [[rng.randrange(4) for _ in range(3)] for _ in supply]
        flow = splits._min_cost_flow(supply, sinks, cost, 5)
        price = lambda f: sum(f[s][j] * cost[s][j] for s in range(3) for j in range(3)) + 5 * sum(max(0, sum(f[s][j] for s in range(3)) - sinks[j]) for j in range(3))
        ways = [[w for w in product(range(n + 1), repeat=3) if sum(w) == n] for n in supply]
        assert [sum(f) for f in flow] == supply
        assert price(flow) == min(price(f) for f in product(*ways))


def test_each_label_has_its_shares():
    rng = random.Random(11)
    bundles = [(1, {x: 1.0}, n) for x, n in (("a", 137), ("b", 41), ("c", 66), ("", 23))]
    for _ in range(60):
        p = {x: float(rng.randrange(1, 6)) for x in rng.sample(["a", "b", "c", ""], rng.randrange(1, 4))}
        bundles.append((sum(p.values()), p, rng.randrange(1, 4)))
    plan = splits.allocate(bundles, [0.8, 0.1, 0.1])
    assert [sum(x) for x in plan] == [n for *_, n in bundles]
    for name in ("a", "b", "c", ""):
        docs = [sum(x[j] * p.get(name, 0) for x, (_, p, _) in zip(plan, bundles)) for j in range(3)]
        assert all(abs(d / sum(docs) - s) < 0.02 for d, s in zip(docs, (0.8, 0.1, 0.1))), (name, docs)
    assert splits.allocate([], [0.8, 0.2]) == []
    assert splits.allocate([(40, {"a": 40.0}, 1), (1, {"a": 1.0}, 80)], [0.8, 0.1, 0.1])[0] == [1, 0, 0]
