import random

from spanmill.llm import overlap, packing, terms
from spanmill.llm.common import bounded_rank


def test_burst_trie_counts_like_a_dict():
    rng = random.Random(1)
    trie, want = terms.BurstTrie(burst=3), {}
    for _ in range(3000):
        t = "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 7)))
        n, d = rng.randrange(1, 4), rng.randrange(2)
        trie.add(t, n, d)
        w = want.setdefault(t, [0, 0])
        w[0] += n
        w[1] += d
    got = {p + s: e for p, box in trie.containers() for s, e in box.items()}
    assert got == want and trie.size == len(want)


MENTIONS = "mention_id long, doc_id string, head string, tokens string, loaded_at int, term string"


def test_terms(spark):
    rows = [(1, "d", " It ", "it", 0, ""), (1, "d", " It ", "it", 5, ""), (2, "d", "IT", None, 0, ""), (3, "e", "it", "", 0, ""), (4, None, "it", "x y", 0, ""), (5, "f", "   ", "x y", 0, ""), (None, "d", "it", "it", 0, ""), (6, "f", "　é ", "É" * 5000, 0, "")]
    df = spark.createDataFrame(rows, MENTIONS)
    fields = {"head": "head", "tokens": "tokens"}
    for limits in ({}, {"burst": 1, "flush": 2}):
        got = {(r["field"], r["term"]): (r["n_mentions"], r["n_documents"], r["mark"]) for r in terms.marked_terms(df, fields, **limits).collect()}
        assert got == {("head", "it"): (4, 2, "common"), ("tokens", "it"): (1, 1, "rare"), ("tokens", "x y"): (2, 1, "rare"), ("head", "é"): (1, 1, "rare"), ("tokens", "é" * 5000): (1, 1, "rare")}
    assert terms.marked_terms(df.limit(0), fields).count() == 0


def test_terms_that_begin_alike_go_to_many_tasks(spark):
    """A long prefix that all terms share is no single route, and the merge is exact across batches."""
    rng = random.Random(4)
    rows = [(i, f"d{i % 7}", "aa" * 40 + "".join(rng.choice("abc") for _ in range(5)), None, 0, "") for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = terms.term_counts(spark.createDataFrame(rows, MENTIONS).repartition(4), {"head": "head"}, burst=4, flush=60)
        got = {r["term"]: (r["n_mentions"], r["n_documents"], r["p"]) for r in out.selectExpr("*", "spark_partition_id() AS p").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict = {}
    for r in rows:
        n, docs = want.setdefault(r[2], [0, set()])
        want[r[2]][0] += 1
        docs.add(r[1])
    assert {t: x[:2] for t, x in got.items()} == {t: (n, len(d)) for t, (n, d) in want.items()}
    assert len({x[2] for x in got.values()}) == 2  # all of the session's shuffle partitions


DOCS = "doc_key long, tokens array<string>, split string, key_a int, source string"


def sets(tokens, width):
    low = [(t or "").lower() for t in tokens]
    return {tuple(low[i : i + width]) for i in range(len(low) - width + 1)}


def test_overlaps_match_brute_force(spark):
    rng = random.Random(8)
    texts = [[rng.choice("abcdefghijklm") for _ in range(30)] for _ in range(60)]
    for i in range(0, 60, 3):  # near copies
        texts.append([rng.choice("xyz") if rng.random() < 0.05 else t.upper() for t in texts[i]])
    texts += [texts[0]] * 8 + [["a", "b"], [], None, ["q", None, "r", "s"], ["q", None, "r", "s"]]
    rows = [(i, t, [" Train", "dev", "TEST ", None][i % 4 if i < 80 else i % 3], 1, f"s{i % 2}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:9], DOCS)
    got = {(r["key_a"], r["key_b"]) for r in overlap.cross_split_pairs(df, width=3, threshold=0.5).collect()}
    part = {i: ("train" if s.strip().lower() == "train" else "held", sets(t, 3)) for i, t, s, *_ in rows if t and s and sets(t, 3)}
    want = {(a, b) for a in part for b in part if a < b and part[a][0] != part[b][0] and 2 * len(part[a][1] & part[b][1]) >= len(part[a][1] | part[b][1])}
    assert got == want and len(want) > 10
    report = overlap.overlap_report(overlap.cross_split_pairs(df, width=3, threshold=0.5), df, df["source"]).collect()
    assert sum(r["n_pairs"] for r in report) == len(want)
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0


def test_banding_meets_its_miss_rate():
    for t in (0.3, 0.5, 0.8, 0.95):
        bands, rows = overlap.banding(t)
        assert (1 - t**rows) ** bands <= 1e-6
    assert overlap.banding(1.0)[0] == 1


def test_rank_is_exact(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(500)], "g int, k long")
    for r in range(3):
        ranks = sorted(x["rank"] for x in bounded_rank(df, ["g"], ["k"], buckets=7).filter(f"g = {r}").collect())
        assert ranks == list(range(len(ranks)))


def check(sizes, rows, capacity):
    per, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["first"], r["n_tokens"]))
        if r["container"] is None:
            assert r["n_tokens"] == 0
        else:
            per[r["container"]] = per.get(r["container"], 0) + r["n_tokens"]
    assert all(0 < n <= capacity for n in per.values())
    for k, n in sizes.items():
        parts = sorted(pieces[k])
        assert sum(p[2] for p in parts) == n and len(parts) == max(1, -(-n // capacity))
        assert [p[1] for p in parts] == [i * capacity for i in range(len(parts))]
    return per


def test_packing(spark):
    rng = random.Random(6)
    sizes = {i: rng.choice([0, 1, 7, rng.randrange(1, 100), rng.randrange(1, 20), 333]) for i in range(600)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens int")
    per = check(sizes, packing.pack(df, capacity=100).collect(), 100)
    assert len(per) <= 1.03 * -(-sum(sizes.values()) // 100)
    assert packing.pack(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, None), (2, 250)], "doc_id long, n_tokens int")
    check({1: 0, 2: 250}, packing.pack(one, capacity=100).collect(), 100)


def test_sweep_is_best_fit():
    """The sweep gives the same containers as trying all gaps for one document after the other."""
    rng = random.Random(9)
    for _ in range(30):
        sizes = sorted((rng.randrange(1, 30) for _ in range(60)), reverse=True)
        gaps: list[int] = []
        for s in sizes:
            fits = [g for g in gaps if g >= s]
            if fits:
                gaps.remove(min(fits))
            gaps.append((min(fits) if fits else 30) - s)
        boxes, left, opened = packing.sweep(sizes, [], 30, None, lambda i: i)
        assert opened == len(gaps) and None not in boxes and sorted(g for g, _ in left) == sorted(g for g in gaps if g)
    assert packing.sweep([5, 4, 3], [(4, 9)], 30, 0, None) == ([None, 9, None], [], 0)


def test_packing_in_rounds(spark, monkeypatch):
    """Many slabs and several rounds lose nothing and keep close to the lower bound; so does a large capacity."""
    monkeypatch.setattr(packing, "SLAB_CONTAINERS", 8)
    rng = random.Random(7)
    for capacity, n in ((100, 1500), (1_000_000, 700)):
        sizes = {i: rng.choice([rng.randrange(1, capacity), rng.randrange(1, capacity // 10), rng.randrange(1, max(2, capacity // 50)), 2 * capacity + 7, capacity]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
        per = check(sizes, packing.pack(df, capacity=capacity).collect(), capacity)
        assert len(per) <= 1.02 * -(-sum(sizes.values()) // capacity)
    equal = spark.createDataFrame([(i, 30) for i in range(2000)], "doc_id long, n_tokens long")  # one hot size
    assert len(check({i: 30 for i in range(2000)}, packing.pack(equal, capacity=100).collect(), 100)) <= 670
