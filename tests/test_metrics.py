"""Golden scores of small key/response pairs: letters are mentions, words are entities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.operators import metrics as M


def f(r, p):
    return (r, p, 0.0 if r + p == 0 else 2 * r * p / (r + p))


# key, response, {metric: (R, P, F)}
CASES = {
    "A1": ("a bc def", "a bc def", {m: (1, 1, 1) for m in M.METRICS}),
    "A2": ("a bc def", "a de", {"muc": (1 / 3, 1, 0.5), "bcub": (7 / 18, 1, 14 / 25), "ceafm": (0.5, 1, 0.66667), "ceafe": (0.6, 0.9, 0.72), "blanc": (0.21591, 1, 0.35385)}),
    "A3": ("a bc def", "a bcx defy z", {"muc": (1, 3 / 5, 0.75), "bcub": (1, (4 + 7 / 12) / 9, 110 / 163), "ceafm": (1, 0.66667, 0.8), "ceafe": (0.88571, 0.66429, 0.75918), "blanc": (1, 0.42593, 0.59717)}),
    "A4": ("a bc def", "a bcx dy z", {"muc": (1 / 3, 1 / 3, 1 / 3), "bcub": f(5 / 9, 17 / 42), "ceafm": (0.66667, 0.57143, 0.61538), "ceafe": (0.73333, 0.55, 0.62857), "blanc": (0.35227, 0.27206, 0.30357)}),
    "A5": ("a bc def", "a bcxB dy z", {"muc": (1 / 3, 1 / 4, 2 / 7), "bcub": f(5 / 9, 5 / 16), "ceafm": (0.66667, 0.5, 0.57143), "ceafe": (0.68889, 0.51667, 0.59048), "blanc": (0.35227, 0.19048, 0.24716)}),
    "A6": ("a bc def", "a bcx dy Bz", {"muc": (1 / 3, 1 / 4, 2 / 7), "bcub": f(5 / 9, 17 / 48), "ceafm": (0.66667, 0.5, 0.57143), "ceafe": (0.73333, 0.55, 0.62857), "blanc": (0.35227, 0.20870, 0.25817)}),
    "A10": ("a bc def", "a b c d e f", {"muc": (0, 0, 0), "bcub": (0.5, 1, 2 / 3), "blanc": (0.5, 0.36667, 0.42308)}),
    "A11": ("a bc def", "abcdef", {"muc": (1, 3 / 5, 3 / 4), "bcub": (1, 7 / 18, 14 / 25), "blanc": (0.5, 0.13333, 0.21053)}),
    "A12": ("a bc def", "a x y c d e z", {"muc": (0, 0, 0), "bcub": f(13 / 36, 4 / 7), "blanc": (0.22727, 0.11905, 0.15625)}),
    "A13": ("a bc def", "axycdez", {"muc": (1 / 3, 1 / 6, 2 / 9), "bcub": f(17 / 36, 6 / 49), "blanc": (0.125, 0.02381, 0.04)}),
    "B1": ("ab cde", "bcx de", {"blanc": (7 / 24, 7 / 24, 7 / 24)}),
    "C1": ("ab cde fg", "bcx de fg", {"blanc": (0.5125, 0.5125, 0.5125)}),
    "D1": ("12345 67 89ABC", "12345 6789ABC", {"muc": f(1, 9 / 10), "bcub": f(1, 16 / 21)}),
    "E1": ("12345 67 89ABC", "1234589ABC 67", {"muc": f(1, 9 / 10), "bcub": f(1, 7 / 12)}),
    "F1": ("ABCD", "AB CD", {"muc": f(2 / 3, 1)}),
    "G1": ("AB CD", "ABCD", {"muc": f(1, 2 / 3)}),
    "H1": ("ABCD", "ABCD", {"muc": (1, 1, 1)}),
    "J1": ("ABC", "AC", {"muc": f(1 / 2, 1)}),
    "K1": ("BCDEGHJ", "ABC DEF GHI", {"muc": (1 / 2, 1 / 2, 1 / 2)}),
    "L1": ("ABC DEFG", "AB CD FGH", {"muc": f(2 / 5, 2 / 4)}),
    "M1": ("abcdef", "abcdef", {m: (1, 1, 1) for m in M.METRICS}),
    "M2": ("abcdef", "a b c d e f", {"muc": (0, 0, 0), "blanc": (0, 0, 0)}),
    "M3": ("abcdef", "ab cde f", {"blanc": (0.26667, 1, 0.42105)}),
    "M4": ("abcdef", "abcxyz", {"blanc": (0.2, 0.2, 0.2)}),
    "M5": ("abcdef", "a b c x y z", {"muc": (0, 0, 0), "blanc": (0, 0, 0)}),
    "M6": ("abcdef", "ab cxy z", {"blanc": (0.06667, 0.25, 0.10526)}),
    "N1": ("a b c d e f", "a b c d e f", {"muc": (0, 0, 0), "blanc": (1, 1, 1)}),
    "N2": ("a b c d e f", "abcdef", {"muc": (0, 0, 0), "blanc": (0, 0, 0)}),
    "N3": ("a b c d e f", "ab cde f", {"blanc": (0.73333, 1, 0.84615)}),
    "N4": ("a b c d e f", "a b c x y z", {"muc": (0, 0, 0), "blanc": (0.2, 0.2, 0.2)}),
    "N5": ("a b c d e f", "abcxyz", {"blanc": (0, 0, 0)}),
    "N6": ("a b c d e f", "ab cxy z", {"blanc": (0.13333, 0.18182, 0.15385)}),
}


def table(spark, which):
    rows = [(case, mention, f"e{i}") for case, c in CASES.items() for i, entity in enumerate(c[which].split()) for mention in entity]
    return spark.createDataFrame(rows, "doc_id string, mention string, entity string")


@pytest.mark.parametrize("metric", M.METRICS)
def test_goldens(spark, metric):
    got = {r["doc_id"]: (r["recall"], r["precision"], r["f1"]) for r in M.score(table(spark, 0), table(spark, 1), metric, per_doc=True).collect()}
    for case, (_, _, want) in CASES.items():
        if metric in want:
            assert sum(abs(a - b) for a, b in zip(got[case], want[metric])) < 1e-4, (case, got[case], want[metric])


def test_repeated_mentions_count_once(spark):
    key = spark.createDataFrame([("d", m, e) for m, e in zip("abcdef", "122333")], "doc_id string, mention string, entity string")
    once = [("a", "1"), ("b", "2"), ("c", "2"), ("x", "2"), ("d", "3"), ("y", "3"), ("z", "4")]
    want = [(1 / 3, 1 / 3), (5 / 9, 17 / 42)]
    for extra in ([("b", "2")], [("b", "3")], [("b", "3")] * 10):
        response = spark.createDataFrame([("d", m, e) for m, e in once + extra], key.schema)
        for metric, (r, p) in zip(("muc", "bcub"), want):
            row = M.score(key, response, metric).first()
            assert (row["recall"], row["precision"]) == pytest.approx((r, p))
    with pytest.raises(Exception, match="too many"):
        M.score(key, spark.createDataFrame([("d", m, e) for m, e in once + [("b", "3")] * 11], key.schema), "muc").collect()


def test_total_average_and_report(spark):
    s = M.score(table(spark, 0), table(spark, 1), "all", per_doc=True)
    average = {r["doc_id"]: r["conll"] for r in M.conll_average(s).collect()}
    assert average["A1"] == pytest.approx(1) and None in average
    assert {r["metric"] for r in M.report(s).collect()} == {*M.METRICS, "conll"}


def test_empty_and_null_rows(spark):
    schema = "doc_id string, mention string, entity string"
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([("d", None, "e"), ("d", "a", None)], schema)
    for k, r in ((none, none), (odd, none), (none, odd)):
        rows = M.score(k, r, "all").collect()
        assert all(x["f1"] == 0 for x in rows)
    one = spark.createDataFrame([("d", "a", "e"), ("d", "b", "e")], schema)
    assert {r["recall"] for r in M.score(one, none, "all").collect()} == {0.0}
    assert M.score(one, none, "mentions").first()["f1"] == 0


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 2), (4, 4)):
        w = rng.random((n, m))
        best = max(sum(w[i, p[i]] for i in range(n)) for p in permutations(range(m), n)) if n <= m else max(sum(w[p[j], j] for j in range(m)) for p in permutations(range(n), m))
        assert sum(w[a, b] for a, b in M.assignment(w)) == pytest.approx(best)
    assert M.assignment(np.zeros((0, 0))) == []


def test_shown_cuts_off(spark):
    assert spark.range(1).select(M.shown(F.lit(0.66669)).alias("x")).first()["x"] == 66.66
