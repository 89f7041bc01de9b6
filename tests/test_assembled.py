"""Sums over the feature strings of all pairs are those of the pairs, without building them."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_counts import _no_pairs
from test_pairs_and_rules import SCHEMA
from test_relation_counts import _odd

from spanmill.functions import features as X
from spanmill.operators import assembled
from spanmill.operators.pairs import backward_pairs
from spanmill.plans import links


def _of_pairs(m) -> set:
    of_pair = F.aggregate(X.feature_strings(*links._ASSEMBLED), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("crc")), lambda t, w: F.struct((t["n"] + 1).alias("n"), (t["crc"] + F.crc32(w.cast("binary"))).alias("crc")))
    p = backward_pairs(m, links._ASSEMBLY_FIELDS).select("doc_id", "ana_idx", of_pair.alias("f"))
    return {tuple(r) for r in p.groupBy("doc_id", "ana_idx").agg(F.count(F.lit(1)), F.sum("f.n"), F.sum("f.crc")).collect()}


@pytest.mark.parametrize("few", [0, 128])
def test_sums_of_odd_rows(spark, few):
    m = spark.createDataFrame(_odd(170), f"mention_id int, {SCHEMA}")
    m = m.withColumns({"tokens_as_lowercase_string": F.when(F.col("mention_id") % 11 > 0, F.col("tokens_as_lowercase_string")).when(F.col("mention_id") % 2 == 0, ""), "head_as_lowercase_string": F.concat("head_as_lowercase_string", F.when(F.col("mention_id") % 9 == 0, "é中").otherwise(""))})
    m = m.withColumn("feature_values", X.mention_values(links._ASSEMBLED[0])).localCheckpoint()
    again = m.unionByName(m.filter("mention_idx % 5 = 0")).withColumn("_row", F.xxhash64("mention_id"))
    table = assembled._Sums.joined.__globals__
    own, table["_FEW"] = table["_FEW"], few
    try:
        import pyarrow as pa

        asked = again.filter("mention_idx > 0").select("doc_id", "mention_idx", "_row", "sent_id", "speaker", "tokens_as_lowercase_string", "head_as_lowercase_string", *[F.get("feature_values", F.lit(i)).alias(f"v{i}") for i in range(5)]).toArrow()
        got = [tuple(x.values()) for b in assembled._Sums(assembled.Rows(asked.to_batches()), *links._ASSEMBLED, 5).batches() for x in pa.Table.from_batches([b]).to_pylist()]
    finally:
        table["_FEW"] = own
    want = _of_pairs(m)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_no_pairs_of_assembled_features(spark, monkeypatch):
    want = _of_pairs(links._assembly_mentions(spark, DATA))
    monkeypatch.setattr(links, "backward_pairs", _no_pairs)
    got = links.feature_assembly_all(spark, DATA)
    assert got.columns == ["doc_id", "ana_idx", "n_pairs", "n_features", "crc_sum"]
    assert {tuple(r) for r in got.collect()} == want and want
