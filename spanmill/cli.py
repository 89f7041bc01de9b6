"""Command line: train, predict, resolve by rules, score, analyse.

    python -m spanmill.cli train train.conll --model out/model --approach latent
    python -m spanmill.cli predict dev.conll --model out/model --out out/dev [--gold dev.conll]
    python -m spanmill.cli resolve dev.conll --out out/rules
    python -m spanmill.cli predict-text notes.txt --model out/model --out out/notes
    python -m spanmill.cli score key.conll response.conll --metric all
    python -m spanmill.cli errors key.conll response.conll --out out/errors
    python -m spanmill.cli visualize key.conll response.conll --out out/pages

``--dependencies`` names a parquet table (doc_id, tok_idx, head, deprel) for CoNLL
input, which has none itself; without it governors and ancestry stay empty.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.features import DEFAULT_MENTION_FEATURES, DEFAULT_PAIR_FEATURES
from .operators import analysis, cluster, metrics, pipeline, resolve
from .operators.context import place_in_document
from .operators.mentions import system_mentions
from .session import get_session
from .sinks import html, writers
from .sources import conll, lookups, rawtext


def read_corpus(spark, path: str, lexicon: DataFrame | None = None, dependencies: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, system mentions, annotated spans) of CoNLL text."""
    t = conll.tokens(conll.read_documents(spark, path))
    if dependencies:
        d = spark.read.parquet(dependencies).groupBy("doc_id", "tok_idx").agg(F.max(F.struct(F.col("head").cast("int").alias("head"), "deprel")).alias("_d"))
        t = t.join(d, ["doc_id", "tok_idx"], "left").withColumns({"head": F.col("_d.head"), "deprel": F.col("_d.deprel")}).drop("_d")
    else:
        t = t.withColumns({"head": F.lit(None).cast("int"), "deprel": F.lit(None).cast("string")})
    gold = conll.coreference_spans(t)
    return t, system_mentions(t, lexicon, gold), gold


def _entities(spans: DataFrame) -> DataFrame:
    return spans.filter("set_id IS NOT NULL").select("doc_id", F.col("span").alias("mention"), F.col("set_id").alias("entity"))


def _features(spark, path: str | None) -> dict:
    if path is None:
        return {"mention_features": DEFAULT_MENTION_FEATURES, "pair_features": DEFAULT_PAIR_FEATURES}
    mention, pair = lookups.feature_list(spark, path)
    return {"mention_features": mention, "pair_features": pair}


def _finish(tokens: DataFrame, mentions: DataFrame, decisions: DataFrame, clusters: DataFrame, out: str) -> DataFrame:
    done = cluster.with_decisions(mentions, clusters, decisions)
    writers.write_conll(tokens, done, f"{out}/conll")
    writers.write_antecedents(done, f"{out}/antecedents")
    return done


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="spanmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, files in (("train", ["input"]), ("predict", ["input"]), ("predict-text", ["input"]), ("resolve", ["input"]), ("score", ["key", "response"]), ("errors", ["key", "response"]), ("visualize", ["key", "response"])):
        s = sub.add_parser(name)
        for f in files:
            s.add_argument(f)
        for flag, kind, default in (("model", str, None), ("out", str, None), ("approach", str, "latent"), ("epochs", int, 5), ("seed", int, 23), ("cost-scaling", float, 100.0), ("shards", int, None), ("features", str, None), ("gold", str, None), ("dependencies", str, None), ("metric", str, "all")):
            s.add_argument(f"--{flag}", type=kind, default=default)
    a = p.parse_args(argv)
    spark = get_session()
    if a.command == "train":
        _, m, _ = read_corpus(spark, a.input, dependencies=a.dependencies)
        model, priors = pipeline.train(m, a.approach, a.epochs, a.seed, a.cost_scaling, a.shards, **_features(spark, a.features))
        writers.write_model(model, priors, a.model)
    elif a.command == "predict":
        t, m, _ = read_corpus(spark, a.input, dependencies=a.dependencies)
        decisions, clusters = pipeline.predict(m, *writers.read_model(spark, a.model), a.approach, **_features(spark, a.features))
        done = _finish(t, m, decisions, clusters, a.out)
        if a.gold:
            gold = conll.coreference_spans(conll.tokens(conll.read_documents(spark, a.gold)))
            metrics.report(metrics.score(_entities(gold), _entities(done), "all")).show(truncate=False)
    elif a.command == "predict-text":
        docs = spark.read.option("wholetext", "true").text(a.input).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))
        t = rawtext.annotate(docs).withColumns({"corpus": F.lit("text"), "parse_bit": F.lit(None).cast("string")})
        m = system_mentions(t)
        decisions, clusters = pipeline.predict(m, *writers.read_model(spark, a.model), a.approach, **_features(spark, a.features))
        writers.write_tagged(writers.inline_tags(t, cluster.with_decisions(m, clusters, decisions)), a.out)
    elif a.command == "resolve":
        t, m, _ = read_corpus(spark, a.input, dependencies=a.dependencies)
        best = resolve.best_antecedents(resolve.edges(m, tokens=t))
        _finish(t, m, best, resolve.entities(best), a.out)
    else:
        spans = [conll.coreference_spans(conll.tokens(conll.read_documents(spark, f))) for f in (a.key, a.response)]
        if a.command == "score":
            metrics.report(metrics.score(*map(_entities, spans), a.metric)).show(truncate=False)
        else:
            m = spans[0].withColumnRenamed("set_id", "annotated_set_id").join(spans[1], ["doc_id", "span"], "full")
            m = place_in_document(m, "doc_id", F.col("span.begin"), [F.col("span")], "mention_idx")
            found = analysis.Analysis("closest", "closest").add_system("response", m, "set_id").get()
            if a.command == "visualize":
                t = conll.tokens(conll.read_documents(spark, a.key))
                html.write_pages(html.document_pages(t, m, found.filter("kind <> 'decisions'"), "annotated_set_id"), a.out)
            else:
                found.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
