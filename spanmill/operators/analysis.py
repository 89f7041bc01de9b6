"""Error analysis: entity edges, spanning edges, error sets.

The complete graph of an entity is quadratic; what is asked of it (the
closest antecedent, the closest one of a type, the antecedent inside the other
side's entity) is a running maximum along the entity, so spanning edges come from
windows in linear size.  ``entity_edges`` builds the graph itself where it is
wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["doc_id", "ana_idx", "ante_idx"]


def entity_edges(mentions: DataFrame, entity: str) -> DataFrame:
    """(doc_id, entity, ana_idx, ante_idx): each mention with all earlier ones of its entity; null entities have none."""
    m = mentions.filter(F.col(entity).isNotNull()).select("doc_id", F.col(entity).alias("entity"), "mention_idx")
    a, b = m.withColumnRenamed("mention_idx", "ana_idx"), m.withColumnRenamed("mention_idx", "ante_idx")
    return a.join(b, ["doc_id", "entity"]).filter("ante_idx < ana_idx")


def partition(edges: DataFrame, other: DataFrame) -> DataFrame:
    """Edges that are also edges of the other side's entities."""
    return edges.join(other.select(*EDGE), EDGE, "left_semi")


def difference(edges: DataFrame, other: DataFrame) -> DataFrame:
    return edges.join(other.select(*EDGE), EDGE, "left_anti")


def _before(*keys: str):
    return Window.partitionBy("doc_id", *keys).orderBy("mention_idx").rowsBetween(Window.unboundedPreceding, -1)


def _closest(mentions: DataFrame, entity: str, other: str) -> DataFrame:
    """Adds the closest earlier mention of the entity, and of the entity within the other side's."""
    m = mentions.filter(F.col(entity).isNotNull())
    inside = F.when(F.col(other).isNotNull(), F.max("mention_idx").over(_before(entity, other)))
    return m.withColumns({"_kept": inside, "_closest": F.max("mention_idx").over(_before(entity))})


def recall_closest(mentions: DataFrame, entity: str, other: str) -> DataFrame:
    """(doc_id, ana_idx, ante_idx, is_kept): a spanning edge per mention but an entity's first.

    To the closest antecedent that the other side keeps together with it, else
    to the closest one of the entity.
    """
    m = _closest(mentions, entity, other).filter("_closest IS NOT NULL")
    return m.select("doc_id", F.col("mention_idx").alias("ana_idx"), F.coalesce("_kept", "_closest").alias("ante_idx"), F.col("_kept").isNotNull().alias("is_kept"))


def recall_accessibility(mentions: DataFrame, entity: str, other: str, kind: str = "type") -> DataFrame:
    """As :func:`recall_closest`; without a kept antecedent a name or common noun goes to the closest name, else noun, else to the closest."""
    w = _before(entity)
    of = lambda t: F.max(F.when(F.col(kind) == t, F.col("mention_idx"))).over(w)
    m = _closest(mentions, entity, other).withColumns({"_nam": of("NAM"), "_nom": of("NOM")}).filter("_closest IS NOT NULL")
    far = F.when(F.coalesce(F.col(kind).isin("PRO", "DEM"), F.lit(False)), F.col("_closest")).otherwise(F.coalesce("_nam", "_nom", "_closest"))
    return m.select("doc_id", F.col("mention_idx").alias("ana_idx"), F.coalesce(F.col("_kept"), far).alias("ante_idx"), F.col("_kept").isNotNull().alias("is_kept"))


def precision_system_output(mentions: DataFrame, entity: str, other: str, antecedent: str = "antecedent_idx") -> DataFrame:
    """The system's own antecedents inside its entities; ``is_kept`` where both mentions are in one entity of the other side."""
    ante = mentions.select("doc_id", F.col("mention_idx").alias("ante_idx"), F.col(entity).alias("_e"), F.col(other).alias("_o"))
    own = mentions.filter(F.col(antecedent).isNotNull()).select("doc_id", F.col("mention_idx").alias("ana_idx"), F.col(antecedent).cast("int").alias("ante_idx"), F.col(entity).alias("_ae"), F.col(other).alias("_ao"))
    pairs = own.join(ante, ["doc_id", "ante_idx"]).filter((F.col("_ae") == F.col("_e")) & (F.col("ante_idx") < F.col("ana_idx")))
    return pairs.select(*EDGE, F.coalesce(F.col("_ao") == F.col("_o"), F.lit(False)).alias("is_kept"))


def errors(spanning: DataFrame, system: str, kind: str) -> DataFrame:
    """Spanning edges that the other side doesn't keep, as (system, kind, doc_id, ana_idx, ante_idx)."""
    return spanning.filter("NOT is_kept").select(F.lit(system).alias("system"), F.lit(kind).alias("kind"), *EDGE)


RECALL: dict[str, Callable[..., DataFrame]] = {"closest": recall_closest, "accessibility": recall_accessibility}
PRECISION: dict[str, Callable[..., DataFrame]] = {"system_output": precision_system_output, "closest": recall_closest, "accessibility": recall_accessibility}


class Analysis:
    """Errors and decisions of systems against one reference, as tables that are filtered, grouped and combined.

    ``add_system`` takes one row per mention with the reference entity and the
    system's (documents are matched by identifier).
    """

    def __init__(self, recall: str | Callable = "closest", precision: str | Callable = "system_output", reference: str = "annotated_set_id") -> None:
        self.recall, self.precision, self.reference = RECALL.get(recall, recall), PRECISION.get(precision, precision), reference
        self.rows: DataFrame | None = None

    def add_system(self, name: str, mentions: DataFrame, entity: str = "set_id") -> Analysis:
        recall, precision = self.recall(mentions, self.reference, entity), self.precision(mentions, entity, self.reference)
        kinds = [(recall, "recall"), (precision, "precision")]
        parts = [errors(s, name, f"{k}_errors") for s, k in kinds]
        parts += [s.select(F.lit(name).alias("system"), F.lit("decisions").alias("kind"), *EDGE) for s, k in kinds[1:]]
        for p in parts:
            self.rows = p if self.rows is None else self.rows.unionByName(p)
        return self

    def get(self) -> DataFrame:
        """(system, kind, doc_id, ana_idx, ante_idx)."""
        if self.rows is None:
            raise ValueError("no system has been added")
        return self.rows


def with_mentions(errors_: DataFrame, mentions: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``ana`` and ``ante`` structs of the given mention columns, for filters and categories."""
    m = mentions.select("doc_id", "mention_idx", F.struct(*columns).alias("_m"))
    side = lambda idx, name: m.select("doc_id", F.col("mention_idx").alias(idx), F.col("_m").alias(name))
    return errors_.join(side("ana_idx", "ana"), ["doc_id", "ana_idx"]).join(side("ante_idx", "ante"), ["doc_id", "ante_idx"])


def categorize(errors_: DataFrame, category: Column, level: int = 1) -> DataFrame:
    """Adds a level of categories as ``cat<level>``."""
    return errors_.withColumn(f"cat{level}", category)


def counts(errors_: DataFrame, *levels: str, totals: bool = False) -> DataFrame:
    """Errors per group; with totals also per prefix of the levels (null = all)."""
    g = errors_.rollup(*levels) if totals else errors_.groupBy(*levels)
    return g.agg(F.count(F.lit(1)).alias("n_errors"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common errors, whatever the system."""
    return a.select(*EDGE).intersect(b.select(*EDGE))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*EDGE).subtract(b.select(*EDGE))


def update(mapping: DataFrame, other: DataFrame, path: tuple[str, ...] = ("system", "kind")) -> DataFrame:
    """All leaves of both; a leaf (equal path) of ``other`` replaces that of ``mapping``."""
    leaves = other.select(*path).distinct()
    return mapping.join(leaves, list(path), "left_anti").select(*mapping.columns).unionByName(other.select(*mapping.columns))


def with_gold_anaphor(errors_: DataFrame, mentions: DataFrame, reference: str = "annotated_set_id") -> DataFrame:
    """Adds ``gold_anaphor``: whether the reference has the anaphor at all, 'is_gold' or 'is_not_gold'."""
    gold = mentions.filter(F.col(reference).isNotNull()).select("doc_id", F.col("mention_idx").alias("ana_idx"), F.lit("is_gold").alias("gold_anaphor")).distinct()
    return errors_.join(gold, ["doc_id", "ana_idx"], "left").withColumn("gold_anaphor", F.coalesce("gold_anaphor", F.lit("is_not_gold")))


def apart(errors_: DataFrame, least: int, most: int | None = None, field: str = "sent_id") -> DataFrame:
    """Errors (see :func:`with_mentions`) whose mentions are at least, and at most, so many sentences apart; a null distance is left out."""
    d = F.col(f"ana.{field}") - F.col(f"ante.{field}")
    return errors_.filter((d >= least) & ((d <= most) if most is not None else F.lit(True)))


def decisions(mentions: DataFrame, antecedent: str = "antecedent_idx") -> DataFrame:
    """All (doc_id, ana_idx, ante_idx) of mentions with an antecedent."""
    return mentions.filter(F.col(antecedent).isNotNull()).select("doc_id", F.col("mention_idx").alias("ana_idx"), F.col(antecedent).alias("ante_idx"))


def top_heads(errors_: DataFrame, head: Column, k: int = 10, by: tuple[str, ...] = ("system",)) -> DataFrame:
    """The k most frequent heads per group: (by, head, n, rank); equal counts in the order of the heads."""
    n = errors_.groupBy(*by, head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "head")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pivoted(errors_: DataFrame, category: str, systems: list[str]) -> DataFrame:
    """Counts per category, a column per system: the table behind a bar plot."""
    return errors_.groupBy(category).pivot("system", systems).agg(F.count(F.lit(1)))


def as_json(errors_: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, json) rows for a viewer: kind, and the 0-based places of both mentions among the document's."""
    place = mentions.groupBy("doc_id", "mention_idx").agg(F.lit(1).alias("_"))
    first = place.filter("mention_idx > 0").groupBy("doc_id").agg(F.min("mention_idx").alias("_first"))
    e = errors_.join(first, "doc_id")
    fields = [c for c in errors_.columns if c not in ("doc_id", "ana_idx", "ante_idx", "ana", "ante")]
    return e.select("doc_id", F.to_json(F.struct(*fields, (F.col("ana_idx") - F.col("_first")).alias("anaphor"), (F.col("ante_idx") - F.col("_first")).alias("antecedent"))).alias("json"))
