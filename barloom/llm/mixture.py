"""Mixing sources to target weights along a tree of domains, languages and sources.

The token budget is handed down the tree. At each node it is shared among the children in
proportion to their weights; a child cannot get more than its subtree holds (its tokens times
``max_epochs``), and what it cannot take goes to its siblings first. Only what all siblings together
cannot take stays with the ancestors, which is why a node's capacity is known before its share.
A leaf's budget is spent on whole epochs of its documents and then on the first tokens of one more
epoch, whose order is a seeded hash of the document id.

Sharing works on one row for each node. The cut of a leaf's last epoch is found from token sums of
hash ranges, whose number follows from the leaf's rows; only the one range that holds the cut is
sorted. Texts are read twice and never shuffled while the leaves fit a broadcast.

Defined cases: null or empty domain, language and source are the node ``unknown``; null and empty
texts have no tokens and are never selected; rows that repeat an id stand at one place of an epoch
and share what the budget leaves there; a zero weight takes nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .words import free_name

UNKNOWN = "unknown"
RANGE_ROWS = 20_000
BROADCAST_LEAVES = 100_000
TOKEN = r"[^\x20\x09-\x0D]+"

# Production targets; a node without a target has weight 1.
DOMAIN_WEIGHTS = {"group0": 4, "group1": 3, "group2": 2}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 2}


def source_group(source: Column) -> Column:
    """Domain of a numbered source: one of four groups by its last digit."""
    digit = F.regexp_extract(source.cast("string"), "([0-9])$", 1)
    return F.when(digit != "", F.concat(F.lit("group"), (F.ascii(digit) % 4).cast("string")))


def _named(column: Column) -> Column:
    text = column.cast("string")
    return F.when(F.length(text) > 0, text).otherwise(F.lit(UNKNOWN))


def _weight(column: str, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(table[F.col(column)], F.lit(1))


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Rows of siblings (``weight``, ``capacity``, their parent's ``budget``) with what each may ``spend``.

    In order of capacity for its weight, a child is full if the remaining budget, shared by weight
    among it and those after it, would exceed its capacity; the others share the rest.
    """
    siblings = Window.partitionBy(*parent)
    order = siblings.orderBy(F.col("capacity") / F.col("weight"), name)
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = F.col("capacity") * F.col("rest") <= (F.col("budget") - F.col("before")) * F.col("weight")
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(siblings), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings)
    return (
        children.filter((F.col("weight") > 0) & (F.col("capacity") > 0))
        .withColumns({"rest": rest, "before": before}).withColumn("full", full)
        .withColumn("left", left).withColumn("open", open_)
        .withColumn("spend", F.when(F.col("full"), F.col("capacity"))
                    .otherwise(F.floor(F.col("left") * F.col("weight") / F.col("open"))).cast("long"))
        .drop("rest", "before", "full", "left", "open", "budget")
    )


def leaf_budgets(leaves: DataFrame, budget: int, *, max_epochs: int, domain_weights: dict, language_weights: dict,
                 source_weights: dict) -> DataFrame:
    """Leaves (domain, language, source, tokens) with the tokens each may ``spend``."""
    leaves = leaves.filter("tokens > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    # A subtree without weight holds nothing that its ancestors could count on.
    sources = leaves.withColumn("weight", _weight("source", source_weights))
    languages = sources.filter("weight > 0").groupBy("domain", "language").agg(F.sum("capacity").alias("capacity")) \
        .withColumn("weight", _weight("language", language_weights))
    domains = languages.filter("weight > 0").groupBy("domain").agg(F.sum("capacity").alias("capacity")) \
        .withColumn("weight", _weight("domain", domain_weights))
    spend = F.col("spend").alias("budget")
    domains = share_out(domains.withColumns({"root": F.lit(0), "budget": F.lit(budget).cast("long")}), ["root"], "domain")
    languages = share_out(languages.join(domains.select("domain", spend), "domain"), ["domain"], "language")
    return share_out(sources.join(languages.select("domain", "language", spend), ["domain", "language"]),
                     ["domain", "language"], "source").select("domain", "language", "source", "tokens", "rows", "spend")


LEAF = ["domain", "language", "source"]


def _place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch of its leaf: a hash that any engine can compute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _cuts(rows: DataFrame, plan: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Where the last epoch of each leaf ends: place, and tokens of each row that stands there."""
    high = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    ranges = F.ceil(F.col("rows") / RANGE_ROWS)
    placed = rows.filter("part > 0").withColumn("range", F.floor(high * ranges / F.lit(float(1 << 32))))
    sums = placed.groupBy(*LEAF, "range").agg(F.sum("tokens").alias("sum"), F.max("part").alias("part"))
    end = F.sum("sum").over(Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    cut = sums.withColumn("end", end).filter((F.col("end") > F.col("part")) & (F.col("end") - F.col("sum") <= F.col("part"))) \
        .select(*LEAF, "range", (F.col("part") - F.col("end") + F.col("sum")).alias("room"))
    near = placed.join(small(cut), [*LEAF, "range"]).groupBy(*LEAF, "place") \
        .agg(F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("copies"), F.max("room").alias("room"))
    end = F.sum("sum").over(Window.partitionBy(*LEAF).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("end", end).filter((F.col("end") > F.col("room")) & (F.col("end") - F.col("sum") <= F.col("room")))
    each = F.floor((F.col("room") - F.col("end") + F.col("sum")) / F.col("copies"))
    return plan.join(found.select(*LEAF, F.col("place").alias("cut"), each.alias("each")), LEAF, "left")


def mix(docs: DataFrame, *, budget_tokens: int | None = None, share: float = 0.5, max_epochs: int = 4, seed: int = 7,
        domain: Column | None = None, doc_id: str = "doc_id", text: str = "text", language: str = "lang",
        source: str = "source", domain_weights: dict | None = None, language_weights: dict | None = None,
        source_weights: dict | None = None) -> DataFrame:
    """``docs`` with ``mix_epoch`` and ``mix_tokens`` columns, one row for each selected document and epoch.

    ``budget_tokens`` is the size of the mixture; without it ``share`` of all tokens. ``mix_tokens``
    is how many of the document's first tokens the epoch takes; domain, language and source of the
    tree come as a ``mix_leaf`` struct.
    """
    names = {c: free_name(docs, c) for c in ("mix_leaf", "mix_tokens", "mix_epoch")}
    tokens = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long")
    leaf = [_named(source_group(F.col(source)) if domain is None else domain).alias("domain"),
            _named(F.col(language)).alias("language"), _named(F.col(source)).alias("source")]
    rows = stage(docs.select(F.col(doc_id).alias("id"), *leaf, tokens.alias("tokens")).filter("tokens > 0"))
    leaves = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    if budget_tokens is None:
        budget_tokens = int((rows.agg(F.sum("tokens")).first()[0] or 0) * share)
    plan = leaf_budgets(leaves, budget_tokens, max_epochs=max_epochs,
                        domain_weights=DOMAIN_WEIGHTS if domain_weights is None else domain_weights,
                        language_weights=LANGUAGE_WEIGHTS if language_weights is None else language_weights,
                        source_weights=source_weights or {})
    plan = stage(plan.withColumn("whole", F.floor(F.col("spend") / F.col("tokens")).cast("int"))
                 .withColumn("part", F.col("spend") - F.col("whole") * F.col("tokens"))
                 .drop("tokens", "spend"))  # one row for each leaf
    few = plan.count() <= BROADCAST_LEAVES
    small = F.broadcast if few else (lambda df: df)
    placed = rows.join(small(plan), LEAF).withColumn("place", _place(seed, F.col("whole") + 1, F.col("id")))
    cuts = stage(_cuts(placed, plan, small).select(
        F.struct(*LEAF).alias("leaf"), F.struct("whole", "part", "cut", "each").alias("cut")))

    cut = free_name(docs, "mix_cut")
    cuts = cuts.withColumnRenamed("leaf", names["mix_leaf"]).withColumnRenamed("cut", cut)
    chosen = docs.withColumn(names["mix_leaf"], F.struct(*leaf)).withColumn(names["mix_tokens"], tokens) \
        .filter(F.col(names["mix_tokens"]) > 0).join(small(cuts), names["mix_leaf"])
    place = _place(seed, F.col(f"{cut}.whole") + 1, F.col(doc_id))
    size = F.col(names["mix_tokens"])
    last = F.when((F.col(f"{cut}.part") <= 0) | (place > F.col(f"{cut}.cut")), F.lit(0).cast("long")) \
        .when(place == F.col(f"{cut}.cut"), F.least(F.col(f"{cut}.each"), size)).otherwise(size)
    takes = F.concat(F.array_repeat(size, F.col(f"{cut}.whole")), F.array(last))
    return chosen.select(*docs.columns, names["mix_leaf"], F.posexplode(takes).alias(names["mix_epoch"], names["mix_tokens"])) \
        .withColumn(names["mix_epoch"], F.col(names["mix_epoch"]) + 1).filter(F.col(names["mix_tokens"]) > 0)
