"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A leaf can give its tokens `max_epochs` times. The
budget runs down the tree: the children of a node share its budget by weight, a child that
cannot give its share gives all it has, and what it lacks goes to its siblings by weight.
A node's own capacity is that of its leaves, so a shortage leaves a node, for the siblings of
its ancestor, only when the whole node is used up.

The shares of siblings have a closed form. Sorted by capacity / weight, children are used up as long
as capacity / weight <= level = (budget - capacities before) / (weights from here on); the
others get weight * level of the first that is not. That is one window per level over the tree,
which has a row per leaf and no documents.

A leaf's budget is whole epochs and a prefix of one more, in the order of
md5(seed:epoch:id). The prefix is cut without sorting a leaf: tokens are summed per leaf and
first two hex digits, the running sum over those (256 at most) finds the group with the cut, the same
goes on inside that group, and after three levels the documents of one group in 16,777,216 are ordered.

Everything is built-in expressions, joins and grouped sums. Defined cases: tokens are runs of
`[^\\x20\\x09-\\x0D]`; null and empty texts have 0 and follow their place in the order; null
domains, languages and sources form the node ''; rows with one id stand or fall together;
budgets are rounded down to whole tokens; nodes of weight 0 get nothing; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import checkpointed

# Hex digits of a place that one level looks at, and levels before single documents.
DIGITS, LEVELS = 2, 3
# Leaves up to this count (rows of some 100 bytes) are broadcast.
BROADCAST_LEAVES = 200_000
LEAF = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Tree:
    """Whole-number weights per name on each level; a name that is not listed has `other`."""

    domain: str                                   # SQL expression over the documents
    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 10
    lang: str = "lang"
    source: str = "source"

    def leaf(self) -> list[Column]:
        return [F.coalesce(F.expr(e).cast("string"), F.lit("")).alias(n) for n, e in zip(LEAF, (self.domain, self.lang, self.source), strict=True)]

    def weight(self, level: str) -> Column:
        out = F.lit(self.other)
        for name, weight in {"domain": self.domains, "lang": self.langs, "source": self.sources}[level].items():
            out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
        return out


def token_count(column: str) -> Column:
    return F.coalesce(F.expr(rf"regexp_count(`{column}`, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("bigint")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `budget` to nodes (with `given`, `capacity`, `weight`) that share `given` per parent."""
    usable = nodes.where("weight > 0 AND capacity > 0")
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("given") - before) / weights
    out = usable.withColumn("level", level).withColumn("full", F.col("capacity") / F.col("weight") <= F.col("level"))
    # Levels fall from the first child that is not used up on, so the largest of theirs is its level.
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent))
    portion = F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(F.greatest(F.lit(0.0), F.col("weight") * rest) + 1e-6))
    return out.withColumn("budget", portion.cast("bigint")).drop("level", "full", "given", "weight")


def leaf_budgets(leaves: DataFrame, tree: Tree, budget_share: float, max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with the `budget` of each, in tokens."""
    sized = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * budget_share).cast("bigint").alias("given"), F.lit(0).alias("root"))
    domains = sized.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("root", F.lit(0)).join(total, "root")
    domains = share(domains.withColumn("weight", tree.weight("domain")), ["root"], "domain")
    langs = sized.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    langs = langs.join(domains.select("domain", F.col("budget").alias("given")), "domain")
    langs = share(langs.withColumn("weight", tree.weight("lang")), ["domain"], "lang")
    found = sized.join(langs.select("domain", "lang", F.col("budget").alias("given")), ["domain", "lang"])
    return share(found.withColumn("weight", tree.weight("source")), ["domain", "lang"], "source")


def _place(seed: int) -> Column:
    """The order of a document in the epoch that is taken in part."""
    text = F.concat_ws(":", F.lit(str(seed)), (F.col("epochs") + 1).cast("string"), F.coalesce(F.col("id"), F.lit("")))
    return F.md5(text.cast("binary"))


def leaf_cuts(rows: DataFrame, tree: Tree, budget_share: float, max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: `epochs` taken whole, and `cut`, the last place taken of one more (null: none).

    rows: id (string), domain, lang, source, n (tokens).
    """
    leaves = rows.groupBy(*LEAF).agg(F.sum("n").alias("tokens"))
    budgets = checkpointed(
        leaf_budgets(leaves, tree, budget_share, max_epochs)
        .withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("bigint"))
        .select(*LEAF, "tokens", "budget", "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("left"))
    )
    # What is left of each leaf's budget, and the first digits of the places that hold its cut.
    open_ = budgets.select(*LEAF, "epochs", "left", F.lit("").alias("front"))
    for level in range(1, LEVELS + 1):
        fronts = (
            _inside(rows, open_, seed).groupBy(*LEAF, F.substring("place", 1, level * DIGITS).alias("next"))
            .agg(F.sum("n").alias("n"), F.max("left").alias("left"), F.max("epochs").alias("epochs"))
        )
        upto = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("next"))
        # The group in which the running sum passes what is left; the groups before it are taken.
        open_ = checkpointed(
            fronts.withColumn("upto", upto).where("upto > left AND upto - n <= left")
            .select(*LEAF, "epochs", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("next").alias("front"))
        )
    exact = _inside(rows, open_, seed).groupBy(*LEAF, "place", "left").agg(F.sum("n").alias("n"))
    exact = exact.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("place")))
    last = exact.where("upto <= left").groupBy(*LEAF).agg(F.max("place").alias("inner"))
    # Without a document of the last group, all places before that group are taken.
    cuts = budgets.join(open_.select(*LEAF, "front"), LEAF, "left").join(last, LEAF, "left")
    return checkpointed(cuts.select(*LEAF, "tokens", "budget", "epochs", F.coalesce("inner", "front").alias("cut")))


def _beside(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows with the columns of their leaf. A counted table of leaves is broadcast, a larger one shuffled."""
    few = leaves.count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if few else leaves, LEAF)


def _inside(rows: DataFrame, open_: DataFrame, seed: int) -> DataFrame:
    """The rows whose place begins with the front of their leaf."""
    return _beside(rows, open_).withColumn("place", _place(seed)).where(F.col("place").startswith(F.col("front")))


def mix(docs: DataFrame, tree: Tree, budget_share: float = 0.6, max_epochs: int = 2, seed: int = 42,
        id_column: str = "doc_id", text_column: str = "text", times_column: str = "times") -> DataFrame:
    """The documents taken, with all their columns and how often each is taken (`times_column`).

    The mix holds `budget_share` of all tokens at most.
    """
    key = F.col(id_column).cast("string").alias("id")
    rows = checkpointed(docs.select(key, *tree.leaf(), token_count(text_column).alias("n")))
    cuts = leaf_cuts(rows, tree, budget_share, max_epochs, seed)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key, *tree.leaf())
    taken = _beside(held, cuts.select(*LEAF, "epochs", "cut")).withColumn("place", _place(seed))
    times = F.col("epochs") + F.coalesce((F.col("place") <= F.col("cut")).cast("bigint"), F.lit(0))
    out = taken.select("row", times.alias("times")).where("times > 0")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != times_column], F.col("times").alias(times_column))


def _case(level: str, weights: dict[str, int], other: int) -> str:
    arms = " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in weights.items())
    return f"CASE {arms} ELSE {other} END" if arms else str(other)


def mix_sql(tree: Tree, columns: str, budget_share: float = 0.6, max_epochs: int = 2, seed: int = 42) -> str:
    """The same for DuckDB over `documents`, sorting each leaf whole."""
    def shared(source: str, parent: str, name: str, weight: str, more: str = "") -> str:
        keys = f"{parent}, {name}" if parent else name
        part = f"PARTITION BY {parent}" if parent else ""
        return f"""
        SELECT {keys}{more}, CAST(CASE WHEN capacity / weight <= level THEN capacity ELSE
               floor(greatest(0.0, weight * max(CASE WHEN capacity / weight > level THEN level END) OVER ({part})) + 1e-6) END AS BIGINT) AS budget
        FROM (SELECT *, (given - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM (SELECT *, {weight} AS weight FROM {source})
              WHERE weight > 0 AND capacity > 0 WINDOW w AS ({part} ORDER BY capacity / weight, {name}))"""
    d, l, s = (_case(n, w, tree.other) for n, w in (("domain", tree.domains), ("lang", tree.langs), ("source", tree.sources)))
    return rf"""
    WITH rows AS (
        SELECT *, coalesce({tree.domain}, '') AS t_domain, coalesce({tree.lang}, '') AS t_lang, coalesce({tree.source}, '') AS t_source,
               CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n
        FROM documents),
    leaves AS (SELECT t_domain AS domain, t_lang AS lang, t_source AS source, CAST(sum(n) AS DOUBLE) AS tokens, CAST(sum(n) * {max_epochs} AS DOUBLE) AS capacity FROM rows GROUP BY ALL),
    top AS (SELECT domain, sum(capacity) AS capacity, (SELECT floor(sum(tokens) * {budget_share}) FROM leaves) AS given FROM leaves GROUP BY domain),
    domains AS ({shared("top", "", "domain", d)}),
    middle AS (SELECT domain, lang, sum(capacity) AS capacity, any_value(budget) AS given FROM leaves JOIN domains USING (domain) GROUP BY domain, lang),
    langs AS ({shared("middle", "domain", "lang", l)}),
    bottom AS (SELECT leaves.*, budget AS given FROM leaves JOIN langs USING (domain, lang)),
    budgets AS ({shared("bottom", "domain, lang", "source", s, ", tokens")}),
    whole AS (SELECT *, CAST(floor(budget / tokens) AS BIGINT) AS epochs FROM budgets),
    placed AS (
        SELECT rows.*, epochs, budget - epochs * tokens AS rest,
               md5('{seed}:' || (epochs + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
        FROM rows JOIN whole ON t_domain = whole.domain AND t_lang = whole.lang AND t_source = whole.source),
    summed AS (SELECT *, sum(n) OVER (PARTITION BY t_domain, t_lang, t_source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM placed)
    SELECT {columns}, epochs + CAST(upto <= rest AS BIGINT) AS times FROM summed WHERE epochs + CAST(upto <= rest AS BIGINT) > 0"""
