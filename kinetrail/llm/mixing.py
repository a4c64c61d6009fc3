"""Mixing sources to target weights by hierarchical budgeting.

Documents belong to leaves of a domain-language-source tree. The token budget
flows down the tree: a node's budget is shared among its children by weight,
no child gets more than its leaves hold in ``max_epochs`` epochs, and what a
child cannot use goes to its siblings by weight. As a node's own limit is what
all its leaves hold, a shortage passes to an ancestor's other children only when no
sibling can take it. A leaf's allocation is a number of whole epochs and a
token-prefix of one more, in an order seeded by (seed, epoch, doc_id).

The prefix is found without sorting a leaf: tokens are summed by the first
digits of the order's hash, the bin that the prefix ends in is found from
those sums, and only that bin is ordered. The outcome is one cut for each leaf,
so documents are selected by a filter and their texts are never shuffled.

Statistics of the leaves, at most ``MAX_LEAVES``, go to the driver and back as a
broadcast; more leaves raise an error.

Defined results: null languages and sources are a value of their own; a source without a number
at its end, a null one too, is of domain0.
Rows that share a doc_id share its place in the order and are selected
together. Null and empty texts have 0 tokens. Children without a weight have
weight 1; those of weight 0 get nothing. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .packing import n_tokens

MAX_LEAVES = 100_000
#: Hexadecimal digits of the order's hash that are binned.
BIN_DIGITS = 3
LEVELS = ("domain", "lang", "source")


def domain_of(source: str = "source") -> Column:
    """The domain of a source: its number modulo 4, 0 without one."""
    return F.concat(F.lit("domain"), (F.coalesce(F.regexp_extract(F.col(source), r"(\d{1,9})$", 1).try_cast("int"), F.lit(0)) % 4).cast("string"))


def fill(budget: float, weights: list[float], limits: list[float]) -> list[float]:
    """Share a budget by weight under limits; what one cannot take goes to the others by weight."""
    out, open_ = [0.0] * len(weights), [k for k, w in enumerate(weights) if w > 0]
    while open_ and budget > 1e-9:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if limits[k] <= budget * weights[k] / total]
        if not full:
            for k in open_:
                out[k] = budget * weights[k] / total
            break
        for k in full:
            out[k] = limits[k]
        budget -= sum(limits[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return out


def allocate(leaves: dict[tuple, int], budget: float, weights: dict[tuple, float], max_epochs: float) -> dict[tuple, int]:
    """Tokens for each leaf (a path) that holds so many; ``weights`` are by path of a node."""
    out: dict[tuple, int] = {}

    def usable(path: tuple, held: int) -> float:
        return held * max_epochs if all(weights.get(path[: d + 1], 1.0) > 0 for d in range(len(path))) else 0.0

    def down(part: list[tuple], depth: int, own: float) -> None:
        groups: dict[object, list[tuple]] = defaultdict(list)
        for path in part:
            groups[path[depth]].append(path)
        names = sorted(groups, key=lambda x: (x is None, str(x)))
        limits = [sum(usable(p, leaves[p]) for p in groups[n]) for n in names]
        shares = fill(own, [weights.get((*part[0][:depth], n), 1.0) for n in names], limits)
        for name, share in zip(names, shares, strict=True):
            if depth + 1 == len(part[0]):
                out[groups[name][0]] = int(share + 1e-6)
            else:
                down(groups[name], depth + 1, share)

    if leaves:
        down(sorted(leaves, key=str), 0, budget)
    return out


def order_hash(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


@dataclass
class Plan:
    """A cut for each leaf: whole epochs, and the last place in the order of one more."""

    leaves: DataFrame
    seed: int

    def times(self, docs: DataFrame, levels: tuple[Column, ...]) -> DataFrame:
        """The rows of ``docs`` that some epoch selects, with a column ``_times``, the number of those epochs. ``levels`` give a row's leaf."""
        marked = docs.join(F.broadcast(self.leaves), [c.eqNullSafe(self.leaves[f"_leaf_{n}"]) for c, n in zip(levels, LEVELS, strict=True)])
        extra = (order_hash(self.seed, F.col("_leaf_epochs")) <= F.col("_leaf_cut")).cast("int")
        return marked.withColumn("_times", (F.col("_leaf_epochs") + extra).cast("int")).where(F.col("_times") > 0)


LEAF_SCHEMA = "_leaf_domain string, _leaf_lang string, _leaf_source string, leaf_id int, _leaf_epochs int, leaf_rest long"


def plan(rows: DataFrame, share: float, weights: dict[tuple, float], max_epochs: int, seed: int) -> Plan:
    """Cuts for rows of (doc_id, domain, lang, source, n_tokens), for a budget of ``share`` of all tokens."""
    spark = rows.sparkSession
    stats = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(stats) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    held = {tuple(r[c] for c in LEVELS): r.n for r in stats}
    given = allocate(held, share * sum(held.values()), weights, max_epochs)
    cuts = [(*path, k, given[path] // n if n else 0, given[path] % n if n else 0) for k, (path, n) in enumerate(held.items())]
    leaves = spark.createDataFrame(cuts, LEAF_SCHEMA)
    placed = rows.join(F.broadcast(leaves), [rows[c].eqNullSafe(leaves[f"_leaf_{c}"]) for c in LEVELS])
    placed = placed.select("leaf_id", "leaf_rest", "n_tokens", order_hash(seed, F.col("_leaf_epochs")).alias("h"))
    bins = placed.groupBy("leaf_id", "leaf_rest", F.substring("h", 1, BIN_DIGITS).alias("bin")).agg(F.sum("n_tokens").alias("n"))
    through = F.sum("n").over(Window.partitionBy("leaf_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    # the bin in which the prefix ends; none where it takes all
    ends = bins.withColumn("through", through).where("through > leaf_rest").groupBy("leaf_id").agg(F.min("bin").alias("bin"), F.min_by(F.col("through") - F.col("n"), "bin").alias("before"))
    # a row for each leaf at most
    inside = placed.withColumn("bin", F.substring("h", 1, BIN_DIGITS)).join(F.broadcast(ends), ["leaf_id", "bin"]).select("leaf_id", "leaf_rest", "before", "h", "n_tokens")
    inside = inside.groupBy("leaf_id", "leaf_rest", "before", "h").agg(F.sum("n_tokens").alias("n"))
    reached = F.col("before") + F.sum("n").over(Window.partitionBy("leaf_id").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("reached", reached).where("reached <= leaf_rest").groupBy("leaf_id").agg(F.max("h").alias("h"))
    found = {r.leaf_id: r.cut for r in ends.join(last, "leaf_id", "left").select("leaf_id", F.coalesce("h", "bin").alias("cut")).collect()}
    # without an end all is taken ("g" is after every hash), but nothing of a leaf that got nothing
    full = [(*c[:5], found.get(c[3], "g" if c[5] else "")) for c in cuts]
    return Plan(spark.createDataFrame(full, "_leaf_domain string, _leaf_lang string, _leaf_source string, _leaf_id int, _leaf_epochs int, _leaf_cut string"), seed)


#: Target weights of the query: of domains, and of English inside each domain.
WEIGHTS = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0} | {(f"domain{k}", "en"): 2.0 for k in range(4)}


def with_levels(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", domain_of())


def mix(docs: DataFrame, share: float = 0.6, weights: dict[tuple, float] | None = None, max_epochs: int = 2, seed: int = 13) -> DataFrame:
    """doc_id, epoch, domain, lang, source, n_tokens: a row for each selection of a document."""
    rows = stage(with_levels(docs.select("doc_id", "lang", "source", n_tokens().alias("n_tokens"))), "mixing-rows")
    chosen = plan(rows, share, WEIGHTS if weights is None else weights, max_epochs, seed).times(rows, tuple(rows[c] for c in LEVELS))
    return chosen.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch"), "domain", "lang", "source", "n_tokens")


def select(docs: DataFrame, share: float, weights: dict[tuple, float] | None = None, seed: int = 13) -> DataFrame:
    """The rows of ``docs``, all columns, that one seeded epoch selects; each row once at most."""
    rows = stage(with_levels(docs.select("doc_id", "lang", "source", n_tokens().alias("n_tokens"))), "mixing-rows")
    cuts = plan(rows, share, WEIGHTS if weights is None else weights, 1, seed)
    return cuts.times(docs, (domain_of(), F.col("lang"), F.col("source"))).select(*docs.columns)


def run(docs: DataFrame) -> DataFrame:
    return mix(docs)
