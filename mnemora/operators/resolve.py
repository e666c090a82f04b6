"""Entity resolution: exact tiers, fuzzy tier, and new labels against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.config import NEW_NODE_CONFIDENCE
from mnemora.functions.text import fuzzy_match, node_id, normalize


def mapped(mentions: DataFrame, aliases: dict[str, str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """Mentions with ``name`` (normalised, aliases applied); ignored names are dropped."""
    m = mentions.withColumn("name", normalize(F.col("text")))
    if ignore:
        m = m.filter(~F.col("name").isin(*[x.lower() for x in ignore]))
    if aliases:
        table = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k, v.lower())])
        m = m.withColumn("name", F.coalesce(table[F.col("text")], table[F.col("name")], F.col("name")))
    return m.filter("name <> ''")


def exact(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, id, tier): label matches before alias matches, the least id of several."""
    by = nodes.select(normalize(F.col("label")).alias("name"), "id", F.lit("label").alias("tier"), F.lit(0).alias("k"))
    by = by.unionByName(nodes.select(F.explode("aliases").alias("a"), "id").select(normalize(F.col("a")).alias("name"), "id", F.lit("alias").alias("tier"), F.lit(1).alias("k")))
    best = by.groupBy("name").agg(F.min(F.struct("k", "id", "tier")).alias("b"))
    return names.select("name").distinct().join(best, "name").select("name", "b.id", "b.tier")


def _blocks(df: DataFrame, name: str) -> DataFrame:
    """A row for each block in which a fuzzy partner can stand.

    Names within two edits share a string that at most two deletions make of either; longer ones
    share a token, for half of the larger set of tokens is common.
    """
    c = F.col(name)
    n = F.length(c)

    def shorter(x: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)))
        return F.array_union(F.array(x), F.transform(places, lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))

    twice = F.array_distinct(F.flatten(F.transform(shorter(c), shorter)))
    short = F.transform(twice, lambda x: F.concat(F.lit("s:"), x))
    tokens = F.transform(F.array_distinct(F.split(c, " ")), lambda x: F.concat(F.lit("t:"), x))
    return df.withColumn("block", F.explode(F.when(n <= 15, F.array_union(short, tokens)).otherwise(tokens)))


def fuzzy_pairs(names: DataFrame, against: DataFrame) -> DataFrame:
    """(name, other) of fuzzy matches of two tables of distinct names: candidates by blocks, then the test itself."""
    a = _blocks(names.select("name").distinct(), "name")
    b = _blocks(against.select(F.col("name").alias("other")).distinct(), "other")
    pairs = a.join(b, "block").select("name", "other").distinct()
    return pairs.filter(fuzzy_match(F.col("name"), F.col("other")))


def fuzzy(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, id): the least id among the nodes whose label matches loosely."""
    labels = nodes.select(normalize(F.col("label")).alias("name"), "id")
    hit = fuzzy_pairs(names, labels).join(labels.withColumnRenamed("name", "other"), "other")
    return hit.groupBy("name").agg(F.min("id").alias("id"))


#: Pairs that one task settles in order, and rounds between two such tasks for each component.
IN_ORDER, ROUNDS = 200_000, 3


def leaders(labels: DataFrame, in_order: int = IN_ORDER) -> DataFrame:
    """(name, leader) of new labels (name, ord): in order, each joins the first earlier leader it matches loosely, or leads.

    Whether a label leads depends on the matching labels before it alone. All that no open label precedes lead at once, and what
    they match follows; what is then left of each component is settled in order inside a task, its first ``in_order`` pairs at a time, so a chain
    in the worst order costs no rounds of its own.
    """
    from mnemora.shared import small_enough, written

    l = written(labels.groupBy("name").agg(F.min("ord").alias("ord")), "labels")
    p = fuzzy_pairs(l, l).filter("name <> other")
    o = l.select(F.col("name").alias("other"), F.col("ord").alias("other_ord"))
    before = written(p.join(l, "name").join(o, "other").filter("other_ord < ord").select("name", "ord", "other", "other_ord"), "before")
    open_, pairs, lead = l.select("name"), before, []
    while True:
        new = written(open_.join(pairs.select("name").distinct(), "name", "left_anti"), "leaders")  # no open label matches them earlier
        lead.append(new)
        if small_enough(pairs, in_order):
            lead.append(written(_settled(pairs.withColumn("root", F.lit(0))), "leaders"))
            break
        if len(lead) % ROUNDS == 0:
            lead.append(written(_settled(_first_pairs(pairs, in_order)), "leaders"))
            new = new.unionByName(lead[-1])
        follow = pairs.join(new.withColumnRenamed("name", "other"), "other", "left_semi").select("name").distinct()
        gone = written(new.unionByName(follow).distinct(), "settled")
        open_ = written(open_.join(gone, "name", "left_anti"), "open")
        pairs = written(pairs.join(gone, "name", "left_anti").join(gone.withColumnRenamed("name", "other"), "other", "left_anti"), "pairs")
    every = lead[0]
    for more in lead[1:]:
        every = every.unionByName(more)
    every = written(every, "leaders")
    joined = before.join(every, "name", "left_anti").join(every.withColumnRenamed("name", "other"), "other", "left_semi")
    followed = joined.groupBy("name").agg(F.min(F.struct("other_ord", "other"))["other"].alias("leader"))
    return every.select("name", F.col("name").alias("leader")).unionByName(followed)


def _first_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs with ``root`` of each component's first labels in order, so many pairs in all (or one label's)."""
    from mnemora.operators.components import contract

    root = contract(pairs.select(F.col("name").alias("a"), F.col("other").alias("b")), least=False).withColumnRenamed("node", "name")
    by = Window.partitionBy("root").orderBy("ord", "name")
    size = pairs.groupBy("name", "ord").agg(F.count(F.lit(1)).alias("_n")).join(root, "name").withColumn("_sum", F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return pairs.join(size.filter((F.col("_sum") <= most) | (F.col("_sum") == F.col("_n"))).select("name", "root"), "name")


def _settled(pairs: DataFrame) -> DataFrame:
    """The labels that lead among those of pairs (root, name, ord, other), settled in order; an ``other`` that is no name of its root leads."""

    def walk(table):
        import pyarrow as pa

        lead, names = set(), table.column("name").to_pylist()
        at: dict = {}
        for name, ord_, other in zip(names, table.column("ord").to_pylist(), table.column("other").to_pylist(), strict=True):
            at.setdefault(name, (ord_, []))[1].append(other)
        place = lambda o: tuple(o.values()) if isinstance(o, dict) else o
        for name in sorted(at, key=lambda n: (place(at[n][0]), n)):
            if not any(o in lead or o not in at for o in at[name][1]):
                lead.add(name)
        return pa.table({"name": pa.array(sorted(lead), pa.string())})

    return pairs.select("root", "name", "ord", "other").groupBy("root").applyInArrow(walk, "name string")


def resolve(mentions: DataFrame, nodes: DataFrame, aliases: dict[str, str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """Mentions with ``node_id`` and ``tier`` (label, alias, fuzzy, new); those that would need a new node but lack confidence are dropped."""
    m = mapped(mentions, aliases, ignore)
    names = m.select("name").distinct()
    one = exact(names, nodes)
    rest = names.join(one, "name", "left_anti")
    two = fuzzy(rest, nodes).withColumn("tier", F.lit("fuzzy"))
    known = one.unionByName(two.select("name", "id", "tier"))
    new = m.join(known, "name", "left_anti").filter(F.col("confidence") > NEW_NODE_CONFIDENCE)
    led = leaders(new.select("name", F.struct("file", "section", "ord").alias("ord"))).select("name", node_id(F.col("leader")).alias("id"), F.lit("new").alias("tier"))
    every = known.unionByName(led)
    return m.join(every, "name").withColumnRenamed("id", "node_id")
