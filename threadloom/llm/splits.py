"""Train, validation and test splits that keep related records together.

Records and the entities they name (author, thread, response) form a bipartite
graph whose connected components must each land in one split.

*Components.* Every round, each entity takes the smallest label among its
records, each label hooks onto the smallest label it meets, the hooks (a forest,
since a hook always points at a smaller label) are resolved by pointer jumping,
and the graph is contracted. The number of labels at least halves in every
component that is not finished, so rounds grow with the logarithm of the input
and not with the length of a chain. An entity with a third of all links is
reduced by map-side minimum; the way back goes through a broadcast of the hot
entities alone, of which there can be at most ``1 / HOT`` .

*Incremental.* The component table (node, component, split) is persisted by the
caller. A later batch meets it through the nodes it shares: each old component is
one more entity of the batch, so old records are not read again. A component that
meets one split keeps it; several old components of one split merge, under the
smallest of their names, in every row of the table; a merge of components in
different splits is quarantined: its new records get a component of their own, named
``quarantine:`` and their smallest record, and the old ones stay as they are. Which
components such a conflict ties is kept as links, so that the groups themselves
(``tied_groups``) are those of all records whatever the batches were.

*Shares.* New components fill the deficits of the target shares. Those above
``LARGE`` of all records (at most ``1 / LARGE`` of them) go one by one to the
greatest deficit; all others are laid out in hash order on the line of the
remaining deficits by a two-level prefix sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.keys import plain_id, plain_key
from threadloom.runtime import Scratch, broadcast_if_small, hot_keys, join_hot

#: An entity with more than this share of the links is hot.
HOT = 0.001
#: A component with more than this share of the records is placed by itself.
LARGE = 0.01
#: Components in a hash slice of the two-level prefix sum; there are at most 2 ** 20 slices.
SLICE_ROWS = 20_000
QUARANTINE = "quarantine"

# Names that tie nothing.
NO_TIE = ("", "[deleted]", "automoderator")


@dataclass
class SplitResult:
    """records: record, component, split; table: node, component, split; conflicts: component (the quarantined one), splits;
    ties: component, old, of what conflicts tie; renamed: component, to, of earlier components that merged into another (none without a table)."""

    records: DataFrame
    table: DataFrame
    conflicts: DataFrame
    ties: DataFrame
    renamed: DataFrame | None = None


def pair_links(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and their links to entities: (record), (record, entity).

    Ids are trimmed, lower-cased and without ``t1_``/``t3_``; claim and response
    authors are one set of names. Null and empty values, ``[deleted]`` and
    ``automoderator`` make no link. Rows without a pair_id are no record.
    """
    who = lambda c: F.when(~plain_key(F.col(c).cast("string")).isin(*NO_TIE), plain_key(F.col(c).cast("string")))
    rows = pairs.select(
        plain_id(F.col("pair_id").cast("string")).alias("record"),
        F.array(
            F.concat(F.lit("s:"), plain_id(F.col("submission_id").cast("string"))),
            F.concat(F.lit("r:"), plain_id(F.col("response_id").cast("string"))),
            F.concat(F.lit("a:"), who("claim_author")),
            F.concat(F.lit("a:"), who("response_author")),
        ).alias("_e"),
    ).filter(F.col("record").isNotNull())
    links = rows.select("record", F.explode("_e").alias("entity")).filter(F.col("entity").isNotNull()).distinct()
    return rows.select("record").distinct(), links


def _back(links: DataFrame, per_entity: DataFrame, total: int, n_hot: int) -> DataFrame:
    """Join the entities' values back onto their links without gathering a hot entity's links."""
    if not n_hot:
        return links.join(per_entity, "entity")
    hot = F.broadcast(per_entity.filter(F.col("n") > HOT * total))
    cold = per_entity.filter(F.col("n") <= HOT * total)
    in_hot = links.join(hot, "entity")
    in_cold = links.join(hot.select("entity"), "entity", "left_anti").join(cold, "entity")
    return in_hot.unionByName(in_cold)


def components(records: DataFrame, links: DataFrame, scratch: Scratch, n_links: int | None = None) -> DataFrame:
    """record, component: the smallest record (string order) connected with it. ``n_links``: of links that are a written table."""
    label = records.select("record", F.col("record").alias("component"))
    row = F.lit(True)
    links, seen = links.select("entity", F.col("record").alias("label")), {"n": n_links}
    if n_links is None:
        links, seen = scratch.counted(links, n=row)
    while True:
        total = seen["n"]
        per = links.groupBy("entity").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
        per, seen = scratch.counted(per.filter(F.col("low") < F.col("high")), n=row, hot=F.col("n") > HOT * total)
        if not seen["n"]:
            return label
        hooks = _back(links, per, total, seen["hot"]).filter(F.col("low") < F.col("label")).groupBy("label").agg(F.min("low").alias("to"))
        hooks = scratch.keep(hooks)
        while True:  # pointer jumping; targets that do not hook themselves are roots
            up = hooks.select(F.col("label").alias("to"), F.col("to").alias("_next"))
            moved = hooks.join(up, "to", "left").select("label", F.coalesce("_next", "to").alias("to"))  # two jumps before each write
            moved = moved.join(up, "to", "left").select("label", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved"))
            moved, seen = scratch.counted(moved, open=F.col("moved"))
            hooks = moved.drop("moved")
            if not seen["open"]:
                break
        # A component with a third of all records is one label: its hook goes to them in a broadcast.
        move = lambda df, c: join_hot(df, hooks.withColumnRenamed("label", c), c, hot_keys(df, c), "left").withColumn(c, F.coalesce("to", c)).drop("to")
        label = scratch.keep(move(label, "component").select("record", "component"))
        # Entities with one label left are finished and leave the graph.
        links, seen = scratch.counted(move(links.join(broadcast_if_small(per.select("entity")), "entity", "left_semi"), "label").select("entity", "label").distinct(), n=row)


def _place(sizes: DataFrame, targets: list[tuple[str, float]], held: dict[str, int]) -> DataFrame:
    """component, split for components (component, n) without one."""
    all_ = sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).first()
    new, slices_n = all_["n"] or 0, min(1 << 20, max(8, all_["c"] // SLICE_ROWS))
    want = new + sum(held.get(s, 0) for s, _ in targets)
    deficit = {s: max(0.0, share * want - held.get(s, 0)) for s, share in targets}
    bound = max(1.0, LARGE * new)
    # More than LARGE of all records each: at most 1 / LARGE components come to the driver.
    large = sizes.filter(F.col("n") > bound).collect()
    placed = []
    for r in sorted(large, key=lambda r: (-r["n"], r["component"])):
        s = max(deficit, key=lambda k: (deficit[k], k))
        deficit[s] = deficit[s] - r["n"]
        placed.append((r["component"], s))
    rest = {s: max(0.0, d) for s, d in deficit.items()}
    if not sum(rest.values()):
        rest = {s: share for s, share in targets}
    small = sizes.filter(F.col("n") <= bound).withColumn("_h", F.xxhash64("component")).withColumn("_slice", F.pmod("_h", F.lit(slices_n)))
    slices = small.groupBy("_slice").agg(F.sum("n").alias("_n"))
    before = slices.withColumn("_before", F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_all", F.sum("_n").over(Window.partitionBy())).select("_slice", F.coalesce("_before", F.lit(0)).alias("_before"), "_all")
    within = F.sum("n").over(Window.partitionBy("_slice").orderBy("_h", "component"))
    at = (F.col("_before") + within - F.col("n") / 2) / F.col("_all")
    line = small.join(F.broadcast(before), "_slice").withColumn("_at", at)  # at most 2 ** 20 rows of three numbers
    total, upto, case = sum(rest.values()), 0.0, None
    names = [s for s in rest if rest[s] > 0]
    for s in names[:-1]:
        upto += rest[s] / total
        case = (F.when if case is None else case.when)(F.col("_at") < upto, s)
    split = F.lit(names[-1]) if case is None else case.otherwise(names[-1])
    out = line.select("component", split.alias("split"))
    if placed:
        out = out.unionByName(sizes.sparkSession.createDataFrame(placed, "component string, split string"))
    return out


def assign(records: DataFrame, links: DataFrame, targets: DataFrame, table: DataFrame | None = None) -> SplitResult:
    """Give every record a split; see the module text.

    targets: split_name, target_share. table: the component table of earlier
    batches (node, component, split), or none. Nodes of records are written
    ``p:`` and the record, those of entities as in ``links``.

    Nulls and empties: records without links are components of one. An empty
    batch returns the table as it is. Repeated rows count once.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "splits")
    records = scratch.keep(records.select("record").distinct())
    links, seen = scratch.counted(links.select("record", "entity").distinct(), n=F.lit(True))
    own = links.unionByName(records.select("record", F.concat(F.lit("p:"), F.col("record")).alias("entity")))
    shares = [(r["split_name"], float(r["target_share"])) for r in targets.select("split_name", "target_share").limit(1000).collect()]
    whole = own
    if table is not None:
        known = own.join(table.select(F.col("node").alias("entity"), F.col("component").alias("old"), "split"), "entity").select("record", "old", "split").distinct()
        known = scratch.keep(known)
        whole = links.unionByName(known.select("record", F.concat(F.lit("c:"), F.col("old")).alias("entity")))
    else:
        known = spark.createDataFrame([], "record string, old string, split string")
        whole = links
    comp = components(records, whole, scratch, seen["n"] if table is None else None)
    hot = hot_keys(comp, "component")
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    # As many splits as there are targets, and as many old components as a component met.
    met = scratch.keep(comp.join(known, "record").groupBy("component").agg(F.min("old").alias("old"), F.sort_array(F.collect_set("split")).alias("splits")))
    held = {r["split"]: r["n"] for r in table.filter(F.col("node").startswith("p:")).groupBy("split").agg(F.count(F.lit(1)).alias("n")).limit(1000).collect()} if table is not None else {}
    fresh = _place(scratch.keep(sizes.join(met, "component", "left_anti")), shares, held)
    clash = F.size("splits") > 1
    named = F.when(clash, F.concat(F.lit(f"{QUARANTINE}:"), F.col("component"))).otherwise(F.col("old"))
    decided = met.select("component", named.alias("to"), F.when(clash, QUARANTINE).otherwise(F.get("splits", F.lit(0))).alias("split"), clash.alias("clash"))
    decided = scratch.keep(decided.unionByName(fresh.select("component", F.col("component").alias("to"), "split", F.lit(False).alias("clash"))))
    placed = scratch.keep(join_hot(comp, decided, "component", hot).select("record", F.col("to").alias("component"), "split"))
    clashing = decided.filter("clash").select("component", F.col("to"))
    conflicts = met.filter(clash).select("component", "splits").join(clashing, "component").select(F.col("to").alias("component"), "splits")
    ties = comp.join(known, "record").join(clashing, "component").select(F.col("to").alias("component"), "old").distinct()
    # New nodes; a node already known keeps its row, renamed if its component merged.
    nodes = own.join(placed, "record").groupBy(F.col("entity").alias("node")).agg(F.min("component").alias("component"), F.min("split").alias("split"))
    alias = None
    if table is not None:
        alias = scratch.keep(comp.join(known, "record").join(decided.filter(~F.col("clash")), "component").filter(F.col("old") != F.col("to")).select(F.col("old").alias("component"), "to").distinct())
        old = join_hot(table, alias, "component", hot_keys(table, "component"), "left").select("node", F.coalesce("to", "component").alias("component"), "split")
        nodes = nodes.join(table.select("node"), "node", "left_anti").unionByName(old)
        # A record of an earlier batch stays where it was, even in a batch whose other records are quarantined.
        before = old.filter(F.col("node").startswith("p:")).select(F.expr("substring(node, 3)").alias("record"), F.col("component").alias("_c"), F.col("split").alias("_s"))
        placed = scratch.keep(placed.join(before, "record", "left").select("record", F.coalesce("_c", "component").alias("component"), F.coalesce("_s", "split").alias("split")))
    return SplitResult(placed, nodes.select("node", "component", "split"), conflicts, ties, alias)


def arrivals(pairs: DataFrame, time: str = "response_created_utc") -> list[DataFrame]:
    """Every row in one of two batches: those up to the middle of the times or without one, then the later ones."""
    at = F.col(time).cast("double")
    span = pairs.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if span["a"] is None:
        return [pairs]
    early = F.coalesce(at <= (span["a"] + span["b"]) / 2, F.lit(True))
    return [pairs.filter(early), pairs.filter(~early)]


def tied_groups(batches: list[DataFrame], targets: DataFrame) -> DataFrame:
    """pair_id, group_id of pairs tied to at least one other pair, from the component table.

    The batches go through ``assign`` one after the other; each finds the table
    of those before it written. Conflicting merges, which the table leaves
    apart, are then closed over their links. Batches may share records.
    """
    scratch = Scratch(targets.sparkSession, "ties")
    table, links = None, None
    for batch in batches:
        records, own = pair_links(batch)
        result = assign(records, own, targets, table)
        table = scratch.keep(result.table)
        tie = result.ties.select(F.col("component").alias("entity"), F.explode(F.array("component", "old")).alias("record"))
        if result.renamed is not None:  # what a conflict tied earlier may have another name by now
            tie = tie.unionByName(result.renamed.select(F.concat(F.lit("to:"), "component").alias("entity"), F.explode(F.array("component", "to")).alias("record")))
        tie = scratch.keep(tie.distinct())
        links = tie if links is None else links.unionByName(tie)
    members = table.filter(F.col("node").startswith("p:")).select(F.expr("substring(node, 3)").alias("record"), "component")
    if not links.isEmpty():
        joined = components(links.select("record").distinct(), links, scratch).select(F.col("record").alias("component"), F.col("component").alias("_group"))
        hot = hot_keys(table, "component")
        members = join_hot(members, joined, "component", hot, "left").select("record", F.coalesce("_group", "component").alias("component"))
    per = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("record").alias("group_id")).filter("n > 1")
    return join_hot(members, per, "component", hot_keys(members, "component")).select(F.col("record").alias("pair_id"), "group_id")


def share_report(result: SplitResult, targets: DataFrame) -> DataFrame:
    """split, records, share, target_share, components."""
    per = result.records.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("component").alias("components"))
    total = F.sum("records").over(Window.partitionBy())
    return per.withColumn("share", F.round(F.col("records") / total, 6)).join(targets.select(F.col("split_name").alias("split"), "target_share"), "split", "left").select("split", "records", "components", "share", "target_share")
