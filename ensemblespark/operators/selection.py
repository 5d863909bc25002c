"""Selections over clusters, lists and catalogs: filters with their audit, anti-joins, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks import keep


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in order; a partial aggregate, so no key gathers its rows."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in (*order, *rest)])


def filter_trail(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(step, label, removed, remaining) for rules that keep what satisfies them, in one pass:
    each row counts for the first rule it fails."""
    first = F.lit(len(rules))
    for i, (_, keeps) in reversed(list(enumerate(rules))):
        first = F.when(F.coalesce(~keeps, F.lit(True)), F.lit(i)).otherwise(first)
    counts = rows.select(first.alias("step")).groupBy("step").agg(F.count("*").alias("removed"))
    names = rows.sparkSession.createDataFrame([(i, label) for i, (label, _) in enumerate(rules)] + [(len(rules), "")], "step int, label string")
    every = names.join(F.broadcast(counts), "step", "left").select("step", "label", F.coalesce("removed", F.lit(0)).alias("removed"))
    after = Window.orderBy("step").rowsBetween(1, Window.unboundedFollowing)  # a row per rule
    return every.withColumn("remaining", F.coalesce(F.sum("removed").over(after), F.lit(0))).where(F.col("step") < len(rules))


def not_exposed(members: DataFrame, exposure: DataFrame, cluster: str, entry: str) -> DataFrame:
    """Clusters none of whose members' entries is on a list."""
    hit = members.join(exposure.select(F.col("id").alias(entry)).distinct(), entry, "left_semi").select(cluster).distinct()
    return members.select(cluster).distinct().join(hit, cluster, "left_anti")


def cluster_summary(members: DataFrame, exposure: DataFrame) -> DataFrame:
    """Per cluster: experimental tokens, distinct entries, all and predicted members, overlap, representative."""
    flagged = members.join(exposure.select(F.col("id").alias("entry"), F.lit(True).alias("seen")).distinct(), "entry", "left")
    exp = ~F.col("predicted")
    return flagged.groupBy("cluster_id").agg(
        F.sum(exp.cast("long")).alias("n_entities"), F.countDistinct(F.when(exp, F.col("entry"))).alias("n_pdb"), F.count("*").alias("n_raw"), F.sum(F.col("predicted").cast("long")).alias("n_predicted"),
        F.max(F.coalesce(F.col("seen"), F.lit(False)) & exp).alias("overlaps"), F.min(F.when(exp, F.col("token"))).alias("representative"),
    )


def band_select(rows: DataFrame, blocked: DataFrame, low: float, high: float) -> DataFrame:
    """Units whose latest status isn't ok and whose rmsd lies in [low, high), not blocked."""
    last = latest_per_key(rows, ["unit"], ["line_no", "status", "rmsd"])
    return last.where((F.col("status") != "ok") & (F.col("rmsd") >= low) & (F.col("rmsd") < high)).join(blocked, "unit", "left_anti")


def allow_exclude(rows: DataFrame, listed: DataFrame, key: str, keep_listed: bool) -> DataFrame:
    """Rows whose id, or the entry before its `_`, is (not) listed, whatever the case."""
    names = listed.select(F.lower("id").alias("_id")).distinct()
    full, entry = F.lower(F.col(key)), F.lower(F.split_part(F.col(key), F.lit("_"), F.lit(1)))
    hit = rows.select(key, F.explode(F.array_distinct(F.array(full, entry))).alias("_id")).join(names, "_id", "left_semi").select(key).distinct()
    return rows.join(hit, key, "left_semi" if keep_listed else "left_anti")


def upsert(layers: list[DataFrame], key: str, removed: DataFrame) -> DataFrame:
    """Layers in rising precedence merged to one row per key, removed keys left out."""
    all_ = None
    for i, layer in enumerate(layers):
        own = layer.withColumn("_layer", F.lit(i))
        all_ = own if all_ is None else all_.unionByName(own)
    return latest_per_key(all_, [key], ["_layer"]).drop("_layer").join(removed, key, "left_anti")


def merge_same_sequence(families: DataFrame, members: DataFrame) -> DataFrame:
    """One family per sequence: the one with most members, then the least id; with the union of
    the members' paths."""
    sizes = members.groupBy("family_id").agg(F.countDistinct("path").alias("size"))
    own = families.join(sizes, "family_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    best = own.groupBy("seqres").agg(F.max(F.struct("size", (-F.col("doc_id")).alias("neg"))).alias("b"))
    keeper = best.select("seqres", (-F.col("b.neg")).alias("doc_id")).join(own.select("doc_id", "family_id"), "doc_id").select("seqres", F.col("family_id").alias("keeper"))
    paths = families.join(members, "family_id").select("seqres", "path").distinct().groupBy("seqres").agg(F.count("*").alias("n_paths"))
    return keeper.join(paths, "seqres", "left").select("keeper", F.coalesce("n_paths", F.lit(0)).alias("n_paths"))


def share_cap(sizes: DataFrame, size: str, share: float) -> DataFrame:
    """(cap, draws): the largest cap, scanning up from 1 and stopping at the first failure, at
    which the largest draw makes up at most `share` of all draws. Works on the histogram of
    sizes: a row per distinct size."""
    # D distinct sizes need at least D * D / 2 draws, so the histogram is a small table whatever the input.
    hist = sizes.groupBy(F.col(size).cast("bigint").alias("n")).agg(F.count("*").alias("m"))
    up, every = Window.orderBy("n"), Window.partitionBy()
    steps = hist.select("n", F.sum(F.col("n") * F.col("m")).over(up).alias("low"), (F.sum("m").over(every) - F.sum("m").over(up)).alias("above"), F.lead("n").over(up).alias("to"))
    first = hist.agg(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("low"), F.sum("m").alias("above"), F.min("n").alias("to"))
    # From one size to the next draws rise by `above` with each cap, so the first failure in between is where a line crosses.
    runs = steps.unionByName(first).select(F.greatest("n", F.lit(1)).alias("a"), F.coalesce(F.col("to") - 1, "n").alias("b"), "low", "above").where("a <= b")
    cross = F.floor(share * F.col("low") / F.greatest(1 - share * F.col("above"), F.lit(1e-300)))
    near = F.when(share * F.col("above") >= 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda i: F.least(F.greatest(cross + i, "a"), F.col("b")).cast("bigint")))
    fails = F.filter(F.array_union(near, F.array("a", "b")), lambda c: c > (F.col("low") + c * F.col("above")) * share)
    runs = runs.withColumn("bad", F.array_min(fails))
    bad = runs.agg(F.coalesce(F.min("bad"), F.max("b") + 1).alias("first_bad"))
    at = runs.crossJoin(F.broadcast(bad)).where((F.col("a") < F.col("first_bad")) & (F.col("first_bad") <= F.col("b") + 1))  # one row against the histogram
    best = at.select((F.col("first_bad") - 1).alias("cap"), (F.col("low") + (F.col("first_bad") - 1) * F.col("above")).alias("draws"))
    return bad.join(best, F.lit(True), "left").select(F.coalesce("cap", F.lit(1)).alias("cap"), "draws")


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with each one's place (from 1) within its group by order. Rows are dealt out by ranges
    of (group, order), so that no task sorts a whole group; the counts of a group's rows in the
    ranges before, a small table, give each range its first place."""
    keys = [*group, *order]
    own = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    own = keep(own.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"))
    sizes = own.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_{g}") for g in group], (before - F.col("_first") + 1).alias("_add"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return own.join(offsets, same).select(*rows.columns, (F.col("_at") + F.col("_add")).alias(name))
