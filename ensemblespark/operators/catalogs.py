"""Selections, look-ups and audits over catalogs, clusters and stored artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import residue_letter, unit_hash
from ..sinks import forget, keep, small
from .selection import ranked


def derive_seqres(residues: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """(group, seqres): the residues' letters in order; a group is one chain."""
    own = residues.select(group, F.struct(F.col(order).alias("o"), residue_letter(F.col(name)).alias("c")).alias("r"))
    return own.groupBy(group).agg(F.array_sort(F.collect_list("r")).alias("r")).select(group, F.array_join(F.transform("r", lambda r: r["c"]), "").alias("seqres"))


def canonical(rows: DataFrame, by: list[str], aliases: dict[str, list[str]], tie: str) -> DataFrame:
    """(by, metric, name, value) of rows (by, name, value, tie): of a metric's names the one that comes
    first among its aliases, then the least tie. Names that are no alias are left out."""
    known = F.create_map(*[x for metric, names in aliases.items() for i, n in enumerate(names) for x in (F.lit(n), F.struct(F.lit(metric).alias("metric"), F.lit(i).alias("rank")))])
    own = rows.withColumn("_a", F.element_at(known, F.col("name"))).where("_a is not null")
    best = own.groupBy(*by, F.col("_a.metric").alias("metric")).agg(F.min(F.struct("_a.rank", tie, "name", "value")).alias("b"))
    return best.select(*by, "metric", "b.name", "b.value")


def one_experimental(members: DataFrame, blocked: DataFrame, least_predicted: int) -> DataFrame:
    """Clusters (cluster, token) with exactly one experimental entry, which is not blocked (entry), and at
    least so many predicted members; the experimental representative first, then the predicted in order."""
    predicted = F.col("token").startswith("AF_")
    entry = F.when(~predicted, F.split_part("token", F.lit("_"), F.lit(1)))
    g = members.withColumn("_e", entry).groupBy("cluster").agg(
        F.count("*").alias("n_raw"), F.count("_e").alias("n_entities"), F.count(F.when(predicted, 1)).alias("n_af"), F.min("_e").alias("entry"), F.max("_e").alias("_top"),
        F.min(F.when(~predicted, F.col("token"))).alias("rep"), F.array_sort(F.collect_list(F.when(predicted, F.upper("token")))).alias("_af"),
    )
    kept = g.where((F.col("entry") == F.col("_top")) & (F.col("n_af") >= least_predicted)).join(blocked.distinct(), "entry", "left_anti")
    return kept.select(F.lower("rep").alias("cluster_id"), "n_entities", "n_raw", "n_af", F.concat("rep", F.lit(" "), F.array_join("_af", " ")).alias("members"))


def task_violations(task: Column, n: Column, stride: Column, given: Column) -> Column:
    """What is wrong with a case: unknown task, more than one frame of an iid case, missing frames or
    stride of another, a wrong number of conditions."""
    checks = [
        (~task.isin("iid", "forward", "interp"), "task"), ((task == "iid") & (n > 1), "frames"), ((task != "iid") & n.isNull(), "no frames"), ((task != "iid") & stride.isNull(), "no stride"),
        (((task == "forward") & (given != 1)) | ((task == "interp") & (given != 2)), "conditions"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))


def reopen(progress: DataFrame, unit: str, at_least: int) -> DataFrame:
    """Progress rows (unit, status, n_members, ...) without the finished rows of units that finished
    with at least so many members, so that these are done again."""
    finished = F.col("status").isin("ok", "done")
    capped = progress.where(finished & (F.col("n_members") >= at_least)).select(unit).distinct().withColumn("_capped", F.lit(True))
    return progress.join(capped, unit, "left").where(~(finished & F.coalesce("_capped", F.lit(False)))).drop("_capped")


def lookup(entries: DataFrame, index: DataFrame, suffixes: int) -> DataFrame:
    """(entry, suffix, cluster_id): the cluster of entry_1, else of entry_2 and so on; entries in none are left out."""
    tried = entries.select("entry", F.explode(F.sequence(F.lit(1), F.lit(suffixes))).alias("suffix")).withColumn("token", F.concat("entry", F.lit("_"), F.col("suffix").cast("string")))
    found = tried.join(index, "token").groupBy("entry").agg(F.min(F.struct("suffix", "cluster_id")).alias("b"))
    return found.select("entry", "b.suffix", "b.cluster_id")


def best_member(members: DataFrame, cluster: str, entry: str, order: str, distance: str, most: int) -> DataFrame:
    """Each entry's row of least distance (then first in order); entries in order of first appearance (then
    of name), up to `most` a cluster. Only one row per entry is ranked."""
    own = members.groupBy(cluster, entry).agg(F.min(F.struct(distance, order, "token")).alias("b"), F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy("_first", entry)).cast("long")
    return own.select(cluster, entry, "b.token", F.col(f"b.{distance}").alias(distance), place.alias("place")).where(F.col("place") <= most)


def drop_outliers(members: DataFrame, cluster: str, order: str, distance: str, limit: float, at_most: int, at_least: int) -> DataFrame:
    """Members of each cluster without its worst k, the least k up to at_most that leaves at_least members
    all within the limit; all of them if there is no such k. Ties: the first in order goes first."""
    worst = Window.partitionBy(cluster).orderBy(F.col(distance).desc(), order)
    top = members.groupBy(cluster).agg(F.count("*").alias("_n"), F.expr(f"slice(sort_array(collect_list({distance}), false), 1, {at_most + 1})").alias("_top"))
    fits = [F.when((F.col("_n") - k >= (at_least if k else 0)) & (F.coalesce(F.get("_top", F.lit(k)), F.lit(float("-inf"))) <= limit), F.lit(k)) for k in range(at_most + 1)]
    plan = top.select(cluster, F.coalesce(*fits, F.lit(0)).alias("_k")).where("_k > 0")
    marked = members.join(plan, cluster, "left")
    whole = marked.where("_k is null")
    cut = marked.where("_k is not null").withColumn("_r", F.row_number().over(worst)).where("_r > _k").drop("_r")
    return whole.unionByName(cut).drop("_k")


def populated(assigned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(split, n, missing) for each split asked for; missing if it should have some and has none."""
    asked = assigned.sparkSession.createDataFrame(list(shares.items()), "split string, share double")
    n = assigned.groupBy("split").agg(F.count("*").alias("n"))
    return asked.join(n, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"), ((F.col("share") > 0) & F.col("n").isNull()).alias("missing"))


def fingerprint(families: DataFrame, digits: int = 3) -> DataFrame:
    """(buckets, fingerprint) of families (family_id, seqres), whatever their order: the digest of the
    digests of buckets, each that of its families' digests in order. A family's bucket is the first
    `digits` hexadecimal digits of its id's digest, so a bucket holds one in 16 ** digits of them, and only
    digests are gathered; take more digits for more families."""
    leaf = families.select("family_id", F.sha2(F.concat("family_id", F.lit("\x00"), "seqres", F.lit("\n")), 256).alias("h"), F.substring(F.sha2("family_id", 256), 1, digits).alias("bucket")).where("h is not null")
    one = leaf.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("family_id", "h"))).alias("x"))
    one = one.select("bucket", F.sha2(F.array_join(F.transform("x", lambda r: r["h"]), ""), 256).alias("h"))
    every = one.agg(F.array_sort(F.collect_list(F.struct("bucket", "h"))).alias("x"))  # at most 16 ** digits
    return every.select(F.size("x").cast("long").alias("buckets"), F.sha2(F.array_join(F.transform("x", lambda r: r["h"]), ""), 256).alias("fingerprint"))


def expectation(fields: DataFrame) -> DataFrame:
    """(field, verdict) of fields (field, stored, asked): numbers agree within 1e-6, texts exactly; a field
    that isn't stored is unknown, which is no mismatch."""
    a, b = F.col("stored").try_cast("double"), F.col("asked").try_cast("double")
    same = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 1e-6).otherwise(F.col("stored") == F.col("asked"))
    return fields.select("field", F.when(F.col("stored").isNull(), "unknown").when(F.coalesce(same, F.lit(False)), "same").otherwise("mismatch").alias("verdict"))


def upper_median(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, value): the middle value in order, the upper of two. Works on the counts of equal values."""
    h = rows.groupBy(*by, value).agg(F.count("*").alias("_m"))
    upto, every = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    h = h.select(*by, value, F.sum("_m").over(upto).alias("_upto"), F.floor(F.sum("_m").over(every) / 2).alias("_half")).where("_upto > _half")
    return h.groupBy(*by).agg(F.min(value).alias(value))


def cache_state(wanted: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """(key, state) of each wanted key, once: cached if a file lies under a name that the index has for it,
    lost if the index has a name without a file, else missing."""
    known = index.join(files.distinct().withColumn("_file", F.lit(True)), "index", "left").groupBy("key").agg(F.max(F.coalesce("_file", F.lit(False))).alias("_file"))
    own = wanted.select("key").distinct().join(known, "key", "left")
    return own.select("key", F.when(F.col("_file"), "cached").when(F.col("_file").isNotNull(), "lost").otherwise("missing").alias("state"))


def plan_fetch(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files (name, size) that aren't here in the same size."""
    here = local.select("name", F.col("size").alias("_size"))
    return remote.join(here, "name", "left").where(~F.col("size").eqNullSafe(F.col("_size"))).select("name", "size")


def payload(members: DataFrame) -> DataFrame:
    """(kind, dst): the files to ship for members with a split, each destination once: structures for all,
    trajectories for all but the test split."""
    files = F.array(F.struct(F.lit("topology").alias("kind"), F.col("path").alias("dst")), F.when(F.col("is_trajectory") & (F.col("split") != "test"), F.struct(F.lit("trajectory").alias("kind"), F.concat("path", F.lit(".xtc")).alias("dst"))))
    return members.select(F.explode(F.array_compact(files)).alias("f")).select("f.*").distinct()


def resolve(replaced: DataFrame) -> DataFrame:
    """(old, leaf) of replacements (old, new), each old once: the id at the end of its chain. Chains are
    halved in every round, so the rounds grow with the logarithm of the longest. A cycle has no end: its
    ids are left out, as are those that lead into it."""
    now = keep(replaced.select("old", "new"))
    left = now.count()
    for _ in range(64):
        onward = now.select(F.col("old").alias("new"), F.col("new").alias("_next"))
        after = keep(now.join(onward, "new", "left").select("old", F.coalesce("_next", "new").alias("new"), F.col("_next").isNotNull().alias("moved")))
        moved = after.where("moved").count()
        forget(now)
        now = after.select("old", "new")
        if not moved or not left:
            break
    ends = replaced.select(F.col("old").alias("new")).distinct()
    return now.join(ends, "new", "left_anti").select("old", F.col("new").alias("leaf"))


def batches(requests: DataFrame, key: str, order: str, size: int, first: int) -> DataFrame:
    """(order, number, batch, last) of each request: equal keys share a number, from `first` in order of first
    appearance, and numbers are cut into batches; last is the key's last request."""
    once = requests.groupBy(key).agg(F.min(order).alias("_first"), F.max(order).alias("last"))
    numbered = ranked(once, [], ["_first", key], "_place")
    return requests.join(numbered, key).select(order, (F.col("_place") - 1 + first).alias("number"), F.floor((F.col("_place") - 1) / size).alias("batch"), "last")


def mixture(draws: DataFrame, draw: str, items: DataFrame, source: str, order: list[str], shares: dict[str, float], seed: int) -> DataFrame:
    """(draw, source, item columns): a source for each draw by a hash against cumulated shares; a source's
    draws, in order, take its items in order and start again when they are used up."""
    u = unit_hash(F.lit(seed), F.col(draw), sep="|")
    upto, pick, last = 0.0, None, list(shares)[-1]
    for name, share in list(shares.items())[:-1]:
        upto += share
        pick = F.when(u < upto, name) if pick is None else pick.when(u < upto, name)
    chosen = draws.select(draw, (pick.otherwise(last) if pick is not None else F.lit(last)).alias(source))
    own = ranked(chosen, [source], [draw], "_k")
    pool = ranked(items, [source], order, "_i")
    sizes = items.groupBy(source).agg(F.count("*").alias("_size"))
    placed = own.join(small(sizes, len(shares)), source).withColumn("_i", (F.col("_k") - 1) % F.col("_size") + 1)
    return placed.join(pool, [source, "_i"]).select(draw, source, *[c for c in items.columns if c != source and c != "h"])


def match_names(rows: DataFrame, reference: DataFrame, group: str) -> DataFrame:
    """rows (group, key, ...) whose key the reference (key, at) has, numbered by group in the reference's order.
    A key that the reference, or a group, has more than once matches nothing."""
    once = reference.groupBy("key").agg(F.min("at").alias("_at"), F.count("*").alias("_n")).where("_n = 1").select("key", "_at")
    single = rows.groupBy(group, "key").agg(F.count("*").alias("_n")).where("_n = 1").select(group, "key")
    own = rows.join(once, "key").join(single, [group, "key"])
    return own.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_at")).cast("long")).drop("_at")  # a structure's atoms


def verify(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(name, problem) of what is listed (name, digest) against what is there: missing, corrupt or not listed."""
    both = listed.select("name", F.col("digest").alias("_want")).join(found.select("name", F.col("digest").alias("_have")), "name", "full_outer")
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "not listed").when(F.col("_want") != F.col("_have"), "corrupt")
    return both.select("name", problem.alias("problem")).where("problem is not null")
