"""Identity of a checkpoint from the metadata that it carries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that declare an identity, keys that only hint at one, tasks that are allowed, levels below the first.
DECLARING = ["weight_family", "model_name", "checkpoint_name", "model_family"]
HINTING = ["name", "family", "tasks", "task_mode", "train_tasks"]
TASKS = ["forward", "iid"]
DEPTH = 4


def identity_strings(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """(id, path, value): strings, and the items of lists, under the listed keys (any case) of a VARIANT object, down to DEPTH
    levels of objects below it. path orders them depth first, an object's keys by name."""
    found, level = [], rows.select("id", F.lit("").alias("at"), F.col(node).alias("v"))
    for _ in range(DEPTH + 1):
        # Only objects are opened; an explode of anything else has other keys.
        objects = level.where(F.schema_of_variant("v").startswith("OBJECT"))
        level = objects.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer())).select("id", F.concat("at", F.lit("/"), "key").alias("at"), "key", F.col("value").alias("v"))
        listed = level.where(F.lower("key").isin(keys))
        kind = F.schema_of_variant("v")
        one = listed.where(kind == "STRING").select("id", "at", F.lit(-1).alias("i"), F.try_variant_get("v", "$", "string").alias("value"))
        items = listed.where(kind.startswith("ARRAY")).select("id", "at", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "x")).select("id", "at", "i", F.try_variant_get("x", "$", "string").alias("value"))
        found += [one, items]
        level = level.select("id", "at", "v")
    return reduce(DataFrame.unionByName, found).where("value is not null").select("id", F.struct("at", "i").alias("path"), "value")


def provenance(rows: DataFrame, base: str, other: str = "interp") -> DataFrame:
    """(id, tag, declared) of rows (id, json): base, foreign, interp or unverified, `malformed` if the text isn't an object,
    or `tasks` if it lists tasks that aren't allowed.

    The first key of DECLARING at the top with a string that isn't blank decides; then the first such string under any
    of them in `metadata`, then in `model_cfg`. Nothing declared: interp if a hinting key anywhere mentions
    `other`, else unverified. A declared name is interp if it mentions `other`, base if it matches `base`
    (a pattern, both without regard to case), else foreign."""
    parsed = rows.select("id", F.try_parse_json("json").alias("v"))
    parsed = parsed.withColumn("ok", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    good = parsed.where("ok")
    string: Column = lambda path: F.trim(F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.try_variant_get("v", path, "string")))
    filled = lambda c: F.when(c != "", c)
    top = good.select("id", "v", F.coalesce(*[filled(string(f"$.{k}")) for k in DECLARING]).alias("top"), F.try_variant_get("v", "$.tasks", "array<string>").alias("tasks"))
    below = []
    for rank, name in enumerate(("metadata", "model_cfg")):
        inner = good.select("id", F.try_variant_get("v", f"$.{name}", "variant").alias("v")).where("v is not null")
        below.append(identity_strings(inner, "v", DECLARING).where(F.trim("value") != "").select("id", F.lit(rank).alias("rank"), "path", F.trim("value").alias("value")))
    nested = below[0].union(below[1]).groupBy("id").agg(F.min(F.struct("rank", "path", "value")).alias("b")).select("id", F.col("b.value").alias("nested"))
    hints = identity_strings(good.select("id", "v"), "v", HINTING).where(F.lower("value").contains(other)).select("id").distinct().withColumn("hint", F.lit(True))
    out = parsed.select("id", "ok").join(top.drop("v"), "id", "left").join(nested, "id", "left").join(hints, "id", "left")
    declared = F.coalesce("top", "nested")
    illegal = F.size(F.array_except("tasks", F.array(*map(F.lit, TASKS)))) > 0
    tag = (
        F.when(~F.col("ok"), "malformed").when(F.coalesce(illegal, F.lit(False)), "tasks").when(declared.isNull(), F.when(F.col("hint"), "interp").otherwise("unverified"))
        .when(F.lower(declared).contains(other), "interp").when(F.lower(declared).rlike(base), "base").otherwise("foreign")
    )
    return out.select("id", tag.alias("tag"), declared.alias("declared"))
