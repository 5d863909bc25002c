"""Families as folders of files, structure files that may be indexed by residue number, and reports on domains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks import keep
from .ensembles import turned

#: A replica's number at the end of a file's stem, or its last one anywhere.
REPLICA, REPLICA_ANYWHERE = r"_R(\d+)(?:_fit)?$", r".*_R(\d+)"


def replica_id(stem: Column) -> Column:
    number = lambda pattern: F.nullif(F.regexp_extract(stem, pattern, 1), F.lit(""))
    found = F.coalesce(number(REPLICA), number(REPLICA_ANYWHERE))
    return F.when(found.isNotNull(), F.concat(F.lit("R"), found)).otherwise(stem)


def family_dirs(files: DataFrame) -> DataFrame:
    """(family_id, layout, member_id, path, topology, error) of files (path), relative to a store's root: what each folder
    directly under it holds.

    Any .xtc below a folder makes it a trajectory family; else a .pdb directly in it a static one; else a .pdb in its
    `protein` or `analysis` a trajectory family whose trajectories are missing; else it is left out. A
    static family has a member per .pdb directly in it. A trajectory family has its replicas from
    `protein`, of two files of one replica the one that ends in _fit, then the lesser name, and a member
    `ref`, the structure named as the folder, else the least; without a structure or replicas in
    `protein` it is one row that says so, as `analysis` is sampled differently and never used.

    A file's role decides what its folder is, so files are reduced to one row a role and member, which is kept: paths are
    read and taken apart once, and the families' facts and their rows both come from those. Paths listed twice count once."""
    parts = F.split("path", "/")
    own = files.select("path", parts.alias("p")).where(F.size("p") > 1).select(
        "path", F.element_at("p", 1).alias("family_id"), F.element_at("p", -1).alias("name"), F.when(F.size("p") == 2, "").when(F.size("p") == 3, F.element_at("p", 2)).alias("folder"))
    xtc, pdb, folder = F.col("name").endswith(".xtc"), F.col("name").endswith(".pdb"), F.coalesce("folder", F.lit("-"))
    own = own.withColumn("role", F.when(xtc, F.when(folder == "protein", "replica").otherwise("moves")).when(pdb, F.when(folder == "", "static").when(folder == "protein", "structure").when(folder == "analysis", "below"))).where("role is not null")
    role, stem = F.col("role"), F.expr("left(name, char_length(name) - 4)")  # both kinds end in four characters
    key = F.when(role == "static", F.col("path")).when(role == "replica", replica_id(stem))
    second = F.when(role == "replica", ~F.col("name").endswith("_fit.xtc")).when(role == "structure", stem != F.col("family_id")).otherwise(False)
    rows = keep(own.select("family_id", "role", key.alias("key"), second.alias("second"), "path").groupBy("family_id", "role", "key").agg(F.min(F.struct("second", "path")).alias("b")).select("family_id", "role", "key", "b.path"))
    has = lambda *roles: F.max(role.isin(*roles))
    seen = rows.groupBy("family_id").agg(has("replica", "moves").alias("moves"), has("static").alias("top"), has("structure", "below").alias("below"), has("replica").alias("replicas"), F.min(F.when(role == "structure", F.col("path"))).alias("topology"))
    seen = seen.select(
        "family_id", F.when(F.col("moves") | (~F.col("top") & F.col("below")), "trajectory").when(F.col("top"), "static").alias("layout"), "topology",
        F.when(F.col("topology").isNull(), "no protein structure").when(~F.col("replicas"), "no replica trajectories").alias("error"))
    nothing = F.lit(None).cast("string")
    members = rows.where(role.isin("static", "replica")).join(seen, "family_id").where(((role == "static") & (F.col("layout") == "static")) | ((role == "replica") & (F.col("layout") == "trajectory") & F.col("error").isNull()))
    top = F.regexp_extract("path", r"([^/]*)\....$", 1)
    found = members.select("family_id", "layout", F.when(role == "static", top).otherwise(F.col("key")).alias("member_id"), "path", F.when(role == "replica", F.col("topology")).alias("topology"), nothing.alias("error"))
    good = F.col("error").isNull()
    return found.union(seen.where("layout = 'trajectory'").select("family_id", "layout", F.when(good, "ref"), F.when(good, F.col("topology")), nothing, "error"))


def indexable_check(atoms: DataFrame) -> DataFrame:
    """(file, violation): null for a file whose residues may be placed by number, else its first fault, of atoms (file, line_no,
    model, hetero, altloc, chain, resseq, icode): several models, no polymer, several chains, hetero
    residues, insertion codes, alternate locations, a residue number in two blocks, or numbers other than 1 to N.

    Blocks of equal residues follow from one ordering of a file's lines; the rest are aggregates of a file."""
    own = atoms.select("file", "line_no", "model", "hetero", F.coalesce("altloc", F.lit("")).alias("altloc"), F.coalesce("chain", F.lit("")).alias("chain"), "resseq", F.coalesce("icode", F.lit("")).alias("icode"))
    by = Window.partitionBy("file").orderBy("line_no")
    residue = F.struct("model", "hetero", "chain", "resseq", "icode")
    blocks = own.withColumn("r", residue).withColumn("new", (~F.col("r").eqNullSafe(F.lag("r").over(by))).cast("int")).withColumn("block", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.groupBy("file", "block").agg(F.first("hetero").alias("hetero"), F.first("chain").alias("chain"), F.first("resseq").alias("resseq"), F.first("icode").alias("icode"), F.first("model").alias("model"), F.count_distinct(F.when(F.col("altloc") != "", F.col("altloc"))).alias("altlocs"))
    polymer = ~F.col("hetero")
    placed = blocks.withColumn("place", F.sum(polymer.cast("int")).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    many = lambda c: F.max(F.when(polymer, c.cast("int")))
    facts = placed.groupBy("file").agg(
        F.count_distinct(F.coalesce("model", F.lit(0))).alias("models"), F.sum(polymer.cast("long")).alias("residues"), F.count_distinct(F.when(polymer, F.col("chain"))).alias("chains"), F.sum(F.col("hetero").cast("long")).alias("hetero"),
        many(F.col("icode") != "").alias("icodes"), many(F.col("altlocs") > 1).alias("altlocs"), F.count_distinct(F.when(polymer, F.col("resseq"))).alias("numbers"),
        F.min(F.when(polymer & ~F.col("resseq").eqNullSafe(F.col("place")), F.col("place"))).alias("off"),
    )
    fault = (
        F.when(F.col("models") > 1, "models").when(F.col("residues") == 0, "no polymer").when(F.col("chains") > 1, "chains").when(F.col("hetero") > 0, "hetero").when(F.col("icodes") > 0, "insertion codes")
        .when(F.col("altlocs") > 0, "alternate locations").when(F.col("numbers") < F.col("residues"), "repeated number").when(F.col("off").isNotNull(), "numbering")
    )
    return facts.select("file", fault.alias("violation"))


def atom_select(atoms: DataFrame, selection: str) -> DataFrame:
    """Atoms (atom, element, ...) of a selection: ca, heavy or all. A hydrogen is known by its element, or where that
    is missing by its name's first letter after leading digits. A selection that leaves a file (file) without atoms
    is an error by atom_faults()."""
    if selection not in ("ca", "heavy", "all"):
        raise ValueError(f"unknown atom selection {selection!r}: ca, heavy or all")
    return atoms.where({"ca": F.col("atom") == "CA", "heavy": hydrogen() == F.lit(False), "all": F.lit(True)}[selection])


def hydrogen() -> Column:
    element = F.nullif(F.upper(F.trim("element")), F.lit(""))
    return F.coalesce(element, F.upper(F.substring(F.regexp_replace("atom", "^[0-9]+", ""), 1, 1))) == "H"


def atom_faults(atoms: DataFrame, selection: str) -> DataFrame:
    """(file, atoms): files in which a selection finds nothing, and how many atoms they have."""
    return atoms.groupBy("file").agg(F.count("*").alias("atoms")).join(atom_select(atoms, selection).select("file").distinct(), "file", "left_anti")


def domain_rmsf(frames: DataFrame, fit: list[int]) -> DataFrame:
    """(ensemble_id, res_idx, rmsf) about the mean of rows (ensemble_id, frame_idx, v), each frame turned onto its ensemble's
    first by the points of `fit`."""
    first = frames.groupBy("ensemble_id").agg(F.min_by("v", "frame_idx").alias("onto"))

    def moved(batches):
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy().reshape(len(batch), -1, 3) for c in ("v", "onto"))
            out, _ = turned(x, y, np.asarray(fit))
            cuts = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * x.shape[1] * 3) if len(batch) else pa.array([0], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("ensemble_id"), batch.column("frame_idx"), pa.ListArray.from_arrays(cuts, pa.array(out.ravel()))], names=["ensemble_id", "frame_idx", "v"])

    kind = frames.schema
    own = frames.join(first, "ensemble_id").select("ensemble_id", "frame_idx", "v", "onto").mapInArrow(moved, f"ensemble_id {kind['ensemble_id'].dataType.simpleString()}, frame_idx {kind['frame_idx'].dataType.simpleString()}, v array<double>")
    return own


def _spread(rows: DataFrame) -> DataFrame:
    points = rows.select("ensemble_id", F.posexplode("v").alias("c", "x")).groupBy("ensemble_id", "c").agg(F.var_pop("x").alias("s"))
    return points.groupBy("ensemble_id", F.floor(F.col("c") / 3).cast("int").alias("res_idx")).agg(F.sqrt(F.sum("s")).alias("rmsf"))


def flexibility_report(frames: DataFrame, one: list[int], two: list[int], linker: list[int]) -> DataFrame:
    """(ensemble_id, metric, value) of rows (ensemble_id, frame_idx, v): how rigid two domains are, and how they move.

    Within: mean and largest fluctuation of each domain's points, fitted on that domain (the linker's on the first).
    Between: the distance of the domains' centres, and the angle of their longest axes, over frames: mean, deviation,
    least and largest; the second domain's fluctuation with the first held. Geometry: neighbours' distances."""
    frames = keep(frames.select("ensemble_id", "frame_idx", "v"))
    on_one, on_two = keep(domain_rmsf(frames, one)), domain_rmsf(frames, two)
    s1, s2 = keep(_spread(on_one)), _spread(on_two)
    out: list[DataFrame] = []

    def emit(df: DataFrame, **metrics: Column) -> None:
        out.append(df.select("ensemble_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()])).alias("m")).select("ensemble_id", "m.metric", "m.value"))

    for name, table, points in (("domain1", s1, one), ("domain2", s2, two), ("linker", s1, linker)):
        own = table.where(F.col("res_idx").isin(points)).groupBy("ensemble_id").agg(F.avg("rmsf").alias("a"), F.max("rmsf").alias("m"))
        emit(own, **{f"{name}_mean_rmsf": F.col("a"), f"{name}_max_rmsf": F.col("m")})
    emit(s1.where(F.col("res_idx").isin(two)).groupBy("ensemble_id").agg(F.avg("rmsf").alias("a")), domain2_rmsf_about_domain1=F.col("a"))

    def between(batches):
        """Each frame's distance of centres and angle of axes."""
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(len(batch), -1, 3)
            a, b = x[:, one], x[:, two]
            apart = np.sqrt(((a.mean(1) - b.mean(1)) ** 2).sum(1))
            axis = lambda p: np.linalg.eigh(np.einsum("fai,faj->fij", p - p.mean(1, keepdims=True), p - p.mean(1, keepdims=True)))[1][:, :, -1]
            angle = np.degrees(np.arccos(np.clip(np.abs((axis(a) * axis(b)).sum(1)), 0, 1)))
            yield pa.RecordBatch.from_arrays([batch.column("ensemble_id"), pa.array(apart), pa.array(angle)], names=["ensemble_id", "apart", "angle"])

    e = frames.schema["ensemble_id"].dataType.simpleString()
    each = frames.mapInArrow(between, f"ensemble_id {e}, apart double, angle double")  # neither depends on where a frame lies
    stats = each.groupBy("ensemble_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("apart", "angle") for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))])
    emit(stats, **{c: F.col(c) for c in stats.columns if c != "ensemble_id"}, apart_relative_width=F.col("apart_sd") / F.col("apart_mean"))
    bonds = frames.select("ensemble_id", F.explode(F.transform(F.sequence(F.lit(0), (F.size("v") / 3).cast("int") - 2), lambda i: F.sqrt(sum(((F.get("v", 3 * i + k) - F.get("v", 3 * i + 3 + k)) ** 2 for k in (1, 2)), (F.get("v", 3 * i) - F.get("v", 3 * i + 3)) ** 2)))).alias("b"))
    g = bonds.groupBy("ensemble_id").agg(F.avg("b").alias("a"), F.min("b").alias("lo"), F.max("b").alias("hi"), F.avg(((F.col("b") > 4.5) | (F.col("b") < 3.0)).cast("double")).alias("off"))
    emit(g, bond_mean=F.col("a"), bond_min=F.col("lo"), bond_max=F.col("hi"), bonds_outside_percent=100 * F.col("off"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def id_filters(families: DataFrame, excluded: DataFrame | None, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(kept, report): families (family_id) less those on the exclude list, then only those on the allow list (id); an id matches
    whole or by the part before its last `_`, whatever the case. report is (step, before, matched, kept, warning),
    a row a list. A list that leaves nothing is an error; an allow list that drops half or more is warned of."""
    kept, rows = families.select("family_id").distinct(), []
    for step, listed in (("exclude", excluded), ("allow", allowed)):
        if listed is None:
            continue
        names = listed.select(F.lower(F.trim("id")).alias("_id")).where("_id <> ''").distinct()
        full, entry = F.lower("family_id"), F.lower(F.regexp_replace("family_id", "_[^_]*$", ""))
        hit = kept.select("family_id", F.explode(F.array_distinct(F.array(full, entry))).alias("_id")).join(names, "_id", "left_semi").select("family_id").distinct()
        after = keep(kept.join(hit, "family_id", "left_anti" if step == "exclude" else "left_semi"))
        before, left = kept.count(), after.count()
        if before and not left:
            raise ValueError(f"the {step} list leaves none of {before} families")
        warning = "drops half or more" if step == "allow" and before and 2 * (before - left) >= before else None
        rows.append((step, before, before - left if step == "exclude" else left, left, warning))
        kept = after
    return kept, families.sparkSession.createDataFrame(rows, "step string, before long, matched long, kept long, warning string")
