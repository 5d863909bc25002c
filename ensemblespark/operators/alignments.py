"""Agreement of aligned rows, and pairing of rows across chains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sinks import keep

#: Rows of a chain that one task compares at a time.
PART = 2_000
GAP = ord("-")
#: Letters that are counted at a time, and the bits of a letter in a cell (its place, then its code point).
LETTERS, CODE = 4_000_000, 21


def _letters(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def agreement(rows: DataFrame, centers: DataFrame, gaps: bool = True) -> DataFrame:
    """(chain, row_idx, center, agreement, size): for each row the center of its chain that has the same
    letter in most places, the least row_idx of several, and that center's length. Whole texts of any
    length are compared, place by place. centers are few per chain; rows are dealt out in parts.
    A chain without centers gives no rows; null chains are left out."""
    parts = rows.groupBy("chain").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = rows.join(parts, "chain").select("chain", "row_idx", "seq", F.pmod(F.xxhash64("row_idx"), F.col("parts")).alias("part"))
    shown = centers.join(parts, "chain").select(F.col("chain").alias("c_chain"), F.col("row_idx").alias("c_row"), F.col("seq").alias("c_seq"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("c_part"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        own = sorted(((r["c_row"], _letters(r["c_seq"])) for r in right.select(["c_row", "c_seq"]).to_pylist()), key=lambda r: r[0])
        out: dict[str, list] = {"chain": [], "row_idx": [], "center": [], "agreement": [], "size": []}
        for chain, row_idx, seq in zip(*(left.column(c).to_pylist() for c in ("chain", "row_idx", "seq")), strict=True) if own else ():
            x = _letters(seq)
            best = (-1, 0, 0)
            for place, y in own:
                n = min(len(x), len(y))
                same = x[:n] == y[:n]
                k = int((same if gaps else same & (x[:n] != GAP)).sum())
                if k > best[0]:
                    best = (k, place, len(y))
            for c, v in zip(out, (chain, row_idx, best[1], best[0], best[2]), strict=True):
                out[c].append(v)
        return pa.table({"chain": pa.array(out["chain"], pa.string()), "row_idx": pa.array(out["row_idx"], pa.int32()), "center": pa.array(out["center"], pa.int32()), "agreement": pa.array(out["agreement"], pa.int64()), "size": pa.array(out["size"], pa.int64())})

    return dealt.groupBy("chain", "part").cogroup(shown.groupBy("c_chain", "c_part")).applyInArrow(nearest, "chain string, row_idx int, center int, agreement long, size long")


def pair_by_species(msa: DataFrame, most: int = 600) -> DataFrame:
    """(species, rank, chain, row_idx): rows of several chains paired by species. Within a chain and
    species, rows are ranked by their similarity to the chain's row 0 (share of equal places), then
    row_idx; a pair is a rank that all the species' chains have. A species of one chain, or with more
    than `most` rows in one, has no pairs, so no group that is ranked has more rows than that."""
    counts = msa.where("species <> ''").groupBy("chain", "species").agg(F.count("*").alias("n"))
    taken = counts.groupBy("species").agg(F.min("n").alias("take"), F.max("n").alias("top"), F.count("*").alias("chains")).where(f"chains > 1 and top <= {most}").select("species", "take")
    rows = msa.join(taken, "species")
    alike = agreement(rows, msa.where("row_idx = 0")).select("chain", "row_idx", (F.col("agreement") / F.greatest(F.lit(1), "size")).alias("sim"))
    by = Window.partitionBy("chain", "species").orderBy(F.col("sim").desc(), "row_idx")
    ranked = rows.drop("seq").join(alike, ["chain", "row_idx"]).select("species", "chain", "row_idx", "take", F.row_number().over(by).cast("long").alias("rank"))
    return ranked.where("rank <= take").select("species", "rank", "chain", "row_idx")


def cluster_profile(msa: DataFrame, assigned: DataFrame) -> DataFrame:
    """(chain, center, col, letter, share, members): how many of a center's members, itself included, have a letter at
    a place; a member that is too short counts as having none.

    A task counts the letters of a center's members among 2 * PART consecutive rows, LETTERS at a time; what is shuffled and
    summed up by cell are counts, fewer the more members share a cell."""
    assigned = keep(assigned.select("chain", "row_idx", "center"))
    members = assigned.groupBy("chain", "center").agg(F.count("*").alias("members"))
    rows = msa.where("seq <> ''").select("chain", "row_idx", "seq").join(assigned, ["chain", "row_idx"])
    types = rows.schema["chain"].dataType.simpleString(), rows.schema["center"].dataType.simpleString()

    def counted(table: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[np.ndarray] = []
        size = 0

        def count() -> None:
            nonlocal size
            found.append(np.unique(np.concatenate(held), return_counts=True))
            held.clear()
            size = 0

        for seq in table.column("seq"):
            letters = _letters(seq.as_py())
            for start in range(0, len(letters), LETTERS):
                x = letters[start : start + LETTERS].astype(np.int64)
                x += np.arange(start, start + len(x), dtype=np.int64) << CODE
                held.append(x)
                size += len(x)
                if size >= LETTERS:
                    count()
        if held:
            count()
        n = sum(len(cells) for cells, _ in found)
        same = {c: pa.repeat(table.column(c)[0], n) for c in ("chain", "center")}
        return pa.table(same | {"cell": np.concatenate([cells for cells, _ in found]), "k": np.concatenate([k for _, k in found]).astype(np.int64)})

    part = F.floor(F.col("row_idx") / (2 * PART)).alias("part")
    parts = rows.groupBy("chain", "center", part).applyInArrow(counted, f"chain {types[0]}, center {types[1]}, cell long, k long")
    counts = parts.groupBy("chain", "center", "cell").agg(F.sum("k").alias("k"))
    letter = F.decode(F.unhex(F.lpad(F.hex(F.col("cell").bitwiseAND((1 << CODE) - 1)), 8, "0")), "UTF-32")
    return counts.join(members, ["chain", "center"]).select("chain", "center", F.shiftright("cell", CODE).cast("int").alias("col"), letter.alias("letter"), (F.col("k") / F.col("members")).alias("share"), "members")


def crop_sizes(msa: DataFrame, paired: DataFrame, size: int) -> DataFrame:
    """(chain, paired, unpaired): rows kept of each chain for an alignment of `size` rows: up to half of them
    paired, by species and rank, and of all rows as many as the paired ones that aren't all gaps leave."""
    top = paired.withColumn("_p", F.row_number().over(Window.partitionBy("chain").orderBy("species", "rank"))).where(F.col("_p") <= size // 2)  # a chain's paired rows: at most 600 a species
    k = top.join(msa.select("chain", "row_idx", "seq"), ["chain", "row_idx"]).groupBy("chain").agg(F.count("*").alias("paired"), F.count(F.when(F.col("seq").rlike("[^-]"), 1)).alias("_full"))
    own = msa.groupBy("chain").agg(F.count("*").alias("_n")).join(k, "chain", "left")
    return own.select("chain", F.coalesce("paired", F.lit(0)).alias("paired"), F.least("_n", F.greatest(size - F.coalesce("_full", F.lit(0)), F.lit(0))).alias("unpaired"))
