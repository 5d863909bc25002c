"""Statistics of ensembles of frames and between two of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import ranked as places


def rmsf(frames: DataFrame) -> DataFrame:
    """Fluctuation of each point about its own mean."""
    return frames.groupBy("ensemble_id", "res_idx").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"))


def gyration(frames: DataFrame) -> DataFrame:
    return frames.groupBy("ensemble_id", "frame_idx").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rg"))


def covariance(frames: DataFrame) -> DataFrame:
    """Mean and population covariance of each point."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return frames.groupBy("ensemble_id", "res_idx").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])


def moments(frames: DataFrame) -> DataFrame:
    """(ensemble_id, n, p, q, sp, sq, spq): over an ensemble's frames the sums of every two coordinates
    p <= q (3 * place of the point + axis) and of their products. Each task sums its own frames by
    matrix products; what is shuffled is a matrix per task and ensemble, whatever the frames."""
    own = packed(frames).select("ensemble_id", F.flatten(F.transform("p", lambda r: F.array(r["x"], r["y"], r["z"]))).alias("v"))

    def summed(batches):
        held: dict = {}
        for batch in batches:
            key = batch.column("ensemble_id").to_numpy(zero_copy_only=False)
            for e in np.unique(key):
                rows = batch.column("v").take(pa.array(np.flatnonzero(key == e)))
                x = rows.flatten().to_numpy().reshape(len(rows), -1)
                n, s, g = held.get(e, (0, 0.0, 0.0))
                held[e] = (n + len(x), s + x.sum(0), g + x.T @ x)
        for e, (n, s, g) in held.items():
            p, q = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), e)), pa.array(np.full(len(p), n)), pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(s[p]), pa.array(s[q]), pa.array(g[p, q])], names=["ensemble_id", "n", "p", "q", "sp", "sq", "spq"])

    kind = own.schema["ensemble_id"].dataType.simpleString()
    parts = own.mapInArrow(summed, f"ensemble_id {kind}, n long, p int, q int, sp double, sq double, spq double")
    return parts.groupBy("ensemble_id", "p", "q").agg(*[F.sum(c).alias(c) for c in ("n", "sp", "sq", "spq")])


def effective_dim(frames: DataFrame) -> DataFrame:
    """(ensemble_id, dim): squared sum over sum of squares of the spectrum of an ensemble's covariance
    over all coordinates, as squared trace over squared norm; null if nothing varies."""
    return spectrum_dim(moments(frames))


def spectrum_dim(moments: DataFrame) -> DataFrame:
    """effective_dim() from the sums of moments()."""
    c = moments.select("ensemble_id", "p", "q", (F.col("spq") / F.col("n") - F.col("sp") * F.col("sq") / F.col("n") ** 2).alias("c"))
    own = F.col("p") == F.col("q")
    norm = F.sum(F.col("c") ** 2 * F.when(own, 1.0).otherwise(2.0))
    return c.groupBy("ensemble_id").agg((F.sum(F.when(own, F.col("c"))) ** 2 / F.nullif(norm, F.lit(0.0))).alias("dim"))


def validity(bond: Column, clash: Column, ref_bond: Column, ref_clash: Column) -> Column:
    """void from a quarter of broken bonds on; flagged from the larger of 5 % and ten times the
    reference's share on, or from 1 % more clashes than the reference on; else ok."""
    flagged = (bond >= F.greatest(F.lit(0.05), 10 * F.coalesce(ref_bond, F.lit(0.0)))) | (clash - F.coalesce(ref_clash, F.lit(0.0)) >= 0.01)
    return F.when(bond >= 0.25, "void").when(flagged, "flagged").otherwise("ok")


def packed(frames: DataFrame) -> DataFrame:
    """One row per frame with its points as an array in order."""
    return frames.groupBy("ensemble_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("res_idx", "x", "y", "z"))).alias("p"))


def pair_distances(frames: DataFrame, sep: int) -> DataFrame:
    """(ensemble_id, frame_idx, i, j, d) for points at least `sep` apart along the chain. Pairs
    are made inside each frame's own row, so nothing is joined or shuffled beyond the packing."""
    a = packed(frames).select("ensemble_id", "frame_idx", "p", F.explode("p").alias("a"))
    b = a.select("ensemble_id", "frame_idx", "a", F.explode(F.filter("p", lambda x: x["res_idx"] >= F.col("a.res_idx") + sep)).alias("b"))
    d = F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "yz"), (F.col("a.x") - F.col("b.x")) ** 2))
    return b.select("ensemble_id", "frame_idx", F.col("a.res_idx").alias("i"), F.col("b.res_idx").alias("j"), d.alias("d"))


def contact_probability(frames: DataFrame, limit: float = 8.0, sep: int = 3) -> DataFrame:
    return pair_distances(frames, sep).groupBy("ensemble_id", "i", "j").agg(F.avg((F.col("d") < limit).cast("double")).alias("p"))


def distance_variance(frames: DataFrame, sep: int = 1) -> DataFrame:
    return pair_distances(frames, sep).groupBy("ensemble_id", "i", "j").agg(F.var_pop("d").alias("v"))


def contact_jaccard(a: DataFrame, b: DataFrame, native: DataFrame) -> DataFrame:
    """(ensemble_id, weak, transient): Jaccard of contacts lost (native, p < 0.9) and gained (not native,
    p > 0.1) between one table of contact probabilities and those of b's ensembles; null if neither has any."""
    own = a.select("i", "j", F.col("p").alias("pa")).join(b.select("ensemble_id", "i", "j", F.col("p").alias("pb")), ["i", "j"]).join(native.select("i", "j", "native"), ["i", "j"])

    def jaccard(x: Column, y: Column) -> Column:
        return F.sum((x & y).cast("long")) / F.nullif(F.sum((x | y).cast("long")), F.lit(0))

    weak = [F.col("native") & (F.col(c) < 0.9) for c in ("pa", "pb")]
    new = [~F.col("native") & (F.col(c) > 0.1) for c in ("pa", "pb")]
    return own.groupBy("ensemble_id").agg(jaccard(*weak).alias("weak"), jaccard(*new).alias("transient"))


def bond_clash(frames: DataFrame, low: float = 3.5, high: float = 4.2, clash: float = 3.5, sep: int = 3) -> DataFrame:
    """Share of neighbours whose distance is out of [low, high], and of pairs `sep` apart closer than `clash`."""
    d = pair_distances(frames, 1)
    near = (F.col("j") == F.col("i") + 1)
    far = (F.col("j") >= F.col("i") + sep)
    return d.groupBy("ensemble_id").agg(
        F.avg(F.when(near, ((F.col("d") < low) | (F.col("d") > high)).cast("double"))).alias("bond"), F.avg(F.when(far, (F.col("d") < clash).cast("double"))).alias("clash")
    )


def _bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a value in [lo, hi], the right edge in the last one; null outside."""
    at = F.floor((value - lo) / ((hi - lo) / bins))
    at = F.when((at == bins) & (value <= hi), F.lit(bins - 1)).otherwise(at)
    return F.when((at >= 0) & (at < bins), at)


def js_hist(reference: DataFrame, sample: DataFrame, channel: str, value: str, bins: int = 50, pseudo: float = 1e-6) -> DataFrame:
    """(channel, js, inside): Jensen-Shannon distance (base e) of two samples over the reference's
    range, and the share of the sample inside it. A constant reference gets a range of one around it."""
    span = reference.groupBy(channel).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = F.col("hi") <= F.col("lo")
    span = span.select(channel, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    both = reference.select(channel, value, F.lit(1).alias("r"), F.lit(0).alias("g")).unionByName(sample.select(channel, value, F.lit(0).alias("r"), F.lit(1).alias("g")))
    placed = both.join(span, channel).select(channel, "r", "g", _bin(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin"))
    counts = placed.groupBy(channel, "bin").agg(F.sum("r").alias("r"), F.sum("g").alias("g"))
    sums = counts.groupBy(channel).agg(F.sum("g").alias("all_g"), F.sum(F.when(F.col("bin").isNotNull(), F.col("r"))).alias("in_r"), F.sum(F.when(F.col("bin").isNotNull(), F.col("g"))).alias("in_g"), F.count("bin").alias("k"))
    p, q = (F.col("r") + pseudo) / (F.col("in_r") + bins * pseudo), (F.col("g") + pseudo) / (F.col("in_g") + bins * pseudo)
    term = lambda a, b: a * F.log(2 * a / (a + b)) / 2
    seen = counts.where("bin is not null").join(sums, channel).groupBy(channel, "all_g", "in_r", "in_g", "k").agg(F.sum(term(p, q) + term(q, p)).alias("s"))
    empty_p, empty_q = pseudo / (F.col("in_r") + bins * pseudo), pseudo / (F.col("in_g") + bins * pseudo)
    rest = (bins - F.col("k")) * (term(empty_p, empty_q) + term(empty_q, empty_p))
    return seen.select(channel, F.sqrt(F.greatest(F.lit(0.0), F.col("s") + rest)).alias("js"), (F.col("in_g") / F.col("all_g")).alias("inside"))


def hist_overlap(a: DataFrame, b: DataFrame, channel: str, value: str, bins: int = 40) -> DataFrame:
    """(channel, overlap): intersection of two histograms over their common range."""
    both = a.select(channel, value, F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(b.select(channel, value, F.lit(0).alias("p"), F.lit(1).alias("q")))
    span = both.groupBy(channel).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    placed = both.join(span, channel).withColumn("bin", F.when(F.col("hi") > F.col("lo"), _bin(F.col(value), F.col("lo"), F.col("hi"), bins)).otherwise(F.lit(0)))
    counts = placed.groupBy(channel, "bin", "np", "nq").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return counts.groupBy(channel).agg(F.sum(F.least(F.col("p") / F.greatest("np", F.lit(1)), F.col("q") / F.greatest("nq", F.lit(1)))).alias("overlap"))


def js_against(reference: DataFrame, samples: DataFrame, by: str, keys: list[str], value: str, bins: int = 50, pseudo: float = 1e-6) -> DataFrame:
    """(by, keys, js, inside): js_hist() of many samples (by, keys, value) with one reference (keys, value). The reference is
    binned once, over its own range; only its counts meet the samples'."""
    span = reference.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("in_r"))
    flat = F.col("hi") <= F.col("lo")
    span = span.select(*keys, "in_r", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = _bin(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin")
    r = reference.join(span, keys).select(*keys, place).groupBy(*keys, "bin").agg(F.count("*").alias("r"))
    packed_ = r.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "r"))).alias("r"))  # at most `bins` entries
    g = samples.join(span.select(*keys, "lo", "hi"), keys).select(by, *keys, place).groupBy(by, *keys, "bin").agg(F.count("*").alias("g"))
    inside = F.sum(F.when(F.col("bin").isNotNull(), F.col("g")))
    own = g.groupBy(by, *keys).agg(F.sum("g").alias("all_g"), F.coalesce(inside, F.lit(0)).alias("in_g"), F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "g")))).alias("g"))
    both = own.join(packed_, keys).join(span.select(*keys, "in_r"), keys)
    share = lambda counts, total: lambda b: (F.coalesce(F.try_element_at(counts, b), F.lit(0)) + pseudo) / (total + bins * pseudo)
    p, q = share(F.col("r"), F.col("in_r")), share(F.col("g"), F.col("in_g"))
    term = lambda a, b: a * F.log(2 * a / (a + b)) / 2
    total = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda b: term(p(b), q(b)) + term(q(b), p(b))), F.lit(0.0), lambda s, x: s + x)
    return both.select(by, *keys, F.sqrt(F.greatest(F.lit(0.0), total)).alias("js"), (F.col("in_g") / F.col("all_g")).alias("inside"))


def overlap_against(reference: DataFrame, samples: DataFrame, by: str, keys: list[str], value: str, bins: int = 40) -> DataFrame:
    """(by, keys, overlap): hist_overlap() of many samples (by, keys, value) with one reference (keys, value), each over the
    range of both. The ranges of a key are one row; a reference row meets that row once and is placed in every
    range on the spot, so that no copy of it is shuffled."""
    own = samples.groupBy(by, *keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("nq"))
    ref = reference.groupBy(*keys).agg(F.min(value).alias("rlo"), F.max(value).alias("rhi"), F.count("*").alias("np"))
    span = own.join(ref, keys).select(by, *keys, F.least("lo", "rlo").alias("lo"), F.greatest("hi", "rhi").alias("hi"), "np", "nq")
    place = lambda v, lo, hi: F.when(hi > lo, _bin(v, lo, hi, bins)).otherwise(F.lit(0)).alias("bin")
    q = samples.join(span, [by, *keys]).select(by, *keys, place(F.col(value), F.col("lo"), F.col("hi"))).groupBy(by, *keys, "bin").agg(F.count("*").alias("q"))
    ranges = span.groupBy(*keys).agg(F.collect_list(F.struct(by, "lo", "hi")).alias("s"))  # one per sample
    p = reference.join(ranges, keys).select(*keys, F.explode(F.transform("s", lambda r: F.struct(r[by].alias(by), place(F.col(value), r["lo"], r["hi"])))).alias("x")).groupBy(F.col(f"x.{by}").alias(by), *keys, F.col("x.bin").alias("bin")).agg(F.count("*").alias("p"))
    both = p.join(q, [by, *keys, "bin"]).join(span.select(by, *keys, "np", "nq"), [by, *keys]).groupBy(by, *keys).agg(F.sum(F.least(F.col("p") / F.col("np"), F.col("q") / F.col("nq"))).alias("o"))
    return span.select(by, *keys).join(both, [by, *keys], "left").select(by, *keys, F.coalesce("o", F.lit(0.0)).alias("overlap"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, rho): rank correlation with mean ranks for ties; null if one side is constant."""
    by = by or []

    def ranked(df: DataFrame, c: str) -> DataFrame:
        mean = places(df.select(*by, c), by, [c], "_place").groupBy(*by, c).agg(F.avg("_place").alias(f"r_{c}"))
        return df.join(mean, [*by, c])

    both = ranked(ranked(rows.select(*by, x, y), x), y)
    return both.groupBy(*by).agg(F.when((F.stddev_pop(f"r_{x}") > 0) & (F.stddev_pop(f"r_{y}") > 0), F.corr(f"r_{x}", f"r_{y}")).alias("rho"))


#: Frames of a block of distances, and the most blocks of an ensemble: every frame goes to each of the other side's blocks, so
#: larger ensembles have larger blocks, which a task meets in strips of FRAMES.
FRAMES, BLOCKS = 256, 32


def flat(frames: DataFrame) -> DataFrame:
    """(ensemble_id, frame_idx, v): a row per frame, its coordinates in order (3 * point + axis)."""
    return packed(frames).select("ensemble_id", "frame_idx", F.flatten(F.transform("p", lambda r: F.array(r["x"], r["y"], r["z"]))).alias("v"))


def turned(x: np.ndarray, onto: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Frames x (f, a, 3) turned and moved onto `onto` (f or 1, a, 3) by least squares over the points in
    use, never mirrored; and the rotations."""
    use = np.arange(x.shape[1]) if use is None else use
    center, to = x[:, use].mean(1, keepdims=True), onto[:, use].mean(1, keepdims=True)
    u, _, vt = np.linalg.svd((x[:, use] - center).transpose(0, 2, 1) @ (onto[:, use] - to))
    flip = np.ones((len(x), 3))
    flip[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    turn = np.einsum("fji,fj,fkj->fik", vt, flip, u)
    return np.einsum("fij,faj->fai", turn, x - center) + to, turn


def superposed(rows: DataFrame, reference: list[float], fit: list[int] | None = None) -> DataFrame:
    """(ensemble_id, frame_idx, v, rmsd, det) of rows (ensemble_id, frame_idx, v): each frame turned and moved
    onto the reference by least squares over the points in `fit` (all by default), never mirrored; the
    distance left over all points; the determinant of the rotation. Frames are independent of each other."""
    target = np.asarray(reference, float).reshape(-1, 3)
    use = np.arange(len(target)) if fit is None else np.asarray(fit)

    def fitted(batches):
        for batch in batches:
            v = batch.column("v")
            y, turn = turned(v.flatten().to_numpy().reshape(len(v), -1, 3), target[None], use)
            rmsd = np.sqrt(((y - target) ** 2).sum(2).mean(1))
            cuts = pa.array(np.arange(0, y.size + 1, y.shape[1] * 3, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("ensemble_id"), batch.column("frame_idx"), pa.ListArray.from_arrays(cuts, pa.array(y.ravel())), pa.array(rmsd), pa.array(np.linalg.det(turn))], names=["ensemble_id", "frame_idx", "v", "rmsd", "det"])

    kind = rows.schema
    return rows.select("ensemble_id", "frame_idx", "v").mapInArrow(fitted, f"ensemble_id {kind['ensemble_id'].dataType.simpleString()}, frame_idx {kind['frame_idx'].dataType.simpleString()}, v array<double>, rmsd double, det double")


def frame_distances(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(ensemble_id, frame_idx, label, total, n): for each frame of left (ensemble_id, frame_idx, v, label) the
    sum of its root-mean-square distances to the frames of each label in its ensemble in right (left
    itself, if not given, its own distance of 0 included), and their number.

    Frames are cut into blocks, a pair of blocks is one matrix product in a task, and only sums leave it."""
    alone = right is None
    right = left if alone else right

    def sized(rows: DataFrame) -> DataFrame:
        return rows.groupBy("ensemble_id").agg(F.least(F.ceil(F.count("*") / FRAMES), F.lit(BLOCKS)).cast("int").alias("of"))

    def blocks(rows: DataFrame, side: int) -> DataFrame:
        own, other = ("b1", "b2") if side == 0 else ("b2", "b1")
        other_sizes = sized(right if side == 0 else left).withColumnRenamed("of", "_other")
        placed = rows.join(sized(rows), "ensemble_id").join(other_sizes, "ensemble_id").withColumn(own, F.pmod(F.xxhash64("frame_idx"), F.col("of")).cast("int"))
        return placed.select("ensemble_id", own, F.explode(F.sequence(F.lit(0), F.col("_other") - 1)).alias(other), F.lit(side).alias("side"), "frame_idx", F.col("label").cast("string").alias("label"), "v")

    kind = left.schema
    pairs = ["ensemble_id", "b1", "b2"]
    dealt = blocks(left, 0).unionByName(blocks(right, 1)).repartition(*pairs).sortWithinPartitions(*pairs)

    def summed(batches):
        held = None

        def settle(rows: pa.Table):
            side = rows.column("side").to_numpy()
            key = [rows.column(c).to_numpy(zero_copy_only=False) for c in pairs]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            v, frame, label = rows.column("v").combine_chunks(), rows.column("frame_idx").to_numpy(), np.array(rows.column("label").to_pylist(), object)
            for i, j in zip([0, *cut], [*cut, len(rows)], strict=True):
                a, b = i + np.flatnonzero(side[i:j] == 0), i + np.flatnonzero(side[i:j] == 1)
                if not len(a) or not len(b):
                    continue
                x, y = (v.take(pa.array(k)).flatten().to_numpy().reshape(len(k), -1) for k in (a, b))
                names = sorted(set(label[b].tolist()), key=str)
                of = np.array([names.index(n) for n in label[b]])
                yy = (y * y).sum(1)[None, :]
                for at in range(0, len(a), FRAMES):
                    part, f = x[at : at + FRAMES], frame[a[at : at + FRAMES]]
                    d = np.sqrt(np.maximum((part * part).sum(1)[:, None] + yy - 2 * part @ y.T, 0) / (x.shape[1] / 3))
                    if alone:
                        d[f[:, None] == frame[b][None, :]] = 0.0
                    for k, name in enumerate(names):
                        mine = of == k
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), key[0][i])), pa.array(f), pa.array([name] * len(f), pa.string()), pa.array(d[:, mine].sum(1)), pa.array(np.full(len(f), mine.sum()))], names=["ensemble_id", "frame_idx", "label", "total", "n"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key = [held.column(c).to_numpy(zero_copy_only=False) for c in pairs]
            before = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            if len(before):
                yield from settle(held.slice(0, before[-1] + 1))
                held = held.slice(before[-1] + 1).combine_chunks()
        if held is not None and len(held):
            yield from settle(held)

    e, f = (kind[c].dataType.simpleString() for c in ("ensemble_id", "frame_idx"))
    return dealt.mapInArrow(summed, f"ensemble_id {e}, frame_idx {f}, label string, total double, n long").groupBy("ensemble_id", "frame_idx", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def gaussian_w2(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ensemble_id, res_idx, translation, variance): distance of the Gaussians fitted to each point in two
    ensembles, given their means and covariances (covariance()); b has one row per point. A squared
    distance below 0 beyond rounding is null."""
    names = ["mx", "my", "mz", "cxx", "cxy", "cxz", "cyy", "cyz", "czz"]
    both = a.join(b.select("res_idx", *[F.col(n).alias(f"r_{n}") for n in names]), "res_idx")

    def distances(batches):
        for batch in batches:
            get = lambda n: batch.column(n).to_numpy()
            matrix = lambda p: np.stack([np.stack([get(p + n) for n in row], -1) for row in (("cxx", "cxy", "cxz"), ("cxy", "cyy", "cyz"), ("cxz", "cyz", "czz"))], -2)
            s1, s2 = matrix("r_"), matrix("")
            w, v = np.linalg.eigh(s1)
            root = (v * np.sqrt(np.clip(w, 0, None))[:, None, :]) @ v.transpose(0, 2, 1)
            inner = root @ s2 @ root
            own = np.sqrt(np.clip(np.linalg.eigvalsh((inner + inner.transpose(0, 2, 1)) / 2), 0, None)).sum(1)
            trace = np.trace(s1, axis1=1, axis2=2) + np.trace(s2, axis1=1, axis2=2)
            left = trace - 2 * own
            bad = left < -1e-8 * np.maximum(trace, 1.0)
            moved = np.sqrt(sum((get("r_" + m) - get(m)) ** 2 for m in ("mx", "my", "mz")))
            yield pa.RecordBatch.from_arrays([batch.column("ensemble_id"), batch.column("res_idx"), pa.array(moved), pa.array(np.sqrt(np.clip(left, 0, None)), mask=bad)], names=["ensemble_id", "res_idx", "translation", "variance"])

    e, r = (both.schema[c].dataType.simpleString() for c in ("ensemble_id", "res_idx"))
    return both.mapInArrow(distances, f"ensemble_id {e}, res_idx {r}, translation double, variance double")


def principal_axes(frames: DataFrame, k: int = 3) -> DataFrame:
    """(ensemble_id, axis, variance, direction): the first k principal axes of an ensemble's coordinates, from
    the sums of moments(); a task gets one ensemble's matrix, whatever the number of its frames. The
    largest entry of a direction is positive."""
    return axes_of(moments(frames), k)


def axes_of(m: DataFrame, k: int) -> DataFrame:
    """principal_axes() from the sums of moments()."""

    def axes(rows: pa.Table) -> pa.Table:
        p, q, n = (rows.column(c).to_numpy() for c in ("p", "q", "n"))
        c = np.zeros((p.max() + 1, p.max() + 1))
        c[p, q] = rows.column("spq").to_numpy() / n - rows.column("sp").to_numpy() * rows.column("sq").to_numpy() / n**2
        c = c + np.triu(c, 1).T
        w, v = np.linalg.eigh(c)
        w, v = w[::-1][:k], v[:, ::-1][:, :k]
        v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
        return pa.table({"ensemble_id": pa.array([rows.column("ensemble_id")[0].as_py()] * len(w), rows.schema.field("ensemble_id").type), "axis": pa.array(np.arange(len(w)), pa.int32()), "variance": pa.array(np.clip(w, 0, None)), "direction": pa.array(v.T.tolist(), pa.list_(pa.float64()))})

    return m.groupBy("ensemble_id").applyInArrow(axes, f"ensemble_id {m.schema['ensemble_id'].dataType.simpleString()}, axis int, variance double, direction array<double>")


def apply_rigid(points: DataFrame, moves: DataFrame) -> DataFrame:
    """Points (ensemble_id, frame_idx, res_idx, x, y, z) by their frame's rotation r (nine numbers by rows) and shift t."""
    own = points.join(moves, ["ensemble_id", "frame_idx"])
    at = lambda i: sum((F.get("r", F.lit(3 * i + k)) * F.col(c) for k, c in enumerate("xyz")), F.get("t", F.lit(i)))
    return own.select("ensemble_id", "frame_idx", "res_idx", *[at(i).alias(c) for i, c in enumerate("xyz")])


def exposure_jaccard(a: DataFrame, reference: DataFrame, structure: DataFrame, least: float = 0.1) -> DataFrame:
    """(ensemble_id, jaccard) of tables (ensemble_id, frame_idx, res_idx, on): among points off in the structure,
    those on in more than a share `least` of the frames; null if neither side has any."""
    buried = structure.where("not on").select("res_idx")

    def often(rows: DataFrame) -> DataFrame:
        return rows.join(buried, "res_idx", "left_semi").groupBy("ensemble_id", "res_idx").agg((F.avg(F.col("on").cast("double")) > least).alias("open"))

    both = often(a).join(often(reference).select("res_idx", F.col("open").alias("r")), "res_idx")
    total = lambda c: F.sum(c.cast("long"))
    return both.groupBy("ensemble_id").agg((total(F.col("open") & F.col("r")) / F.nullif(total(F.col("open") | F.col("r")), F.lit(0))).alias("jaccard"))


def exposure_mi(rows: DataFrame) -> DataFrame:
    """(ensemble_id, i, j, mi), i < j, of rows (ensemble_id, frame_idx, res_idx, on). Pairs are made within a
    frame's own row."""
    frames = rows.groupBy("ensemble_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("res_idx", F.col("on").cast("double").alias("v")))).alias("p"))
    a = frames.select("ensemble_id", "p", F.explode("p").alias("a"))
    b = a.select("ensemble_id", "a", F.explode(F.filter("p", lambda x: x["res_idx"] > F.col("a.res_idx"))).alias("b"))
    m = b.groupBy("ensemble_id", F.col("a.res_idx").alias("i"), F.col("b.res_idx").alias("j")).agg(F.avg("a.v").alias("p"), F.avg("b.v").alias("q"), F.avg(F.col("a.v") * F.col("b.v")).alias("both"))
    p, q, both = F.col("p"), F.col("q"), F.col("both")
    term = lambda x, y, z: F.when(x > 1e-12, x * F.log(x / (y * z))).otherwise(0.0)
    return m.select("ensemble_id", "i", "j", (term(both, p, q) + term(p - both, p, 1 - q) + term(q - both, 1 - p, q) + term(1 - p - q + both, 1 - p, 1 - q)).alias("mi"))


def local_neighbours(frames: DataFrame, radius: float = 15.0, sep: int = 3) -> DataFrame:
    """(ensemble_id, i, j), both ways: points at least `sep` apart along the chain whose median distance is within the radius."""
    near = pair_distances(frames, sep).groupBy("ensemble_id", "i", "j").agg(F.median("d").alias("m")).where(F.col("m") <= radius)
    return near.select("ensemble_id", F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p")).select("ensemble_id", "p.*")


def gdt_drmsd(frames: DataFrame, structure: DataFrame) -> DataFrame:
    """(ensemble_id, frame_idx, gdt_ts, gdt_ha, drmsd) against one structure, without superposing."""
    ref = structure.select("res_idx", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    d = F.sqrt(sum(((F.col(c) - F.col(f"r{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("rx")) ** 2))
    share = lambda cutoffs: sum((F.avg((F.col("d") <= c).cast("double")) for c in cutoffs[1:]), F.avg((F.col("d") <= cutoffs[0]).cast("double"))) / len(cutoffs)
    near = frames.join(ref, "res_idx").select("ensemble_id", "frame_idx", d.alias("d")).groupBy("ensemble_id", "frame_idx").agg(share([1.0, 2.0, 4.0, 8.0]).alias("gdt_ts"), share([0.5, 1.0, 2.0, 4.0]).alias("gdt_ha"))
    own = pair_distances(structure, 1).select("i", "j", F.col("d").alias("d0"))
    inner = pair_distances(frames, 1).join(own, ["i", "j"]).groupBy("ensemble_id", "frame_idx").agg(F.sqrt(F.avg((F.col("d") - F.col("d0")) ** 2)).alias("drmsd"))
    return near.join(inner, ["ensemble_id", "frame_idx"])


def diversity(ratio: Column) -> Column:
    """Verdict on an ensemble's mean distance over the reference's: void outside [0.1, 5] or undefined, flagged outside [0.5, 2]."""
    return F.when(ratio.isNull() | ~ratio.between(0.1, 5.0), "void").when(~ratio.between(0.5, 2.0), "flagged").otherwise("ok")


def _hash(seed: int, *parts: str) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("long")


#: Resamples, and signs, up to which a group is enumerated whole.
ORDERED, SIGNS = 200_000, 1 << 20


def _units(diffs: DataFrame, by: str, unit: str, value: str) -> DataFrame:
    """A group's units numbered from 0, and their number."""
    from pyspark.sql import Window

    own = diffs.select(by, unit, value, (F.row_number().over(Window.partitionBy(by).orderBy(unit)) - 1).alias("_i"), F.count("*").over(Window.partitionBy(by)).alias("_n"))  # a group's units, one per family
    return own.withColumn("_i", F.col("_i").cast("long"))


def bootstrap(diffs: DataFrame, by: str, unit: str, value: str, draws: int, seed: int) -> DataFrame:
    """(by, low, high, resamples): the middle 95 % of the means of resamples of a group's units: of all n ** n ordered
    ones where they are ORDERED at most, resample k being k's digits in base n; else of `draws` by hash.
    Draws are made from each unit's own row, so a group's draws are spread over tasks."""
    own = _units(diffs, by, unit, value)
    exact = F.pow(F.col("_n").cast("double"), F.col("_n").cast("double")) <= ORDERED
    many = F.when(exact, F.pow(F.col("_n").cast("double"), F.col("_n").cast("double")).cast("long")).otherwise(F.lit(draws).cast("long"))
    picks = own.select(by, "_n", F.col("_i").alias("_pos"), exact.alias("_exact"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("_k"))
    digit = F.floor(F.col("_k") / F.pow(F.col("_n").cast("double"), F.col("_pos").cast("double"))).cast("long") % F.col("_n")
    picks = picks.withColumn("_i", F.when(F.col("_exact"), digit).otherwise(_hash(seed, by, "_k", "_pos") % F.col("_n")))
    means = picks.join(own.select(by, "_i", value), [by, "_i"]).groupBy(by, "_k").agg(F.avg(value).alias("m"))
    return means.groupBy(by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count("*").alias("resamples"))


def sign_flips(diffs: DataFrame, by: str, unit: str, value: str, draws: int, seed: int) -> DataFrame:
    """(by, p, floor, signs): how often signs give a mean as far from 0 as the observed one: all 2 ** n of a group's units
    where they are SIGNS at most, sign k being k's bits; else `draws` by hash."""
    own = _units(diffs, by, unit, value)
    exact = F.col("_n") <= int(np.log2(SIGNS))
    many = F.when(exact, F.pow(F.lit(2.0), F.col("_n").cast("double")).cast("long")).otherwise(F.lit(draws).cast("long"))
    seen = diffs.groupBy(by).agg(F.abs(F.avg(value)).alias("_seen"), F.count("*").alias("_n"))
    flipped = own.select(by, unit, value, "_i", exact.alias("_exact"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("_k"))
    bit = F.when(F.col("_exact"), F.floor(F.col("_k") / F.pow(F.lit(2.0), F.col("_i").cast("double"))).cast("long") % 2).otherwise(_hash(seed, by, "_k", unit) % 2)
    flipped = flipped.withColumn("_v", F.when(bit == 0, F.col(value)).otherwise(-F.col(value)))
    means = flipped.groupBy(by, "_k").agg(F.abs(F.avg("_v")).alias("m")).join(seen, by)
    return means.groupBy(by).agg(F.avg((F.col("m") >= F.col("_seen") - 1e-12).cast("double")).alias("p"), (2.0 / F.pow(F.lit(2.0), F.max("_n"))).alias("floor"), F.count("*").alias("signs"))
