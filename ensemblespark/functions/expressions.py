"""Scalar expressions of the engine: each takes and returns Columns, all within Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of an entry id and of a chain id.
ENTRY_SHAPE, CHAIN_SHAPE = "^[0-9][0-9A-Za-z]{3}$", "^[0-9A-Za-z]{1,4}$"
KMER = 8


def entry_id(family_id: Column) -> Column:
    """Entry part of `entry_chain`; null unless both parts have the right shape."""
    entry = F.split_part(family_id, F.lit("_"), F.lit(1))
    chain = F.regexp_extract(family_id, "^[^_]*_(.*)$", 1)
    return F.when(family_id.contains("_") & entry.rlike(ENTRY_SHAPE) & chain.rlike(CHAIN_SHAPE), entry)


def kmers(seq: Column, k: int = KMER) -> Column:
    """Distinct k-mers; a sequence of at most k letters is its own only token."""
    s = F.upper(F.trim(seq))
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (k - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(k))))
    return F.when(F.length(s) <= k, F.array(s)).otherwise(many)


def unit_hash(*parts: Column, sep: str = "\x00") -> Column:
    """First 8 bytes of the SHA-256 of the joined parts over 2**64, in [0, 1)."""
    digest = F.sha2(F.concat_ws(sep, *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def rank_hash(seed: Column, root: Column) -> Column:
    """SHA-256 of `seed:root` as a sort key."""
    return F.sha2(F.concat_ws(":", seed.cast("string"), root), 256)


def stride_ladder(lo: int, hi: int) -> list[int]:
    """Powers of two times lo up to hi, and hi itself."""
    lo, hi = sorted((max(1, lo), max(1, hi)))
    steps = [lo << i for i in range(64) if lo << i <= hi]
    return steps if steps[-1] == hi else [*steps, hi]


def default_stride(lo: Column, hi: Column, usual: int = 256) -> Column:
    """The usual hop where the range holds it, else the range's upper end."""
    a, b = F.greatest(F.lit(1), F.least(lo, hi)), F.greatest(F.lit(1), F.greatest(lo, hi))
    return F.when((a <= usual) & (b >= usual), F.lit(usual)).otherwise(b)


def natural_key(name: Column) -> Column:
    """The last whole number in a name, -1 without one."""
    return F.coalesce(F.regexp_extract(name, "([0-9]+)[^0-9]*$", 1).try_cast("bigint"), F.lit(-1))


def deletion_scale(d: Column) -> Column:
    return F.atan(d / 3) * 2 / F.pi()


def paired_difference(metric: Column, a: Column, b: Column) -> Column:
    """Log-ratio for positive metrics, difference of Fisher z for correlations (`_r`), else null."""
    fisher = F.when((F.abs(a) < 1) & (F.abs(b) < 1), F.atanh(a) - F.atanh(b))
    return F.when(metric.endswith("_r"), fisher).otherwise(F.when((a > 0) & (b > 0), F.log(a / b)))


def higher_is_better(metric: Column) -> Column:
    return metric.rlike("(_r|_jaccard|_cosine|_hit_fraction)$")


def gap_stamp(task: Column, delta: Column, source: Column, target: Column) -> Column:
    """Time gap of an example in frames: 0 unless it runs forward; its own gap if it has one; else the
    distance of its two frames; 0 for a pair of structures without frames."""
    return F.when(task != "forward", 0).otherwise(F.coalesce(delta, F.abs(target - source), F.lit(0)))


def frame_schedule(task: Column, n: Column, stride: Column) -> tuple[Column, Column]:
    """(frames, conditioned) of a task: iid has frame 0; forward conditions on its first frame; interp
    puts the last frame first and conditions on the two ends."""
    grid = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * stride)
    ends = F.concat(F.slice(grid, -1, 1), F.slice(grid, F.lit(1), n - 1))
    frames = F.when(task == "iid", F.array(F.lit(0))).when(task == "forward", grid).otherwise(ends)
    given = F.when(task == "iid", 0).when(task == "forward", 1).otherwise(2)
    return frames, F.transform(frames, lambda _, i: (i < given).cast("int"))


#: Fixed value: the shape of a sequence identifier that names a species.
SPECIES = r"^(?:tr|sp)\|[A-Za-z0-9]{6,10}(?:_[0-9])?\|[A-Za-z0-9]+_([A-Za-z0-9]{1,5})(?:_[0-9]+)?$"


def species_id(description: Column) -> Column:
    """Species code in the first word of a description, up to a slash; empty without one."""
    first = F.split_part(F.element_at(F.split(F.trim(description), r"\s+"), 1), F.lit("/"), F.lit(1))
    return F.regexp_extract(first, SPECIES, 1)


#: Names of residues and their letters.
RESIDUES = "ALA A ARG R ASN N ASP D CYS C GLN Q GLU E GLY G HIS H ILE I LEU L LYS K MET M PHE F PRO P SER S THR T TRP W TYR Y VAL V"


def residue_letter(name: Column) -> Column:
    """One letter for a residue's three; X for any other name."""
    parts = RESIDUES.split()
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, parts)), name), F.lit("X"))


def residue_spans(spec: Column, length: Column) -> Column:
    """The parts of "1-22,114-117" as structs (part, lo, hi, ok); ok if 1 <= lo <= hi <= length."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")

    def span(p: Column) -> Column:
        lo, hi = F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int"), F.element_at(F.split(p, "-", 2), -1).try_cast("int")
        return F.struct(p.alias("part"), lo.alias("lo"), hi.alias("hi"), F.coalesce((lo >= 1) & (lo <= hi) & (hi <= length), F.lit(False)).alias("ok"))

    return F.transform(parts, span)


def residue_indices(sequence: Column, start: Column) -> Column:
    """A counter at each place of an aligned row: -1 at a gap; lower-case letters only advance it."""
    kinds = F.transform(F.filter(F.split(sequence, ""), lambda c: c != ""), lambda c: F.when(c == "-", 0).when(c.rlike(r"^\p{Ll}$"), 1).otherwise(2))
    step = lambda s, k: F.struct((s["n"] + F.when(k > 0, 1).otherwise(0)).alias("n"), F.when(k == 1, s["at"]).otherwise(F.array_append(s["at"], F.when(k == 0, -1).otherwise(s["n"]))).alias("at"))
    return F.aggregate(kinds, F.struct(start.cast("int").alias("n"), F.array().cast("array<int>").alias("at")), step, lambda s: s["at"])


def residue_index_totals(sequence: Column, start: Column) -> Column:
    """What residue_indices() of a row adds up to, as a struct (gaps, residues, places): places that are -1, other places, the
    sum of these. One pass with four counters, however long the row is."""
    letters = F.filter(F.split(F.regexp_replace(sequence, r"\p{Ll}", "l"), ""), lambda c: c != "")
    zero = F.lit(0).cast("long")

    def step(s: Column, c: Column) -> Column:
        gap = c == "-"
        residue = ~gap & (c != "l")
        one = lambda hit: F.when(hit, 1).otherwise(0)
        return F.struct((s["n"] + one(~gap)).alias("n"), (s["gaps"] + one(gap)).alias("gaps"), (s["residues"] + one(residue)).alias("residues"), (s["places"] + F.when(residue, s["n"]).otherwise(0)).alias("places"))

    return F.aggregate(letters, F.struct(start.cast("long").alias("n"), zero.alias("gaps"), zero.alias("residues"), zero.alias("places")), step)


def first_difference(declared: Column, derived: Column) -> Column:
    """Place, from 1, at which two sequences of equal length first differ; 0 if they don't, null if their lengths differ."""
    return F.when(F.length(declared) == F.length(derived), F.array_position(F.zip_with(F.split(declared, ""), F.split(derived, ""), lambda a, b: a != b), F.lit(True)))


def hit_verdict(after_cutoff: Column, aligned: Column, hit: Column, query: Column) -> Column:
    """Why a hit is left out: too new, too little of the query aligned, a part of the query that covers
    most of it, too short; ok otherwise. The first reason counts."""
    bare = F.replace(hit, F.lit("-"), F.lit(""))
    ratio = lambda n: n / F.length(query)
    return F.when(after_cutoff, "date").when(ratio(aligned) <= 0.1, "align").when(F.contains(query, bare) & (ratio(F.length(bare)) > 0.95), "duplicate").when(F.length(bare) < 10, "length").otherwise("ok")
