"""Fill-in-the-middle transformation of whole texts, and its inverse, as pyarrow.compute pipelines.

A text is cut into units: a word with the white space before it, or the white space at the
end. Two hashed numbers of the document choose where its prefix and middle end, two more
whether it stays plain or takes the form prefix, suffix, middle (psm) or suffix, prefix,
middle (spm). A batch is worked on as a whole: units become lists, lists are flattened with
the indices of their parents, ordinals follow, a filter by role keeps the units of each
piece, lists are rebuilt and joined. No text meets a Python object, and there is no shuffle:
a document is independent of all others, so a lost task is simply run again.

Cutting marks each unit's end with a byte that no UTF-8 text holds, so any character may
occur in a text. The marks of the forms may not: a text with one of them stays plain, and so
restore() finds a piece's end at the first mark that follows it.

Defined cases: a null text counts as empty; an empty text is plain and has no units; a null
doc_id hashes as the seed with nothing after it; repeated rows give equal rows; a text of any
length is cut whole (batches are cut to about 4 MB of text, a longer text is a batch of its
own); columns besides doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .store import table

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: A document is transformed if its third number is below this percentage, as spm if its fourth is below that.
RATE, SPM_RATE, SEED = 50, 80, 42
UNIT = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
_END = b"\xff"
_BYTES = pa.large_binary()
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def numbers(seed: int = SEED) -> list:
    """Four columns h1 to h4, 32 bits each, of the SHA-256 of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _modulo(x: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def _piece(units: pa.Array, role: pa.Array, sizes: pa.Array) -> pa.Array:
    """The joined units of one role, given which units have it and how many each text has of them."""
    ends = np.concatenate(([0], np.cumsum(sizes.to_numpy(zero_copy_only=False))))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), units.filter(role)), pa.scalar(b"", _BYTES))


def _characters(piece: pa.Array) -> pa.Array:
    return pc.utf8_length(piece.view(pa.large_string())).cast(pa.int64())


def _string(text: pa.Array) -> pa.Array:
    """Bytes as the strings they are, in the type that Spark asks for."""
    return text.view(pa.large_string()).cast(pa.string())


def _either(which: pa.Array, one, other) -> pa.Array:
    fixed = lambda x: pa.scalar(x.encode(), _BYTES) if isinstance(x, str) else x
    return pc.if_else(which, fixed(one), fixed(other))


def _transformed(batches: Iterator[pa.RecordBatch], rate: int, spm_rate: int) -> Iterator[pa.RecordBatch]:
    to_prefix, to_suffix, to_middle = MARKS
    for batch in H.slices(batches):
        text = pc.fill_null(batch.column("text"), "").cast(_BYTES)
        h1, h2, h3, h4 = (batch.column(f"h{i}") for i in range(1, 5))
        lists = pc.split_pattern(pc.replace_substring_regex(text, pattern=UNIT, replacement=rb"\1" + _END), pattern=_END)
        n = pc.subtract(pc.list_value_length(lists), 1).cast(pa.int64())  # after the last end stands an empty string
        some = pc.add(n, 1)
        a, b = _modulo(h1, some), _modulo(h2, some)
        first, last = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
        units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        start = pa.array(np.cumsum(some.to_numpy()) - some.to_numpy())
        ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(start, parent))
        in_prefix, in_suffix = pc.less(ordinal, pc.take(first, parent)), pc.greater_equal(ordinal, pc.take(last, parent))
        prefix = _piece(units, in_prefix, first)
        middle = _piece(units, pc.invert(pc.or_(in_prefix, in_suffix)), pc.subtract(last, first))
        suffix = _piece(units, in_suffix, pc.subtract(some, last))
        plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(h3, 100), rate))
        for mark in MARKS:
            plain = pc.or_(plain, pc.match_substring(text, mark))
        psm = pc.greater_equal(_modulo(h4, 100), spm_rate)
        joined = pc.binary_join_element_wise(
            _either(psm, to_prefix, to_suffix), _either(psm, prefix, suffix), _either(psm, to_suffix, to_prefix), _either(psm, suffix, prefix), pa.scalar(to_middle.encode(), _BYTES), middle,
            pa.scalar(b"", _BYTES),
        )
        form = pc.if_else(plain, "plain", pc.if_else(psm, "psm", "spm"))
        counts = [pc.if_else(plain, pa.scalar(None, pa.int64()), _characters(x)) for x in (prefix, middle)]
        output = _string(pc.if_else(plain, text, joined))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, form, *counts, output], names=[x.split()[0] for x in MADE.split(", ")])


def _halves(text: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first occurrence of a mark; nothing after it where there is none."""
    parts = pc.split_pattern(text, pattern=mark.encode(), max_splits=1)
    flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts)
    opens = pc.not_equal(parent, pa.concat_arrays([pa.array([-1], parent.type), parent[:-1]]))
    rest = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy() - 1)))), flat.filter(pc.invert(opens)))
    return flat.filter(opens), pc.binary_join(rest, pa.scalar(b"", _BYTES))


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    to_prefix, to_suffix, to_middle = MARKS
    for batch in H.slices(batches, "output"):
        form, output = batch.column("form"), pc.fill_null(batch.column("output"), "").cast(_BYTES)
        whole = output.take(pa.array(np.arange(len(output))))
        for name, (head, second) in {"psm": (to_prefix, to_suffix), "spm": (to_suffix, to_prefix)}.items():
            mine = pc.fill_null(pc.equal(form, name), False)
            if not pc.any(mine).as_py():
                continue
            one, rest = _halves(_halves(output.filter(mine), head)[1], second)
            other, middle = _halves(rest, to_middle)
            prefix, suffix = (one, other) if name == "psm" else (other, one)
            whole = pc.replace_with_mask(whole, mine, pc.binary_join_element_wise(prefix, middle, suffix, pa.scalar(b"", _BYTES)))
        yield pa.RecordBatch.from_arrays([*batch.columns, _string(whole)], names=[*batch.schema.names, "restored"])


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """Rows MADE of docs (doc_id, text), one per document; prefix_chars and middle_chars are null where it stays plain."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", *numbers(seed), "text")
    return own.mapInArrow(lambda batches: _transformed(batches, rate, spm_rate), MADE)


def restore(made: DataFrame) -> DataFrame:
    """Rows of transform() with the text rebuilt from form and output alone, as column restored."""
    return made.select(*[x.split()[0] for x in MADE.split(", ")]).mapInArrow(_restored, f"{MADE}, restored string")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), dealt AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 AS d
  FROM own
), cut AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(units[1:least(a, b)], ''), '') AS prefix, coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
    coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS suffix
  FROM dealt
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output ELSE prefix || middle || suffix END) AS restored_sha256
FROM made
"""
