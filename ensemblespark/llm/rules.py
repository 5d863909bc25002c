"""Quality rules by distribution divergence, in DataFrame operations only.

Each language's reference is counted over all its documents: the shares of character classes
in its texts, and the shares of its common words, those that make up at least COMMON of its
words (so at most 1 / COMMON of them, whatever the corpus). A document is held against its
own language's reference by the Jensen-Shannon distance (in bits, 0 to 1) of the character
classes, and of the common words with all others as one. Short texts have noisy histograms:
the words are judged only from MIN_WORDS words on, the classes from MIN_CHARS characters. All
that is judged depends on text and language alone, so texts are known by 128 bits of hash.

Words are runs of characters other than space and \\t..\\r, as they stand. Besides the
distances there are the base counts of words, symbols, repeated lines and repeated windows
of three words.

Defined cases: a null or empty text has no words and fails; a null language is one of its
own; a language without common words has word distances of 0; texts of any length are counted
whole; repeated rows are judged each; columns besides doc_id, text and lang are carried on or
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import forget, keep, small, table

COMMON = 0.004
MIN_WORDS, MIN_CHARS = 80, 200
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.31
BLANK = " \t\n\x0b\f\r"
#: Character classes taken from a text one after the other; what is left is the last class.
CLASSES = (("lower", r"\p{Ll}+"), ("blank", r"[\x20\x09-\x0D]+"), ("upper", r"\p{Lu}+"), ("digit", r"\p{Nd}+"), ("stop", r"[.,;:!?'\"()\-]+"))


def words_of(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    for c in BLANK[1:]:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def measured(docs: DataFrame) -> DataFrame:
    """docs' columns but text, with t1 and t2 (128 bits of hash that name the text), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words and c0.. (characters of each class). Written once: a filter on
    the numbers can't be moved below the arrays that they are counted with."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    out = out.withColumn("_lines", lines).withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("_grams", F.when(F.col("n_words") >= 3, F.expr("transform(slice(words, 1, size(words) - 2), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2)))")).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a repeated window need the sort.
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(F.expr("transform(_grams, (h, i) -> named_struct('h', h, 'i', i))"))))
    again = "sort_array(transform(filter(transform(_sorted, (x, k) -> named_struct('i', x.i, 'again', coalesce(x.h = get(_sorted, k - 1).h, false) or coalesce(x.h = get(_sorted, k + 1).h, false))), y -> y.again), y -> y.i))"
    out = out.withColumn("_again", F.expr(f"if(_sorted is null, cast(array() as array<int>), {again})"))
    covered = "aggregate(transform(_again, (p, k) -> if(k + 1 < size(_again), least(3, get(_again, k + 1) - p), 3)), 0L, (a, x) -> a + x)"
    rest, counts = text, []
    left = F.length(text)
    for i, (_, pattern) in enumerate(CLASSES):
        out = out.withColumn(f"_r{i}", F.regexp_replace(rest, pattern, ""))
        rest = F.col(f"_r{i}")
        counts.append((left - F.length(rest)).cast("long").alias(f"c{i}"))
        left = F.length(rest)
    counts.append(left.cast("long").alias(f"c{len(CLASSES)}"))
    blank = [name for name, _ in CLASSES].index("blank")
    return keep(out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"], *text_key(), "n_words", *counts, F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.expr(covered).alias("n_repeat_words"),
    ).withColumn("word_chars", sum((F.col(f"c{i}") for i in range(len(CLASSES) + 1) if i != blank), F.lit(0).cast("long"))))


def text_key() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, w, q): each language's common words and their shares, at most 1 / COMMON of them."""
    counts = keep(docs.select("lang", F.explode(words_of(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("all")).withColumnRenamed("lang", "_l")
    common = keep(counts.join(small(sums, sums.count()), F.col("lang").eqNullSafe(F.col("_l"))).where(F.col("n") >= F.col("all") * COMMON).select("lang", "w", (F.col("n") / F.col("all")).alias("q")))
    forget(counts)
    return common


def class_shares(measures: DataFrame) -> DataFrame:
    """(_l, ref_classes): the shares of the character classes in each language's texts."""
    chars = measures.groupBy("lang").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(CLASSES) + 1)])
    total = F.greatest(sum((F.col(f"c{i}") for i in range(1, len(CLASSES) + 1)), F.col("c0")), F.lit(1)).cast("double")
    return chars.select(F.col("lang").alias("_l"), F.array(*[F.col(f"c{i}") / total for i in range(len(CLASSES) + 1)]).alias("ref_classes"))


def _half(a: str, b: str) -> str:
    return f"if({a} > 0, {a} * log2(2 * {a} / ({a} + {b})), 0D)"


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance in bits of two arrays of shares; null if one is null."""
    return F.expr(f"sqrt(greatest(0D, aggregate(zip_with({p}, {q}, (x, y) -> ({_half('x', 'y')} + {_half('y', 'x')}) / 2), 0D, (a, x) -> a + x)))")


def word_distances(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(_l, _t1, _t2, word_distance): for each text, by its hash, the distance of its common words, all
    others as one, from its language's. A text's words are counted where they stand, so what is shuffled
    is a row per text and common word in it; equal texts are one, whatever their number."""
    # A row without a word for each language counts how often a text occurs.
    langs = docs.select("lang").distinct().select(F.col("lang").alias("_l"), F.lit(None).cast("string").alias("_w"), F.lit(None).cast("double").alias("q"))
    known = keep(langs.unionByName(common.select(F.col("lang").alias("_l"), F.col("w").alias("_w"), "q")))
    rows = docs.select("lang", *text_key(), words_of(F.col("text")).alias("words")).select("lang", "t1", "t2", F.size("words").alias("n"), F.explode(F.array_append("words", F.lit(None).cast("string"))).alias("w"))
    own = rows.join(small(known, known.count()), F.col("lang").eqNullSafe(F.col("_l")) & F.col("w").eqNullSafe(F.col("_w")))
    own = own.groupBy("_l", "t1", "t2", "n", "q", "_w").agg(F.count("*").alias("c"))
    own = own.groupBy("_l", "t1", "t2", "n").agg(F.max(F.when(F.col("q").isNull(), F.col("c"))).alias("times"), F.array_sort(F.collect_list(F.when(F.col("q").isNotNull(), F.struct("_w", "c", "q")))).alias("x"))
    share = "y.c / (times * n)"
    own = own.withColumns({
        "terms": F.expr(f"aggregate(x, 0D, (a, y) -> a + ({_half(f'({share})', 'y.q')} + {_half('y.q', f'({share})')}) / 2)"),
        "sp": F.expr(f"aggregate(x, 0D, (a, y) -> a + {share})"), "sq": F.expr("aggregate(x, 0D, (a, y) -> a + y.q)"),
    })
    every = common.groupBy(F.col("lang").alias("_k")).agg(F.sum("q").alias("all_q"))
    own = own.join(small(every, every.count()), F.col("_l").eqNullSafe(F.col("_k")), "left").withColumns({"p0": 1 - F.col("sp"), "q0": 1 - F.col("all_q")})
    # A common word that a text lacks adds half its share.
    js = F.expr(f"terms + (all_q - sq) / 2 + ({_half('p0', 'q0')} + {_half('q0', 'p0')}) / 2")
    return own.select("_l", F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.coalesce(F.sqrt(F.greatest(js, F.lit(0.0))), F.lit(0.0)).alias("word_distance"))


def judge(docs: DataFrame) -> DataFrame:
    """docs' columns but text (docs has text, lang and any small ones), t1 and t2 that name the text, the
    counts, the two distances, base_failed and kept."""
    own = docs.select("text", "lang")
    m = measured(docs)
    far = keep(word_distances(own, common_words(own)))
    shares = keep(class_shares(m))
    m = m.join(far, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left").drop("_l", "_t1", "_t2")
    m = m.join(small(shares, shares.count()), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
    chars = sum((F.col(f"c{i}") for i in range(1, len(CLASSES) + 1)), F.col("c0"))
    m = m.withColumn("_n", chars).withColumn("_c", F.array(*[F.col(f"c{i}") / F.greatest(F.col("_n"), F.lit(1)) for i in range(len(CLASSES) + 1)]))
    m = m.withColumn("class_distance", distance("_c", "ref_classes"))
    m = m.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    odd = ((F.col("_n") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return m.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], "t1", "t2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def _class_sql() -> str:
    """Class counts of `text`, each class taken from what the ones before leave."""
    out, rest = [], "text"
    for _, pattern in CLASSES:
        after = f"regexp_replace({rest}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
        out.append(f"cast(length({rest}) - length({after}) as double)")
        rest = after
    return f"[{', '.join([*out, f'cast(length({rest}) as double)'])}]"


_JS = "sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: (case when z[1] > 0 then z[1] * log2(2 * z[1] / (z[1] + z[2])) else 0 end + case when z[2] > 0 then z[2] * log2(2 * z[2] / (z[1] + z[2])) else 0 end) / 2))))"
OP4_SQL = f"""
with d as (
  select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents
), t as (
  select rid, lang, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from d
), g as (
  select rid, i, w || chr(1) || lead(w, 1) over p || chr(1) || lead(w, 2) over p as g from t window p as (partition by rid order by i)
), again as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from g where g is not null) where n > 1
), covered as (
  select rid, count(*) as n from (select distinct rid, unnest([i, i + 1, i + 2]) as i from again) group by rid
), m as (
  select d.rid, doc_id, lang, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines, coalesce(covered.n, 0) as n_repeat_words, {_class_sql()} as classes
  from d left join covered on d.rid = covered.rid
), rc as (
  select lang, list_transform([{', '.join(f'sum(classes[{i + 1}])' for i in range(len(CLASSES) + 1))}], lambda x: x / greatest(1, sum(list_sum(classes)))) as ref_classes from m group by lang
), n as (
  select lang, w, count(*) as n from t group by lang, w
), a as (
  select lang, sum(n) as total from n group by lang
), common as (
  select n.lang, n.w, n.n / a.total as p from n join a on n.lang is not distinct from a.lang where n.n >= a.total * {COMMON}
), dc as (
  select rid, lang, w, count(*) as c from t group by rid, lang, w
), grid as (
  select m.rid, common.w, common.p as q, coalesce(dc.c, 0) / greatest(1, m.n_words) as p
  from m join common on m.lang is not distinct from common.lang left join dc on dc.rid = m.rid and dc.w = common.w
), lists as (
  select rid, list(p order by w) as p, list(q order by w) as q, 1 - sum(p) as p0, 1 - sum(q) as q0 from grid group by rid
), dist as (
  select m.*, {_JS.format(p='list_transform(classes, lambda x: x / greatest(1, list_sum(classes)))', q='ref_classes')} as class_distance,
         coalesce({_JS.format(p='list_append(lists.p, lists.p0)', q='list_append(lists.q, lists.q0)')}, 0) as word_distance
  from m join rc on m.lang is not distinct from rc.lang left join lists on m.rid = lists.rid
), j as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from dist
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not base_failed and not ((list_sum(classes) >= {MIN_CHARS} and class_distance > {MAX_CLASS_DISTANCE}) or (n_words >= {MIN_WORDS} and word_distance > {MAX_WORD_DISTANCE})) as kept,
       round(class_distance, 6) as class_distance, round(word_distance, 6) as word_distance
from j
"""
