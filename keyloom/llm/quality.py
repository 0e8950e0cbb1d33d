"""Quality rules with adaptive thresholds.

Fixed cutoffs reject whole sources whose style differs. Here each (lang, source) group sets its own cutoffs: every
document's measures go into quantile sketches of their group, the sketches merge up to the language and to the corpus,
and a document is rejected where a measure lies beyond its group's fence.

The sketch of a measure is a histogram of integers that keeps their SKETCH_BITS leading bits: counts of a bucket add up,
so sketches merge exactly, in any order and on any partitioning, and every quantile is right to a relative error of
2 ** -(SKETCH_BITS - 1). A hot source is no hot key: counts are summed before the shuffle, and a group has a bounded
number of buckets.

A fence stands `factor` spreads from the median, a spread being the distance between two quantiles; no cutoff is a constant. A
spread is never taken as finer than the sketch's error at its two ends, so a group of uniform texts bears small deviations.
A group's median and spread are drawn to those of its language, and these to the corpus's, as if the merged sketch held
PRIOR documents of the group: smoothly, so a group's size switches nothing.

Defined results: null text has no words and is rejected; null lang or source counts as the empty name; repeated rows are
judged (and counted) each; an empty table gives an empty result; other columns, of any name, pass through `filter_quality`
untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import SPACES, read, staged, words

SKETCH_BITS = 8
#: Documents that the merged sketch of the level above counts for.
PRIOR = 200
#: measure: (lower fence?, upper fence?, the two percentiles whose distance is the spread, spreads from the median to a fence)
#: Symbols a word and repeated lines a line are in percent, so less than one in a hundred counts as none; characters a word
#: in hundredths. Symbols are judged by the upper quartile, as most texts have none; repeated lines by the highest percentile,
#: as some sound texts have a few.
RULES = {
    "symbols": (False, True, 50, 75, 4),
    "dup_lines": (False, True, 50, 99, 3),
    "word_length": (True, True, 25, 75, 8),
}
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_repeats(df: DataFrame, w: str, out: str) -> DataFrame:
    """df with `out`: the words of array w in 3-word windows found twice or more, the first included.

    The steps are columns of their own: as one expression, each array would be computed again wherever a lambda uses it.
    """
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    pairs = F.sort_array(F.transform("__t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, j: F.coalesce(F.get("__s", j)["h"] == x["h"], F.lit(False))
    hits = F.transform("__s", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
    steps = F.transform("__p", lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get("__p", i - 1), F.lit(-3))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        df.withColumn("__t", windows)
        .withColumn("__s", F.when(F.size(F.array_distinct("__t")) < F.size("__t"), pairs))
        .withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.filter(hits, lambda p: p.isNotNull()))))
        .withColumn(out, F.when(F.col("__p").isNull(), F.lit(0).cast("long")).otherwise(total))
        .drop("__t", "__s", "__p")
    )


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with flat columns `__<count>` (a struct would be computed again for each use of a field) and `__base_failed`."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumn("__w", words(F.col(text))).withColumn("__lines", lines)
    n_words = F.size("__w").cast("long")
    counts = {
        "n_words": n_words,
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
    }
    out = with_repeats(out.withColumns({f"__{k}": c for k, c in counts.items()}), "__w", "__n_repeat_words").drop("__w", "__lines")
    return out.withColumn("__base_failed", (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words")))


def measure_values() -> dict[str, Column]:
    """The judged measures of one document."""
    per = lambda a, b: F.expr(f"100 * __{a} div greatest(__{b}, 1)")
    return {"symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "word_length": per("word_chars", "n_words")}


def bucket(v: Column) -> Column:
    """v with all but its SKETCH_BITS leading bits cleared."""
    low = F.greatest(F.lit(0), F.length(F.bin(v)) - SKETCH_BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) over the documents that pass the base rules: the mergeable sketches."""
    values = measure_values()
    items = F.array(*(F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in values.items()))
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    # no filter on the counts: the optimiser would push it below them and compute them again, lambda by lambda
    some = F.when(~F.col("__base_failed"), items)
    rows = measured.select(name("lang").alias("lang"), name("source").alias("source"), F.explode_outer(some).alias("m"))
    return rows.groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n")).where("measure IS NOT NULL")


def merge_levels(sketch: DataFrame) -> DataFrame:
    """The group sketches and their merges: level 0 is (lang, source), 1 lang, 2 the corpus."""
    level = lambda k: sketch.select(F.lit(k).alias("level"), F.col("lang") if k < 2 else F.lit("").alias("lang"), F.col("source") if k < 1 else F.lit("").alias("source"), "measure", "bucket", "n")
    return level(0).union(level(1)).union(level(2)).groupBy("level", "lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source) of the sketches: lang, source and `fence`, measure -> (lo, hi)."""
    group = Window.partitionBy("level", "lang", "source", "measure")
    ranked = merge_levels(sketch).withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    percents = sorted({50, *(q for rule in RULES.values() for q in rule[2:4])})
    quantiles = [F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bucket"))).alias(f"q{q}") for q in percents]
    table = ranked.groupBy("level", "lang", "source", "measure").agg(F.max("total").alias("n"), *quantiles)
    spread, error = F.lit(None).cast("long"), 2 * F.call_function("shiftright", F.col("q50"), F.lit(SKETCH_BITS - 1))
    for k, (_, _, low, high, factor) in RULES.items():
        spread = F.when(F.col("measure") == k, factor * F.greatest(F.col(f"q{high}") - F.col(f"q{low}"), error)).otherwise(spread)
    table = table.select("level", "lang", "source", "measure", "n", F.col("q50").alias("c"), spread.alias("r"))
    own, lang, top = (table.where(F.col("level") == k).drop("level") for k in (0, 1, 2))
    drawn = lambda x, y, n: F.expr(f"({n} * {x} + {PRIOR} * {y}) div ({n} + {PRIOR})")
    top = top.select("measure", F.col("c").alias("c2"), F.col("r").alias("r2"))
    lang = lang.join(F.broadcast(top), "measure")  # a row for each measure
    lang = lang.select("lang", "measure", drawn("c", "c2", "n").alias("c1"), drawn("r", "r2", "n").alias("r1"))
    own = own.join(lang, ["lang", "measure"]).select("lang", "source", "measure", drawn("c", "c1", "n").alias("c"), drawn("r", "r1", "n").alias("r"))
    ends = {k: F.struct((F.col("c") - F.col("r") if rule[0] else F.lit(None).cast("long")).alias("lo"), (F.col("c") + F.col("r") if rule[1] else F.lit(None).cast("long")).alias("hi")) for k, rule in RULES.items()}
    return own.groupBy("lang", "source").agg(F.struct(*(F.max(F.when(F.col("measure") == k, x)).alias(k) for k, x in ends.items())).alias("fence"))


def judged(measured: DataFrame, fence: DataFrame) -> DataFrame:
    """measured with `__kept`, by joining each row with its group's fences."""
    f = fence.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("fence").alias("__fence"))
    on = (F.coalesce("lang", F.lit("")) == F.col("__lang")) & (F.coalesce("source", F.lit("")) == F.col("__source"))
    within = F.lit(True)
    for k, v in measure_values().items():
        lo, hi = F.col(f"__fence.{k}.lo"), F.col(f"__fence.{k}.hi")
        within &= F.coalesce(v >= lo, F.lit(True)) & F.coalesce(v <= hi, F.lit(True))
    joined = measured.join(f, on, "left")
    # as one value of both sides: no filter stands on the measures
    return joined.withColumn("__kept", F.array_min(F.array(~F.col("__base_failed"), within))).drop("__lang", "__source", "__fence")


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that pass the base rules and their group's fences, with the columns of docs.

    Each row travels as one struct, so no column's name can clash; the measures are computed once and staged beside it.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    measured = staged(with_measures(rows).drop("text"), "quality-measures")
    fence = staged(fences(sketches(measured)), "quality-fences")
    return judged(measured, fence).where("__kept").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = staged(with_measures(docs).drop("text"), "quality-measures")
    return judged(measured, staged(fences(sketches(measured)), "quality-fences")).select(
        "doc_id", *(F.col(f"__{c}").alias(c) for c in BASE_COLUMNS), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept")
    )


_WORD = "[^\\x20\\x09-\\x0D]+"
_PER = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words")}
_RULE_ROWS = ", ".join(f"('{k}', {low}, {high}, {factor}, {str(lower).lower()}, {str(upper).lower()})" for k, (lower, upper, low, high, factor) in RULES.items())
OP4_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '{_WORD}') AS ws, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM t),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, len(ws) AS n_words, coalesce(CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
  len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS ({" UNION ALL ".join(f"SELECT r, lang, source, base_failed, '{k}' AS measure, CAST(100 * {x} // greatest({y}, 1) AS BIGINT) AS v FROM b" for k, (x, y) in _PER.items())}),
k AS (SELECT lang, source, measure, (v >> s) << s AS bucket FROM (SELECT *, greatest(0, length(ltrim(bin(v), '0')) - {SKETCH_BITS}) AS s FROM v WHERE NOT base_failed)),
h AS (SELECT level, l, g, measure, bucket, count(*) AS n FROM (SELECT 0 AS level, lang AS l, source AS g, * FROM k UNION ALL SELECT 1, lang, '', * FROM k UNION ALL SELECT 2, '', '', * FROM k) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, l, g, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, l, g, measure) AS total FROM h),
rules(measure, low, high, factor, lower, upper) AS (VALUES {_RULE_ROWS}),
q AS (SELECT level, l, g, measure, CAST(max(total) AS BIGINT) AS n, min(bucket) FILTER (100 * upto >= 50 * total) AS c, max(factor) * greatest(min(bucket) FILTER (100 * upto >= high * total) - min(bucket) FILTER (100 * upto >= low * total), 2 * ((min(bucket) FILTER (100 * upto >= 50 * total)) >> {SKETCH_BITS - 1})) AS d
  FROM c JOIN rules USING (measure) GROUP BY level, l, g, measure),
q1 AS (SELECT a.l, a.measure, (a.n * a.c + {PRIOR} * z.c) // (a.n + {PRIOR}) AS c, (a.n * a.d + {PRIOR} * z.d) // (a.n + {PRIOR}) AS d FROM q a JOIN q z ON a.level = 1 AND z.level = 2 AND a.measure = z.measure),
q0 AS (SELECT a.l, a.g, a.measure, (a.n * a.c + {PRIOR} * z.c) // (a.n + {PRIOR}) AS c, (a.n * a.d + {PRIOR} * z.d) // (a.n + {PRIOR}) AS d FROM q a JOIN q1 z ON a.level = 0 AND a.l = z.l AND a.measure = z.measure),
out AS (SELECT DISTINCT r FROM v JOIN q0 ON v.lang = q0.l AND v.source = q0.g AND v.measure = q0.measure JOIN rules ON rules.measure = v.measure WHERE (upper AND v > c + d) OR (lower AND v < c - d))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM out) AS kept FROM b
"""
