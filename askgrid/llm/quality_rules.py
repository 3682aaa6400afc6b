"""Quality rules with thresholds that adapt to language and source.

Counts come from built-in functions only. For each measure and each (language, source) a
quantile sketch is kept: a histogram over buckets whose width grows with the value, so any
quantile is known within 1/16 of its value. Such histograms merge by adding counts: the sketch
of a language is the sum of its sources, that of the corpus the sum of all. A group's fences
are its quartiles widened by a multiple of their distance, the upper one at least its ninth decile
widened likewise, which tells usual from odd where both quartiles are 0; too small a group takes the fences
of its language, then of the corpus. The filter joins documents with the fences of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askgrid.llm.rows import BLANKS, written
from askgrid.operators.sizing import broadcast_if_small

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
# Per mille measures: of lines for dup_lines, of words for the others. A distance of quartiles
# counts as the width of a bucket at least, as the sketch tells no less.
MEASURES = ("word_length", "symbols", "dup_lines", "repeats")
FENCE = 3
UPPER = 90  # percent of a group that is usual in it
# A text strays by chance, a short one farther: FENCE times one event is allowed to each, a sign, a
# line or a window of five words found twice; to the mean length of n words FENCE times its error,
# half a usual length / sqrt(n).
EVENT = {"symbols": 1, "dup_lines": 1, "repeats": 10}
MIN_GROUP = 200


def _windows(hashes: Column) -> Column:
    """Hash of every window of five words, from the hashes of its words."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)]))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct ``row`` with the counts of its text.

    Columns: row, n_words, word_chars, n_symbols, n_lines (not blank), n_dup_lines, n_repeat_words
    (long). A null text has no words. A text of any length is one row. Only where two windows of a text have equal
    hashes are these windows sorted by their words, and those found twice there count.

    Each step is a column of its own: a lambda that held the expression of an array would make
    that array again for every element.
    """
    blank = "[" + BLANKS + "]+"
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words, windows, ordered, near, starts = F.col("words"), F.col("windows"), F.col("ordered"), F.col("near"), F.col("starts")
    twin = lambda a, key: F.filter(a, lambda x, i: (
        ((i > 0) & (F.get(a, i - 1)[key] == x[key])) | ((i < F.size(a) - 1) & (F.get(a, i + 1)[key] == x[key]))))
    texts = F.transform(twin(ordered, "h"), lambda x: F.struct(F.array_join(F.slice(words, x["i"] + 1, 5), " ").alias("t"), x["i"].alias("i")))
    gaps = F.transform(starts, lambda s, i: F.when(i < F.size(starts) - 1, F.least(F.lit(5), F.get(starts, i + 1) - s)).otherwise(F.lit(5)))
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        .withColumn("t", F.coalesce(F.col("row.text"), F.lit("")))
        .withColumn("words", F.array_remove(F.split(F.col("t"), blank, -1), ""))
        .withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn("windows", F.when(F.size("hashes") >= 6, _windows(F.col("hashes"))))
        .withColumn("ordered", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(
            F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("near", F.sort_array(texts))
        .withColumn("starts", F.sort_array(F.transform(twin(near, "t"), lambda x: x["i"])))
        .withColumn("lines", F.when(F.col("t").contains("\n"), lines))
        .select(
            "row",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
            (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.when(F.col("t").contains("\n"), F.size("lines")).otherwise(F.lit(1)).cast("long").alias("n_lines"),
            F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
            F.coalesce(F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long").alias("n_repeat_words")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_measures(counts: DataFrame) -> DataFrame:
    """Per mille measures of a text, whole numbers; 0 without words."""
    rate = lambda c, of="n_words": F.expr(f"{c} * 1000 div greatest({of}, 1)")
    return (counts.withColumn("word_length", rate("word_chars")).withColumn("symbols", rate("n_symbols"))
            .withColumn("dup_lines", rate("n_dup_lines", "n_lines")).withColumn("repeats", rate("n_repeat_words")))


def bucket(value: Column) -> Column:
    """Place in the sketch: values below 32 exactly, above that 16 buckets per power of two."""
    shift = F.length(F.bin(value)) - 5
    return F.when(value < 32, value).otherwise(shift * 16 + F.floor(value / F.pow(F.lit(2.0), shift))).cast("long")


def bucket_width(b: Column) -> Column:
    """How many whole values a bucket has."""
    return F.when(b < 32, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.floor((b - 16) / 16))).cast("long")


def bucket_floor(b: Column) -> Column:
    """Smallest value of a bucket."""
    shift = F.floor((b - 16) / 16)
    return F.when(b < 32, b).otherwise((b - shift * 16) * F.pow(F.lit(2.0), shift)).cast("long")


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): mergeable by adding n. Null lang and source are groups."""
    each = measures.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("m"))
    return each.groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """Per (lang, source): rows, and low/high/usual (third quartile) of every measure, each from the
    smallest group of at least MIN_GROUP rows that holds it."""
    levels = {"own": ["lang", "source"], "language": ["lang"], "corpus": []}
    groups = sketch.filter(F.col("measure") == MEASURES[0]).groupBy("lang", "source").agg(F.sum("n").alias("rows"))
    out = groups
    for level, keys in levels.items():
        by = [*keys, "measure"]
        merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
        run = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        total = W.partitionBy(*by)
        cum = merged.withColumn("c", F.sum("n").over(run)).withColumn("total", F.sum("n").over(total))
        at = lambda percent: F.min(F.when(F.col("c") * 100 >= F.col("total") * percent, F.col("bucket")))
        quarts = cum.groupBy(*by).agg(at(25).alias("b1"), at(75).alias("b3"), at(UPPER).alias("upper"), F.max("total").alias("total"))
        q1, q3, step = bucket_floor(F.col("b1")), bucket_floor(F.col("b3")), bucket_width(F.col("b3"))
        upper, upper_step = bucket_floor(F.col("upper")), bucket_width(F.col("upper"))
        spread = F.greatest(q3 - q1, step)
        fence = F.when(F.col("total") >= (MIN_GROUP if keys else 0), F.struct(
            (q1 - FENCE * spread).alias("low"),
            F.greatest(q3 + step - 1 + FENCE * spread, upper + upper_step - 1 + FENCE * F.greatest(upper - q3, upper_step)).alias("high"),
            (q3 + step - 1).alias("usual")))
        wide = quarts.withColumn("fence", fence).groupBy(*keys).agg(*[
            F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"{level}_{m}") for m in MEASURES])
        if keys:
            right = wide.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in wide.columns if c not in keys])
            cond = [out[k].eqNullSafe(right[f"r_{k}"]) for k in keys]
            out = out.join(right, cond, "left").drop(*[f"r_{k}" for k in keys])
        else:
            out = out.crossJoin(F.broadcast(wide))  # one row
    return out.select("lang", "source", "rows", *[
        F.coalesce(*[F.col(f"{level}_{m}") for level in levels]).alias(m) for m in MEASURES])


def _judged(measures: DataFrame, limits: DataFrame) -> DataFrame:
    right = broadcast_if_small(limits.select(
        F.col("lang").alias("r_lang"), F.col("source").alias("r_source"), *[F.col(m).alias(f"fence_{m}") for m in MEASURES]))
    met = measures.join(right, [measures["lang"].eqNullSafe(right["r_lang"]), measures["source"].eqNullSafe(right["r_source"])], "left")
    inside = F.lit(True)
    for m in MEASURES:
        size = F.greatest(F.col("n_lines" if m == "dup_lines" else "n_words"), F.lit(1))
        room = F.lit(1000 * FENCE * EVENT[m]) / size if m in EVENT else FENCE * F.col(f"fence_{m}.usual") / 2 / F.sqrt(size)
        inside = inside & (F.col(m) <= F.col(f"fence_{m}.high") + room)
        if m == "word_length":
            inside = inside & (F.col(m) >= F.col(f"fence_{m}.low") - room)
    return met.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, lang, source; more columns stay) with their verdict.

    Columns: row (struct of the input), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept. Null or empty text: no words, base fails. Null lang or
    source is a group of its own. Rows that repeat are judged alike. Empty table: no rows.
    """
    # Written once: read for the sketches and again for the verdicts, and no filter is pushed into
    # the counts, where it would make their arrays a second time.
    keyed = written(with_measures(measured(docs)), "measures").withColumn("lang", F.col("row.lang")).withColumn("source", F.col("row.source"))
    # Fences come from texts that pass the base rules: junk must not widen what counts as usual.
    limits = written(fences(written(sketches(keyed.filter(~base_failed())), "sketches")), "fences")
    return _judged(keyed, limits).select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_counts(docs: DataFrame) -> DataFrame:
    """As quality_rules with doc_id in place of the whole row; the counts are made once."""
    keyed = with_measures(measured(docs.select("doc_id", "text", "lang", "source"))).select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"),
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *MEASURES)
    keyed = written(keyed, "measures")
    limits = written(fences(sketches(keyed.filter(~base_failed()))), "fences")
    return _judged(keyed, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
