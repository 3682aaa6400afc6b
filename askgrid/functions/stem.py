"""English stems (Porter, "An algorithm for suffix stripping", 1980) as column expressions.

Beside a word goes its shape, a C or V for each sign: y is a vowel behind a consonant. The shape
of a stem is a prefix of the shape of its word, so suffixes come off both alike, and the measure of
a stem is the number of times VC stands in its shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.session import cut_lineage

# Suffix rules (suffix, replacement) of steps 2, 3 and 4 of the paper.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def shape(word: Column) -> Column:
    """The word as a string of C and V."""
    known = F.regexp_replace(F.regexp_replace(word, "[^aeiouy]", "C"), "[aeiou]", "V")
    signs = F.filter(F.split(known, ""), lambda x: x != "")
    step = lambda acc, x: F.concat(acc, F.when(x != "y", x).when(acc.endswith("C"), "V").otherwise("C"))
    return F.when(known.contains("y"), F.aggregate(signs, F.lit(""), step)).otherwise(known)


def _measure(shaped: Column) -> Column:
    return (F.length(shaped) - F.length(F.replace(shaped, F.lit("VC"), F.lit("")))) / 2


def _cut(text: Column, n: Column | int) -> Column:
    """All but the last n signs."""
    return F.substring(text, F.lit(1), F.length(text) - n)


def _ends_cvc(word: Column, shaped: Column) -> Column:
    return shaped.endswith("CVC") & ~word.rlike("[wxy]$")


def _any_suffix(suffixes: tuple[str, ...]) -> str:
    return "(?:" + "|".join(suffixes) + ")$"  # the leftmost match is the longest suffix


def _step(df: DataFrame, word: Column, shaped: Column) -> DataFrame:
    return df.withColumn("_", F.struct(word.alias("w"), shaped.alias("s"))).withColumn("w", F.col("_.w")).withColumn("s", F.col("_.s"))


def _replace_suffix(df: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """The longest suffix of the rules is replaced if its stem has a measure above 0."""
    w, s, x = F.col("w"), F.col("s"), F.col("x")
    new = {suffix: end for suffix, end in rules}
    ends = F.create_map(*[F.lit(t) for rule in new.items() for t in rule])
    kinds = "".join("V" if c in "aeiou" else "C" for c in "abcdefghijklmnopqrstuvwxyz")
    df = df.withColumn("x", F.regexp_extract("w", _any_suffix(tuple(new)), 0)).withColumn("end", F.try_element_at(ends, x))
    hit = (F.length(x) > 0) & (_measure(_cut(s, F.length(x))) > 0)
    return _step(df, F.when(hit, F.concat(_cut(w, F.length(x)), F.col("end"))).otherwise(w), F.when(hit, F.concat(
        _cut(s, F.length(x)), F.translate("end", "abcdefghijklmnopqrstuvwxyz", kinds))).otherwise(s))


def stem_table(terms: DataFrame) -> DataFrame:
    """(term, stem) of a table of lower-case terms; words of one or two letters and null stay as they
    are. Built-in functions only.

    The result is stored: a condition on the stem would else be moved in front of the steps, where each
    step repeats it several times over.
    """
    w, s, x = F.col("w"), F.col("s"), F.col("x")
    df = terms.select("term", F.col("term").alias("w")).withColumn("s", shape(w))
    # 1a: plurals
    n = F.when(w.rlike("(?:sses|ies)$"), 2).when(w.rlike("[^s]s$"), 1).otherwise(0)
    df = _step(df.withColumn("n", n), _cut(w, F.col("n")), _cut(s, F.col("n")))
    # 1b: eed, ed, ing
    df = df.withColumn("x", F.regexp_extract("w", "(?:eed|ed|ing)$", 0))
    eed = (x == "eed") & (_measure(_cut(s, 3)) > 0)
    off = x.isin("ed", "ing") & _cut(s, F.length(x)).contains("V")
    n = F.when(eed, 1).when(off, F.length(x)).otherwise(0)
    df = _step(df.withColumn("off", off).withColumn("n", n), _cut(w, F.col("n")), _cut(s, F.col("n")))
    grows = F.col("off") & (w.rlike("(?:at|bl|iz)$") | ((_measure(s) == 1) & _ends_cvc(w, s)))
    halves = F.col("off") & w.rlike(r"([^aeioulsz])\1$") & s.endswith("C")
    df = _step(df, F.when(grows, F.concat(w, F.lit("e"))).when(halves, _cut(w, 1)).otherwise(w),
               F.when(grows, F.concat(s, F.lit("V"))).when(halves, _cut(s, 1)).otherwise(s))
    # 1c: y
    turns = w.endswith("y") & _cut(s, 1).contains("V")
    df = _step(df, F.when(turns, F.concat(_cut(w, 1), F.lit("i"))).otherwise(w), F.when(turns, F.concat(_cut(s, 1), F.lit("V"))).otherwise(s))
    df = _replace_suffix(_replace_suffix(df, STEP2), STEP3)
    # 4: suffixes that go
    df = df.withColumn("x", F.regexp_extract("w", _any_suffix(STEP4), 0))
    goes = (F.length(x) > 0) & (_measure(_cut(s, F.length(x))) > 1) & (~w.endswith("ion") | w.rlike("[st]ion$"))
    df = df.withColumn("n", F.when(goes, F.length(x)).otherwise(0))
    df = _step(df, _cut(w, F.col("n")), _cut(s, F.col("n")))
    # 5: e and ll
    m = _measure(_cut(s, 1))
    drops = w.endswith("e") & ((m > 1) | ((m == 1) & ~_ends_cvc(_cut(w, 1), _cut(s, 1))))
    df = _step(df, F.when(drops, _cut(w, 1)).otherwise(w), F.when(drops, _cut(s, 1)).otherwise(s))
    stem = F.when(w.endswith("ll") & (_measure(s) > 1), _cut(w, 1)).otherwise(w)
    return cut_lineage(df.select("term", F.when(F.length("term") <= 2, F.col("term")).otherwise(stem).alias("stem")))
