"""Text quality statistics of documents, and prose told from lists, tables and junk.

The statistics are counts of characters and words over whole texts and their lines, as built-in column expressions:
no shuffle, no Python. Which words are common is counted from the corpus: those in COMMON_SHARE of all documents
of a language. Gradient-boosted trees are fitted on the statistics, on at most about LABELLED rows that rules on
the shapes of lines label weakly (the rules abstain in between, and are no statistic the trees see), and their scores
are calibrated on a holdout of texts checked by hand.

Defined cases: a null or empty text has no words, ratios of 0, and counts as prose; blank lines are no lines; quotation
marks of mail (">") before a line are left out; repeated documents get the same verdict; documents without a language,
or of one with few documents, count no common words of their own, unless all are so, and then all together do. Texts
of both kinds come with the package (TAUGHT), so that there is always something of either to learn from.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.llm.holdout import checked_texts, taught_texts
from pelorus.session import stored

#: Weakly labelled rows that the trees are fitted on, about at most; all rows are scored.
LABELLED = 20_000
#: A word is common if it is in this share of the documents of a language, one with so many documents and such a share of all.
COMMON_SHARE, LANGUAGE_DOCUMENTS, LANGUAGE_SHARE = 0.4, 50, 0.005

STATISTICS = (
    "words", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share", "digit_ratio", "upper_ratio", "blank_ratio",
    "unique_word_ratio", "longest_word", "words_a_line", "repeated_line_share",
    # the share of all characters that lie in lines of a kind
    "in_ended", "in_common", "in_few_words", "in_digits", "in_symbols", "in_blanks", "in_long_words", "in_same_words", "in_small_start", "in_sign_start",
    "in_sentences", "in_scraps",
)

#: What a line ends in, and what may follow it; blanks may stand anywhere among these.
ENDS, CLOSERS = ".!?…:;", "\")]»”’'"


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _spoken(text: Column) -> Column:
    """Words in small letters without signs; there may be an empty one."""
    return F.split(F.lower(text), r"[^\p{L}'’]+")


def _filled(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def common_words(documents: DataFrame, text: str = "text", lang: str = "lang") -> list[str]:
    """The words in COMMON_SHARE of the documents of a language, in order.

    Counted over all documents. Only these words reach the driver: as each is in two fifths of a language's
    documents, there are at most two and a half times as many as a document of it has different words on average.
    """
    label = F.col(lang) if lang in documents.columns else F.lit(None).cast("string")
    rows = documents.select(label.alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("t <> ''")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).where("lang is not null").orderBy(F.desc("n")).limit(1 + int(1 / LANGUAGE_SHARE)).collect()
    total = rows.count()
    large = {r["lang"]: r["n"] for r in sizes if r["n"] >= max(LANGUAGE_DOCUMENTS, LANGUAGE_SHARE * total)}
    if large:
        rows = rows.where(F.col("lang").isin(*large))
        least = F.create_map(*[F.lit(x) for k, n in large.items() for x in (k, math.ceil(COMMON_SHARE * n))])[F.col("lang")]
    else:
        rows, least = rows.withColumn("lang", F.lit("")), F.lit(math.ceil(COMMON_SHARE * total))
    words = rows.select("lang", F.explode(F.array_distinct(_spoken(F.col("t")))).alias("w")).where("w <> ''")
    seen = words.groupBy("lang", "w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sorted({r["w"] for r in seen.select("w").collect()})


def statistics(documents: DataFrame, common: list[str], text: str = "text") -> DataFrame:
    """documents with a column for each of STATISTICS."""
    known = (lambda w: w.isin(*common)) if common else (lambda w: F.lit(False))
    t = F.coalesce(F.col(text), F.lit(""))
    d = documents.withColumn("_t", t).withColumn("_a", F.regexp_replace("_t", r"\p{L}+", "")).withColumn("_b", F.regexp_replace("_a", r"\p{N}+", ""))
    d = d.withColumn("_c", F.regexp_replace("_b", r"\s+", "")).withColumn("_w", _filled(F.split("_t", r"\s+")))
    even = lambda c: F.when(F.col(c).rlike(r"[\t\r\u00a0]"), F.translate(c, "\t\r\u00a0", "   ")).otherwise(F.col(c))
    by_line = F.arrays_zip(*[F.split(even(c), "\n").alias(n) for c, n in (("_t", "x"), ("_a", "a"), ("_b", "b"))])

    # a step after the other, so that each is worked out once a line
    def tidy(z: Column) -> Column:
        return F.struct(
            F.rtrim(F.ltrim(z["x"], F.lit(" >"))).alias("x"), F.rtrim(F.ltrim(z["b"], F.lit(" >"))).alias("rest"), (F.length(z["a"]) - F.length(z["b"])).alias("digits")
        )

    def parted(z: Column) -> Column:
        symbols = F.length(F.replace(z["rest"], F.lit(" "), F.lit("")))
        return F.struct(
            z["x"].alias("x"), F.length(z["x"]).alias("n"), _filled(F.split(z["x"], " ")).alias("words"), z["digits"].alias("digits"), symbols.alias("symbols"),
            (F.length(z["rest"]) - symbols).alias("blanks"), F.left(z["x"], F.lit(1)).alias("first"), F.size(F.filter(_spoken(z["x"]), known)).alias("common"),
            F.right(F.rtrim(z["x"], F.lit(" " + CLOSERS)), F.lit(1)).isin(*ENDS).alias("ended"),
        )

    def counts(z: Column) -> Column:
        kept = [z[k].alias(k) for k in ("x", "n", "digits", "symbols", "blanks", "common", "ended")]
        return F.struct(
            *kept, F.size(z["words"]).alias("words"), F.size(F.array_distinct(z["words"])).alias("different"), F.array_max(F.transform(z["words"], F.length)).alias("longest"),
            (F.upper(z["first"]) != z["first"]).alias("small"), (F.upper(z["first"]) == F.lower(z["first"])).alias("sign"),
        )

    full = F.filter(F.transform(by_line, tidy), lambda z: z["x"] != "")
    d = d.withColumn("_s", F.transform(F.transform(full, parted), counts))
    n_lines, n_words, n_chars = F.size("_s"), F.size("_w"), F.length("_t")
    line_chars = F.aggregate("_s", F.lit(0), lambda a, s: a + s["n"])
    total = lambda field: F.aggregate("_s", F.lit(0), lambda a, s: a + s[field])
    spoken = lambda s: s["common"] >= 0.08 * s["words"]

    def share(kind) -> Column:
        return _ratio(F.aggregate("_s", F.lit(0), lambda a, s: a + F.when(kind(s), s["n"]).otherwise(0)), line_chars)

    lines = F.transform("_s", lambda s: s["x"])
    out = {
        "words": n_words.cast("double"),
        "mean_word_length": _ratio(n_chars - F.length("_b") + F.length("_c"), n_words),
        "symbol_ratio": _ratio(F.length("_c"), n_chars),
        "punctuated_line_share": _ratio(F.size(F.filter("_s", lambda s: s["ended"])), n_lines),
        "common_word_share": _ratio(total("common"), n_words),
        "digit_ratio": _ratio(F.length("_a") - F.length("_b"), n_chars),
        "upper_ratio": _ratio(n_chars - F.length(F.regexp_replace("_t", r"\p{Lu}+", "")), n_chars),
        "blank_ratio": _ratio(F.length("_b") - F.length("_c"), n_chars),
        "unique_word_ratio": _ratio(total("different"), n_words),
        "longest_word": F.coalesce(F.array_max(F.transform("_s", lambda s: s["longest"])), F.lit(0)).cast("double"),
        "words_a_line": _ratio(n_words, n_lines),
        "repeated_line_share": F.when(n_lines > 0, 1 - _ratio(F.size(F.array_distinct(lines)), n_lines)).otherwise(0.0),
        "in_ended": share(lambda s: s["ended"]),
        "in_common": share(spoken),
        "in_few_words": share(lambda s: s["words"] <= 3),
        "in_digits": share(lambda s: s["digits"] >= 0.1 * s["n"]),
        "in_symbols": share(lambda s: s["symbols"] >= 0.1 * s["n"]),
        "in_blanks": share(lambda s: s["blanks"] >= 0.25 * s["n"]),
        "in_long_words": share(lambda s: s["longest"] >= 25),
        "in_same_words": share(lambda s: (s["words"] >= 5) & (s["different"] <= 0.5 * s["words"])),
        "in_small_start": share(lambda s: s["small"]),
        "in_sign_start": share(lambda s: s["sign"]),
        "in_sentences": share(lambda s: s["ended"] & spoken(s) & (s["words"] >= 4)),
        "in_scraps": share(lambda s: ~s["ended"] & ~spoken(s)),
    }
    return d.withColumns(out).drop("_t", "_a", "_b", "_c", "_w", "_s")


# ---- weak labels, by the shapes of lines ----

_BULLET = r"^(?:[-*•·–—▪o]|\d{1,3}[.)]|\(?[a-z]\))\s+\S"
#: Words with strange signs inside, counted over a line: few in prose, so that few matches are kept.
_STRANGE = r"""(?<!\S)(?![("“«„‘'\[¿¡]*+\p{L}[\p{L}'’\-]*+[.,;:!?…)"”»’'\]]*+(?!\S))\S++"""
_RULE = r"^[|\-+=: ]{3,}$"
#: Shapes of table lines, each looked for only in lines that hold its mark.
_TABLES = (
    ("|", r"\|[^|]*\||" + _RULE),
    ("   ", r"\S {3,}\S+(?: {2,}\S+)+"),
    (";", r"^[^;]*+(?:;[^;]*+)*;\s*-?\d+(?:[.,]\d+)?$"),
    (",", r"^[^;,]*+(?:,[^;,]*+)+,\s*-?\d+(?:\.\d+)?$"),
    ("....", r"\.{4,}\s*\d*$"),
    ("---", _RULE),
    ("===", _RULE),
)
#: A word four times in a row and more.
_AGAIN = r"(?:(?<=\s)|^)(\S++)(?:\s+\1(?=\s|$)){3,}"


def weak_label(documents: DataFrame, common: list[str], text: str = "text") -> DataFrame:
    """documents with `label`: 1 junk, 0 prose, null where the rules abstain; and `odd_share`, which they go by."""
    known = (lambda w: w.isin(*common)) if common else (lambda w: F.lit(False))
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.transform(F.split(t, r"\n"), lambda x: F.regexp_replace(F.trim(x), r"^[>\s]+", "")), lambda x: F.trim(x) != "")

    def shaped(x: Column) -> Column:
        n = F.length(x)
        table = x.contains("\t")
        for mark, pattern in _TABLES:
            table |= x.contains(mark) & x.rlike(pattern)
        marked = x.contains("<") | x.contains("{") | x.contains("&")
        markup = marked & (F.length(F.regexp_replace(x, r"<[^<>]*>|\{[^{}]*\}|&[a-z]+;", "")) < n * 0.7)
        commas = F.floor((n - F.length(F.replace(x, F.lit(", "), F.lit("")))) / 2)
        return F.struct(
            x.alias("x"), n.alias("n"), F.size(_filled(F.split(x, r"\s+"))).alias("words"), F.right(F.rtrim(x, F.lit(" \t\r\u00a0" + CLOSERS)), F.lit(1)).isin(*ENDS).alias("ended"),
            (table | markup).alias("tabular"), F.regexp_count(x, F.lit(_STRANGE)).alias("strange"), ((n >= 20) & x.rlike(r"(?<!\S)\S{36}|^\S{20,}$")).alias("machine"), (commas + 1).alias("between"),
            F.size(F.filter(_spoken(x), known)).alias("common"),
        )

    def odd(s: Column) -> Column:
        x, words = s["x"], s["words"]
        bare = (words <= 4) & ~s["ended"] & ~x.rlike(r"[,\-]$")
        # names or things one after another: three or more parts of about two words each
        roll = (s["between"] >= 3) & (words <= 2.6 * s["between"]) & (s["common"] <= 0.1 * words)
        listed = bare | ((~s["ended"] | (words <= 6)) & x.rlike(_BULLET)) | roll
        return s["tabular"] | listed | s["machine"] | (s["strange"] > 0.45 * words)

    d = documents.withColumn("_s", F.transform(F.transform(lines, shaped), lambda s: F.struct(s["n"].alias("n"), odd(s).alias("odd"))))
    line_chars = F.aggregate("_s", F.lit(0), lambda a, s: a + s["n"])
    by_line = _ratio(F.aggregate("_s", F.lit(0), lambda a, s: a + F.when(s["odd"], s["n"]).otherwise(0)), line_chars)
    again = _ratio(F.length(t) - F.length(F.regexp_replace(t, _AGAIN, "")), F.length(t))
    spoken = _filled(_spoken(t))
    d = d.withColumn("odd_share", F.greatest(by_line, again)).withColumn("_words", F.size(spoken)).withColumn("_known", F.size(F.filter(spoken, known)))
    short = F.size(_filled(F.split(t, r"\s+"))) <= 12
    junk = (F.col("odd_share") > 0.62) & ~short
    prose = (F.col("odd_share") < 0.38) & (short | (F.col("_known") > 0.12 * F.col("_words")))
    return d.withColumn("label", F.when(junk, 1.0).when(prose, 0.0)).drop("_s", "_words", "_known")


# ---- the trees ----

_SHARES = tuple(c for c in STATISTICS if c.endswith(("_share", "_ratio")) or c.startswith("in_"))


def _assembled(stats: DataFrame) -> DataFrame:
    """stats with `features`: shares in hundredths, so that trees weigh every one of their thresholds.

    Trees bin a column by its quantiles, and nearly all documents have shares of 0 or 1: in full, the few in
    between would share a bin with either.
    """
    rows = stats.withColumn("_f", F.struct(*[(F.round(c, 2) if c in _SHARES else F.col(c)).alias(c) for c in STATISTICS]))
    named = rows.select(*stats.columns, *[F.col(f"_f.{c}").alias(f"_{c}") for c in STATISTICS])
    vectors = VectorAssembler(inputCols=[f"_{c}" for c in STATISTICS], outputCol="features", handleInvalid="keep")
    return vectors.transform(named).drop(*[f"_{c}" for c in STATISTICS])


def _raw(model: GBTClassificationModel, stats: DataFrame) -> DataFrame:
    return model.transform(_assembled(stats)).withColumn("raw", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _mixed(weak: DataFrame) -> DataFrame:
    """Text and label of texts of either kind put together, as far as one clearly outweighs the other.

    Over the bounded sample: its rows are numbered in one task.
    """
    numbered = lambda kind, name: weak.where(F.col("label") == kind).select(
        F.col("text").alias(name), F.row_number().over(Window.orderBy(F.xxhash64("text", F.lit("mixed")), "text")).alias("n")
    )
    both = numbered(0.0, "prose").join(numbered(1.0, "junk"), "n")
    share = F.length("junk") / (F.length("junk") + F.length("prose"))
    text = F.when(F.col("n") % 2 == 0, F.concat_ws("\n\n", "prose", "junk")).otherwise(F.concat_ws("\n\n", "junk", "prose"))
    return both.select(text.alias("text"), F.when(share > 0.6, 1.0).when(share < 0.4, 0.0).alias("label")).where("label is not null")


def fit(documents: DataFrame, common: list[str], labelled: int = LABELLED) -> GBTClassificationModel:
    """Trees fitted on weakly labelled rows, those whose text's hash lies below the share that makes `labelled`."""
    spark = documents.sparkSession
    share = min(1.0, labelled / max(1, documents.count()))
    # a bounded number of rows, spread over the cores whatever files they come from
    drawn = documents.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).repartition(32, F.xxhash64("text"))
    # stored before any condition on the label: pushed down, that would have every rule worked out once more
    weak = stored(weak_label(drawn, common).select("text", "label"), "weak").where("label is not null")
    # a third of the prose in short lines: how it is broken into lines must not decide
    broken = F.when((F.col("label") == 0) & (F.pmod(F.xxhash64("text", F.lit("lines")), F.lit(3)) == 0), F.regexp_replace("text", r"(\S.{40,60}?) ", "$1\n"))
    weak = weak.withColumn("text", F.coalesce(broken, "text"))
    weak = weak.unionByName(_mixed(weak))
    taught = spark.createDataFrame([(t, float(j)) for t, j in taught_texts()], "text string, label double")
    sample = stored(statistics(weak.unionByName(taught), common).select("label", *STATISTICS), "labelled").coalesce(4).persist()
    trees = GBTClassifier(maxIter=16, maxDepth=5, stepSize=0.3, minInstancesPerNode=2, maxBins=128, seed=11, labelCol="label")
    try:
        return trees.fit(_assembled(sample))
    finally:
        sample.unpersist()


def calibrate(raw: list[float], truth: list[int], steps: int = 200) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a raw + b))), by Newton steps on the log-likelihood."""
    n1 = sum(truth)
    n0 = len(truth) - n1
    hi, lo = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)  # targets that keep a separable holdout finite
    a, b = 1.0, 0.0
    for _ in range(steps):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y in zip(raw, truth, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            e, w = p - (hi if y else lo), max(1e-9, p * (1 - p))
            g0, g1 = g0 + e * x, g1 + e
            h00, h01, h11 = h00 + w * x * x, h01 + w * x, h11 + w
        h00, h11 = h00 + 1e-6, h11 + 1e-6
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, the statistics, junk_probability and junk of every document (doc_id, text, and lang if there)."""
    spark = documents.sparkSession
    common = common_words(documents)
    model = fit(documents, common)
    checked = spark.createDataFrame([(t, j) for t, j in checked_texts()], "text string, truth int")
    scored = _raw(model, statistics(checked, common)).select("raw", "truth").collect()
    a, b = calibrate([r["raw"] for r in scored], [r["truth"] for r in scored])
    probability = 1 / (1 + F.exp(-(F.col("raw") * a + b)))
    # stored, as a condition on the verdict, pushed down, would have each count worked out wherever it is used
    stats = stored(statistics(documents.select("doc_id", "text"), common).drop("text"), "text-statistics")
    out = _raw(model, stats).withColumn("junk_probability", F.when(F.col("words") > 0, probability).otherwise(0.0))
    return out.withColumn("junk", F.col("junk_probability") > 0.5).drop("raw")
