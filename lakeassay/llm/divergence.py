"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are
compared with those of its language by the Jensen-Shannon distance. References are
sums over all documents of a language that pass the base rules, made a second time
without those far from the first. A document too short for a histogram to mean
anything is not judged by it.

Base rules: at least ``min_words`` words, and at most ``max_repeat`` of words
within 8-word windows that occur twice or more in the text.

Edge cases: null and empty texts have counts of 0 and fail the base; a null or
unknown language is one of its own; a language whose reference has fewer than
``min_reference`` words judges nothing; rows are judged one by one, so repeated
rows agree; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MAX_LANGUAGES = 10_000
_GAP = r"[\x20\x09-\x0D]+"
_WHITE = " \t\n\x0b\x0c\r"

# The most common words of each language; they only name the bins.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "des", "ist", "ein", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"),
}
#: Character classes: signs outside ordinary prose, each a bin; letters by case, digits and all else.
CLASSES = ("upper", "digit", "symbol", "bang", "stop", "white", "rest")


def counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One row a document: base counts, class counts and common-word counts, in one pass over its text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), t.alias("t"))
    ws = F.filter(F.split("t", _GAP), lambda w: w != "")
    d = base.withColumn("ws", ws)
    # Line by line: those with a word, and those of them that are first of their kind.
    solid = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "")
    n = F.size("ws").cast("long")
    hashes = F.transform("ws", lambda w: F.xxhash64(w))
    d = d.withColumn("joined", F.array_join("ws", "  ")).withColumn("n_words", n).withColumn("hs", hashes).withColumn("solid", solid)
    lower = F.concat(F.lit(" "), F.lower("joined"), F.lit(" "))
    words = F.lit(None)
    for lang, common in COMMON_WORDS.items():
        words = F.when(F.col("lang") == lang, F.array(*map(F.lit, common))).otherwise(words)
    d = d.withColumn("low", lower).withColumn("common", F.coalesce(words, F.array(*map(F.lit, COMMON_WORDS["en"]))))
    length = F.length("t")
    upper, digit, symbols, bang, stop = (F.regexp_count("t", F.lit(c)).cast("long") for c in ("[A-Z]", "[0-9]", "[#*$%&|<>]", "[!?]", "[.,;:]"))
    word_chars = (F.length("joined") - 2 * F.greatest(n - 1, F.lit(0))).cast("long")
    white = length.cast("long") - word_chars
    low = F.col("low")
    hits = F.transform("common", lambda w: ((F.length(low) - F.length(F.replace(low, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)).cast("long"))
    return d.select(
        "doc_id", "lang", "n_words", repeat_words(F.col("hs")).alias("n_repeat_words"),
        word_chars.alias("word_chars"), symbols.alias("n_symbols"),
        (F.size("solid") - F.size(F.array_distinct("solid"))).cast("long").alias("n_dup_lines"),
        F.array(upper, digit, symbols, bang, stop, white).alias("classes"), length.cast("long").alias("n_chars"), hits.alias("hits"),
    )


def repeat_words(hs: Column) -> Column:
    """Words within windows of 8 that occur twice or more, the first occurrence included.

    Windows are hashes over 8 word hashes. Only if some are equal are they sorted with
    their places; each place whose neighbour is equal covers up to the next covered place.
    """
    def windows(h: Column) -> Column:
        # Of pairs' hashes, so that each is four look-ups and not a copy of eight words.
        pairs = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        all_ = _let(pairs, lambda p: F.transform(p, lambda x, i: F.xxhash64(x, F.get(p, i + 2), F.get(p, i + 4), F.get(p, i + 6))))
        return F.slice(all_, F.lit(1), F.size(h) - (WINDOW - 1))

    def covered(w: Column) -> Column:
        ranked = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return _let(ranked, places)

    def places(r: Column) -> Column:
        at = lambda i: F.get(r, i)
        some = F.filter(F.transform(r, lambda x, i: F.when((at(i - 1)["w"] == x["w"]) | (at(i + 1)["w"] == x["w"]), x["i"])), lambda x: x.isNotNull())
        return _let(F.array_sort(some), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    found = _let(windows(hs), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))
    return F.when(F.size(hs) > WINDOW, found).otherwise(F.lit(0)).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shares(counts_: Column, total: Column) -> Column:
    """Bins and the rest as shares of a total."""
    rest = total - F.aggregate(counts_, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.transform(F.concat(counts_.cast("array<double>"), F.array(F.greatest(rest, F.lit(0.0)))), lambda x: F.try_divide(x, total))


def js_distance(p: Column, q: Column) -> Column:
    """The square root of the Jensen-Shannon divergence (base 2) of two histograms, 0 to 1."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    each = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) / 2 + part(y, (x + y) / 2) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x)))


def references(counted: DataFrame, n_bins: int) -> DataFrame:
    """Histograms of each language over its documents that pass the base, each document weighing its size."""
    own = counted.where(~F.col("base_failed"))
    sums = [F.sum(F.get("classes", F.lit(j))).cast("double").alias(f"c{j}") for j in range(len(CLASSES) - 1)] + [F.sum(F.get("hits", F.lit(j))).cast("double").alias(f"w{j}") for j in range(n_bins)]
    r = own.groupBy("lang").agg(F.sum("n_words").cast("double").alias("ref_words"), F.sum("n_chars").cast("double").alias("ref_chars"), *sums)
    return r.select("lang", "ref_words", _shares(F.array(*(f"c{j}" for j in range(len(CLASSES) - 1))), F.col("ref_chars")).alias("ref_classes"), _shares(F.array(*(f"w{j}" for j in range(n_bins))), F.col("ref_words")).alias("ref_common"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 20, max_repeat: float = 0.30, min_chars: int = 300, min_common: int = 100, min_reference: int = 2000, max_class: float = 0.23, max_common: float = 0.275) -> DataFrame:
    """doc_id, the base counts, class_distance, common_distance, base_failed and kept, for every document.

    ``min_chars`` and ``min_common`` (words) guard the two distances: below them a
    distance is null and judges nothing.
    """
    from . import store

    n_bins = len(next(iter(COMMON_WORDS.values())))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeat) * F.col("n_words"))
    counted = store.write(counts(docs, id_col, text_col, lang_col).withColumn("base_failed", failed), "counts")

    def measured(among: DataFrame) -> DataFrame:
        # One row a language: sent to every task if they are counted to be few, else joined like any table.
        known = store.write(references(among, n_bins), "references")
        judged = counted.join(F.broadcast(known) if known.count() <= MAX_LANGUAGES else known, "lang", "left")
        enough = F.coalesce(F.col("ref_words") >= min_reference, F.lit(False))
        by_class = F.when(enough & (F.col("n_chars") >= min_chars), js_distance(_shares(F.col("classes").cast("array<double>"), F.col("n_chars").cast("double")), F.col("ref_classes")))
        by_common = F.when(enough & (F.col("n_words") >= min_common), js_distance(_shares(F.col("hits").cast("array<double>"), F.col("n_words").cast("double")), F.col("ref_common")))
        return judged.select(*counted.columns, by_class.alias("class_distance"), by_common.alias("common_distance"))

    # Junk takes part in the first references only; the second ones are of documents near the first.
    near = (F.col("class_distance") <= max_class) & (F.col("common_distance") <= max_common)
    out = measured(measured(counted).where(near)).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "common_distance", "base_failed")
    odd = F.coalesce(F.col("class_distance") > max_class, F.lit(False)) | F.coalesce(F.col("common_distance") > max_common, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~odd)
