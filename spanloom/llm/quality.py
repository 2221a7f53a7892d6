"""Quality rules by distribution divergence, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, joined, stored

#: Words in a language's reference histogram; the rest share one bin.
COMMON = 24
#: Guards: texts with fewer words than these are too short for either comparison.
MIN_CLASS_WORDS, MIN_COMMON_WORDS = 20, 100
#: Jensen-Shannon distances (base 2, 0 to 1) above which a text's histogram isn't its language's: of labelled documents those of good
#: quality stay below 0.28 on both, most symbol, capital and table junk lies above 0.34.
MAX_CLASS, MAX_COMMON = 0.31, 0.34
SYMBOLS = "#*$%&|<>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in 3-word windows found twice or more in it, the first included."""
    n = F.size(words)

    def covered(grams: Column) -> Column:
        # Equal windows are neighbours after sorting; positions of those that have an equal neighbour, in order.
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        hit = lambda s: F.filter(F.transform(s, lambda x, k: F.when((x.g == F.get(s, k - 1).g) | (x.g == F.get(s, k + 1).g), x.i)), lambda i: i.isNotNull())
        gaps = lambda at: F.aggregate(F.transform(at, lambda i, k: F.coalesce(F.least(F.lit(3), F.get(at, k + 1) - i), F.lit(3))), F.lit(0), lambda a, x: a + x)
        return let(ordered, lambda s: let(F.array_sort(hit(s)), gaps))

    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    # Equal windows have equal hashes: only a text in which hashes repeat needs the windows themselves.
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    grams = F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i + 1, 3)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(grams, covered)).otherwise(0))


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts of equal length; 0 if either is all zero."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    distance = lambda n, m: F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(p, q, lambda a, b: (part(a / n, (a / n + b / m) / 2) + part(b / m, (a / n + b / m) / 2)) / 2))))
    return let(total(p), lambda n: let(total(q), lambda m: F.when((n > 0) & (m > 0), distance(n, m)).otherwise(0.0)))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, words and hits: the COMMON most frequent lower-cased words of each language's documents with their counts,
    by falling count, and all_words. All documents count; the table has a row a language."""
    counted = docs.select(F.col(lang_col).cast("string").alias("lang"), F.explode(_words(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counted = stored(counted, "words")
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    top = counted.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= COMMON)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
    total = counted.groupBy("lang").agg(F.sum("n").alias("all_words"))
    return total.alias("t").join(top.alias("c"), F.col("t.lang").eqNullSafe(F.col("c.lang"))).select("t.lang", F.col("top.word").alias("words"), F.col("top.n").alias("hits"), "all_words")


def base_statistics(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row of docs: the base statistics, and its histograms of character classes (`classes`) and of the words in
    its language's row of `words` (`common`, with one more bin for all other words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    code = lambda k: F.char(k + 48)  # noqa: E731  a character that stands for the k-th common word
    coded = words.select("lang", F.map_from_arrays("words", F.transform("words", lambda _, k: code(k))).alias("code_of"), F.transform("words", lambda _, k: code(k)).alias("codes"), F.array_max(F.transform("words", F.octet_length)).alias("longest"))
    rows = joined(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text")).alias("a"), coded.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")), "left", 128 * COMMON + 2 * COMMON * F.col("longest")).select("doc_id", "a.lang", "text", "code_of", "codes", "longest")

    def measured(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        hits = F.array_join(F.transform(F.transform(words, F.lower), lambda w: F.when(F.octet_length(w) <= F.col("longest"), F.element_at("code_of", w))), "")
        counts = lambda s: F.concat(F.transform("codes", lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double")), F.array((n - F.length(s)).cast("double")))
        return F.struct(n.alias("n_words"), F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"), repeated_words(words).cast("bigint").alias("n_repeat_words"), let(hits, counts).alias("common"))

    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    # What isn't a lower-case letter or a space is little, and all the classes are in it.
    rare = F.regexp_replace("text", r"[a-z \n]+", "")
    count = lambda t, pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("bigint")
    patterns = {"n_symbols": f"[{SYMBOLS}]+", "upper": r"\p{Lu}+", "digit": r"\p{N}+", "mark": r"[!-/:-@\[-`{-~]+"}
    classed = let(rare, lambda t: F.struct(*(count(t, p).alias(name) for name, p in patterns.items())))
    found = rows.select("doc_id", "lang", let(_words(F.col("text")), measured).alias("m"), dup.alias("n_dup_lines"), classed.alias("c")).select("doc_id", "lang", "m", "n_dup_lines", "c.*")
    # Characters of words: symbols, other punctuation, digits, upper case, and all the rest.
    classes = [F.col("n_symbols"), F.col("mark") - F.col("n_symbols"), F.col("digit"), F.col("upper"), F.greatest(F.lit(0), F.col("m.word_chars") - F.col("mark") - F.col("digit") - F.col("upper"))]
    return found.select("doc_id", "lang", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", F.array(*(c.cast("double") for c in classes)).alias("classes"), "m.common")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base statistics of each text and whether it is like its language.

    Rows: one per input row with doc_id (the id), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance and common_distance. A null text has no words: base_failed, not kept. Rows of a null language are
    compared with each other, like a language's. Repeated rows repeat; an empty table gives none; other columns are not looked at.

    Each language's reference is the sum of its rows' histograms: of character classes, and of its COMMON most frequent words (the rest in
    one bin), over all documents. A text fails if a Jensen-Shannon distance passes MAX_CLASS or MAX_COMMON; texts of
    fewer words than the guards aren't compared. Word counts and class sums are combined before the shuffle; texts are not shuffled.
    """
    words = stored(references(docs, text_col, lang_col), "references")
    stats = stored(base_statistics(docs, words, id_col, text_col, lang_col), "statistics")
    sums = stats.groupBy("lang").agg(F.array(*(F.sum(F.col("classes")[k]) for k in range(5))).alias("ref_classes"))
    hits = F.transform("hits", lambda n: n.cast("double"))
    ref = sums.alias("s").join(words.alias("w"), F.col("s.lang").eqNullSafe(F.col("w.lang")), "left").select(F.col("s.lang").alias("ref_lang"), "ref_classes", F.concat(hits, F.array(F.col("all_words") - _sum(hits))).alias("ref_common"))
    found = joined(stats, stored(ref, "references"), stats.lang.eqNullSafe(F.col("ref_lang")), "left", 32 * COMMON)
    distance = lambda a, b, least: F.when(F.col("n_words") >= least, F.coalesce(_divergence(F.col(a), F.col(b)), F.lit(0.0))).otherwise(0.0)
    found = found.withColumns({
        "class_distance": distance("classes", "ref_classes", MIN_CLASS_WORDS),
        "common_distance": distance("common", "ref_common", MIN_COMMON_WORDS),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })
    kept = ~F.col("base_failed") & (F.col("class_distance") <= MAX_CLASS) & (F.col("common_distance") <= MAX_COMMON)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "common_distance")
