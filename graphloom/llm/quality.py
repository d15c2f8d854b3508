"""Quality rules by distribution divergence.

The characters of a document fall into seven classes and its words into the common words of its language and the
rest. Both histograms are compared with those of all documents of the language by Jensen-Shannon distance. A document
with too few words for a histogram is not judged by it. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, let, words_of

#: Fixed value: the symbols that the base rule counts.
SYMBOLS = "#*$%&|<>"
#: Character classes after lower-case letters and blanks, each removed from what the former ones left.
CLASSES = (("upper", UPPER), ("digit", "0123456789"), ("symbol", SYMBOLS), ("mark", "!\"'()+,-./:;=?@[\\]^_`{}~"))
N_CLASSES = 3 + len(CLASSES)
POOL = "*"  # languages that are not listed share one reference


def class_counts(text: Column, words: Column) -> Column:
    """Array of code points by class: a-z, blanks, those of CLASSES, then all others. Null counts as empty."""
    whole = F.length(F.coalesce(text, F.lit(""))).cast("long")
    in_words = F.length(F.array_join(words, "")).cast("long")

    def step(left: Column, classes: tuple, found: list[Column]) -> Column:
        if not classes:
            return F.array(*found, F.length(left).cast("long"))
        return let(F.translate(left, classes[0][1], ""), lambda rest: step(rest, classes[1:], [*found, (F.length(left) - F.length(rest)).cast("long")]))

    other = F.regexp_replace(F.coalesce(text, F.lit("")), "[a-z \\t-\\r]+", "")  # long runs, so few matches
    return let(other, lambda left: let(in_words, lambda n: step(left, CLASSES, [n - F.length(left), whole - n])))


def _repeat_words(words: Column) -> Column:
    """Words covered by the 3-word windows that occur twice or more. Windows are told apart by a 64-bit hash."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = lambda all_, k: (F.get(all_, k + 1)["h"] == all_[k]["h"]) | (F.get(all_, k - 1)["h"] == all_[k]["h"])
        starts = let(placed, lambda p: F.transform(F.filter(F.transform(p, lambda x, k: F.when(F.coalesce(twin(p, k), F.lit(False)), x["i"])), lambda i: i.isNotNull()), lambda i: i))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
        more = lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(i - s["last"], F.lit(3))).cast("long").alias("sum"))
        return F.aggregate(F.array_sort(starts), zero, more, lambda s: s["sum"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    repeated = let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(covered(t)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(repeated)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return F.when(F.coalesce(text, F.lit("")).contains("\n"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))).otherwise(F.lit(0).cast("long"))


def _language(lang: Column, languages: Sequence[str]) -> Column:
    return F.when(lang.isin(*languages), lang).otherwise(F.lit(POOL))


def language_references(df: DataFrame, languages: Sequence[str], text: str = "text", lang: str = "lang", n_common: int = 24) -> DataFrame:
    """A row for each listed language and one for the rest: key, class shares, common words and their shares.

    Counts cover all words of all documents. Words are counted once, map side first; the classes of their characters are
    then counted a distinct word at a time, and blanks are what the words leave of the texts' lengths. At most
    len(languages) + 1 rows.
    """
    key = _language(F.col(lang), languages).alias("_key")
    words = df.select(key, F.explode(words_of(F.col(text))).alias("w")).groupBy("_key", "w").agg(F.count(F.lit(1)).alias("n"))
    lengths = df.select(key, F.length(F.coalesce(F.col(text), F.lit(""))).alias("n")).groupBy("_key").agg(F.sum("n").alias("chars"))
    counts = words.select("_key", "n", class_counts(F.col("w"), F.array("w")).alias("c"))
    sums = counts.groupBy("_key").agg(*[F.sum(F.col("n") * F.col("c")[i]).alias(f"c{i}") for i in range(N_CLASSES)], F.sum("n").alias("all"))
    sums = lengths.join(F.broadcast(sums), "_key", "left").na.fill(0)  # a row a language
    held = sum((F.col(f"c{i}") for i in range(N_CLASSES) if i != 1), F.lit(0))
    classes = sums.withColumn("c1", F.col("chars") - held)
    classes = classes.select("_key", "all", F.array(*[F.col(f"c{i}") / F.greatest("chars", F.lit(1)) for i in range(N_CLASSES)]).alias("_class_p"))
    best = words.withColumn("k", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("n"), "w"))).where(F.col("k") <= n_common)
    best = best.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("k", "w", "n"))).alias("best"))
    both = classes.join(F.broadcast(best), "_key", "left")
    rest = (F.col("all") - F.aggregate("best", F.lit(0).cast("long"), lambda s, x: s + x["n"])) / F.col("all")
    common = F.transform("best", lambda x: x["w"])
    return both.select("_key", "_class_p", common.alias("_common"), F.array_max(F.transform(common, F.length)).alias("_longest"), F.concat(F.transform("best", lambda x: x["n"] / F.col("all")), F.array(rest)).alias("_word_p"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two arrays of shares."""

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b)) / 2).otherwise(F.lit(0.0))

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a)), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def quality_rules(
    df: DataFrame,
    languages: Sequence[str] = ("en", "de", "fr", "es"),
    text: str = "text",
    lang: str = "lang",
    min_words: int = 50,
    min_common: int = 100,
    max_class_distance: float = 0.33,
    max_word_distance: float = 0.45,
    n_common: int = 24,
) -> DataFrame:
    """df with _q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    Base rules reject fewer than 50 words and more than half of the words in repeated 3-word windows. Class distances
    count from min_words words on, word distances from min_common on; below, they are null and don't reject. A null or
    empty text has no words and is rejected; a null or unlisted language is compared with the pooled reference of such;
    equal texts of a language get equal values; an empty table gives no rows. Other columns stay as they are, but for one
    named _q, which is replaced.
    """
    key = "_q_key"
    refs = language_references(df, languages, text, lang, n_common).withColumnRenamed("_key", key)
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "_q"]).alias("_q_row"), F.col(text), _language(F.col(lang), languages).alias(key))
    out = out.join(F.broadcast(refs), key, "left")

    def verdict(words: Column, n: Column) -> Column:
        n_words = F.size(words).cast("long")
        chars = F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x)
        share = F.transform(n, lambda x: x / F.greatest(chars, F.lit(1)))
        common = lambda c: F.transform(F.col("_common"), lambda w: (F.size(c) - F.size(F.array_remove(c, w))).cast("long"))
        counted = let(F.filter(words, lambda w: (F.length(w) <= F.col("_longest")) & F.array_contains(F.col("_common"), w)), lambda c: F.concat(common(c), F.array((n_words - F.size(c)).cast("long"))))
        word_distance = F.when((n_words >= min_common) & F.col("_common").isNotNull(), _distance(F.transform(counted, lambda x: x / n_words), F.col("_word_p")))
        class_distance = F.when(n_words >= min_words, _distance(share, F.col("_class_p")))
        return F.struct(n_words.alias("n_words"), (chars - n[1]).alias("word_chars"), n[4].alias("n_symbols"), _dup_lines(F.col(text)).alias("n_dup_lines"), _repeat_words(words).alias("n_repeat_words"), class_distance.alias("class_distance"), word_distance.alias("word_distance"))

    def judged(q: Column) -> Column:
        failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
        diverges = (F.coalesce(q["class_distance"], F.lit(0.0)) > max_class_distance) | (F.coalesce(q["word_distance"], F.lit(0.0)) > max_word_distance)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance")
        return F.struct(*[q[x].alias(x) for x in names], failed.alias("base_failed"), (~failed & ~diverges).alias("kept"))

    found = let(let(words_of(F.col(text)), lambda w: let(class_counts(F.col(text), w), lambda n: verdict(w, n))), judged)
    return out.select("_q_row.*", found.alias("_q"))
