"""Quality rules: repetition and length, then the distance of a text's histograms to its language's."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import Scratch

# Common function words by language, in the order of the word histogram.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not are at from or an this have but",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an aus er bei",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il",
}
SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5
CLASSES = ["lower", "space", "upper", "other_letter", "digit", "symbol", "mark"]


@dataclass(frozen=True)
class Limits:
    """Guards in words: shorter texts are not compared. Distances are Jensen-Shannon, 0 to 1.

    ``noise`` times the square root of bins over observations is added to a limit, as
    histograms of little text stray further from their source.
    """

    least_words: int = 10
    repeat_percent: int = 20
    guard: int = 50
    classes: float = 0.20
    words: float = 0.04
    noise: float = 0.57


def _repeats(words: str, windows: str) -> list[tuple[str, Column]]:
    """Steps to the number of words in windows that occur again; null if no window does."""
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    at = lambda a, i: F.get(a, i)
    ordered = F.when(some, F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    alike = lambda i, j: F.coalesce(at("_ordered", i)["h"] == at("_ordered", j)["h"], F.lit(False))
    again = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_ordered") - 1), lambda k: alike(k, k - 1) | alike(k, k + 1)),
        lambda k: at("_ordered", k)["i"])
    places = F.when(F.col("_ordered").isNotNull(), F.sort_array(again))
    covered = F.when(
        F.size("_places") > 0,
        F.aggregate(F.sequence(F.lit(0), F.size("_places") - 1), F.lit(0).cast("long"),
                    lambda total, k: total + F.least(F.lit(WINDOW), F.coalesce(at("_places", k) - at("_places", k - 1), F.lit(WINDOW)))))
    return [("_ordered", ordered), ("_places", places), ("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts of the base rules, and the two histograms of every text."""
    df = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.coalesce("text", F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id", "lang", "_text", lines.alias("_lines"), F.array_remove(F.split("_text", SPACE + "+"), "").alias("_words"),
        F.regexp_replace("_text", r"[a-z\x20\x09-\x0D]+", "").alias("_t1"))
    windows = F.when(F.size("_words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    known = [w for words in COMMON.values() for w in words.split()]
    common = F.concat(F.lit(" "), F.array_join(F.filter("_words", lambda w: w.isin(sorted(set(known)))), "  "), F.lit(" "))
    df = df.select(
        "doc_id", "lang", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.length("_text").cast("long").alias("_n"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("_windows"), common.alias("_common"),
        F.length("_t1").cast("long").alias("_n1"), F.regexp_replace("_t1", "[A-Z]+", "").alias("_t2"))
    for name, step in _repeats("_words", "_windows"):
        df = df.withColumn(name, step)
    df = df.drop("_windows", "_ordered", "_places")
    df = df.withColumn("_t3", F.regexp_replace("_t2", r"\p{L}+", "")).withColumn("_t4", F.regexp_replace("_t3", r"\p{N}+", ""))
    df = df.withColumn("n_symbols", (F.length("_t4") - F.length(F.regexp_replace("_t4", r"[#*$%&|<>]+", ""))).cast("long"))
    length = lambda c: F.length(c).cast("long")
    space = F.col("_n") - F.col("word_chars")
    classes = [F.col("_n") - F.col("_n1") - space, space, F.col("_n1") - length("_t2"), length("_t2") - length("_t3"),
               length("_t3") - length("_t4"), F.col("n_symbols"), length("_t4") - F.col("n_symbols")]

    def count(word: str) -> Column:
        return ((length("_common") - length(F.replace("_common", F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)).cast("long")

    words = None
    for lang, listed in COMMON.items():
        found = F.array(*[count(w) for w in listed.split()])
        words = F.when(F.col("lang") == lang, found) if words is None else words.when(F.col("lang") == lang, found)
    return df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     F.array(*classes).alias("classes"), words.alias("words"))


def with_rest(words: str) -> Column:
    """The word histogram with all other words as its last bin."""
    return F.concat(words, F.array(F.col("n_words") - F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x)))


def references(stats: DataFrame) -> DataFrame:
    """Summed histograms by language of COMMON, and of all texts under the empty name."""
    k = max(len(w.split()) for w in COMMON.values()) + 1
    rows = stats.select(F.explode(F.array(F.lit(""), "lang")).alias("ref"), "classes", with_rest("words").alias("words"))
    rows = rows.filter(F.col("ref").isin("", *COMMON))
    sums = rows.groupBy("ref").agg(
        *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))],
        *[F.sum(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(k)])
    return sums.select("ref", F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_classes"),
                       F.when(F.col("ref") != "", F.array(*[F.coalesce(f"w{i}", F.lit(0)) for i in range(k)])).alias("ref_words"))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of two histograms of counts."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: x / F.greatest(total(a), F.lit(1.0)))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(share(p), share(q), lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(terms))))


def judged(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Counts, distances and verdict of every row of ``docs`` (doc_id, text, lang).

    Each text's histograms of character classes and common words are compared to those
    of all texts of its language; texts of no listed language (or null) only by classes,
    to all texts. Texts under ``guard`` words are not compared and keep their base
    verdict; null and empty texts fail the base rules. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    stats = scratch.keep(measured(docs), "quality")
    refs = F.broadcast(references(stats))  # one row a language of COMMON, and one
    ref = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("")
    rows = stats.withColumn("_ref", ref).join(refs, F.col("_ref") == F.col("ref"), "left")
    rows = rows.withColumn("_all", F.when(F.col("words").isNotNull(), with_rest("words")))
    compared = F.col("n_words") >= limits.guard
    rows = rows.withColumn("class_distance", F.when(compared, distance("classes", "ref_classes")))
    rows = rows.withColumn("word_distance", F.when(compared & F.col("_all").isNotNull() & F.col("ref_words").isNotNull(), distance("_all", "ref_words")))
    failed = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    stray = [F.coalesce(F.col(d) > most + limits.noise * F.sqrt(F.lit(float(bins)) / F.col(n)), F.lit(False))
             for d, most, bins, n in (("class_distance", limits.classes, len(CLASSES), "word_chars"), ("word_distance", limits.words, 26, "n_words"))]
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~reduce(lambda a, b: a | b, stray)).alias("kept"), "class_distance", "word_distance")
