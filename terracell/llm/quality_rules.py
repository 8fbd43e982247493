"""Quality rules per document, and line frequencies across the documents of a host (operator 2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: white space between words
SPACE = " \t\n\x0b\x0c\r"
#: symbol characters that are counted
SYMBOLS = "#*$%&|<>"

LINES = "array<struct<hash:bigint,chars:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, SPACE, "")).cast("bigint")


def normalised(line: Column) -> Column:
    """A-Z in lower case, runs of digits as one 0, runs of white space as one space, no space at either end."""
    lowered = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, "[0-9]+", "0"), "[\\x20\\x09-\\x0D]+", " "))


def repeated_words(words: Column, size: int) -> Column:
    """Words that stand in a window of `size` words found twice or more in the array.

    Windows are compared by hash. Only texts in which one repeats are sorted: neighbours with equal hashes give the
    places, and each place covers the words up to the next place, at most `size`.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-size).alias("end")),
            lambda a, p: F.struct(
                (a["n"] + size - F.greatest(F.lit(0), a["end"] - p)).cast("bigint").alias("n"), (p + size).alias("end")
            ),
        )["n"]

    def places(by_hash: Column) -> Column:
        repeats = F.filter(
            by_hash,
            lambda x, k: ((k > 0) & (F.get(by_hash, k - 1)["hash"] == x["hash"])) | (F.get(by_hash, k + 1)["hash"] == x["hash"]),
        )
        return F.array_sort(F.transform(repeats, lambda x: x["at"]))

    def count(hashes: Column) -> Column:
        tagged = F.transform(hashes, lambda h, k: F.struct(h.alias("hash"), k.alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            let(F.array_sort(tagged), lambda by_hash: let(places(by_hash), covered))
        )

    def hashed(word_hashes: Column) -> Column:
        windows = F.sequence(F.lit(1), F.size(word_hashes) - size + 1)
        return F.transform(windows, lambda k: F.xxhash64(F.slice(word_hashes, k, size)))

    word_hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < size + 1, F.lit(0).cast("bigint")).otherwise(
        let(word_hashes, lambda h: let(hashed(h), count))
    )


def document_rules(docs: DataFrame, id_col: str, text_col: str, host_col: str, window: int = 8) -> DataFrame:
    """Counts that need nothing but the document itself, and the hashes of its distinct normalised lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    word_lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, SPACE, "") != "")
    counts = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w, window).alias("n_repeat_words")),
    )
    lines = let(
        word_lines,
        lambda ls: F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
            F.transform(
                ls, lambda line: F.struct(F.xxhash64(normalised(line)).alias("hash"), word_chars(line).alias("chars"))
            ).alias("lines"),
        ),
    )
    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host")
    )
    return picked.select(
        "doc_id",
        "host",
        word_chars(text).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        counts.alias("counts"),
        lines.alias("lines"),
        F.xxhash64(text).alias("print"),
    ).select("doc_id", "host", "word_chars", "n_symbols", "counts.*", "lines.*", "print")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_docs: int = 20,
    max_percent: int = 1,
    max_removed: float = 0.5,
) -> DataFrame:
    """Base rules on each document, then the line frequency rule across the documents of each host.

    A host's distinct documents (equal texts are one) that contain a normalised line are counted, each once a line. Lines in more than
    max_docs of them that are also more than max_percent of the host's distinct documents are removed from all of the host's
    documents, so a corpus that grows evenly keeps its verdicts, and copies of one text alone remove nothing; a document that loses more than max_removed of its word characters
    is depleted and rejected.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than min_words
    words, or more than max_repeat_percent of them in repeated 8-word windows), kept, removed_chars.

    Only hashes and lengths of lines are shuffled, partially counted. The frequent lines, a small part of all, are met by
    an equi-join whose form Spark picks by their measured size.

    Null text is a document without words, so it fails. A null host is a host of its own. Repeated rows are
    documents of their own. An empty table gives no rows. Other columns are ignored.
    """
    rules = keep(document_rules(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "quality-rules")
    # one row for each distinct text and line: copies meet in partial sums
    distinct_lines = rules.select("host", "print", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash")).distinct()
    hosts = rules.select("host", "print").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = distinct_lines.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > max_docs)
    above = counts.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
    above = above.filter(100 * F.col("docs") > max_percent * F.col("host_docs"))
    frequent = above.select(F.col("c.host").alias("f_host"), F.col("hash").alias("f_hash"))
    lines = rules.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.*")
    hit = lines.join(frequent, (F.col("hash") == F.col("f_hash")) & F.col("host").eqNullSafe(F.col("f_host")))
    removed = hit.groupBy("row").agg(F.sum("chars").alias("removed_chars"))
    removed_chars = F.coalesce(F.col("removed_chars"), F.lit(0).cast("bigint"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return rules.join(removed, "row", "left").select(
        F.col("doc_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (removed_chars <= max_removed * F.col("word_chars"))).alias("kept"),
        removed_chars.alias("removed_chars"),
    )
