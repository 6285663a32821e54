"""Query expansion by a dictionary table (word, synonyms): related words beside a query's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that are never expanded.
NEVER = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "can", "this", "that",
    "these", "those", "i", "you", "he", "she", "it", "we", "they",
    "what", "which", "who", "whom", "whose", "where", "when", "why", "how",
    "all", "each", "every", "both", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "also", "now", "here", "there",
)
EXPANDED, ADDED, KNOWN = 3, 2, 5


def others(synonyms: Column, word: Column) -> Column:
    """A word's synonyms in lower case, without itself, each once, in order."""
    return F.array_sort(F.array_remove(F.array_distinct(F.transform(synonyms, lambda s: F.lower(s))), word))


def expanded(queries: DataFrame, key: str, query: str, dictionary: DataFrame) -> DataFrame:
    """(key, query) with two synonyms behind each of the first three words that have some; words are joined, not looped."""
    words = queries.select(key, F.posexplode(F.split(query, " ")).alias("at", "shown"))
    words = words.withColumn("word", F.lower("shown"))
    joined = words.join(dictionary.select(F.lower("word").alias("word"), "synonyms"), "word", "left")
    able = (F.length("word") >= 3) & ~F.col("word").isin(*NEVER) & F.col("synonyms").isNotNull()
    so_far = F.sum(F.when(able, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("at"))
    chosen = F.slice(F.slice(others(F.col("synonyms"), F.col("word")), 1, KNOWN), 1, ADDED)
    more = F.when(able & (so_far <= EXPANDED), F.concat_ws(" ", "shown", F.array_join(chosen, " "))).otherwise(F.col("shown"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])
    return joined.withColumn("x", more).groupBy(key).agg(F.array_join(listed, " ").alias(query))


def related(lists: DataFrame, key: str, words: str, dictionary: DataFrame, include_original: bool = True) -> DataFrame:
    """(key, related): all synonyms of a list's words, with the words themselves, as a sorted set."""
    own = lists.select(key, F.explode_outer(F.transform(words, lambda w: F.lower(w))).alias("word"))
    found = own.join(dictionary.select(F.lower("word").alias("word"), "synonyms"), "word", "left")
    some = F.coalesce(others(F.col("synonyms"), F.col("word")), F.array().cast("array<string>"))
    both = F.array_union(F.array_compact(F.array("word")), some) if include_original else some
    return found.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(both)))).alias("related"))
