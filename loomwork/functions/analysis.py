"""The keyword analyser (terms without stop words, English stems) and the hashing embedder, as column expressions.

The embedder is a deterministic stand-in for a remote model. Both work inside a row: no term becomes a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.session import spread, staged

#: Words of English grammar that keyword search leaves out: articles, pronouns, prepositions, conjunctions, auxiliaries.
STOP_WORDS = (
    "a an the i me my mine we us our ours you your yours he him his she her hers it its they them their theirs this that these "
    "those who whom whose which what when where why how am is are was were be been being do does did have has had can could "
    "may might must shall should will would and or but nor if then than so as at by for from in into of off on onto out over "
    "to up with about after before between through under not no"
).split()
DIMENSIONS = 64


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, two characters and more, without stop words; in order, with repeats."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


#: What a stem is: the word without its longest ending of these, three letters at least, and without a doubled consonant.
ENDING = (
    "^(.{3,}?)(?:izations?|ationally|ational|ations?|fulness|ousness|iveness|ingly|edly|ements?|ments?|nesses|ness|ables?|ibles?|"
    "ances?|ences?|ings?|ions?|ities|ity|ies|ers?|est|ed|es|ly|al|ic|s|e|y)$"
)
DOUBLED = "^(.{2,})(?:(b)b|(d)d|(f)f|(g)g|(m)m|(n)n|(p)p|(t)t)$"


def stem(word: Column) -> Column:
    """An English stem by its endings alone, so that forms of a word meet, which is what a search for all words needs.

    It is no dictionary, and not the stemmer of any search server. The first three letters of a word never change.
    """
    short = F.regexp_replace(word, ENDING, "$1")
    return F.regexp_replace(short, DOUBLED, "$1$2$3$4$5$6$7$8$9")


def lexemes(text: Column) -> Column:
    """The stems of a text's terms, in order, with repeats."""
    return F.transform(terms(text), stem)


def counted(values: Column) -> Column:
    """Array of (x, n): each different value of an array with the number of its occurrences, in order of values.

    The array is sorted once; a value's last place less that of the value before it is its number.
    """
    def runs(p: Column) -> Column:
        ends = F.transform(p, lambda x, i: F.when(~x.eqNullSafe(F.get(p, i + 1)), F.struct(x.alias("x"), (i + 1).alias("to"))))
        return F.filter(ends, lambda e: e.isNotNull())

    def sizes(e: Column) -> Column:
        return F.transform(e, lambda x, i: F.struct(x["x"].alias("x"), (x["to"] - F.coalesce(F.get(e, i - 1)["to"], F.lit(0))).alias("n")))

    # A lambda over one value computes it once.
    ends = F.element_at(F.transform(F.array(F.sort_array(values)), runs), 1)
    return F.element_at(F.transform(F.array(ends), sizes), 1)


def with_embedding(df: DataFrame, key: str, text: str, name: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, embedding): signed feature hashing of a text's terms, not normalised. Texts without terms have no row.

    Terms are counted inside the row. The vectors are written once, so that neither the filter nor what reads them twice digests a text again.
    """
    def place(w: Column) -> Column:
        def signed(m: Column) -> Column:
            bucket = F.conv(F.substring(m, 1, 4), 16, 10).cast("int") % dimensions
            return F.when(F.substring(m, 5, 1) < "8", bucket).otherwise(-1 - bucket)

        return F.element_at(F.transform(F.array(F.md5(w)), signed), 1)

    placed = spread(df.select(key, text)).select(key, F.transform(terms(F.col(text)), place).alias("places"))
    mapped = placed.select(key, F.map_from_entries(counted(F.col("places"))).alias("m"))
    of = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: of(i) - of(-1 - i))
    held = staged(mapped.select(key, F.when(F.size("m") > 0, dense).alias(name)), "embeddings")
    return held.filter(F.col(name).isNotNull())
