"""Encoding with the public tokenizers, and token counts behind a digest cache.

``Encoder`` splits a text into the tokenizer's own pre-tokens, and lets the library's model merge each different pre-token
once, its bytes written as the characters that the vocabulary has for them; the ids of a text are the joined ids of its
pre-tokens. That is what the library does, without repeating the merges for words it has seen. Texts for which the split isn't plain (special strings, characters beyond U+02FF, which may
need Unicode normalisation) go to the library whole.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._common import documents, new_folder, staged, text_or_empty, tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Pre-tokens a worker remembers before it starts a new generation (the last one is kept too); about 170 bytes each.
REMEMBERED = 250_000
TOKEN_LIMIT = 512


def _char_classes() -> tuple[str, str, str]:
    """Letters, numbers and white space up to U+02FF, as regular expression ranges."""
    import unicodedata

    def ranges(kind: str) -> str:
        return "".join(f"\\u{c:04x}" for c in range(0x300) if unicodedata.category(chr(c)).startswith(kind))

    return ranges("L"), ranges("N"), "\\t-\\r \\u0085\\u00a0"


def _byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies have for each byte: itself where it is printed, else one above U+00FF."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class Encoder:
    """Text to token ids, as little-endian bytes of ``width`` bytes an id."""

    def __init__(self, path: str, width: int = 4):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        if self.library.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"ids of {path} do not fit {width} bytes")
        self.merge, self.characters = self.library.model.tokenize, _byte_characters()
        self.kind, self.width = {2: "H", 4: "I"}[width], width
        letter, number, space = _char_classes()
        self.words = "word_bpe" in path
        short = "'s|'t|'re|'ve|'m|'ll|'d|"
        if self.words:
            split = f"{short}[{letter}]+|[{number}]|[^{space}{letter}{number}]+"
        else:
            split = (
                f"{short} ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
                f"|[{space}]+(?![^{space}])|[{space}]+"
            )
        self.split = re.compile(split).findall
        specials = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        # U+0130 becomes two characters in lower case.
        self.special = re.compile("|".join(specials) or "(?!)").search
        self.wide = re.compile("[İ̀-\U0010ffff]").search
        self.known = Remembered(self.piece)

    def pack(self, ids: Iterable[int]) -> bytes:
        packed = array(self.kind, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def piece(self, word: str) -> bytes:
        return self.pack(t.id for t in self.merge(word.encode().decode("latin-1").translate(self.characters)))

    def whole(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def odd(self, text: str) -> bool:
        """Whether the split isn't plain. ASCII texts, which Python knows as such, need no search for wide characters."""
        return bool(self.special(text)) or (not text.isascii() and bool(self.wide(text)))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order. Memory follows the largest text, not the number of texts."""
        known = self.known
        for text in texts:
            if self.odd(text):
                yield self.whole(text)
                continue
            yield b"".join(map(known.__getitem__, self.split(text.lower() if self.words else text)))
            known.age()


class Remembered(dict):
    """Pre-token to packed ids. The library is asked for a pre-token once; those not met for long are forgotten."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self.ask, self.older = ask, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.ask(word)
        self[word] = found
        return found

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int = 4) -> Encoder:
    """One encoder per worker process."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: a digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


#: A session's setting: the cache table that the registered query shares with earlier runs.
CACHE_SETTING = "loomwork.token.cache"


def normal_form(text: Column, tokenizer: str) -> Column:
    """What a text is stored under: equal forms have equal counts.

    The byte-level tokenizer tells all texts apart, since any byte may change its merges: the form is the text itself. The
    word tokenizer lowers letters and takes runs of white space as one, so ASCII texts get both; with other characters
    lower case may compose differently, and a text with ``<|`` may hold a special string, so those stay as they are.
    """
    if "word_bpe" not in tokenizer:
        return text
    plain = text.rlike(r"^[\x00-\x7F]*$") & ~F.contains(text, F.lit("<|"))
    return F.when(plain, F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))).otherwise(text)


CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"


def _stored(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """The cache's folder of one tokenizer; empty where nothing has been stored yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``, through the cache table at ``cache_path``.

    The cache maps (content digest, tokenizer digest) to a count, in a folder for each tokenizer; a run reads the folder of its
    own, and adds no file where nothing is missing. Contents are compared in the form that the tokenizer tells
    apart (``normal_form``), as whole UTF-8 texts with null as empty. Only contents without a stored count are encoded, each
    once, and their counts are appended before documents are joined to the table. Null or empty text has 0 tokens; repeated rows are counted once and
    returned each; an empty table gives an empty one; extra columns don't matter, since only doc_id and text are read.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    keyed = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(normal_form(F.col("text"), tokenizer), 256).alias("digest")
    )
    rows = staged(keyed.select("doc_id", "n_bytes", "digest"), "token-rows")
    stored = _stored(spark, cache_path, version)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer)
        for b in batches:
            counts = [len(x) // own.width for x in own.encode(b.text.tolist())]
            yield pd.DataFrame({"digest": b.digest, "tokenizer": version, "n_tokens": counts})

    distinct = keyed.select("digest", "text").dropDuplicates(["digest"])
    missing = distinct.join(stored.select("digest"), "digest", "left_anti")
    missing.mapInPandas(encoded, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = _stored(spark, cache_path, version)
    # A writer that ran beside this one may have stored the same digest; its count is the same.
    # As a table of its own, so that Spark may split a digest with very many rows when it joins.
    counts = staged(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return rows.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over whole texts, through the cache table that the session names; without one, through a new one."""
    cache = spark.conf.get(CACHE_SETTING, None) or new_folder(spark, "token-cache")
    return count_tokens(documents(spark, sf_dir), cache, tokenizer_path(BYTE_BPE))
