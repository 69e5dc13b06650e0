"""Byte-level BPE tokenisation as a Spark job (SC-06..SC-10, UDF-07).

text -> clean (entity unescape, whitespace collapse, lower) -> token split
(JVM regex, special tokens whole) -> byte mapping and merges -> ids in token
order -> fixed-length context window.

There are two forms of the merges.  ``encode_texts`` is map-only: an Arrow
UDF on the token array, each worker remembering the tokens it has
merged.  ``encode_with_dictionary`` merges every distinct token of the table
exactly once, into a dictionary that is kept and can be extended, and joins it
back; it pays where merging is dear (long merge tables, many texts that share
their words) or the dictionary is wanted itself.

The merge table is an input (the reference ships none); the vocabulary is
derived from it by the usual rule: 256 byte symbols, the same with the
end-of-word marker, one entry per merge, then the two special tokens.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_whitespace, tokens as split_tokens
from ..session import cut_lineage

# End-of-word marker, special tokens (two naming variants), context length.
END_OF_WORD = "</w>"
SPECIALS = {"clip": ("<|startoftext|>", "<|endoftext|>"), "emotion": ("<start_of_text>", "<end_of_text>")}
CONTEXT_LENGTH = 77


def byte_symbols() -> dict[int, str]:
    """Byte -> printable symbol: printable Latin-1 bytes stand for themselves;
    every other byte, in increasing order, gets the next code point from 256."""
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + \
        list(range(ord("®"), ord("ÿ") + 1))
    table, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return table


def build_vocab(merges: list[tuple[str, str]], variant: str = "clip") -> dict[str, int]:
    syms = byte_symbols()
    # symbols of printable bytes first (ascending), then the remapped ones (ascending)
    printable = [syms[b] for b in range(256) if syms[b] == chr(b)]
    remapped = [syms[b] for b in range(256) if syms[b] != chr(b)]
    base = printable + remapped
    vocab = base + [s + END_OF_WORD for s in base] + ["".join(m) for m in merges] + list(SPECIALS[variant])
    return {tok: i for i, tok in enumerate(vocab)}


def bpe_word(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Greedy merging: repeatedly join every occurrence of the adjacent pair
    with the lowest merge rank until no ranked pair is left."""
    word = list(symbols)
    while len(word) > 1:
        best, best_rank = None, None
        for pair in zip(word, word[1:]):
            r = ranks.get(pair)
            if r is not None and (best_rank is None or r < best_rank):
                best, best_rank = pair, r
        if best is None:
            break
        merged, i = [], 0
        while i < len(word):
            if i < len(word) - 1 and (word[i], word[i + 1]) == best:
                merged.append(word[i] + word[i + 1])
                i += 2
            else:
                merged.append(word[i])
                i += 1
        word = merged
    return word


ROWS_PER_STEP = 256         # texts whose values a worker holds as Python objects


def _by_slices(b: pa.Array, f, kind: pa.DataType) -> pa.Array:
    """``f`` of an Arrow batch, a slice of rows at a time."""
    parts = [f(b.slice(lo, ROWS_PER_STEP)) for lo in range(0, len(b), ROWS_PER_STEP)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def unescape_twice(col: Column | str) -> Column:
    """HTML entity unescape applied twice, then strip (Arrow UDF around the
    standard library; mojibake repair is not available and not applied)."""

    def plain(t: str | None) -> str | None:
        return None if t is None else html.unescape(html.unescape(t)).strip()

    @F.arrow_udf(T.StringType())
    def _u(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield _by_slices(b, lambda part: pa.array([plain(t) for t in part.to_pylist()], pa.string()), pa.string())

    return _u(F.col(col) if isinstance(col, str) else col)


def clean_text(col: Column | str, unescape: bool = True) -> Column:
    c = unescape_twice(col) if unescape else (F.col(col) if isinstance(col, str) else col)
    return normalize_whitespace(c)


CACHED_TOKENS = 200_000     # merged tokens a worker remembers


class _Merger:
    """Token -> ids with a bounded memory of the tokens met before."""

    def __init__(self, merges: list[tuple[str, str]], variant: str):
        self.vocab = build_vocab(merges, variant)
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.symbols = byte_symbols()
        self.specials = {t: [self.vocab[t]] for t in SPECIALS[variant]}
        self.known = dict(self.specials)

    def ids(self, token: str) -> list[int]:
        got = self.known.get(token)
        if got is None:
            mapped = [self.symbols[b] for b in token.encode("utf-8")]
            mapped[-1] += END_OF_WORD
            got = [self.vocab[p] for p in bpe_word(mapped, self.ranks)]
            if len(self.known) >= CACHED_TOKENS:
                self.known = dict(self.specials)
            self.known[token] = got
        return got


    def arrays(self, lists: pa.Array) -> pa.Array:
        """Lists of tokens -> lists of ids.  Only the distinct tokens become
        Python strings, the ids are gathered by NumPy."""
        coded = lists.flatten().dictionary_encode()
        return _gather(lists, coded.indices.to_numpy(), [self.ids(t) for t in coded.dictionary.to_pylist()])


def _gather(lists: pa.Array, index: np.ndarray, ids: list) -> pa.Array:
    """Per list of tokens the ids of its tokens in order, ``index`` being each
    token's place in ``ids``."""
    size = np.fromiter((len(i) for i in ids), np.int64, len(ids))
    pool = np.fromiter((x for i in ids for x in i), np.int32, int(size.sum()))
    n = size[index]
    ends = np.concatenate([[0], np.cumsum(n)])
    out = pool[np.repeat((np.cumsum(size) - size)[index] - ends[:-1], n) + np.arange(ends[-1])]
    tokens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = ends[np.concatenate([[0], np.cumsum(tokens)])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, pa.int32()), mask=lists.is_null())


def token_ids(spark: SparkSession, tokens_df: DataFrame, merges: list[tuple[str, str]],
              variant: str = "clip") -> DataFrame:
    """(token) distinct rows -> (token, ids array<int>)."""
    distinct = tokens_df.select("token").distinct()
    return distinct.select("token", merged_ids(spark, F.array("token"), merges, variant).alias("ids"))


def merged_ids(spark: SparkSession, token_arrays: Column, merges: list[tuple[str, str]], variant: str = "clip") -> Column:
    """Array of tokens -> flat array of ids, in token order.  A worker merges a
    token once and remembers it, so nothing is shuffled by token."""
    bc = spark.sparkContext.broadcast((merges, variant))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def _bpe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merger = _Merger(*bc.value)
        for b in batches:
            yield _by_slices(b, merger.arrays, pa.list_(pa.int32()))

    return _bpe(token_arrays)


def word_dictionary(df: DataFrame, text: str, merges: list[tuple[str, str]], variant: str = "clip", unescape: bool = True,
                    known: DataFrame | None = None) -> DataFrame:
    """(token, n, ids): every distinct token of the table, how often it occurs
    (partial counts, so a hot token is no hot task) and its ids, merged once.
    ``known`` is an earlier dictionary, whose tokens are not merged again."""
    found = df.select(F.explode(split_tokens(clean_text(text, unescape), SPECIALS[variant])).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    if known is None:
        return found.select("token", "n", merged_ids(df.sparkSession, F.array("token"), merges, variant).alias("ids"))
    both = found.join(known.select("token", F.col("ids").alias("old")), "token", "left")
    fresh = F.when(F.col("old").isNull(), F.array("token"))
    return both.select("token", "n", F.coalesce("old", merged_ids(df.sparkSession, fresh, merges, variant)).alias("ids"))


BLOCK_BITS = 9              # 512 texts look their distinct tokens up together


def encode_with_dictionary(df: DataFrame, key: str, text: str, dictionary: DataFrame, variant: str = "clip", unescape: bool = True) -> DataFrame:
    """(key, ids array<int>) like ``encode_texts``, from a dictionary of (token,
    n, ids) that holds every token of the table.  Blocks of texts look their
    distinct tokens up: a token is joined once a block, however often it stands
    there, so no token is a hot key and the tokens of the texts are not
    shuffled one by one; each block's texts then meet the block's tokens."""
    row = F.monotonically_increasing_id()          # a block's rows lie in one partition
    rows = cut_lineage(df.select(F.col(key), F.shiftright(row, BLOCK_BITS).alias("_block"),
                                 split_tokens(clean_text(text, unescape), SPECIALS[variant]).alias("_t")))
    needed = rows.select("_block", F.explode(F.array_distinct("_t")).alias("token")).distinct()
    found = needed.join(dictionary.select("token", "ids"), "token", "left").select(
        F.col("_block").alias("_of"), "token", F.coalesce("ids", F.raise_error(F.concat(F.lit("not in the dictionary: "), "token")).cast("array<int>")).alias("ids"))

    def look_up(texts: pa.Table, words: pa.Table) -> pa.Table:
        lists = pa.concat_arrays(texts.column("_t").chunks)
        ids, index = words.column("ids").to_pylist(), pc.index_in(lists.flatten(), value_set=words.column("token").combine_chunks())
        got = _gather(lists, index.to_numpy(), ids)
        whole = pa.ListArray.from_arrays(got.offsets, got.values)          # a null text has no ids
        return pa.table([texts.column(key), whole], [key, "ids"])

    schema = df.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(look_up, schema)


def encode_texts(df: DataFrame, key: str, text: str, merges: list[tuple[str, str]], variant: str = "clip",
                 unescape: bool = True) -> DataFrame:
    """(key, ids array<int>) without start and end ids, in token order; a null
    text has no ids.  Map-only: one row in, one row out."""
    toks = split_tokens(clean_text(text, unescape), SPECIALS[variant])
    ids = merged_ids(df.sparkSession, toks, merges, variant)
    return df.select(key, F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def context_window(ids: Column, sot: int, eot: int, length: int = CONTEXT_LENGTH, mode: str = "error") -> Column:
    """start + ids + end padded with 0 to ``length``.  Too long: ``error``
    raises, ``truncate`` keeps the first ``length`` with the last set to the
    end id, ``truncate_plain`` keeps the first ``length`` as they are."""
    full = F.concat(F.array(F.lit(sot)), ids, F.array(F.lit(eot)))
    n = F.size(full)
    pad = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - n, F.lit(0)))
    fit = F.concat(full, pad)
    if mode == "error":
        too_long = F.raise_error(F.lit(f"input too long for context length {length}")).cast("array<int>")
    elif mode == "truncate":
        too_long = F.concat(F.slice(full, 1, length - 1), F.array(F.lit(eot)))
    else:
        too_long = F.slice(full, 1, length)
    return F.when(n > length, too_long).otherwise(fit)
