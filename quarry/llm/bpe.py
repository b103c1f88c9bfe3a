"""Problem 7: token ids of whole texts by a public byte-pair tokenizer, and back.

Texts are cut into words by the tokenizer's pattern. Words that are a token are looked up in a
literal rank map; the other distinct words of the corpus are encoded once each by folding ranked
merges over their bytes, and joined back. Everything but the merging of very long words stays in
Spark's own functions.
"""

from __future__ import annotations

import base64
import heapq
import json
import math
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut, spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The tokenizer's own word pattern, with Unicode classes as its library reads them.
WORDS = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Slots of the literal rank maps; a lookup scans the few entries of one slot.
SLOTS = 16384
#: Words of more bytes than this are merged by a heap instead of the fold, with the same result.
FOLD_BYTES = 48
#: Copies of each encoded word when it is joined back, so that a word in a third of all documents is met in several tasks.
SALTS = 8


@lru_cache(4)
def ranks(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """The tokenizer's vocabulary; its size is fixed."""
    lines = (Path(folder) / vocabulary).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def slot(token: Column) -> Column:
    return F.pmod(F.crc32(token), F.lit(SLOTS)).cast("int")


@lru_cache(4)
def slotted(folder: str, vocabulary: str) -> str:
    """The rank map as JSON: an array of SLOTS maps from a token's hexadecimal bytes to its rank."""
    from zlib import crc32

    maps: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for token, rank in ranks(folder, vocabulary).items():
        h = token.hex().upper()
        maps[crc32(h.encode()) % SLOTS][h] = rank
    return json.dumps(maps)


def rank_map(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """The literal; Catalyst folds the parsing away once per plan."""
    return F.from_json(F.lit(slotted(folder, vocabulary)), "array<map<string,int>>")


@lru_cache(4)
def slotted_words(folder: str, vocabulary: str) -> str:
    """The ranks of the tokens that are whole characters, keyed by their text, for looking words up as they stand."""
    from zlib import crc32

    maps: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for token, rank in ranks(folder, vocabulary).items():
        try:
            maps[crc32(token) % SLOTS][token.decode()] = rank
        except UnicodeDecodeError:
            continue  # a part of a character is no word
    return json.dumps(maps)


def word_map(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    return F.from_json(F.lit(slotted_words(folder, vocabulary)), "array<map<string,int>>")


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often use names it; a literal is then in the plan once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_rank(word: Column, literal: Column) -> Column:
    return F.try_element_at(F.get(literal, F.pmod(F.crc32(word.cast("binary")), F.lit(SLOTS)).cast("int")), word)


def rank_of(hexed: Column, literal: Column) -> Column:
    return F.try_element_at(F.get(literal, slot(hexed)), hexed)


#: Stands for a pair that is no token; greater than every rank.
NO_RANK = 2**31 - 1


def pair_rank(pair: Column, literal: Column) -> Column:
    return F.coalesce(rank_of(pair, literal), F.lit(NO_RANK))


def merge_step(acc: Column, literal: Column) -> Column:
    """(p, r) with the adjacent pair of least rank, the leftmost of them, merged; unchanged when no pair has a rank.

    r holds the rank of each pair of neighbours; only the two pairs beside the merged piece are looked up anew.
    """
    p, r = acc["p"], acc["r"]
    none = F.array().cast("array<int>")

    def merged(x: Column) -> Column:
        at, joined = x["at"], x["joined"]
        pieces = F.concat(F.slice(p, F.lit(1), at - 1), F.array(joined), F.slice(p, at + 2, F.size(p)))
        left = F.when(at >= 2, F.array(pair_rank(F.concat(F.get(p, at - 2), joined), literal))).otherwise(none)
        right = F.when(at + 1 < F.size(p), F.array(pair_rank(F.concat(joined, F.get(p, at + 1)), literal))).otherwise(none)
        return F.struct(pieces.alias("p"), F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r))).alias("r"))

    at = F.array_position(r, F.array_min(r)).cast("int")
    best = F.struct(at.alias("at"), F.concat(F.get(p, at - 1), F.get(p, at)).alias("joined"))
    return F.when(F.coalesce(F.array_min(r), F.lit(NO_RANK)) == NO_RANK, acc).otherwise(bound(best, merged))


def folded(word: Column, literal: Column) -> Column:
    """The ids of one word: its bytes, merged once per byte but the last, then looked up."""
    pieces = F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit(".."), F.lit(0))

    def fold(p: Column) -> Column:
        first = F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: pair_rank(F.concat(x, F.get(p, i + 1)), literal))
        seed = F.struct(p.alias("p"), first.alias("r"))
        done = F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), seed, lambda acc, _: merge_step(acc, literal))
        return F.transform(done["p"], lambda x: rank_of(x, literal))

    return bound(pieces, fold)


def heap_merge(word: bytes, vocabulary: dict[bytes, int]) -> list[int]:
    """The same merges in n log n steps, for very long words."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(vocabulary[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in vocabulary]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (p := parts[a] + parts[b]) in vocabulary:
                heapq.heappush(heap, (vocabulary[p], a, p))
    return [vocabulary[p] for p in parts if p is not None]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def encoded_words(unknown: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """(w, ids) of the distinct words of unknown: each is merged once, by folding or, if very long, by a heap."""
    distinct = unknown.select("w").distinct()
    short = F.octet_length("w") <= FOLD_BYTES

    @F.pandas_udf("array<int>")
    def by_heap(w: pd.Series) -> pd.Series:
        v = ranks(folder, vocabulary)
        return w.map(lambda x: heap_merge(x.encode(), v))

    return cut(distinct.where(short).select("w", bound(rank_map(folder, vocabulary), lambda ranks_: folded(F.col("w"), ranks_)).alias("ids")).union(distinct.where(~short).select("w", by_heap("w").alias("ids"))))


def unknown_words(rows: DataFrame, words: Column, folder: str, vocabulary: str) -> DataFrame:
    """(row, w): the distinct words of each row that are no token themselves."""
    new = bound(word_map(folder, vocabulary), lambda m: F.filter(F.array_distinct(words), lambda w: word_rank(w, m).isNull()))
    # explode would be given a filter on its array's size, which works the array out a second time
    each = spread(rows).select("row", F.explode_outer(new).alias("w"))
    return cut(each.where("w is not null").distinct())


def met_words(unknown: DataFrame, encoded: DataFrame) -> DataFrame:
    """(row, w, ids): words beside their encoding; every encoding is there SALTS times, so a word of a third of all rows is met in several tasks."""
    salted = encoded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return unknown.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(salted, ["w", "salt"]).drop("salt")


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row: ids is an empty list for a null or empty text. Special tokens' strings are ordinary text.

    Rows of one key with the same text, delivered twice, give one row; the key may be any type, other
    columns are ignored. Only distinct words outside the vocabulary travel: each is encoded once, and
    reaches a document once however often it stands there. Texts are shuffled once, where their words'
    encodings meet them.
    """
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(key, text).alias("row"))
    unknown = unknown_words(rows, words_of(F.col("t")), folder, vocabulary)
    met = met_words(unknown, encoded_words(unknown, folder, vocabulary))
    per_doc = met.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "ids"))).alias("m"))
    ranked = bound(word_map(folder, vocabulary), lambda m: F.transform(words_of(F.col("t")), lambda w: F.struct(w.alias("w"), word_rank(w, m).alias("r"))))
    ids = F.flatten(F.transform(ranked, lambda x: F.when(x["r"].isNull(), F.try_element_at("m", x["w"])).otherwise(F.array(x["r"]))))
    once = rows.dropDuplicates(["row"])
    return once.join(per_doc, "row", "left").select(F.col("k").alias(key), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def pieces_literal(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """The tokens' bytes in hexadecimal by rank, as a literal array."""
    by_rank = sorted(ranks(folder, vocabulary).items(), key=lambda x: x[1])
    return F.from_json(F.lit(json.dumps([t.hex() for t, _ in by_rank])), "array<string>")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the tokens' binary pieces in a row, read as UTF-8; "" for an empty list, null for a null one or an unknown id."""
    pieces = pieces_literal(folder, vocabulary)
    return encoded.select(key, F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "", "!")), "UTF-8").alias("text"))


def sizes(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, kept columns, tokens) of every distinct row, as many tokens as encode gives ids.

    Tokens that are words are counted where they stand; only the other words of a text travel, never the text.
    """
    words = bound(word_map(folder, vocabulary), lambda m: F.transform(words_of(F.col(text)), lambda w: F.struct(w.alias("w"), word_rank(w, m).isNotNull().alias("known"))))
    read = spread(documents.select(key, *keep, text)).select(F.col(key).alias("k"), *[F.col(c) for c in keep], F.xxhash64(key, text).alias("row"), words.alias("_w"))
    rows = cut(read.select("k", *keep, "row", F.coalesce(F.size(F.filter("_w", lambda x: x["known"])), F.lit(0)).alias("known"), F.transform(F.filter("_w", lambda x: ~x["known"]), lambda x: x["w"]).alias("new")))
    unknown = rows.select("row", "k", F.explode_outer("new").alias("w")).where("w is not null").groupBy("row", "w").agg(F.count("*").alias("n"))
    copies = rows.groupBy("row").agg(F.count("*").alias("copies"))  # a row delivered twice has every word twice
    met = met_words(cut(unknown), encoded_words(unknown, folder, vocabulary))
    more = met.groupBy("row").agg(F.sum(F.col("n") * F.size("ids")).alias("more")).join(copies, "row").select("row", F.expr("more div copies").alias("more"))
    once = rows.drop("new").distinct()
    return once.join(more, "row", "left").select(F.col("k").alias(key), *keep, (F.col("known") + F.coalesce("more", F.lit(0))).cast("bigint").alias("tokens"))
