"""Encoding of a corpus with a public byte-level BPE tokenizer, by a table of distinct words."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.session import materialize

#: Where the vocabulary lies; see its README.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pattern of the tokenizer: how it splits a text into words. Unicode classes are switched on for Java.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most words, and characters and ids in them, that go to every worker; rarer words are joined by a shuffle.
MOST_WORDS, MOST_UNITS = 1_000_000, 32_000_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary file: pieces and their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def words_of(text: Column) -> Column:
    """The words of a text, in order; joined they are the text again. None for null and empty texts."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)(" + WORDS + ")"), F.lit(1))


def word_table(docs: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Each distinct word of the corpus, encoded once: word, n (how often it comes), ids."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    counts = docs.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            yield batch.assign(ids=[coder._encode_single_piece(x) for x in batch["word"]])

    return counts.mapInPandas(encode, "word string, n long, ids array<int>")


def encode_corpus(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY, most_words: int = MOST_WORDS, most_units: int = MOST_UNITS) -> DataFrame:
    """The ids of each document by a byte-level BPE, without special tokens: doc_id, ids.

    Method: words are split in Spark and counted, each distinct word is encoded once, and the ids are joined back by
    position. The words that come at least 2^k times go to every worker, with the least k for which they are at most
    `most_words` and their characters and ids at most `most_units`; a batch of documents looks them up in one vectorised pass.
    The others, each of them rare by that choice, are joined by a shuffle on the word, so no hot word meets in one task.

    Empty and null texts give an empty list, repeated rows and null ids as many rows as they have; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = materialize(word_table(docs, "text", vocabulary), "words")
    units = F.length("word") + F.size("ids")
    sizes = table.select(*(F.struct(F.count_if(F.col("n") >= 2**k).alias("words"), F.sum(F.when(F.col("n") >= 2**k, units).otherwise(0)).alias("units")) for k in range(63))).first()
    k = next(k for k in range(63) if sizes[k]["words"] <= most_words and (sizes[k]["units"] or 0) <= most_units)
    common = table.where(F.col("n") >= 2**k).select("word", "ids").toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, common.schema) as writer:
        writer.write_table(common)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    all_common = k == 0

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        one = lambda x, kind: pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], kind)
        keys = one(known["word"], pa.string()).cast(pa.string())
        ids = one(known["ids"], pa.list_(pa.int32())).cast(pa.list_(pa.int32()))
        sizes = np.asarray(pc.list_value_length(ids)) if len(ids) else np.zeros(0, np.int32)
        for batch in batches:
            lists = batch.column("words")
            words = pc.list_flatten(lists).cast(pa.string())
            at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(np.int64)
            place = pc.index_in(words, value_set=keys)
            found = np.asarray(place.is_valid())
            where = np.asarray(pc.fill_null(place, 0))
            lengths = np.where(found, sizes[where] if len(sizes) else 0, 0)
            flat = pc.list_flatten(ids.take(place)) if len(ids) else pa.array([], pa.int32())
            upto = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(upto[at], pa.int32()), flat)
            missing = []
            if not all_common:
                lost = np.flatnonzero(~found)
                doc = np.searchsorted(at, lost, "right") - 1
                missing = [[] for _ in range(len(lists))]
                names = words.take(pa.array(lost)).to_pylist()
                for d, w, name in zip(doc.tolist(), lost.tolist(), names):
                    missing[d].append({"at": int(upto[w] - upto[at[d]]), "pos": int(w - at[d]), "word": name})
            kind = pa.list_(pa.struct([("at", pa.int32()), ("pos", pa.int32()), ("word", pa.string())]))
            rest = pa.array(missing or [[]] * len(lists), kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), whole, rest], names=["doc_id", "ids", "missing"])

    kind = dict(docs.dtypes)["doc_id"]
    coded = docs.select("doc_id", words_of(F.col("text")).alias("words")).mapInArrow(look_up, f"doc_id {kind}, ids array<int>, missing array<struct<at:int,pos:int,word:string>>")
    if all_common:
        return coded.select(F.col("doc_id").alias(doc_id), "ids")

    coded = materialize(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    rare = table.where(F.col("n") < 2**k).select("word", F.col("ids").alias("own"))
    parts = coded.where("size(missing) > 0").select("row", F.explode("missing").alias("m")).select("row", "m.*").join(rare, "word")
    parts = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "at", "own"))).alias("parts"))
    piece = lambda p, i: F.concat(F.slice(F.col("ids"), F.when(i == 0, 1).otherwise(F.get("parts", i - 1)["at"] + 1), p["at"] - F.when(i == 0, 0).otherwise(F.get("parts", i - 1)["at"])), p["own"])
    tail = F.expr("slice(ids, element_at(parts, -1).at + 1, size(ids))")
    mended = F.when(F.col("parts").isNull(), F.col("ids")).otherwise(F.concat(F.flatten(F.transform("parts", piece)), tail))
    return coded.join(parts, "row", "left").select(F.col("doc_id").alias(doc_id), mended.alias("ids"))


def decode_corpus(coded: DataFrame, doc_id: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The texts of lists of ids, by a join of each id with its piece: doc_id, text. An empty or null list gives an empty text; an id without piece counts for nothing.

    The table of pieces has as many rows as the vocabulary, a fixed and small number.
    """
    spark = coded.sparkSession
    pieces = spark.createDataFrame(pd.DataFrame(((i, p) for p, i in read_ranks(vocabulary).items()), columns=["id", "piece"]), "id int, piece binary")
    rows = coded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).withColumn("row", F.monotonically_increasing_id())
    placed = rows.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(pieces), "id", "left")
    joined = placed.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("parts"))
    hexed = F.array_join(F.transform("parts", lambda x: F.hex(F.coalesce(x["piece"], F.lit(b"")))), "")
    return joined.select(F.col("doc_id").alias(doc_id), F.decode(F.unhex(hexed), "UTF-8").alias("text"))
