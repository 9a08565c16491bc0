"""Evaluation texts that leaked into a corpus: latent semantic retrieval and an exact check."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.svd import randomised_svd
from evidra.session import materialize

#: A leak is a stretch of so many words of an item, of any SPAN words of which one may be changed, missing or added.
LEAST, SPAN = 25, 8
#: Width and step of the windows of a document: any stretch of LEAST words with its added ones lies within one.
WINDOW, STEP = 40, 8
RANK = 256
#: Items go to every worker in blocks of about so many, of so many characters together; each block is compared with all documents.
MOST_ITEMS, MOST_CHARS = 4000, 4_000_000
_MARKUP = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text without letter case, punctuation, markup, layout and compatibility forms."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(x for x in text if unicodedata.category(x) != "Cf") if not text.isascii() else text
    if "](" in text:
        text = _LINK.sub(r" \1 ", text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.casefold())


def longest_stretch(doc: list[int], item: list[int], span: int = SPAN) -> int:
    """How many words of the item the longest stretch that the document shares with it has.

    A longest common subsequence in one place: words match in order; between two edits (a word changed, missing or
    added) lie at least span - 1 matching words. Changed and missing words of the item count to the stretch, also one
    at either end of it. Words below 0 match nothing.
    """
    free = span - 1
    places: dict[int, list[int]] = {}
    for i, w in enumerate(item):
        if w >= 0:
            places.setdefault(w, []).append(i)
    best = 0
    before: dict[int, dict[int, int]] = {}
    before2: dict[int, dict[int, int]] = {}
    for w in doc:
        now: dict[int, dict[int, int]] = {}
        for i in places.get(w, ()):
            # matches since the last edit -> words of the item so far
            state = {free: 1}
            if i:
                state[1] = 2
            for since, n in before.get(i - 1, {}).items():
                k = min(free, since + 1)
                if state.get(k, 0) < n + 1:
                    state[k] = n + 1
            for cells, j, more in ((before2, i - 2, 2), (before, i - 2, 2), (before2, i - 1, 1)):
                n = cells.get(j, {}).get(free)
                if n is not None and state.get(1, 0) < n + more:
                    state[1] = n + more
            now[i] = state
            for since, n in state.items():
                best = max(best, n + (since >= free and i + 1 < len(item)))
        before2, before = before, now
    return best


@dataclass
class Index:
    """The items as workers need them: ids of words, their weights, the latent space, the items in it and how long the part of each is that it leaves out."""

    words: dict[str, int]
    squares: np.ndarray
    embed: np.ndarray
    items: np.ndarray
    left: np.ndarray
    bounds: np.ndarray
    texts: list[list[int]]
    ids: list[int]


@dataclass
class Items:
    """A block of items: their ids, the words of all and each item as ids of words."""

    ids: list
    words: dict[str, int]
    texts: list[list[int]]


def read_items(items: DataFrame) -> Items:
    """The items (id, text) of a block, each once, in order of id."""
    rows = items.where("id is not null").groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()
    words: dict[str, int] = {}
    texts = [[words.setdefault(w, len(words)) for w in words_of(r["text"])] for r in rows]
    return Items([r["id"] for r in rows], words, texts)


def code_documents(docs: DataFrame, words: dict[str, int]) -> DataFrame:
    """The documents (doc_id, text), read once: doc_id and ids, the words of each as ids of the items' words, in order; other words have the id after the last."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, none = shared.value, len(shared.value)
        for batch in batches:
            a, texts = 0, batch["text"].tolist()
            while a < len(texts):
                ids, size, b = [], 0, a
                while b < len(texts) and size < 2_000_000:
                    ids.append(np.array([known.get(w, none) for w in words_of(texts[b])], np.int32))
                    size += len(ids[-1])
                    b += 1
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].to_numpy(), "ids": ids})
                a = b

    rows = docs.select("doc_id", "text").mapInPandas(code, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")
    return materialize(rows, "coded-documents")


def index_items(coded: DataFrame, items: Items, rank: int = RANK) -> Index:
    """TF-IDF of the items with the frequencies of all documents, and their latent space by randomised SVD."""
    words, texts = items.words, items.texts
    totals = coded.select(F.explode(F.concat(F.array_distinct("ids"), F.array(F.lit(-1)))).alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect()  # one row a word of the items
    frequency = np.zeros(len(words) + 2, np.int64)
    for r in totals:
        frequency[r["at"]] = r["n"]
    n_docs, frequency = int(frequency[-1]), frequency[: len(words)]
    idf = np.log((1 + n_docs) / (1 + np.minimum(frequency, n_docs))) + 0.1
    squares = idf**2
    passages = [(sorted({*t}), [float(idf[w]) for w in sorted({*t})]) for t in texts]
    if words:
        matrix = coded.sparkSession.createDataFrame(passages, "at array<int>, weights array<double>")
        vectors, _ = randomised_svd(matrix, len(words), min(rank, max(1, len(texts))))
    else:
        vectors = np.zeros((0, 1))
    embed = np.vstack([vectors * idf[:, None], np.zeros((1, vectors.shape[1]))]).astype(np.float32)
    latent = np.array([vectors[at].T @ np.array(w) if at else np.zeros(vectors.shape[1]) for at, w in passages]).reshape(len(texts), vectors.shape[1])
    # the least weight of a stretch from which as many words are changed as may be
    spared = -(-LEAST // SPAN)
    bounds = np.full(len(texts), np.inf)
    for k, t in enumerate(texts):
        kept = [np.sort(squares[t[i : i + LEAST]])[: LEAST - spared].sum() for i in range(len(t) - LEAST + 1)]
        if kept:
            bounds[k] = min(kept)
    size = np.array([squares[at].sum() for at, _ in passages])
    left = np.sqrt(np.maximum(size - (latent**2).sum(1), 0) + 1e-9 * size)
    return Index(words, np.append(squares, 0.0).astype(np.float32), embed, latent.astype(np.float32), left, bounds * 0.999, texts, items.ids)


def build_index(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, rank: int = RANK) -> Index:
    """The index of the items (one block) over the documents."""
    block = read_items(items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")))
    return index_items(code_documents(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), block.words), block, rank)


def candidates(tokens: list[np.ndarray], index: Index) -> list[tuple[int, int, int]]:
    """(document, first word of the window, item) of every window close to an item in the latent space.

    The product of a window with an item is at least the weight of the words they share. In the latent space it may lose
    no more than the product of the parts of both that the space leaves out; with that added, a window below the least
    weight of any leak of an item can't hold one, whatever the rank of the space, the length of the item, the frequencies
    of its words, and what else stands in the window. Nor can one that shares fewer words with the item than a leak
    leaves unchanged, each counted at most as often as the item has it.
    """
    out: list[tuple[int, int, int]] = []
    none, norms = len(index.squares) - 1, np.linalg.norm(index.items, axis=1)
    unchanged = LEAST - -(-LEAST // SPAN)
    usable = np.flatnonzero(np.isfinite(index.bounds))
    if not len(usable):
        return out
    floor = index.bounds[usable].min()
    docs, starts = [], []
    for d, t in enumerate(tokens):
        if len(t) >= unchanged:
            s = np.arange(0, max(1, len(t) - WINDOW + STEP), STEP)
            starts.append(s)
            docs.append(np.full(len(s), d))
    if not docs:
        return out
    base = np.concatenate([[0], np.cumsum([len(t) + WINDOW for t in tokens])])
    flat = np.full(base[-1] + WINDOW, none, np.int32)
    for d, t in enumerate(tokens):
        flat[base[d] : base[d] + len(t)] = t
    doc, start = np.concatenate(docs), np.concatenate(starts)
    weight = np.concatenate([[0.0], np.cumsum(index.squares[flat], dtype=np.float64)])
    first = base[doc] + start
    heavy = np.flatnonzero(weight[first + WINDOW] - weight[first] >= floor)
    for a in range(0, len(heavy), 2048):
        some = heavy[a : a + 2048]
        ids = flat[first[some][:, None] + np.arange(WINDOW)]
        latent = np.zeros((len(some), index.embed.shape[1]), np.float32)
        for p in range(WINDOW):
            latent += index.embed[ids[:, p]]
        product = latent @ index.items.T
        # what single precision may have taken from the product
        rounding = 1e-5 * np.linalg.norm(latent, axis=1)[:, None] * norms[None, :]
        ids = np.sort(ids, axis=1)
        same = np.zeros(ids.shape, np.int32)
        for p in range(1, WINDOW):
            same[:, p] = np.where(ids[:, p] == ids[:, p - 1], same[:, p - 1] + 1, 0)
        whole = (index.squares[ids] * (2 * same + 1)).sum(axis=1)
        beyond = np.sqrt(np.maximum(whole - (latent**2).sum(axis=1), 0) + 1e-5 * whole)
        close = product + rounding + beyond[:, None] * index.left[None, :] >= index.bounds[None, :]
        for k in np.flatnonzero(close.any(axis=0)):
            near = np.flatnonzero(close[:, k])
            has, times = np.unique(index.texts[k], return_counts=True)
            at = np.minimum(np.searchsorted(has, ids[near]), len(has) - 1)
            shares = ((has[at] == ids[near]) & (same[near] < times[at])).sum(axis=1)
            out += [(int(doc[w]), int(start[w]), int(k)) for w in some[near[shares >= unchanged]]]
    return out


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, rank: int = RANK) -> DataFrame:
    """The items that leaked into each document: doc_id, item_id.

    A document holds a leak if a stretch of at least LEAST words of an item's text stands in it, in order and in one
    place, of any SPAN words of which one is changed, missing or added. Method: documents are read once into the words
    that the items have; the items' TF-IDF vectors, weighted by the frequencies in all documents, span a latent space
    (randomised SVD); each window of each document is projected and compared with every item, a fixed query set, without
    a shuffle; candidates are checked by a longest common subsequence with bounded edits. Items, their words and the space
    go to every worker, MOST_ITEMS and MOST_CHARS at a time: more items are taken in blocks, each against all documents.

    Null and empty texts, and items of fewer than LEAST words, leak nothing; of repeated items one counts; repeated
    documents give one row; the other columns are ignored. Without documents or items there are no rows.
    """
    queries = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("id is not null")
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // MOST_ITEMS), -(-size["chars"] // MOST_CHARS))
    rows = docs.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = [_leaks_of(rows, read_items(queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)), dict(items.dtypes)[item_id], rank) for i in range(blocks)]
    return reduce(DataFrame.unionByName, found).distinct().select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id))


def _leaks_of(docs: DataFrame, items: Items, kind: str, rank: int) -> DataFrame:
    """The leaks of one block of items."""
    coded = code_documents(docs, items.words)
    shared = docs.sparkSession.sparkContext.broadcast(index_items(coded, items, rank))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        none = len(index.squares) - 1
        for batch in batches:
            found: set = set()
            ids, words = batch["doc_id"].tolist(), batch["ids"].tolist()
            a = 0
            while a < len(ids):
                tokens, size, b = [], 0, a
                while b < len(ids) and size < 400_000:
                    tokens.append(np.asarray(words[b], np.int32))
                    size += len(tokens[-1]) + WINDOW
                    b += 1
                near: dict[tuple[int, int], list[int]] = {}
                for d, s, k in candidates(tokens, index):
                    near.setdefault((d, k), []).append(s)
                for (d, k), starts in near.items():
                    doc = np.where(tokens[d] == none, -1, tokens[d]).tolist()
                    low = high = None
                    for s in [*sorted(starts), None]:
                        if high is not None and (s is None or s > high):
                            if longest_stretch(doc[low:high], index.texts[k]) >= LEAST:
                                found.add((ids[a + d], index.ids[k]))
                                break
                            low = high = None
                        if s is not None:
                            low, high = s if low is None else low, s + WINDOW
                a = b
            yield pd.DataFrame(sorted(found), columns=["doc_id", "item_id"]) if found else pd.DataFrame({"doc_id": [], "item_id": []})

    return coded.mapInPandas(search, f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {kind}")
