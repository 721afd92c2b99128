"""Exact search of texts by the cosine of sublinear tf-idf over character n-grams.

Documents are dealt into shards by a hash of their key, of about ``shard_chars`` characters each, queries into groups;
a task has one shard and one group. It lays documents with the same heavy words side by side and keeps, for each block
of them, the largest weight of each n-gram. What a query can score in a block is bounded by these; blocks are scored in
falling order of their bounds until no bound reaches the score in the k-th place. Nothing that could be among the k best is
left out, and neither postings nor pairs of documents are shuffled: only documents, queries, counts of n-grams and, for each
task, the k best.

Defined results: documents without n-grams are found by no query but count in the statistics; rows of one key are one
document; a null key counts in the frequencies of n-grams only; equal scores (at nine digits) come in the order of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LO, HI = 2, 4
BLOCK = 16
SLACK = 2e-9  # scores that nine digits may make equal
VOCABULARY = 1_000_000


def word_grams(word: str) -> list[str]:
    """As ranking.char_grams of one word."""
    p = f" {word} "
    out = [p[i : i + n] for n in range(LO, HI + 1) if len(p) > n for i in range(len(p) - n + 1)]
    return [*out, p] if len(p) <= HI else out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), then those from starts[1] on, and so forth."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _coded(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, number of the word) of each word of each list, and the words by number."""
    coded = pc.list_flatten(words).dictionary_encode()
    row, code = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (pc.list_parent_indices(words), coded.indices))
    return row, code, coded.dictionary.to_pylist()


def _counted(row: np.ndarray, item: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, count) of each item of each row, by row."""
    both, n = np.unique(row * items + item, return_counts=True)
    return both // max(1, items), both % max(1, items), n


def _terms(words: pa.Array, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) of each n-gram of each list of words, by row; new n-grams get the next number in ``ids``."""
    row, code, distinct = _coded(words)
    own = [[ids.setdefault(g, len(ids)) for g in word_grams(w)] for w in distinct]
    counts, flat = np.array([len(x) for x in own], np.int64), np.array([g for x in own for g in x], np.int64)
    at = _ranges((np.cumsum(counts) - counts)[code], counts[code])
    return _counted(np.repeat(row, counts[code]), flat[at], len(ids))


def document_counts(docs: DataFrame, words: str) -> DataFrame:
    """(gram, df): in how many documents an n-gram occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        total = np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(total)], ["gram", "n"])

        for batch in batches:
            _, gram, _ = _terms(batch.column(0), ids)
            seen = np.bincount(gram, minlength=len(ids))
            seen[: len(total)] += total
            total = seen
            if len(ids) > VOCABULARY:
                yield out()
                ids, total = {}, np.zeros(0, np.int64)
        yield out()

    return docs.select(words).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("df"))


class Postings:
    """What is listed under each number: item and value from at[number] on."""

    def __init__(self, number: np.ndarray, item: np.ndarray, value: np.ndarray, numbers: int, items: int):
        """Of equal pairs of number and item the largest value is kept."""
        key = number * items + item
        order = np.argsort(key)
        both, first = np.unique(key[order], return_index=True)
        self.value = np.maximum.reduceat(value[order], first) if len(both) else np.zeros(0)
        self.item, self.items = both % max(1, items), items
        self.at = np.searchsorted(both, np.arange(numbers + 1) * items)

    def product(self, number: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each item the sum of weight x value over the numbers."""
        counts = self.at[number + 1] - self.at[number]
        at = _ranges(self.at[number], counts)
        return np.bincount(self.item[at], np.repeat(weight, counts) * self.value[at], minlength=self.items)


class Rows:
    """Numbers and values of rows, in a given order of the rows."""

    def __init__(self, row: np.ndarray, number: np.ndarray, value: np.ndarray, order: np.ndarray):
        counts = np.bincount(row, minlength=len(order))
        at = _ranges((np.cumsum(counts) - counts)[order], counts[order])
        self.number, self.value, self.start = number[at], value[at], np.concatenate([[0], np.cumsum(counts[order])])

    def product(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """For each of ``rows`` the sum of value x of[number]."""
        counts = self.start[rows + 1] - self.start[rows]
        at = _ranges(self.start[rows], counts)
        return np.bincount(np.repeat(np.arange(len(rows)), counts), of[self.number[at]] * self.value[at], minlength=len(rows))


class Shard:
    """Documents in an order in which those with the same heavy words are side by side, in blocks.

    Two bounds stand before a score: that of a block (the largest weight of each n-gram in it) and that of a document, the sum
    over its words. The latter holds as 1 + ln of a sum or product of counts is at most the sum or product of their 1 + ln.
    """

    def __init__(self, words: pa.Array, ids: dict[str, int], idf: np.ndarray, used: np.ndarray):
        """used: the n-grams that some query has; others are dropped when vectors have their length."""
        row, gram, n = _terms(words, ids)
        weight = (1 + np.log(n)) * idf[gram]
        length = np.sqrt(np.bincount(row, weight * weight, minlength=len(words)))
        fit = used[gram]
        row, gram, weight = row[fit], gram[fit], weight[fit] / length[row[fit]]

        owner, code, distinct = _coded(words)
        owner, code, n = _counted(owner, code, len(distinct))
        word, part, n_part = _terms(pa.array([[w] for w in distinct], pa.list_(pa.string())), ids)
        share = (1 + np.log(n_part)) * idf[part]
        mass = np.bincount(word, share * share, minlength=len(distinct))
        turn = np.empty(len(distinct), np.int64)
        turn[np.argsort(-mass, kind="stable")] = np.arange(len(distinct))
        heavy = np.lexsort((turn[code], owner))
        counts = np.bincount(owner, minlength=len(words))
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = np.full((4, len(words)), -1)
        first[nth[nth < 4], owner[nth < 4]] = turn[code[heavy]][nth < 4]
        self.docs = np.lexsort(first[::-1])

        self.vectors, self.words = Rows(row, gram, weight, self.docs), Rows(owner, code, (1 + np.log(n)) / length[owner], self.docs)
        self.parts = Postings(part, word, share, len(ids), len(distinct))
        v = self.vectors
        self.blocks = Postings(v.number, np.repeat(np.arange(len(words)) // BLOCK, np.diff(v.start)), v.value, len(ids), -(-len(words) // BLOCK))
        self.asked = np.zeros(len(ids))

    def reaching(self, gram: np.ndarray, weight: np.ndarray, itself: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores: all that reach the k-th best score, less SLACK; ``itself`` is left out."""
        bound, of_word = self.blocks.product(gram, weight), self.parts.product(gram, weight)
        order = np.flatnonzero(bound)
        order = order[np.argsort(-bound[order])]
        docs, score, least, done, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 4
        self.asked[gram] = weight
        while done < len(order) and bound[order[done]] >= least - SLACK:
            now = order[done : done + step]
            now = now[bound[now] >= least - SLACK] * BLOCK
            places = _ranges(now, np.minimum(BLOCK, len(self.docs) - now))
            most = self.words.product(places, of_word)
            fit = most >= least - SLACK
            places, most = places[fit & (self.docs[places] != itself)], most[fit & (self.docs[places] != itself)]
            places, most = places[turn := np.argsort(-most)], most[turn]
            at, many = 0, 4 * k
            while at < len(places) and most[at] >= least - SLACK:
                some = places[at : at + many]
                s = self.vectors.product(some, self.asked)
                fit = (s > 0) & (s >= least - SLACK)
                docs, score = np.concatenate([docs, self.docs[some[fit]]]), np.concatenate([score, s[fit]])
                if len(score) >= k:
                    least = np.partition(score, -k)[-k]
                    fit = score >= least - SLACK
                    docs, score = docs[fit], score[fit]
                at, many = at + many, 2 * many
            done, step = done + step, min(2 * step, 64)
        self.asked[gram] = 0
        return docs, score


def search_shards(docs: DataFrame, n: int, shards: int, groups: int, k: int) -> DataFrame:
    """(query, doc, score, nine): for each query the k best of each shard; nine: the score at nine digits.

    docs: doc, words, asked. n: how many keys.
    """
    kind = docs.schema["doc"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        part = [table.filter(pc.equal(table["part"], i)).combine_chunks() for i in range(3)]
        words = [pa.concat_arrays(p["words"].chunks) if p["words"].num_chunks else pa.array([], pa.list_(pa.string())) for p in part]
        keys = [pa.concat_arrays(p["doc"].chunks) if p["doc"].num_chunks else pa.array([], table["doc"].type) for p in part]
        ids, idf = {g: i for i, g in enumerate(part[2]["gram"].to_pylist())}, part[2]["idf"].to_numpy()
        query, gram, tf = _terms(words[1], ids)
        weight = (1 + np.log(tf)) * idf[gram]
        weight /= np.sqrt(np.bincount(query, weight * weight, minlength=len(words[1])))[query]
        used = np.zeros(len(ids), bool)
        used[gram] = True
        shard, start = Shard(words[0], ids, idf, used), np.searchsorted(query, np.arange(len(keys[1]) + 1))
        turn = np.empty(len(keys[0]), np.int64)
        turn[pc.sort_indices(keys[0]).to_numpy()] = np.arange(len(turn))
        itself = pc.fill_null(pc.index_in(keys[1], value_set=keys[0]), -1).to_numpy(zero_copy_only=False)
        asking, found, scores = [], [], []
        for q, (lo, hi) in enumerate(zip(start[:-1], start[1:])):
            at, score = shard.reaching(gram[lo:hi], weight[lo:hi], itself[q], k)
            best = np.lexsort((turn[at], -np.round(score, 9)))[:k]
            asking.append(np.full(len(best), q))
            found.append(at[best])
            scores.append(score[best])
        asking, found, scores = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((asking, np.int64), (found, np.int64), (scores, float)))
        return pa.table({"query": keys[1].take(pa.array(asking)), "doc": keys[0].take(pa.array(found)), "score": scores, "nine": np.round(scores, 9)})

    def rows(df: DataFrame, part: int, **columns) -> DataFrame:  # noqa: ANN003
        none = {"doc": f"CAST(NULL AS {kind})", "words": "CAST(NULL AS array<string>)", "gram": "CAST(NULL AS string)", "idf": "CAST(NULL AS double)"}
        return df.select(columns.pop("cell").cast("int").alias("cell"), F.lit(part).alias("part"), *[columns.get(c, F.expr(x)).alias(c) for c, x in none.items()])

    def each(k: int):  # noqa: ANN202
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    own, text = F.col("doc"), {"doc": F.col("doc"), "words": F.col("words")}
    known = docs.filter("doc IS NOT NULL")
    d = known.withColumns({"shard": F.pmod(F.xxhash64(own), F.lit(shards)), "group": each(groups)})
    q = known.filter("asked").withColumns({"group": F.pmod(F.xxhash64(own, F.lit(1)), F.lit(groups)), "shard": each(shards)})
    cell = F.col("shard") * groups + F.col("group")
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    grams = document_counts(docs, "words").withColumn("cell", each(shards * groups))
    cells = rows(d, 0, cell=cell, **text).unionByName(rows(q, 1, cell=cell, **text)).unionByName(rows(grams, 2, cell=F.col("cell"), gram=F.col("gram"), idf=idf))
    return cells.groupBy("cell").applyInArrow(run, f"query {kind}, doc {kind}, score double, nine double")
