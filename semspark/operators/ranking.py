"""Keep-first, numbering, modes, top-k over pairs, access matrices and text retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from . import search


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; Spark keeps one row a key before the shuffle as well."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def mode_first_seen(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """(keys, value, n): the most frequent value, of equally frequent ones the one that came first. Null counts as a value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("c"), F.col("_first").alias("f"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(value), (-F.col("b.c")).alias("n"))


def topk_either_endpoint(pairs: DataFrame, a: str, b: str, score: str, k: int) -> DataFrame:
    """Pairs among the best k of at least one of their ends, by falling score, then by the other end."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col(a).alias("end"), F.col(b).alias("other")), F.struct(F.col(b).alias("end"), F.col(a).alias("other")))).alias("_at"), a, b, score)
    w = W.partitionBy("_at.end").orderBy(F.col(score).desc(), F.col("_at.other"))
    best = ends.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return best.select(a, b, score).distinct()


def standardize(df: DataFrame, column: str, value: str) -> DataFrame:
    """``df`` with ``standard``: value less its column's mean, by its population deviation; 0 where that is 0."""
    # means and deviations are aggregated before the shuffle; rows of a hot column value need not meet in one task
    of = df.groupBy(F.col(column).alias("_column")).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    out = df.join(of, F.col(column).eqNullSafe(F.col("_column")))
    return out.withColumn("standard", F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))).drop("_column", "_mean", "_sd")


def document_frequency(df: DataFrame, group: str, item: str, floor: float = 0.2) -> DataFrame:
    """(item, df, weight): in how many groups an item occurs, and max(floor, 1 - df / groups)."""
    distinct = df.select(group, item).filter(F.col(group).isNotNull() & F.col(item).isNotNull()).distinct()
    n = distinct.agg(F.count_distinct(group).alias("groups"))
    counts = distinct.groupBy(item).agg(F.count("*").alias("df"))
    return counts.join(F.broadcast(n), F.lit(True)).select(item, "df", F.greatest(F.lit(floor), 1 - F.col("df") / F.col("groups")).alias("weight"))  # n is one row


def words(text: Column) -> Column:
    """Words in small letters, cut at white space."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " "), lambda w: w != "")


def char_grams(text: Column, lo: int = 2, hi: int = 4) -> Column:
    """Character n-grams inside words, each word padded with a blank at both ends; a word no longer than n gives itself once."""

    def windows(p: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1)))
        return F.when(F.length(p) > n, F.transform(places, lambda i: F.substring(p, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def grams(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        whole = F.when(F.length(p) <= hi, F.array(p)).otherwise(F.array().cast("array<string>"))
        return F.concat(*[windows(p, n) for n in range(lo, hi + 1)], whole)

    return F.coalesce(F.flatten(F.transform(words(text), grams)), F.array().cast("array<string>"))


def tfidf_search(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int, shard_chars: int = 1_000_000) -> DataFrame:
    """(query, key, score, rank): the k documents most alike to each query by cosine of sublinear tf-idf over character n-grams.

    Statistics are over all documents. Texts are searched shard by shard (see ``search``), so postings are not shuffled.
    """
    asked = queries.select(F.col(key).alias("doc"), F.lit(True).alias("asked")).distinct()
    d = docs.select(F.col(key).alias("doc"), words(F.col(text)).alias("words")).groupBy("doc").agg(F.flatten(F.collect_list("words")).alias("words"))
    d = materialise(d.join(asked, "doc", "left"), "documents")  # read for sizes, counts and the search
    chars = F.length(F.array_join("words", " ")) + 1
    n, all_, of_queries = d.agg(F.count("doc"), F.sum(chars), F.sum(F.when(F.col("asked"), chars))).first()
    shards = -(-(all_ or 1) // shard_chars)
    tasks = -(-int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)  # groups of queries that give all cores work
    groups = max(1, min(tasks, (of_queries or 0) // 5_000), -(-(of_queries or 0) // (2 * shard_chars)))
    score = search.search_shards(d, n, shards, groups, k)
    w = W.partitionBy("query").orderBy(F.col("nine").desc(), "doc")
    return score.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", F.col("doc").alias(key), "score", "rank")


def resolve_names(names: DataFrame, name: str, known: DataFrame, full: str) -> DataFrame:
    """``names`` with resolved and status: exact (without case), unique_leaf, ambiguous_leaf or unmatched.

    The leaf is what follows the last dot. Null names are unmatched; known names that repeat count once.
    """
    k = known.select(F.lower(F.col(full)).alias("_full"), F.col(full).alias("_known")).filter("_full IS NOT NULL")
    exact = k.groupBy("_full").agg(F.min("_known").alias("_exact"))
    leaf = k.withColumn("_leaf", F.substring_index("_full", ".", -1)).groupBy("_leaf").agg(F.count_distinct("_full").alias("_n"), F.min("_known").alias("_one"))
    low = F.lower(F.col(name))
    out = names.withColumns({"_full": low, "_leaf": F.substring_index(low, ".", -1)}).join(exact, "_full", "left").join(leaf, "_leaf", "left")
    status = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_n") == 1, "unique_leaf").when(F.col("_n") > 1, "ambiguous_leaf").otherwise("unmatched")
    resolved = F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_one")))
    return out.withColumns({"resolved": resolved, "status": status}).drop("_full", "_leaf", "_exact", "_n", "_one")
