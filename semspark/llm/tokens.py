"""Encoding of texts with a public tokenizer, by reuse of chunks that texts share.

A rolling hash cuts each distinct text where its last bytes say so, so that equal passages give equal chunks wherever
they stand. Each distinct chunk is encoded once. When the chunks of a text are put together, every join is repaired:
from the last word of what stands before it, words are cut and encoded anew in the whole text, until a word ends where
one of the next chunk's own words ends. From there on both cut alike, as cutting looks at nothing before the
place it starts from, and the chunk's ids hold again. So ids agree with those of the text encoded at once.

Defined results: null and empty texts get the empty list; documents sent twice count once; texts that repeat are
encoded once; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_unique
from ..session import materialise

TOKENIZERS = "/opt/tokenizers"
# Fixed value: how byte-level BPE of this vocabulary cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, MEAN_BITS, LEAST, MOST = 16, 9, 128, 4096  # bytes


@lru_cache(maxsize=4)
def encoder(folder: str, name: str = "byte_bpe_50k"):  # noqa: ANN201
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _words():  # noqa: ANN202
    return regex.compile(PATTERN)


def _gear() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint64)


def chunks(text: str, gear: np.ndarray) -> list[str]:
    """The text cut where the hash of the WINDOW bytes before has MEAN_BITS low zeros; only between characters."""
    raw = text.encode("utf-8")
    if len(raw) <= LEAST:
        return [text]
    b = np.frombuffer(raw, np.uint8)
    g, h = gear[b], np.zeros(len(b), np.uint64)
    for j in range(WINDOW):
        h[j:] += g[: len(g) - j] << np.uint64(j)
    h = (h ^ (h >> np.uint64(17))) & np.uint64((1 << MEAN_BITS) - 1)
    starts = (b & 0xC0) != 0x80
    cut = np.flatnonzero((h[WINDOW - 1 : -1] == 0) & starts[WINDOW:]) + WINDOW
    out, at = [], 0
    while len(raw) - at > LEAST:
        i = np.searchsorted(cut, at + LEAST)
        end = int(cut[i]) if i < len(cut) else len(raw)
        if end - at > MOST:
            end = at + MOST
            while end < len(raw) and not starts[end]:
                end -= 1
        out.append(raw[at:end].decode())
        at = end
    if at < len(raw):
        out.append(raw[at:].decode())
    return out


def tail(chunk: str, last: int, n_last: int, encode) -> tuple[int, int, bool]:  # noqa: ANN001
    """Start of what the next chunk may change, the number of its ids, and whether it is one word.

    That is the last word, and an apostrophe before it: 'r, 'v and 'l are two words until the next letter makes them one.
    """
    if not last or chunk[last - 1] != "'":
        return last, n_last, True
    *_, before, _ = _words().finditer(chunk)
    return before.start(), n_last + len(encode(before.group())), False


def assemble(parts: list[tuple[str, np.ndarray, int, int]], encode) -> np.ndarray:  # noqa: ANN001
    """Ids of the text made of ``parts``: (chunk, its ids, start of its last word, ids of its last word)."""
    words = _words()
    text = "".join(p[0] for p in parts)
    chunk, ids, last, n_last = parts[0]
    last, n_last, single = tail(chunk, last, n_last, encode)
    out, pending, begin, offset = [ids[: len(ids) - n_last]], ids[len(ids) - n_last :] if single else None, last, len(chunk)
    # out: ids of all before `begin`, where the tail of the text so far starts; pending: ids of that tail, if it is one word and ends there
    for chunk, ids, last, n_last in parts[1:]:
        own, own_end, skip, stop = words.finditer(chunk), offset, 0, offset + len(chunk)
        for w in words.finditer(text, begin):
            end = w.end()
            if end > stop:
                pending = None
                break
            out.append(pending if pending is not None and end == offset else np.array(encode(w.group()), np.int32))
            begin, pending = end, None
            while own_end < end:
                o = next(own)
                own_end = offset + o.end()
                skip += len(encode(o.group()))
            if own_end == end:
                if end < stop:
                    at, n, single = tail(chunk, last, n_last, encode)
                    if offset + at < end:  # the whole text has a word's end before the last word, too
                        at, n, single = last, n_last, True
                    cut = len(ids) - n
                    out.append(ids[skip:cut])
                    begin, pending = offset + at, ids[cut:] if single else None
                else:
                    pending = None
                    begin, pending = w.start(), out.pop()
                break
            if end == stop:
                begin, pending = w.start(), out.pop()
        offset = stop
    if pending is None:
        out.extend(np.array(encode(w.group()), np.int32) for w in words.finditer(text, begin))
    else:
        out.append(pending)
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def encode_texts(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids) of each distinct (key, text)."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("text_key", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256)))).dropDuplicates(["key", "text_key"])
    docs = materialise(docs, "texts")
    distinct = docs.filter("text_key IS NOT NULL").select("text_key", "text").dropDuplicates(["text_key"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gear = _gear()
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch["text_key"], batch["text"], strict=True) for i, c in enumerate(chunks(t, gear))]
            yield pd.DataFrame(rows, columns=["text_key", "seq", "chunk"])

    pieces = distinct.mapInPandas(cut, "text_key binary, seq int, chunk string").withColumn("chunk_key", F.unhex(F.sha2("chunk", 256)))
    pieces = materialise(pieces, "chunks")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, words = encoder(folder, name), _words()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = enc.encode_ordinary_batch(texts, num_threads=1)
            last, n_last = [], []
            for t in texts:
                w = None
                for w in words.finditer(t):  # noqa: B007
                    pass
                last.append(w.start())
                n_last.append(len(enc.encode_ordinary(w.group())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(last, pa.int32()), pa.array(n_last, pa.int32())], ["chunk_key", "chunk", "ids", "last", "n_last"])

    encoded = pieces.select("chunk_key", "chunk").dropDuplicates(["chunk_key"]).mapInArrow(encode, "chunk_key binary, chunk string, ids array<int>, last int, n_last int")
    places = join_unique(pieces.select("text_key", "seq", "chunk_key"), encoded, "chunk_key")
    whole = places.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk", "ids", "last", "n_last"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        word = lru_cache(maxsize=50_000)(enc.encode_ordinary)
        for batch in batches:
            ids = [assemble([(p["chunk"], np.array(p["ids"], np.int32), p["last"], p["n_last"]) for p in parts], word) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["text_key", "ids"])

    joined = whole.mapInArrow(join, "text_key binary, ids array<int>")
    out = join_unique(docs.select("key", "text_key"), joined, "text_key", "left")
    return out.select("key", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def count_tokens(df: DataFrame, text: str, size: str = "n_tokens", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``df`` with the number of tokens of each text; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            n = [len(x) for x in enc.encode_ordinary_batch([t or "" for t in batch.column(at).to_pylist()], num_threads=1)]
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32())], [*[c for c in batch.schema.names if c != text], size])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text), f"{size} int"])
    return df.mapInArrow(run, schema)
