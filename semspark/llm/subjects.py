"""Subjects of documents by label propagation over a graph of documents and the phrases that they share.

Two documents are alike in so far as their sentences share phrases (word and character n-grams). That graph is kept
in factors, as edges document - sentence form - phrase, so no pairs of documents are made. Hand labels of documents
are the seeds. Each round joins sentence forms with phrases and back, and forms with documents: a phrase takes the mean
subject of the sentences that hold it, a sentence the sharpened mean of its phrases, purer phrases weighing more, a
document the shares of its sentences. Seed evidence enters the phrases anew in each round. When
the rounds have settled, seeds are verified: a label is trusted where the rest of the collection agrees, that is where its
document's share of the subject reaches ``share``; others are set aside and listed (``seeds``). Trusted seeds are clamped:
the rounds that follow take evidence from them alone, and in the end their documents bear them whatever the last round says. Phrases that seeds know well and tie to no subject are no
links (verification of edges). Rounds settle when the subjects of documents change by less than ``tolerance``.

A mention in passing is learned, not listed: a phrase tied to no subject is one of passing mention if sentences that hold it name a subject
while the labels of their documents do so far more seldom than for other sentences. Such sentences treat no subject; so does
a sentence whose phrases stay below an even chance of any. A document has the subjects of at least ``share`` of its sentences.

Headings, numbering, speaker marks, table rows, code, bracketed lines, footers and page furniture are no sentences.

Defined results: null, blank and contentless texts have no subject; documents and labels sent twice count once;
labels are compared without regard to case and outer blanks, those that name no known subject or no document are left
out; without any seed nothing is found; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import hot_keys, join_unique
from ..session import materialise

MOST = 1000  # subjects, as each is a column

# Line starts that mark items and speakers, and lines that are furniture.
LEAD = re.compile(r"^(?:\[\d{1,2}:\d{2}(?::\d{2})?\]\s*\S+?:\s*|[-*•]\s+|\d{1,3}[.)]\s+)")
FURNITURE = re.compile(r"^(?:#.*|ticket-\d+|state: ?\w+|page \d+ ?/ ?\d+|>>>.*<<<|-{2,}|\|.*|\(.*\)|```.*|generated by .*do not reply|(?:confidential[. ]*)?internal use only)\W*$", re.IGNORECASE)
ENDS = re.compile(r"(?<=[。！？])|(?<=[.!?])(?=\s)|銆\S?|(?<=[.!?])$")
BREAKS = re.compile(r"<br ?/?>|[\n\r\x0b\x0c\x85  ]+", re.IGNORECASE)
CJK = r"㐀-鿿豈-﫿"
UNIT = re.compile(rf"[{CJK}]+|[^\W\d_{CJK}][^\W_{CJK}]*")


def sentences(text: str) -> list[str]:
    """Sentences of a text in a plain form: no case, accents, digits or codes (words of letters, digits and underscores)."""
    text = unicodedata.normalize("NFKC", html.unescape(text)).replace("​", "").replace("﻿", "")
    parts: list[str] = []
    code = False
    for line in BREAKS.split(text):
        line = " ".join(line.split())
        if line.startswith("```"):
            code = not code
            continue
        if code or not line or FURNITURE.match(line):
            continue
        bare = LEAD.sub("", line)
        if parts and bare == line and not re.search(r"[.!?。！？銆]\W*$", parts[-1]):
            parts[-1] += ("" if re.search(rf"[{CJK}]$", parts[-1]) else " ") + bare  # the line before was broken off
        else:
            parts.append(bare)
    out = []
    for part in parts:
        for s in ENDS.split(part):
            s = LEAD.sub("", s.strip())
            s = unicodedata.normalize("NFKD", s.lower())
            s = "".join(c for c in s if not unicodedata.combining(c))
            s = " ".join(w for w in re.sub(r"\w*_\w*\d\w*", " ", re.sub(r"\d+", "0", s)).split())
            if UNIT.search(s):
                out.append(s)
    return out


def phrases(sentence: str) -> set[str]:
    """Runs of 1 to 3 words and of 2 to 4 ideographs."""
    out, words = set(), []
    for u in UNIT.findall(sentence):
        if "㐀" <= u[0]:
            out.update(u[i : i + n] for n in (2, 3, 4) for i in range(len(u) - n + 1))
            words = []
        else:
            words.append(u)
            out.update(" ".join(words[-n:]) for n in (1, 2, 3) if len(words) >= n)
    return out


def _signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def sentence_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, form, sentence, n): how often a document has each sentence form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                own: dict[str, int] = {}
                for s in sentences(t):
                    own[s] = own.get(s, 0) + 1
                rows.extend((d, _signed(s), s, n) for s, n in own.items())
            yield pd.DataFrame(rows, columns=["doc_id", "form", "sentence", "n"])

    return docs.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, form long, sentence string, n int")


def phrase_edges(forms: DataFrame) -> DataFrame:
    """(form, phrase) of all sentence forms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, _signed(p)) for f, s in zip(batch["form"], batch["sentence"], strict=True) for p in phrases(s)]
            yield pd.DataFrame(rows, columns=["form", "phrase"])

    return forms.mapInPandas(run, "form long, phrase long")


class SubjectGraph:
    """Propagates the subjects of labelled documents to sentence forms and documents; ``subjects``: the list of their names, at most MOST.

    purity: a phrase that occurs often in labelled documents links only if that share of them bears one label. even: the
    weight of no subject in a sentence. Both are taken of the share that the purest tenth of phrases reaches, which
    tells how complete the labels are. prior: labelled occurrences that weigh as much as the base rate. passing: a phrase is
    one of passing mention below this part of the usual agreement with labels.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, subjects: list[str], share: float = 0.25, rounds: int = 8, tolerance: float = 0.01, prior: float = 3.0, purity: float = 0.7, even: float = 0.35, passing: float = 0.55):
        if len(subjects) > MOST:
            raise ValueError(f"more than {MOST} subjects")
        self.subjects, self.share, self.rounds, self.tolerance = subjects, share, rounds, tolerance
        self.prior, self.purity, self.even, self.passing = prior, purity, even, passing
        docs = docs.select("doc_id", "text").filter("text IS NOT NULL").distinct()
        self.counts = materialise(sentence_counts(docs), "sentences")
        name = F.lower(F.trim("subject"))
        self.labels = labels.select("doc_id", name.alias("subject")).filter(F.col("subject").isin(subjects)).distinct()
        self.names = [f"s{i}" for i in range(len(subjects))]
        self.changes: list[float] = []

    def _top(self) -> Column:
        return F.greatest(*[F.col(n) for n in self.names], F.lit(0.0), F.lit(0.0))

    def _name(self, top: Column) -> Column:
        return F.coalesce(*[F.when(F.col(n) == top, F.lit(s)) for n, s in zip(self.names, self.subjects, strict=True)], F.lit(None).cast("string"))

    def _seen(self, seeds: DataFrame) -> DataFrame:
        """(form, s0, s1, ..., size): how often each form stands in labelled documents, and in those that bear each subject."""
        names = self.names
        bears = [F.max((F.col("subject") == s).cast("double")).alias(n) for s, n in zip(self.subjects, names, strict=True)]
        marks = self.labels.select("doc_id").distinct().join(seeds.groupBy("doc_id").agg(*bears), "doc_id", "left").fillna(0.0, names)
        return materialise(self.counts.join(marks, "doc_id").groupBy("form").agg(*[F.sum(F.col("n") * F.col(n)).alias(n) for n in names], F.sum("n").alias("size")), "seen")

    def _phrase_sums(self, edges: DataFrame, seen: DataFrame) -> DataFrame:
        return materialise(edges.join(seen, "form").groupBy("phrase").agg(*[F.sum(n).alias(n) for n in [*self.names, "size"]]), "seeds")

    def _purest(self, sums: DataFrame) -> float:
        """The share of one label that the purest tenth of well-known phrases reaches: one figure."""
        return sums.filter("size >= 15").agg(F.percentile_approx(self._top() / F.col("size"), 0.9)).first()[0] or 1.0

    def _passing(self, frames: DataFrame, state: DataFrame, seen: DataFrame) -> DataFrame:
        """The phrases of passing mention among ``frames``, the edges of phrases that are tied to no subject."""
        names, top = self.names, self._top()
        told = state.filter((top >= 0.5) & F.col("sure")).select("form", *[(F.col(n) == top).cast("double").alias(f"p{n}") for n in names])
        agree = sum((F.col(f"p{n}") * F.col(n) for n in names), F.lit(0.0))
        judged = told.join(seen, "form").select("form", agree.alias("agree"), "size")
        usual = judged.agg(F.sum("agree") / F.sum("size")).first()[0]  # one figure
        rows = frames.join(judged, "form").groupBy("phrase").agg(F.sum("agree").alias("agree"), F.sum("size").alias("size"))
        return rows.filter((F.col("size") >= 15) & (F.col("agree") < self.passing * (usual or 0.0) * F.col("size"))).select("phrase")

    @cached_property
    def result(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, subject, share) of the documents, and (doc_id, subject, trusted) of the seeds."""
        names, prior = self.names, self.prior
        forms = materialise(self.counts.groupBy("form").agg(F.first("sentence").alias("sentence"), F.sum("n").alias("n")), "forms")
        edges = materialise(phrase_edges(forms.select("form", "sentence")), "edges")
        hot = hot_keys(edges, "phrase")
        sizes = materialise(self.counts.groupBy("doc_id").agg(F.sum("n").alias("all")), "sizes")
        known = self.labels.join(sizes.select("doc_id"), "doc_id", "left_semi")
        seen = self._seen(known)
        seeds = self._phrase_sums(edges, seen)
        level = self._purest(seeds)
        flat = seeds.filter((F.col("size") >= 15) & (self._top() < self.purity * level * F.col("size"))).select("phrase")
        links = materialise(join_unique(edges, flat, "phrase", "left_anti", hot=hot), "links")
        counted = forms.select("form", "n")
        trusted, state, before, shares, verified = known, None, None, None, False
        for turn in range(self.rounds):
            sums = seen.agg(F.sum("size").alias("size"), *[F.sum(n).alias(n) for n in names]).first()  # one figure a subject
            base = [(sums[n] or 0.0) / (sums["size"] or 1.0) for n in names]

            def shrunk(source: list[Column], size: Column, base: list[float] = base) -> list[Column]:
                return [((c + prior * b) / (size + prior)).alias(n) for c, b, n in zip(source, base, names, strict=True)]

            if state is None:
                current = seeds.select("phrase", *shrunk([F.col(n) for n in names], F.col("size")))
            else:
                told = links.join(state.join(counted, "form").select("form", "n", *[(F.col("n") * F.col(n)).alias(n) for n in names]), "form")
                mean = told.groupBy("phrase").agg(*[F.sum(n).alias(n) for n in names], F.sum("n").alias("size"))
                old = seeds.select("phrase", *[F.col(n).alias(f"o{n}") for n in names], F.col("size").alias("osize"))
                both = mean.join(old, "phrase", "left").fillna(0.0, ["osize", *[f"o{n}" for n in names]])
                current = both.select("phrase", *shrunk([F.col(n) + F.col(f"o{n}") for n in names], F.col("size") + F.col("osize")))
            weighed = join_unique(links, current.withColumn("w", F.pow(self._top(), 4)), "phrase", hot=hot)
            mixed = weighed.groupBy("form").agg(*[F.coalesce(F.try_divide(F.sum(F.col("w") * F.col(n)), F.sum("w")), F.lit(0.0)).alias(n) for n in names], F.max(self._top()).alias("best"))
            power = sum((F.pow(F.col(n), 3) for n in names), F.lit((self.even * level) ** 3))
            state = mixed.select("form", (F.col("best") >= 0.5 * level).alias("sure"), *[(F.pow(F.col(n), 3) / power).alias(n) for n in names])
            state = materialise(state, "state")
            top = self._top()
            treats = state.filter((top >= 0.5) & F.col("sure")).select("form", self._name(top).alias("subject"))
            own = join_unique(self.counts, treats, "form").groupBy("doc_id", "subject").agg(F.sum("n").alias("n"))
            shares = materialise(own.join(sizes, "doc_id").select("doc_id", "subject", (F.col("n") / F.col("all")).alias("share")), "shares")
            held = shares.filter(F.col("share") >= self.share).select("doc_id", "subject")
            if before is not None:
                n, kept = held.count(), held.join(before, ["doc_id", "subject"], "left_semi").count()
                self.changes.append((n + before.count() - 2 * kept) / max(n, 1))
            before = held
            settled = bool(self.changes) and self.changes[-1] < self.tolerance or turn + 2 == self.rounds
            if settled and verified:
                break
            if settled:
                verified = True
                frames = materialise(join_unique(edges, flat, "phrase", "left_semi", hot=hot), "frames")
                aside = join_unique(frames, self._passing(frames, state, seen), "phrase", "left_semi", hot=hot).select("form").distinct()
                links = materialise(links.join(aside, "form", "left_anti"), "links")
                trusted = materialise(known.join(held, ["doc_id", "subject"], "left_semi"), "trusted")
                seen = self._seen(trusted)
                seeds = self._phrase_sums(links, seen)
                level = self._purest(seeds)
        clamped = trusted.join(shares, ["doc_id", "subject"], "left").select("doc_id", "subject", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(self.share)).alias("share"))
        rest = shares.join(trusted, ["doc_id", "subject"], "left_anti")
        seeds = known.join(trusted.withColumn("trusted", F.lit(True)), ["doc_id", "subject"], "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
        return rest.select("doc_id", "subject", "share").unionByName(clamped), seeds

    def document_shares(self) -> DataFrame:
        """(doc_id, subject, share): the share of each document's sentences that treat the subject; of a trusted label at least ``share``."""
        return self.result[0]

    def seeds(self) -> DataFrame:
        """(doc_id, subject, trusted) of the labels that name a known subject of a document with sentences."""
        return self.result[1]
