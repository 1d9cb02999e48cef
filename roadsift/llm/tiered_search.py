"""Ranked lexical search over a tiered index: high-impact postings first, lower tiers only for items whose result is not yet proven.

Scores are those of the caller's contract: a term's weight is floor(1000 ln((2N + 2) /
(2 df + 1))), the impact of a posting (10^9 tf) div (1000 tf + 20 m) with m = 50 +
(50 n N) div L, and a document's score the sum of weight times impact over the item's
distinct terms, in 64-bit integers.

Index.  One pass over the texts keeps, a row a document, the terms that the items use
with their counts.  Impacts fall into levels; a term's tier 0 is its highest levels with
at most ``TIERS[0]`` postings in all, tier 1 those with at most ``TIERS[1]``, tier 2 the
rest.  The index is one row a document with a pair of columns (terms, impacts) a tier, so
a search reads the columns of the tiers it needs, and all postings of a document in a
tier stand together: its score over these tiers needs no shuffle.  Of every term the
largest impact below each tier is kept as the residual bound.

Search.  Tier 0 gives every item its best documents by partial score; the k-th of these
is a floor that the true k-th score reaches.  If the residual bounds of the item's terms
add up to less than the floor, no document outside the tiers read can be in the result:
documents whose partial score and residuals of unmatched terms reach the floor are scored
in full, and the item is done.  All other items fall through to tiers 0 and 1, and then
to all tiers, where partial scores are the scores.  Ties at the floor stay candidates, so
results are exact, ties by document id included.

Scale: the stated items are matched against all documents in blocks; items come in
blocks of about ``TERMS`` terms, whose vocabulary, weights and bounds are the only things
broadcast.  A task keeps k rows an item, whatever its documents; the merge is one window
over these.  Texts are read once a block and never shuffled.

Edge cases: null texts have no terms and no results; an item without terms, or whose
terms stand in no document, has none; null document ids sort last among equal scores;
rows that share an id, and repeated rows, are ranked each; documents with other columns
are fine, as only id and text are read; empty tables give an empty result.  Document ids
must be integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, grows, ids_field, quoted, slices, store, utf8
from .words import flat_words

#: Most postings of a term in tier 0, and in tiers 0 and 1 together; the last tier holds all others.
TIERS = (1_000, 50_000)
#: Impacts are below IMPACT; a level is a step of IMPACT / LEVELS.
IMPACT, LEVELS = 1_000_000, 250
#: Terms of the items of a block, about.
TERMS = 200_000
#: Cells (documents x items) that are scored at a time.
CELLS = 1_000_000
NO_ID = np.iinfo(np.int64).max


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    m = 50 + (50 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


@dataclass
class Vocabulary:
    """Terms of a block of items: their numbers, and for each term the items that hold it (items[starts[t]:starts[t + 1]])."""

    terms: pa.Array
    rows: np.ndarray
    items: np.ndarray
    starts: np.ndarray


def item_terms(items: DataFrame, text: str) -> DataFrame:
    """__item (number of the row), term: the distinct terms of each item."""
    rows = items.select("__item", utf8(quoted(text)).alias("body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 4000, 4 << 20):
            words, bounds = flat_words(batch.column("body"))
            yield pa.RecordBatch.from_arrays([batch.column("__item").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))), words.cast(pa.binary())], names=["__item", "term"])

    return rows.mapInArrow(cut, "__item long, term binary").distinct()


def _vocabulary(found: pa.Table) -> Vocabulary:
    pairs = found.sort_by([("term", "ascending"), ("__item", "ascending")])
    coded = pairs.column("term").combine_chunks().dictionary_encode()  # in order of first appearance, so in order
    rows, own = np.unique(pairs.column("__item").to_numpy(), return_inverse=True)
    codes = coded.indices.to_numpy()
    return Vocabulary(coded.dictionary.cast(pa.large_binary()), rows, own, np.searchsorted(codes, np.arange(len(coded.dictionary) + 1)))


def _count_terms(docs: DataFrame, text: str, doc_id: str, terms: pa.Array) -> DataFrame:
    """__row, doc_id, n (terms with repeats), terms (numbers of the known ones, ascending), tf."""
    held = docs.sparkSession.sparkContext.broadcast(terms)
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), quoted(doc_id).cast("long").alias("doc_id"), utf8(quoted(text)).alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in slices(batches, "body", 4000, 4 << 20):
            words, bounds = flat_words(batch.column("body"))
            number = pc.index_in(words, value_set=known)
            at = np.flatnonzero(np.asarray(number.is_valid()))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))[at]
            cell, tf = np.unique(owner * max(1, len(known)) + pc.drop_null(number).to_numpy().astype(np.int64), return_counts=True)
            offsets = pa.array(np.searchsorted(cell, np.arange(batch.num_rows + 1) * max(1, len(known))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), batch.column("doc_id"), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(offsets, pa.array((cell % max(1, len(known))).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))],
                names=["__row", "doc_id", "n", "terms", "tf"],
            )

    return rows.mapInArrow(count, "__row long, doc_id long, n long, terms array<int>, tf array<int>")


def _flat(batch: pa.RecordBatch, *columns: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of each element of list columns of equal lengths, and the elements."""
    lists = [batch.column(c) for c in columns]
    sizes = np.diff(lists[0].offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]


def _levels(counted: DataFrame, docs: int, total: int) -> DataFrame:
    """term, level, postings, top: the histogram of a term's impacts; each task adds up its own first."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, (term, tf) = _flat(batch, "terms", "tf")
            impact = impacts(tf, batch.column("n").to_numpy()[row], docs, total)
            cell, inverse, counts = np.unique(term * LEVELS + impact * LEVELS // IMPACT, return_inverse=True, return_counts=True)
            top = np.zeros(len(cell), np.int64)
            np.maximum.at(top, inverse, impact)
            yield pa.RecordBatch.from_arrays([pa.array(cell // LEVELS), pa.array(cell % LEVELS), pa.array(counts.astype(np.int64)), pa.array(top)], names=["term", "level", "postings", "top"])

    part = counted.select("n", "terms", "tf").mapInArrow(histogram, "term long, level long, postings long, top long")
    return part.groupBy("term", "level").agg(F.sum("postings").alias("postings"), F.max("top").alias("top"))


def _tiers(levels: DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """df of each term, the lowest level of each tier but the last (terms x tiers), and the largest impact below it; one row a term comes to the driver."""
    from_top = Window.partitionBy("term").orderBy(F.col("level").desc())
    summed = levels.withColumn("above", F.sum("postings").over(from_top))
    cuts = [F.coalesce(F.min(F.when(F.col("above") <= most, F.col("level"))), F.lit(LEVELS)).alias(f"cut{k}") for k, most in enumerate(TIERS)]
    rest = [F.coalesce(F.max(F.when(F.col("above") > most, F.col("top"))), F.lit(0)).alias(f"rest{k}") for k, most in enumerate(TIERS)]
    found = summed.groupBy("term").agg(F.sum("postings").alias("df"), *cuts, *rest).toArrow()
    df, cut, residual = np.zeros(terms, np.int64), np.full((terms, len(TIERS)), LEVELS, np.int64), np.zeros((terms, len(TIERS) + 1), np.int64)
    at = found.column("term").to_numpy()
    df[at] = found.column("df").to_numpy()
    for k in range(len(TIERS)):
        cut[at, k], residual[at, k] = found.column(f"cut{k}").to_numpy(), found.column(f"rest{k}").to_numpy()
    return df, cut, residual


def _tiered(counted: DataFrame, cut: np.ndarray, docs: int, total: int) -> DataFrame:
    """__row, doc_id and, for each tier, the document's terms in it (t0, t1, ...) and their impacts (i0, i1, ...)."""
    held = counted.sparkSession.sparkContext.broadcast(cut)
    n_tiers = len(TIERS) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            row, (term, tf) = _flat(batch, "terms", "tf")
            impact = impacts(tf, batch.column("n").to_numpy()[row], docs, total)
            tier = (impact[:, None] * LEVELS // IMPACT < cuts[term]).sum(1)
            out = [batch.column("__row"), batch.column("doc_id")]
            for k in range(n_tiers):
                mine = np.flatnonzero(tier == k)
                offsets = pa.array(np.searchsorted(row[mine], np.arange(batch.num_rows + 1)).astype(np.int32))
                out += [pa.ListArray.from_arrays(offsets, pa.array(x[mine].astype(np.int32))) for x in (term, impact)]
            yield pa.RecordBatch.from_arrays(out, names=["__row", "doc_id", *[f"{c}{k}" for k in range(n_tiers) for c in "ti"]])

    fields = ", ".join(f"t{k} array<int>, i{k} array<int>" for k in range(n_tiers))
    return counted.filter(F.size("terms") > 0).mapInArrow(deal, f"__row long, doc_id long, {fields}")


class Scorer:
    """Scores of documents against a block of items; ``live`` numbers the items that take part."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, residual: np.ndarray, live: np.ndarray):
        self.weights, self.residual, self.live = weights, residual, live
        place = np.full(len(vocabulary.rows), -1)
        place[live] = np.arange(len(live))
        term = np.repeat(np.arange(len(vocabulary.starts) - 1), np.diff(vocabulary.starts))
        own = place[vocabulary.items]
        self.items = own[own >= 0]
        self.starts = np.searchsorted(term[own >= 0], np.arange(len(vocabulary.starts)))
        #: By item: what the residual impacts of all its terms could add.
        self.unseen = np.bincount(self.items, (weights * residual)[term[own >= 0]].astype(np.float64), len(live)).astype(np.int64)

    def scores(self, rows: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score over the postings given, and what terms outside them could still add (both rows x items; sums stay far below 2^53, where doubles are exact)."""
        times = self.starts[term + 1] - self.starts[term]
        first = np.repeat(self.starts[term] - (np.cumsum(times) - times), times)
        cell = np.repeat(row, times) * len(self.live) + self.items[first + np.arange(len(first))]
        weights = self.weights[term]
        shape = (rows, len(self.live))
        partial = np.bincount(cell, np.repeat((weights * impact).astype(np.float64), times), rows * len(self.live)).reshape(shape)
        matched = np.bincount(cell, np.repeat((weights * self.residual[term]).astype(np.float64), times), rows * len(self.live)).reshape(shape)
        return partial, self.unseen[None] - matched


def _batches(batches: Iterator[pa.RecordBatch], tiers: int, items: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of few documents with the flat postings of the first ``tiers`` tiers."""
    most = max(1, CELLS // max(1, items))
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            batch = whole.slice(at, most)
            found = [_flat(batch, f"t{k}", f"i{k}") for k in range(tiers)]
            yield batch, np.concatenate([f[0] for f in found]), np.concatenate([f[1][0] for f in found]), np.concatenate([f[1][1] for f in found])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy()


def _best(item: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each item by falling score, then id, then row."""
    order = np.lexsort((row, ident, -score, item))
    own = item[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


RANKED = "item int, __row long, doc_id long, score long"


def _top(index: DataFrame, scorer: Scorer, tiers: int, k: int) -> DataFrame:
    """The k best documents of each live item by score over the first tiers, a task at a time; merged over the tasks."""
    held = index.sparkSession.sparkContext.broadcast(scorer)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        floor = np.ones(len(s.live))
        kept = [np.empty(0, np.int64)] * 4  # item, score, id, row
        waiting: list[list[np.ndarray]] = []

        def settle() -> list[np.ndarray]:
            both = [np.concatenate(x) for x in zip(kept, *waiting, strict=True)]
            best = _best(*both, k)
            both = [x[best] for x in both]
            count = np.bincount(both[0], minlength=len(s.live))
            last = np.cumsum(count) - 1
            full = count >= k
            floor[full] = both[1][last[full]]
            waiting.clear()
            return both

        for batch, row, term, impact in _batches(batches, tiers, len(s.live)):
            partial, _ = s.scores(batch.num_rows, row, term, impact)
            r, i = np.nonzero(partial >= floor)
            if len(r):
                waiting.append([i, partial[r, i].astype(np.int64), _ids(batch)[r], batch.column("__row").to_numpy()[r]])
                if sum(len(w[0]) for w in waiting) > 4 * k * len(s.live) + 100_000:
                    kept = settle()
        item, score, ident, row = settle() if waiting else kept
        yield pa.RecordBatch.from_arrays([pa.array(s.live[item].astype(np.int32)), pa.array(row), pa.array(ident, mask=ident == NO_ID), pa.array(score)], names=["item", "__row", "doc_id", "score"])

    columns = [f"{c}{t}" for t in range(tiers) for c in "ti"]
    return _merged(index.select("__row", "doc_id", *columns).mapInArrow(top, RANKED), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "__row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _candidates(index: DataFrame, scorer: Scorer, floors: np.ndarray, tiers: int) -> DataFrame:
    """item, __row of documents whose score could reach the item's floor."""
    held = index.sparkSession.sparkContext.broadcast((scorer, floors))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, least = held.value
        for batch, row, term, impact in _batches(batches, tiers, len(s.live)):
            partial, more = s.scores(batch.num_rows, row, term, impact)
            r, i = np.nonzero((partial > 0) & (partial + more >= least))
            yield pa.RecordBatch.from_arrays([pa.array(s.live[i].astype(np.int32)), batch.column("__row").take(pa.array(r))], names=["item", "__row"])

    columns = [f"{c}{t}" for t in range(tiers) for c in "ti"]
    return index.select("__row", *columns).mapInArrow(pick, "item int, __row long")


def _completed(index: DataFrame, candidates: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """The k best candidates of each item by score over all tiers."""
    held = index.sparkSession.sparkContext.broadcast(scorer)
    wanted = candidates.groupBy("__row").agg(F.collect_list("item").alias("wanted"))  # at most the items of a block

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        place = np.full(int(s.live.max()) + 1, -1)
        place[s.live] = np.arange(len(s.live))
        for batch, row, term, impact in _batches(batches, len(TIERS) + 1, len(s.live)):
            scores, _ = s.scores(batch.num_rows, row, term, impact)
            r, (item,) = _flat(batch, "wanted")
            yield pa.RecordBatch.from_arrays(
                [pa.array(item.astype(np.int32)), batch.column("__row").take(pa.array(r)), batch.column("doc_id").take(pa.array(r)), pa.array(scores[r, place[item]].astype(np.int64))], names=["item", "__row", "doc_id", "score"]
            )

    return _merged(index.join(grows(wanted), "__row").mapInArrow(full, RANKED), k)


def _search_block(docs: DataFrame, vocabulary: Vocabulary, text: str, doc_id: str, k: int) -> DataFrame | None:
    counted = Stored(_count_terms(docs, text, doc_id, vocabulary.terms), "term-counts")
    n_docs, total = counted.df.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return None
    df, cut, residual = _tiers(_levels(counted.df, n_docs, total), len(vocabulary.terms))
    weights = np.asarray([weight(int(x), n_docs) for x in df], np.int64) * (df > 0)
    index = store(_tiered(counted.df, cut, n_docs, total), "tiered-index")
    counted.drop()
    live = np.arange(len(vocabulary.rows))
    done: list[DataFrame] = []
    for tier in range(len(TIERS) + 1):
        if not len(live):
            break
        scorer = Scorer(vocabulary, weights, residual[:, tier], live)
        best = store(_top(index, scorer, tier + 1, k), "tier-best")
        if tier == len(TIERS):
            done.append(best.withColumn("tiers", F.lit(tier + 1)))
            break
        floors = np.zeros(len(vocabulary.rows), np.int64)
        for r in best.filter(F.col("rank") == k).select("item", "score").collect():
            floors[r["item"]] = r["score"]
        proven = (scorer.unseen < floors[live]) | (scorer.unseen == 0)
        if proven.any():
            now = live[proven]
            own = Scorer(vocabulary, weights, residual[:, tier], now)
            candidates = _candidates(index, own, np.maximum(floors[now], 1), tier + 1)
            done.append(store(_completed(index, candidates, own, k), "tier-done").withColumn("tiers", F.lit(tier + 1)))
        live = live[~proven]
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    numbers = docs.sparkSession.createDataFrame([(k, int(r)) for k, r in enumerate(vocabulary.rows)], "item int, __item long")
    return out.join(F.broadcast(numbers), "item").select("__item", "rank", "doc_id", "score", "tiers")  # a row an item of the block


def search(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block_terms: int = TERMS) -> DataFrame:
    """``item_id``, rank (int, from 1), doc_id, score (long) of each item's k best documents with a score above 0, and ``tiers``, the tiers it took to prove them."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[doc_id].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"{doc_id} must be an integer")
    numbered = store(items.select(F.monotonically_increasing_id().alias("__item"), quoted(item_id).alias("__id"), quoted(item_text).alias("__text")), "items")
    terms = store(item_terms(numbered, "__text"), "item-terms")
    blocks = max(1, -(-terms.count() // block_terms))
    block = F.pmod(F.xxhash64("__item"), F.lit(blocks))
    results = []
    for b in range(blocks):
        found = terms.filter(block == b).toArrow()  # about block_terms rows
        if found.num_rows and (part := _search_block(docs, _vocabulary(found), text, doc_id, k)) is not None:
            results.append(part)
    kind = items.schema[item_id].dataType
    if not results:
        fields = [T.StructField(item_id, kind), T.StructField("rank", T.IntegerType()), T.StructField(doc_id, T.LongType()), T.StructField("score", T.LongType()), T.StructField("tiers", T.IntegerType())]
        return spark.createDataFrame([], T.StructType(fields))
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out.join(numbered.select("__item", F.col("__id").alias("__item_id")), "__item").select(F.col("__item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score", "tiers")
