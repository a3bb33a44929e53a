"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are hashed words, with no cap on their number. A term weighs its count, its
rarity over all documents and the log-odds of its labels in the rows learnt from;
the last keeps ordinary words from drowning the few that matter (by rarity alone
the nearest examples share a topic, not a label). Examples are the distinct
vectors of the rows learnt from, at most ``EXAMPLES`` of them (half with toxic rows
among them while there are enough); the space has the terms of their texts that
``LEAST`` rows or more hold, so the index is bounded by the examples and goes to
every task. Document frequencies and label counts are over all rows.

The index is inverted: each term lists the blocks of examples that hold it with its
largest weight there, and each such entry its postings. A query adds up what every
block could reach at best, scores the postings of the best few blocks, then those of
each block that can still reach its kth neighbour: the neighbours are exact. Votes
are weighted by distance and calibrated on the rows learnt from, each scored with
its own row left out of the vote and of the log-odds.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialize
from . import shipping, textbytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXAMPLES = 4096
NEIGHBOURS = 8
# Examples of a block, and blocks that are scored before any bound is used.
BLOCK, OPEN = 256, 2
# Terms that one of so many examples holds are kept as whole columns, not as postings.
COMMON = 32
# Postings and scores of the queries that are answered together.
WORK = 1 << 20
BINS = 20
# Terms of one task held before they are added up.
GATHER = 1 << 21
# Rows learnt from that must hold a term before it counts, and rows added to each.
LEAST = 3
PRIOR = 3.0


def _terms(column: pa.Array):
    """``(first row, last row, text of each word, hash of each word)``, letters only and in lower case."""
    low, mark = textbytes.lower_table(), textbytes.letters_table()
    for first, last, data, offsets in textbytes.pieces(column):
        data = low[data]
        starts, ends = textbytes.word_spans(data, offsets, mark)
        hashes = textbytes.Rolling(data).of(starts, ends)
        yield first, last, np.searchsorted(offsets, starts, side="right") - 1, hashes


def _pairs(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(text, term)`` and how often."""
    by = np.lexsort((hashes, text))
    text, hashes = text[by], hashes[by]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))) if len(text) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(text)))


def term_labels(known: DataFrame) -> DataFrame:
    """``term, toxic, other``: rows learnt from with the term, by label. ``known`` is ``text, label``."""

    def added(terms, labels):
        term, label = np.concatenate(terms), np.concatenate(labels)
        unique, place = np.unique(term, return_inverse=True)
        toxic = np.bincount(place, weights=label, minlength=len(unique)).astype(np.int64)
        count = np.bincount(place, minlength=len(unique))
        for a in range(0, len(unique), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(unique[a : a + 100_000].view(np.int64)), pa.array(toxic[a : a + 100_000]),
                 pa.array((count - toxic)[a : a + 100_000].astype(np.int64))],
                names=["term", "toxic", "other"],
            )

    def run(batches):
        terms, labels, held = [], [], 0
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, text, hashes in _terms(batch.column(0)):
                text, hashes, _ = _pairs(text, hashes)
                terms.append(hashes)
                labels.append(label[first + text])
                held += len(hashes)
                if held > GATHER:
                    yield from added(terms, labels)
                    terms, labels, held = [], [], 0
        if held:
            yield from added(terms, labels)

    rows = known.mapInArrow(run, "term long, toxic long, other long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_odds(toxic, other, size: tuple[int, int]) -> np.ndarray:
    """How far a term's rows part the labels, either way; ``size`` is toxic rows and others.

    Every term has ``PRIOR`` rows more, with the labels of all rows, so that a term of
    few rows says little.
    """
    share = (size[0] + 1.0) / (size[0] + size[1] + 2.0)
    return np.abs(
        np.log((toxic + PRIOR * share) / (size[0] + PRIOR * share)) - np.log((other + PRIOR * (1 - share)) / (size[1] + PRIOR * (1 - share)))
    )


def vector_keys(text: np.ndarray, terms: np.ndarray, counts: np.ndarray, rows: int) -> np.ndarray:
    """One hash per text of its terms and counts, zero without a word."""
    key = np.zeros(rows, np.uint64)
    np.add.at(key, text, textbytes.mix(terms ^ textbytes.mix(counts.astype(np.uint64))))
    return key


def choose_examples(known: DataFrame, examples: int) -> list:
    """At most ``examples`` rows ``key, rows, toxic, name``, one per distinct vector of ``known``.

    The bounded sample: vectors of most rows first, then by hash; half of it for
    vectors with toxic rows while there are enough. ``name`` is the smallest id.
    """

    def run(batches):
        for batch in batches:
            for first, last, text, hashes in _terms(batch.column(2)):
                key = vector_keys(*_pairs(text, hashes), last - first)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, last - first) for i in (0, 1)), pa.array(key.view(np.int64))], names=["doc_id", "label", "key"]
                )

    keyed = known.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, key long").where("key != 0")
    groups = materialize(
        keyed.groupBy("key").agg(F.count("*").alias("rows"), F.sum("label").alias("toxic"), F.min("doc_id").alias("name")), "examples"
    )
    order = [F.desc("rows"), F.xxhash64("key"), "key"]
    with_toxic = groups.where("toxic > 0").orderBy(*order).limit(examples // 2).collect()
    return [*with_toxic, *groups.where("toxic = 0").orderBy(*order).limit(examples - len(with_toxic)).collect()]


def example_terms(known: DataFrame, chosen: list) -> DataFrame:
    """``key, term, n`` of the chosen examples, read from the row of each one's name."""
    names = dict(sorted((r["key"], r["name"]) for r in chosen))
    shared = known.sparkSession.sparkContext.broadcast((np.array(list(names), np.int64), np.array(list(names.values()), np.int64)))

    def run(batches):
        keys, named = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, text, hashes in _terms(batch.column(1)):
                text, terms, counts = _pairs(text, hashes)
                key = vector_keys(text, terms, counts, last - first).view(np.int64)
                at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                mine = (keys[at] == key) & (named[at] == ids[first:last]) if len(keys) else np.zeros(len(key), bool)
                own = mine[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[text[own]]), pa.array(terms[own].view(np.int64)), pa.array(counts[own])], names=["key", "term", "n"]
                )

    rows = known.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return rows.mapInArrow(run, "key long, term long, n long").dropDuplicates(["key", "term"])


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """``(rows of docs, rows with each term)`` over all rows; a task adds up its share."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        chosen = shared.value
        total, found = 0, np.zeros(len(chosen), np.int64)
        for batch in batches:
            total += batch.num_rows
            for _, _, text, hashes in _terms(batch.column(0)):
                _, hashes, _ = _pairs(text, hashes)
                _, place = within(chosen, hashes)
                found += np.bincount(place, minlength=len(chosen))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[some], total))], names=["place", "n"])

    sums = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = sums["place"].to_numpy(), sums["n"].to_numpy()
    frequency = np.zeros(len(terms), np.int64)
    frequency[place[place >= 0]] = n[place >= 0]
    return int(n[place < 0].sum()), frequency


def within(sorted_terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(mask of the hashes that are terms, their places)``."""
    if not len(sorted_terms):
        return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(sorted_terms, hashes), len(sorted_terms) - 1)
    hit = sorted_terms[place] == hashes
    return hit, place[hit]


def unit(row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Weights over the length of their row's vector."""
    size = np.sqrt(np.bincount(row, weight * weight, rows))[row]
    return np.divide(weight, size, out=np.zeros_like(weight), where=size > 0)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Index:
    """Postings of examples by term and block, with the largest weight of a term in a block.

    ``example, place, weight`` are the entries of unit vectors over ``terms`` places.
    Terms of many examples are columns over all of them: their part of every score is
    one product, and a block's bound is its best such part and the maxima of the rest.
    """

    def __init__(self, example: np.ndarray, place: np.ndarray, weight: np.ndarray, terms: int, examples: int):
        # Blocks hold examples of one language, by their commonest term, then of one strongest term.
        held = np.bincount(place, minlength=terms)
        strongest, commonest = np.zeros(examples, np.int64), np.zeros(examples, np.int64)
        by = np.lexsort((-place, weight, example))
        strongest[example[by]] = place[by]
        by = np.lexsort((-place, held[place], example))
        commonest[example[by]] = place[by]
        self.order = np.lexsort((np.arange(examples), strongest, commonest))
        at = np.empty(examples, np.int64)
        at[self.order] = np.arange(examples)
        example = at[example]
        self.examples, self.blocks = examples, -(-examples // BLOCK)
        common = np.flatnonzero(held * COMMON > max(examples, BLOCK))
        self.column = np.full(terms, -1)
        self.column[common] = np.arange(len(common))
        often = self.column[place] >= 0
        self.dense = np.zeros((len(common), self.blocks * BLOCK))
        self.dense[self.column[place[often]], example[often]] = weight[often]
        example, place, weight = example[~often], place[~often], weight[~often]
        by = np.lexsort((example, place))
        self.post_example, self.post_weight = example[by].astype(np.int32), weight[by]
        pair = place[by] * max(self.blocks, 1) + example[by] // BLOCK
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        self.pair_edge = np.append(first, len(pair))
        self.pair_block = (pair[first] % max(self.blocks, 1)).astype(np.int32)
        self.pair_best = np.maximum.reduceat(self.post_weight, first) if len(first) else np.zeros(0)
        self.term_edge = np.searchsorted(pair[first] // max(self.blocks, 1), np.arange(terms + 1))
        self.cost = np.bincount(place, minlength=terms) + np.diff(self.term_edge)

    def nearest(self, row: np.ndarray, place: np.ndarray, weight: np.ndarray, queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(example, cosine)`` of the k nearest per query, best first, ties by example; cosine zero fills up.

        ``row, place, weight`` are the entries of the queries' unit vectors by row and place.
        """
        found, scores = np.zeros((queries, k), np.int64), np.zeros((queries, k))
        if not self.examples or not queries:
            return found, scores
        # An answer's scores are a row over all examples, so that counts as work too.
        work = np.bincount(row, self.cost[place], queries).astype(np.int64) + self.blocks * BLOCK
        for first, last in textbytes.slices(np.concatenate(([0], np.cumsum(work))), WORK):
            a, b = np.searchsorted(row, (first, last))
            some = self._answer(row[a:b] - first, place[a:b], weight[a:b], last - first, min(k, self.examples))
            found[first:last, : some[0].shape[1]], scores[first:last, : some[0].shape[1]] = some
        return found, scores

    def _answer(self, row, place, weight, queries, k):
        width = self.blocks * BLOCK
        column = self.column[place]
        often = column >= 0
        asked = np.zeros((queries, len(self.dense)))
        asked[row[often], column[often]] = weight[often]
        score = asked @ self.dense
        row, place, weight = row[~often], place[~often], weight[~often]
        size = self.term_edge[place + 1] - self.term_edge[place]
        pair = _ranges(self.term_edge[place], size)
        owner, own = np.repeat(row, size), np.repeat(weight, size)
        slot = owner * self.blocks + self.pair_block[pair]
        rest = np.bincount(slot, own * self.pair_best[pair], queries * self.blocks).reshape(queries, self.blocks)
        bound = rest + score.reshape(queries, self.blocks, BLOCK).max(axis=2)

        def added(opened):
            use = opened.reshape(-1)[slot]
            count = self.pair_edge[pair[use] + 1] - self.pair_edge[pair[use]]
            post = _ranges(self.pair_edge[pair[use]], count)
            cell = np.repeat(owner[use], count) * width + self.post_example[post]
            return np.bincount(cell, np.repeat(own[use], count) * self.post_weight[post], queries * width).reshape(queries, width)

        first = min(OPEN, self.blocks)
        opened = np.zeros(bound.shape, bool)
        np.put_along_axis(opened, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        score += added(opened)
        kth = np.partition(score[:, : self.examples], self.examples - k, axis=1)[:, self.examples - k]
        # The margin is wider than the rounding below.
        more = ~opened & (rest > 0) & (bound + 1e-5 >= kth[:, None])
        if more.any():
            score += added(more)
        # Rounded, so that ties are ties and the place in a batch does not show; then the smaller example.
        whole = np.rint(score[:, : self.examples] * 1e6).astype(np.int64)
        rank = whole * self.examples + (self.examples - 1 - self.order)
        top = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(rank, top, 1), axis=1), 1)
        return self.order[top], np.take_along_axis(whole, top, 1) / 1e6


class Examples:
    """What a task needs: terms, their statistics, the examples and their index."""

    def __init__(self, chosen: list, table: pa.Table, size: tuple[int, int]):
        keys = np.array([r["key"] for r in chosen], np.int64)
        by = np.argsort(keys)
        self.keys, self.size = keys[by], size
        self.rows, self.toxic, self.names = (np.array([r[c] for r in chosen], np.int64)[by] for c in ("rows", "toxic", "name"))
        terms = table["term"].to_numpy().view(np.uint64)
        self.terms, first, place = np.unique(terms, return_index=True, return_inverse=True)
        self.term_toxic, self.term_other = (table[c].to_numpy()[first].astype(np.float64) for c in ("toxic", "other"))
        self.entries = np.searchsorted(self.keys, table["key"].to_numpy()), place, table["n"].to_numpy()

    def weigh(self, total: int, frequency: np.ndarray) -> Examples:
        """The index, from documents and documents with each term."""
        self.idf = np.log((total + 1.0) / (frequency + 1.0)) + 1
        example, place, n = self.entries
        by = np.lexsort((place, example))
        example, place, n = example[by], place[by], n[by]
        weight = (1 + np.log(n)) * self.idf[place] * log_odds(self.term_toxic, self.term_other, self.size)[place]
        self.index = Index(example, place, unit(example, weight, len(self.keys)), len(self.terms), len(self.keys))
        del self.entries
        return self

    def queries(self, text, hashes, counts, rows, labels=None):
        """``(row, place, unit weight)``; with ``labels`` a row's own label is left out of the log-odds."""
        hit, place = within(self.terms, hashes)
        row, counts = text[hit], counts[hit]
        toxic, other, size = self.term_toxic[place], self.term_other[place], self.size
        if labels is not None:
            own = labels[row]
            toxic, other, size = np.maximum(toxic - own, 0), np.maximum(other - 1 + own, 0), (size[0] - own, size[1] - 1 + own)
        return row, place, unit(row, (1 + np.log(counts)) * self.idf[place] * log_odds(toxic, other, size), rows)


def learn(docs: DataFrame, known: DataFrame, examples: int = EXAMPLES) -> Examples:
    """The examples of ``known`` (``doc_id, label, text``), weighed over all of ``docs``."""
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = choose_examples(known, examples)
    counts = term_labels(known.select("text", "label")).where(F.col("toxic") + F.col("other") >= LEAST)
    # As many rows as the examples have distinct terms.
    table = example_terms(known, chosen).join(counts, "term").toArrow()
    found = Examples(chosen, table, (size.get(1, 0), size.get(0, 0)))
    return found.weigh(*document_frequencies(docs, found.terms))


def weighed(cosine: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(vote, weights, toxic shares)`` of found examples; no vote without a neighbour."""
    weight = np.where((cosine > 0) & (count > 0), np.sqrt(np.maximum(count, 0)) / (1.05 - np.minimum(cosine, 1)), 0)
    share = np.divide(toxic, count, out=np.zeros(count.shape), where=count > 0)
    total = weight.sum(axis=1)
    return np.divide((weight * share).sum(axis=1), total, out=np.full(len(total), np.nan), where=total > 0), weight, share


def votes(rows: DataFrame, examples: Examples, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``doc_id, label, held_out, vote, vote_apart, evidence``; a vote is null without a neighbour.

    ``vote`` depends on the text alone, so equal texts have equal votes. In
    ``vote_apart`` a row learnt from does not count itself: for the calibration.
    """
    shared = shipping.send(rows.sparkSession, examples)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic_share", pa.float64())]))

    def counted(ex, found):
        return (ex.rows[found], ex.toxic[found]) if len(ex.rows) else (np.zeros(found.shape), np.zeros(found.shape))

    def run(batches):
        ex = shipping.receive(shared)
        for batch in batches:
            every = batch.column(1).to_pylist()
            for first, last, text, hashes in _terms(batch.column(3)):
                n = last - first
                text, hashes, counts = _pairs(text, hashes)
                found, cosine = ex.index.nearest(*ex.queries(text, hashes, counts, n), n, neighbours)
                vote, weight, share = weighed(cosine, *counted(ex, found))
                evidence = [
                    [{"doc_id": int(ex.names[f]), "cosine": float(c), "toxic_share": float(s)} for f, c, s, w in zip(fs, cs, ss, ws) if w > 0][:3]
                    for fs, cs, ss, ws in zip(found.tolist(), cosine.tolist(), share.tolist(), weight.tolist())
                ]
                # Calibration only: a row learnt from neither votes nor weighs terms for itself there.
                apart = np.full(n, np.nan)
                learnt = np.array([i for i, l in enumerate(every[first:last]) if l is not None], np.int64)
                if len(learnt):
                    label = np.array([every[first + i] for i in learnt], np.int64)
                    place = np.full(n, -1)
                    place[learnt] = np.arange(len(learnt))
                    own = place[text] >= 0
                    mine = place[text[own]], hashes[own], counts[own]
                    near, near_cosine = ex.index.nearest(*ex.queries(*mine, len(learnt), label), len(learnt), neighbours)
                    key = vector_keys(*mine, len(learnt)).view(np.int64)
                    itself = near == np.searchsorted(ex.keys, key)[:, None]
                    itself &= (ex.keys[near] == key[:, None]) if len(ex.keys) else False
                    rows_of, toxic_of = counted(ex, near)
                    apart[learnt] = weighed(near_cosine, rows_of - itself, toxic_of - itself * label[:, None])[0]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, n) for i in (0, 1, 2)), pa.array(vote, mask=np.isnan(vote)),
                     pa.array(apart, mask=np.isnan(apart)), pa.array(evidence, kind)],
                    names=["doc_id", "label", "held_out", "vote", "vote_apart", "evidence"],
                )

    return rows.select("doc_id", "label", "held_out", "text").mapInArrow(
        run, "doc_id long, label int, held_out boolean, vote double, vote_apart double, evidence array<struct<doc_id:long,cosine:double,toxic_share:double>>"
    )


def calibrate(voted: DataFrame, bins: int = BINS) -> tuple[np.ndarray, float]:
    """``(score at each bin's middle, score without a neighbour)`` from the rows learnt from.

    Shares of toxic rows by bin of the vote, smoothed towards the overall share and
    made to rise with the vote by pooling neighbours that fall.
    """
    known = voted.where("label IS NOT NULL").withColumn(
        "bin", F.when(F.col("vote_apart").isNotNull(), F.least(F.floor(F.col("vote_apart") * bins), F.lit(bins - 1))).cast("int")
    )
    rows = {r["bin"]: (r["n"], r["toxic"]) for r in known.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).collect()}
    total, toxic = (sum(v[i] for v in rows.values()) for i in (0, 1))
    prior = (toxic + 1) / (total + 2) if total else 0.5
    none = rows.get(None, (0, 0))
    pools = []
    for b in range(bins):
        n, t = rows.get(b, (0, 0))
        # An empty or small bin leans on its own vote.
        pools.append([n + 1.0, t + (b + 0.5) / bins, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] > pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    curve = np.concatenate([np.full(size, t / n) for n, t, size in pools])
    return curve, (none[1] + prior) / (none[0] + 1)


def classify(
    docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, threshold: float = 0.7,
) -> DataFrame:
    """``doc_id, held_out, score, predicted, vote, evidence`` for every row of ``docs``.

    Labels are learnt from rows whose ``crc32(doc_id) % 3`` is not 1, with a label;
    of several labels of an id the largest holds, and any above zero is toxic. A null or empty text, or one
    without a term of the examples, gets the share of toxic rows among its like. Without any
    label every score is 0.5. A null id is never learnt from and not held out.
    Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("toxic").cast("int") > 0).cast("int")).alias("mark")
    )
    side, _ = broadcast_if_small(marks)
    rows = rows.join(side, "doc_id", "left").withColumn("label", F.when(~F.col("held_out"), F.col("mark"))).drop("mark")
    known = rows.where("label IS NOT NULL")
    voted = materialize(votes(rows, learn(rows, known, examples)), "votes")
    curve, alone = calibrate(voted)
    # Straight lines between the middles of the bins.
    place = F.greatest(F.least(F.col("vote") * BINS - 0.5, F.lit(BINS - 1.0)), F.lit(0.0))
    low = F.least(F.floor(place), F.lit(BINS - 2)).cast("int")
    curve_ = F.array(*[F.lit(float(c)) for c in curve])
    line = F.get(curve_, low) + (place - low) * (F.get(curve_, low + 1) - F.get(curve_, low))
    score = F.coalesce(F.when(F.col("vote").isNotNull(), line), F.lit(float(alone)))
    return voted.withColumn("score", score).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "vote", "evidence"
    )
