"""LM scoring by deleted interpolation (Jelinek and Mercer 1980) of word n-grams.

    P(w | v) = l_0 / CLASSES + l_1 c(w) / N + l_2 c(v w) / c(v .)

A word is a class: one of ``CLASSES`` values of its hash, so that counts of single words are arrays of a fixed size, whatever the
corpus has, and a pair of words is one long. Each document is scored by the counts of all others: its own, deleted, can't vouch for it, while
those of a second copy do. The weights l depend on the bucket of the context v, the binary logarithm of how often it is left of a
word elsewhere, and are learned by expectation-maximisation on counts from which the event itself is held out: a pair of
count c is c events of estimates (c - 1) / (c(v .) - 1) and (c(w) - 1) / (N - 1). All documents, whole texts, are counted. The start
of a text is a context of its own.

1. Single words are counted in one scan; the counts are two arrays.
2. Pairs are counted in a second scan, combined in each task before they are shuffled. Pairs that occur once have no estimate when they are deleted, so
   they only add to the held-out histogram, whose cells are buckets of contexts and estimates in ``CELL`` steps of a doubling (for learning only).
3. In a third scan every document is scored as if it had only the most frequent pairs, at most ``HOT`` of them, which all tasks are sent. Its
   other pairs are joined with their counts. As none of those is frequent, no key of that join is hot.

Defined cases: a null or blank text has no words and null scores; repeated rows count and are scored each; null ids stay null; a
corpus of one document has no other estimates than the even one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import written

CLASS_BITS = 20
CLASSES = 1 << CLASS_BITS
HOT = 1 << 19
CELL = 8
#: What each weight keeps of an even share, so that no word is impossible.
EVEN = 1e-4
_HELD = 1_000_000  # pairs that a task combines at a time
_START = np.uint64(0)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, class, row) of each word; context 0 is the start of a text, and no word's class."""
    start, end, row = _text.spans(data, offs)
    w = _text.hashes(data, start, end) % np.uint64(CLASSES - 1) + np.uint64(1)
    v = np.append(_START, w[:-1])
    v[np.append(True, row[1:] != row[:-1]) if len(row) else slice(0)] = _START
    return v[: len(w)], w, row


def _texts(docs: DataFrame) -> DataFrame:
    """With a hash of the text, which tells a document, with its id."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))


def singles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each class is a word, and how often a context, in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_word, as_context, any_ = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64), False
        for b in batches:
            for _, data, offs in _text.blocks(b.column("text")):
                v, w, _ = words(data, offs)
                np.add.at(as_word, w.astype(np.int64), 1)
                np.add.at(as_context, v.astype(np.int64), 1)
                any_ = True
        if any_:
            at = np.flatnonzero(as_word + as_context)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(as_word[at]), pa.array(as_context[at])], ["class", "w", "v"])

    found = _texts(docs).mapInArrow(run, "class int, w long, v long").groupBy("class").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    table = found.toArrow()  # at most CLASSES rows
    as_word, as_context = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    at = table.column("class").to_numpy()
    as_word[at], as_context[at] = table.column("w").to_numpy(), table.column("v").to_numpy()
    return as_word, as_context


def pair_counts(docs: DataFrame) -> DataFrame:
    """(pair, n) of all documents."""

    def combined(held: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], ["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for _, data, offs in _text.blocks(b.column("text")):
                v, w, _ = words(data, offs)
                held.append(v << np.uint64(CLASS_BITS) | w)
                n += len(w)
                if n > _HELD:
                    yield combined(held)
                    held, n = [], 0
        if n:
            yield combined(held)

    return _texts(docs).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def bucket_of(often: np.ndarray) -> np.ndarray:
    """0 for a context that is nowhere else, and one more than the binary logarithm of how often it is."""
    return np.where(often > 0, np.floor(np.log2(np.maximum(often, 1)) + 1e-9) + 1, 0).astype(np.int64)


def _cell(f: np.ndarray) -> np.ndarray:
    """An estimate's step of a binary logarithm, 0 for none."""
    return np.where(f > 0, np.round(-CELL * np.log2(np.where(f > 0, f, 1))) + 1, 0).astype(np.int64)


def _estimate(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 2.0 ** (-(cell - 1) / CELL), 0.0)


def held_out(pair: np.ndarray, n: np.ndarray, as_word: np.ndarray, as_context: np.ndarray) -> np.ndarray:
    """(bucket, cell of the pair's estimate, cell of the word's) of events without themselves, as one number each."""
    total = as_word.sum()
    v, w = as_context[pair >> CLASS_BITS] - 1, as_word[pair & (CLASSES - 1)] - 1
    two = np.where(v > 0, (n - 1) / np.maximum(v, 1), 0.0)
    one = w / max(1, total - 1)
    return bucket_of(v) << 40 | _cell(two) << 20 | _cell(one)


def learn(cells: np.ndarray, events: np.ndarray, rounds: int = 100, tolerance: float = 1e-6) -> dict[int, tuple[float, float, float]]:
    """Weights (even, word, pair) of each bucket, by expectation-maximisation on a histogram of held-out events."""
    out = {}
    for b in np.unique(cells >> 40).tolist():
        own = cells >> 40 == b
        f = np.stack((np.full(own.sum(), 1 / CLASSES), _estimate(cells[own] & 0xFFFFF), _estimate(cells[own] >> 20 & 0xFFFFF)), 1)
        n = events[own].astype(float)
        w = np.array([1 / 3, 1 / 3, 1 / 3]) if b else np.array([0.5, 0.5, 0.0])
        before = -math.inf
        for _ in range(rounds):
            p = f * w
            fit = (n * np.log(p.sum(1))).sum() / n.sum()
            if fit - before < tolerance:
                break
            before, w = fit, (p * (n / p.sum(1))[:, None]).sum(0) / n.sum()
        out[b] = tuple(w.tolist())
    return out


def weights(learned: dict[int, tuple[float, float, float]]) -> np.ndarray:
    """(bucket, weight): where none were learned, those of the nearest bucket; bucket 0 has none for pairs."""
    out = np.zeros((66, 3))
    for b in range(66):
        same = [x for x in learned if bool(x) == bool(b)]
        even = (1 / 3, 1 / 3, 1 / 3) if b else (0.5, 0.5, 0.0)
        best = learned[min(same, key=lambda x: (abs(x - b), x))] if same else even
        out[b] = (1 - EVEN) * np.array(best) + EVEN * np.array(even)
    return out


class Scorer:
    """Scores whole documents by single words and by hot pairs, and says what a further pair would add."""

    def __init__(self, as_word: np.ndarray, as_context: np.ndarray, weight: np.ndarray, hot: np.ndarray, often: np.ndarray):
        self.as_word, self.as_context, self.weight, self.total = as_word, as_context, weight, int(as_word.sum())
        self.find, self.often = _text.Lookup(hot), np.append(often, 0)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(words, sum of log probabilities) of each text, and (row, pair, own count, share) of its pairs that aren't hot.

        A pair that is c times in other documents adds own count * log(1 + share * c).
        """
        docs = len(offs) - 1
        v, w, row = words(data, offs)
        size = np.bincount(row, minlength=docs)
        of = row.astype(np.uint64) << np.uint64(2 * CLASS_BITS)
        _, of_word, n_word = np.unique(of | w, return_inverse=True, return_counts=True)
        _, of_context, n_context = np.unique(of | v, return_inverse=True, return_counts=True)
        _, at, n = np.unique(of | v << np.uint64(CLASS_BITS) | w, return_index=True, return_counts=True)
        v, w, row = v[at], w[at], row[at]
        rest = self.as_context[v.astype(np.int64)] - n_context[of_context[at]]
        share = self.weight[bucket_of(rest)]
        one = (self.as_word[w.astype(np.int64)] - n_word[of_word[at]]) / np.maximum(1, self.total - size[row])
        low = share[:, 0] / CLASSES + share[:, 1] * one
        gain = np.where(rest > 0, share[:, 2] / np.maximum(rest, 1), 0.0) / low
        pair = v << np.uint64(CLASS_BITS) | w
        known = self.find(pair)
        more = np.log1p(gain * np.where(known >= 0, self.often[known] - n, 0))
        logp = np.bincount(row, n * (np.log(low) + more), docs)
        cold = np.flatnonzero((known < 0) & (gain > 0))
        return size, logp, [row[cold], pair[cold].view(np.int64), n[cold], gain[cold]]


def scores(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, logprob, perplexity) of each document; logprob is the mean of its words' natural logarithms."""
    spark = docs.sparkSession
    as_word, as_context = singles(docs)
    sent = spark.sparkContext.broadcast((as_word, as_context))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of two and more occurrences, and the cells of all (negative, less one) with their events."""
        for b in batches:
            pair, n = b.column("pair").to_numpy(), b.column("n").to_numpy()
            often = np.flatnonzero(n > 1)
            cell, inverse = np.unique(held_out(pair, n, *sent.value), return_inverse=True)
            events = np.bincount(inverse, n, len(cell)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((pair[often], -1 - cell))), pa.array(np.concatenate((n[often], events)))], ["pair", "n"])

    counted = written(pair_counts(docs).mapInArrow(tally, "pair long, n long"), "pairs")
    cells = counted.where("pair < 0").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # buckets and steps, whatever the corpus
    weight = weights(learn(-1 - cells.column("pair").to_numpy(), cells.column("n").to_numpy()))
    pairs = counted.where("pair >= 0").withColumn("level", F.floor(F.log2("n") * 64).cast("int"))
    least = _least_hot(pairs, hot)
    top = pairs.where(F.col("level") >= least).select("pair", "n").toArrow()  # at most ``hot`` rows
    scorer = spark.sparkContext.broadcast((as_word, as_context, weight, top.column("pair").to_numpy().view(np.uint64), top.column("n").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with a negative pair so that they are spread, and one for each of its pairs that aren't hot."""
        score, names = Scorer(*scorer.value), ["key", "doc_id", "pair", "n", "x"]
        for b in batches:
            for first, data, offs in _text.blocks(b.column("text")):
                size, logp, (row, pair, n, gain) = score(data, offs)
                ids, keys = (b.column(c).slice(first, len(size)) for c in ("doc_id", "key"))
                own = pa.array(-1 - (keys.to_numpy() & 0x7FFFFFFFFFFFFFFE))
                yield pa.RecordBatch.from_arrays([keys, ids, own, pa.array(size), pa.array(logp)], names)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([keys.take(at), ids.take(at), pa.array(pair), pa.array(n), pa.array(gain.astype(np.float32).astype(float))], names)

    rows = _texts(docs).mapInArrow(run, "key long, doc_id long, pair long, n long, x double")
    rest = pairs.where(F.col("level") < least).select("pair", F.col("n").alias("often"))
    is_doc = F.col("pair") < 0
    added = F.when(is_doc, F.col("x")).otherwise(F.col("n") * F.log1p(F.col("x") * (F.col("often") - F.col("n"))))
    summed = rows.join(rest, "pair", "left").groupBy("key", "doc_id").agg(F.sum(added).alias("sum"), F.sum(F.when(is_doc, F.col("n"))).alias("words"), F.count_if(is_doc).cast("int").alias("times"))
    # Rows that repeat each other are one group, of so many times the words and the sum.
    mean = F.when(F.col("words") > 0, F.col("sum") / F.col("words"))
    each = summed.select("doc_id", (F.col("words") / F.col("times")).cast("long").alias("n_words"), mean.alias("logprob"), F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("one"))
    return each.select("doc_id", "n_words", "logprob", F.exp(-F.col("logprob")).alias("perplexity"))


def _least_hot(pairs: DataFrame, most: int) -> int:
    """The least level from which on there are no more than ``most`` pairs."""
    levels = pairs.groupBy("level").agg(F.count("*").alias("pairs")).orderBy(F.desc("level")).collect()  # 64 a doubling
    least, so_far = 1 << 20, 0
    for r in levels:
        so_far += r.pairs
        if so_far > most:
            break
        least = r.level
    return least
