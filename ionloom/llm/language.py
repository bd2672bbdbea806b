"""Language of texts by words first, and by shorter and shorter character n-grams for words never seen.

A word that the model knows scores the logarithm of its frequency in each language, with one penalty where a
language doesn't have it.  A word that no language has is scored by the mean of those of its n-grams (with a
space on either side) that some language has, for the longest n that finds any; a word of which not even a
single character is known says nothing.  A text goes to the language with the greatest sum over its words.

The model is fitted on a bounded sample of the labelled texts, and holds a bounded number of the most
frequent words and n-grams; a word beyond the bound is scored by its n-grams.  So it can be broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BREAK = regex.compile(r"[^\p{L}\p{M}]")
#: Characters of a text that are looked at together.
BLOCK = 1 << 20
UNKNOWN = "und"


def word_blocks(text: str) -> Iterator[list[str]]:
    """Lower-case words, letters with their marks, in blocks that end between words."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            gap = BREAK.search(text, end)
            end = gap.start() if gap else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def word_counts(text: str) -> Counter:
    out: Counter = Counter()
    for block in word_blocks(text):
        out.update(block)
    return out


def grams(word: str, n: int) -> Iterator[str]:
    """The n-grams of a word with a space on either side; single characters without the spaces."""
    padded = f" {word} " if n > 1 else word
    return (padded[i : i + n] for i in range(len(padded) - n + 1))


class Backoff:
    """Log frequencies by language (columns) of words (order 0) and n-grams (orders 1 to ``longest``)."""

    def __init__(self, languages: list[str], entries: list[dict[str, list[int]]], memo_limit: int = 200_000):
        """``entries``: for each order, the count of each known word or n-gram in each language."""
        self.languages, self.tables = languages, []
        for known in entries:
            counts = np.array(list(known.values()), np.float64).reshape(len(known), len(languages))
            total = np.maximum(counts.sum(axis=0), 1.0)
            logs = np.full(counts.shape, -np.log(total.max()) - 1.0)
            there = counts > 0
            logs[there] = np.log((counts / total)[there])
            self.tables.append(({g: i for i, g in enumerate(known)}, logs))
        self.memo: dict[str, np.ndarray] = {}
        self.memo_limit = memo_limit

    def unseen(self, word: str) -> np.ndarray:
        """Scores of a word that no language has."""
        for n in range(len(self.tables) - 1, 0, -1):
            places, logs = self.tables[n]
            total, seen = np.zeros(len(self.languages)), 0
            found: list[int] = []
            for g in grams(word, n):
                at = places.get(g)
                if at is not None:
                    found.append(at)
                    if len(found) == 4096:  # a word has no bound
                        total, seen, found = total + logs[found].sum(axis=0), seen + len(found), []
            if found or seen:
                return (total + logs[found].sum(axis=0)) / (seen + len(found))
        return np.zeros(len(self.languages))

    def totals(self, words: Counter) -> np.ndarray:
        """Sums of scores over the words of a text."""
        places, logs = self.tables[0]
        rows, times, out = [], [], np.zeros(len(self.languages))
        for word, n in words.items():
            at = places.get(word)
            if at is not None:
                rows.append(at)
                times.append(n)
                continue
            score = self.memo.get(word)
            if score is None:
                score = self.unseen(word)
                if len(self.memo) >= self.memo_limit:
                    self.memo.clear()
                if len(word) <= 64:
                    self.memo[word] = score
            out = out + n * score
        return out + np.array(times, np.float64) @ logs[rows] if rows else out

    def predict(self, text: str | None) -> tuple[str, float]:
        words = word_counts(text or "")
        if not words or not self.languages:
            return UNKNOWN, 0.0
        totals = self.totals(words)
        best = int(totals.argmax())
        return self.languages[best], float(1 / np.exp(totals - totals[best]).sum())


def _counts(longest: int, long_word: int):
    """Counts of words and n-grams by language over a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], Counter] = {}
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for word, n in word_counts(text.as_py()).items():
                    if len(word) <= long_word:
                        found.setdefault((language, 0), Counter())[word] += n
                    for order in range(1, longest + 1):
                        own = found.setdefault((language, order), Counter())
                        for g in grams(word, order):
                            own[g] += n
            for (language, order), own in found.items():
                for lo in range(0, len(own), 1 << 16):
                    some = list(own.items())[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([language] * len(some)), pa.array([order] * len(some), pa.int32()), pa.array([g for g, _ in some]), pa.array([n for _, n in some], pa.int64())],
                        names=["lang", "n", "gram", "times"],
                    )

    return run


def fit(labelled: DataFrame, *, fit_rows: int = 2_000, languages: int = 100, entries: int = 100_000, longest: int = 5, long_word: int = 40) -> Backoff:
    """The model of ``labelled(doc_id, text, lang)``.

    At most ``languages`` languages are learned, the most frequent ones, each from at most ``fit_rows`` texts,
    those of the smallest hashes.  Of words (up to ``long_word`` letters) and of the n-grams of each order the
    ``entries / languages`` most frequent ones of each language come to the driver.
    """
    spark = labelled.sparkSession
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    names = [r["lang"] for r in sizes]
    if not names:
        return Backoff([], [])
    # a share of the texts that holds about twice the rows wanted is ranked; rows of one id may all fall in it
    shares = spark.createDataFrame([(r["lang"], min(1.0, 2 * fit_rows / r["count"])) for r in sizes], "lang string, share double")
    near = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * F.lit(1 << 20))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"))
    sample = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= fit_rows).select("lang", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = sample.repartition(parts).mapInArrow(_counts(longest, long_word), "lang string, n int, gram string, times long")
    sums = counted.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    by_count = Window.partitionBy("lang", "n").orderBy(F.desc("times"), "gram")
    best = sums.withColumn("nth", F.row_number().over(by_count)).where(F.col("nth") <= max(1, entries // len(names))).drop("nth")
    column = {name: i for i, name in enumerate(names)}
    tables: list[dict[str, list[int]]] = [{} for _ in range(longest + 1)]
    for r in best.toLocalIterator():
        tables[r["n"]].setdefault(r["gram"], [0] * len(names))[column[r["lang"]]] = r["times"]
    return Backoff(names, [dict(sorted(t.items())) for t in tables])


def held_out(id_col: str | Column = "doc_id", folds: int = 5) -> Column:
    """Whether a document isn't learned from: the remainder of its id's CRC-32 is 0.  A null id counts as an empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; ``bounds`` are those of :func:`fit`.

    The score is the probability that the sums give the language among those learned.  A null text, an
    empty one and one without letters give ``und`` and 0, as does every text if nothing can be learned;
    equal sums go to the language with more texts, then to the smaller name; letters never seen say
    nothing.  Texts of any length are scored whole, in blocks.  A null id is held out; a null language
    isn't learned.  Repeated rows are learned and scored each for itself.  Other columns are not read.
    An empty table gives no rows.  The model is fitted when this is called.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    own = own.withColumn("held_out", held_out())
    model = fit(own.where(~F.col("held_out")).select("doc_id", "text", "lang"), **bounds)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return own.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
