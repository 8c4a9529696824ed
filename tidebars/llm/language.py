"""Language identification: known words first, shorter and shorter n-grams for the others."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.llm.documents import ids_and_texts, remainder, text_blocks
from tidebars.session import stage

SAMPLE_PER_LANGUAGE = 4000  # labelled rows the model is fitted on, about, for each language
MAX_WORDS = 50_000  # words shared out evenly among the languages; the same holds for n-grams
LEAST_SHARE = 250  # words and n-grams of each language, however many languages there are
LONGEST_GRAM = 5
BLOCK_GRAMS = 1 << 16  # of one word, worked on at once
WEIGHT = 1 << 20  # damped counts are summed as integers, so that their order does not matter
UNDETERMINED = "und"
HELD_OUT, HELD_OUT_REMAINDER = 4, 2
MEMO_WORDS = 400_000
_RUN = re.compile(r"[^\W\d_]+")
_COUNTED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_GRAMS = pa.schema([("lang", pa.int64()), ("gram", pa.string()), ("length", pa.int64()), ("n", pa.int64())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def word_counts(text: str) -> Counter[str]:
    """Lower-case runs of letters of the whole text and how often each occurs."""
    counts: Counter[str] = Counter()
    for block in text_blocks(text):
        counts.update(_RUN.findall(block.lower()))
    for word in [w for w in counts if not w.isalpha()]:  # number signs that are no digits
        n = counts.pop(word)
        if letters := "".join(filter(str.isalpha, word)):
            counts[letters] += n
    return counts


def gram_blocks(word: str, n: int) -> Iterator[list[str]]:
    """The n-grams of the whole word in blocks, however long it is."""
    marked = f"^{word}$"
    count = len(marked) - n + 1
    for start in range(0, count, BLOCK_GRAMS):
        yield [marked[i : i + n] for i in range(start, min(start + BLOCK_GRAMS, count))]


def grams(word: str, n: int) -> list[str]:
    return [g for block in gram_blocks(word, n) for g in block]


@dataclass
class WordModel:
    """Log frequencies per language of words and n-grams, of bounded number."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, int]  # row of each n-gram in gram_scores
    gram_scores: np.ndarray
    memo: dict[str, int] = field(default_factory=dict)  # row of each word in memo_scores
    memo_scores: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "memo_scores": None}

    def word_score(self, word: str) -> np.ndarray:
        """A known word by its own log frequencies; else the mean over its longest known n-grams."""
        known = self.words.get(word)
        if known is not None:
            return known
        for n in range(LONGEST_GRAM, 0, -1):
            total, found = np.zeros(len(self.languages)), 0
            for block in gram_blocks(word, n):
                rows = [r for g in block if (r := self.grams.get(g)) is not None]
                total += self.gram_scores[rows].sum(0)
                found += len(rows)
            if found:
                return total / found
        return np.zeros(len(self.languages))

    def _rows(self, words: Iterable[str]) -> list[int]:
        """Places of the words' scores, which are worked out once while remembered."""
        rows = list(map(self.memo.get, words))
        if None in rows:
            for i, word in enumerate(words):
                if rows[i] is None:
                    rows[i] = self.memo[word] = len(self.memo)
                    if rows[i] == len(self.memo_scores):
                        self.memo_scores = np.concatenate([self.memo_scores, np.zeros_like(self.memo_scores)])
                    self.memo_scores[rows[i]] = self.word_score(word)
        return rows

    def predict(self, text: str) -> tuple[str, float]:
        """The language of the highest sum over words, and its share by softmax."""
        counts = word_counts(text)
        if not counts or not self.languages:
            return UNDETERMINED, 0.0
        if self.memo_scores is None or len(self.memo) > MEMO_WORDS:
            self.memo, self.memo_scores = {}, np.zeros((4096, len(self.languages)))
        rows = self._rows(counts)
        times = np.fromiter(counts.values(), np.float64, len(counts))
        total = times @ self.memo_scores[rows]
        best = int(total.argmax())
        return self.languages[best], float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts by language, summed over a bounded number of words before they leave the task."""
    held: Counter[tuple[str, str]] = Counter()

    def out() -> pa.RecordBatch:
        rows = [(lang, word, n) for (lang, word), n in held.items()]
        held.clear()
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED, strict=True)], schema=_COUNTED)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word, n in word_counts(text).items():
                held[lang, word] += n
            if len(held) > 200_000:
                yield out()
    yield out()


def _log_frequencies(counts: np.ndarray, totals: np.ndarray, kinds: int) -> np.ndarray:
    """Add-half smoothed log frequencies, less their mean over languages."""
    logs = np.log((counts + 0.5) / (totals + 0.5 * kinds))
    return logs - logs.mean(-1, keepdims=True)


def _most_frequent(counts: DataFrame, term: str, share: int) -> DataFrame:
    """The ``share`` most frequent terms of each language, each term once.

    Ranks are cut in every task before the shuffle, so a task sends ``share`` rows a language at most.
    """
    own = Window.partitionBy("lang").orderBy(F.desc("n"), term)
    return counts.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= share).select(term).distinct()


def _matrix(table: pd.DataFrame, term: str, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Terms in order, and a row of each with its count in every language."""
    terms = sorted(set(table[term]))
    rows, columns = ({x: i for i, x in enumerate(named)} for named in (terms, languages))
    counts = np.zeros((len(terms), len(languages)))
    counts[table[term].map(rows).to_numpy(np.int64), table["lang"].map(columns).to_numpy(np.int64)] = table["n"]
    return terms, counts


def fit_language(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, max_words: int = MAX_WORDS) -> WordModel:
    """Fit on a sample by id hash of about ``per_language`` rows of each language.

    Only rows with a language whose crc32(doc_id) mod 4 is not 2 are used; every label found
    there is a language. Spark counts the words; each language gives the same number of its
    own most frequent words, an equal share of ``max_words`` but ``LEAST_SHARE`` or more, and
    as many of the n-grams that Spark counts in these words. The driver gets the counts of
    the words given. Without such rows the model knows no language.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    ).filter((remainder(F.col("doc_id"), HELD_OUT) != HELD_OUT_REMAINDER) & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().collect()  # one row a label
    if not sizes:
        return WordModel([], {}, {}, np.zeros((0, 0)))
    languages = sorted(r["lang"] for r in sizes)
    words_each = max(LEAST_SHARE, max_words // len(languages))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    drawn = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < F.try_element_at(share, F.col("lang"))
    counted = rows.filter(drawn).mapInArrow(_count, "lang string, word string, n long")
    by_word = stage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    words, counts = _matrix(by_word.join(_most_frequent(by_word, "word", words_each), "word").toPandas(), "word", languages)
    scores = _log_frequencies(counts, counts.sum(0), len(words))
    # A word of one occurrence tells little; it goes through its n-grams as an unseen one does.
    own = {w: s for w, s, n in zip(words, scores, counts.sum(1), strict=True) if n > 1}
    known, gram_scores = _fit_grams(docs.sparkSession, words, counts, words_each)
    return WordModel(languages, own, known, gram_scores)


def _fit_grams(spark: SparkSession, words: list[str], counts: np.ndarray, most: int) -> tuple[dict[str, int], np.ndarray]:
    """Scores of the ``most`` heaviest n-grams of each language; Spark counts them over whole words."""
    damped = np.rint(np.log1p(counts) * WEIGHT).astype(np.int64)
    at, lang = np.nonzero(damped)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[int, str]] = Counter()

        def out() -> pa.RecordBatch:
            rows = [(lang, gram, len(gram), n) for (lang, gram), n in held.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * len(_GRAMS)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _GRAMS, strict=True)], schema=_GRAMS)

        for batch in batches:
            for word, lang, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n in range(1, LONGEST_GRAM + 1):
                    for block in gram_blocks(word, n):
                        for gram in block:
                            held[lang, gram] += weight
                        if len(held) > 200_000:
                            yield out()
        yield out()

    weighed = pa.table([pa.array([words[i] for i in at], pa.string()), pa.array(lang), pa.array(damped[at, lang])], names=["word", "lang", "n"])
    found = spark.createDataFrame(weighed).repartition(spark.sparkContext.defaultParallelism)
    by_gram = stage(
        found.mapInArrow(count, "lang long, gram string, length long, n long").groupBy("lang", "gram", "length").agg(F.sum("n").alias("n"))
    )
    chosen = by_gram.join(_most_frequent(by_gram, "gram", most), "gram").toPandas()
    known, weights = _matrix(chosen, "gram", list(range(counts.shape[1])))
    weights /= WEIGHT
    lengths = np.array([len(g) for g in known], np.int64)
    scores = np.zeros_like(weights)
    kinds = {r["length"]: r["kinds"] for r in by_gram.groupBy("length").agg(F.count_distinct("gram").alias("kinds")).collect()}
    totals = {n: np.zeros(counts.shape[1]) for n in kinds}
    for r in by_gram.groupBy("length", "lang").agg(F.sum("n").alias("n")).collect():  # five rows a language
        totals[r["length"]][r["lang"]] = r["n"] / WEIGHT
    for n in kinds:
        scores[lengths == n] = _log_frequencies(weights[lengths == n], totals[n], kinds[n])
    return {g: i for i, g in enumerate(known)}, scores


def identify_language(docs: DataFrame, model: WordModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``.

    The whole text alone decides. ``lang_pred`` is a learned language, or ``und`` with
    score 0 if the text is missing or has no letter, or if nothing was learned; ties go
    to the first language by name. ``score`` is the share of the language among all, by
    softmax. A row without identifier is not held out. Repeated rows are judged each; an
    empty table gives no rows; extra columns are ignored. One pass, no shuffle; the
    broadcast model has at most the larger of ``MAX_WORDS`` and ``LEAST_SHARE`` a language
    words, as many n-grams, and a number a language for each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], _SCORED.field(i + 1).type) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=_SCORED)

    judged = ids_and_texts(docs).mapInArrow(predict, "doc_id long, lang_pred string, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), HELD_OUT) == HELD_OUT_REMAINDER, F.lit(False))
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
