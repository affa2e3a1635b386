"""Language identification with known words first and character n-grams for the rest.

Per language the model holds the log frequencies of its most frequent words and character n-grams. A known word
scores by its frequencies; an unseen one by its longest n-grams that are known, falling back from four
characters to one. The scores of the words add up to the language of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import fresh, small_batches, text_of
from shelfmark.session import stored

#: Bounds of the model: labelled documents of a language that it is fitted on, words and n-grams it keeps.
SAMPLE_DOCS, KEPT_WORDS, KEPT_GRAMS = 1000, 20_000, 20_000
GRAMS = (4, 3, 2, 1)
UNKNOWN = "und"
CHUNK_CHARS = 2_000_000
LETTERS = r"\p{L}[\p{L}\p{M}]*"
_WORDS = regex.compile(LETTERS)


def letters(text: Column) -> Column:
    """Words of letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def gram_codes(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit codes of all n-grams of a sequence of code points."""
    codes = np.full(max(len(points) - n + 1, 0), n, dtype=np.uint64)
    for k in range(n):
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + points[k:k + len(codes)].astype(np.uint64)
        codes ^= codes >> np.uint64(29)
    return codes


@dataclass
class Model:
    """Languages in sorted order; log frequency per language of words and of n-grams by code."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    gram_codes: dict[int, np.ndarray]
    gram_logs: dict[int, np.ndarray]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word, unseen ones by backing off."""
        scores = np.zeros((len(words), len(self.languages)))
        at = np.fromiter((self.words.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = at >= 0
        if known.any():
            scores[known] = self.word_logs[at[known]]
        left = np.flatnonzero(~known)
        for n in GRAMS:
            if not len(left):
                break
            # All words in one array of code points; grams across a border are left out.
            marked = [f"\x02{words[i]}\x03" for i in left.tolist()]
            points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
            owner = np.repeat(np.arange(len(marked)), sizes)
            codes = gram_codes(points, n)
            inside = owner[:len(codes)] == owner[n - 1:] if n > 1 else np.ones(len(codes), dtype=bool)
            table = self.gram_codes[n]
            if len(table):
                place = np.minimum(np.searchsorted(table, codes), len(table) - 1)
                hit = inside & (table[place] == codes)
                of = owner[:len(codes)][hit]
                counts = np.bincount(of, minlength=len(marked))
                sums = np.stack(
                    [np.bincount(of, weights=column, minlength=len(marked)) for column in self.gram_logs[n][place[hit]].T], axis=1
                ) if len(of) else np.zeros((len(marked), len(self.languages)))
                seen = counts > 0
                scores[left[seen]] = sums[seen] / counts[seen, None]
                left = left[~seen]
        return scores

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and its share of the posterior for each text."""
        split = [_WORDS.findall(t.lower()) for t in texts]
        counts = np.array([len(s) for s in split], dtype=np.int64)
        flat = np.empty(int(counts.sum()), dtype=object)
        flat[:] = [w for s in split for w in s]
        if not len(flat) or not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        codes, words = pd.factorize(flat)
        scores = self.word_scores(list(words))
        owner = np.repeat(np.arange(len(texts)), counts)
        sums = np.stack([np.bincount(owner, weights=c[codes], minlength=len(texts)) for c in scores.T], axis=1)
        best = sums.argmax(axis=1)
        share = np.exp(sums - sums.max(axis=1, keepdims=True))
        share = share.max(axis=1) / share.sum(axis=1)
        return (
            [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), counts.tolist(), strict=True)],
            [float(s) if n else 0.0 for s, n in zip(share.tolist(), counts.tolist(), strict=True)],
        )


def top(counts: DataFrame, item: str, most: int) -> DataFrame:
    """The ``most`` frequent items of each language; equal counts in the order of the item."""
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), item)
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def logs(rows: list[tuple[str, str, int]], languages: list[str], totals: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """Items in sorted order and a row of smoothed log frequencies for each."""
    items = sorted({item for _, item, _ in rows})
    at = {item: i for i, item in enumerate(items)}
    counts = np.zeros((len(items), len(languages)))
    for lang, item, n in rows:
        counts[at[item], languages.index(lang)] = n
    total = np.array([max(totals.get(lang, 0), 1) for lang in languages], dtype=float)
    return items, np.log((counts + 0.5) / (total + 0.5 * max(len(items), 1)))


def sampled(able: DataFrame, sample_docs: int) -> DataFrame:
    """Stored ``in_id, in_key``: of each language the ``sample_docs`` documents with the smallest checksums.

    Counts by language and range of checksums bound what is ordered, first over 4,096 ranges, then over as many
    parts of the range where the bound lies. So a language of any size sends its counts, and then the sample and
    one narrow range, to the task that orders it. Rows that repeat id and text count once in the sample.
    """
    text = F.xxhash64(text_of())
    rows = able.select(
        F.col("lang").cast("string").alias("lang"), "doc_id", text.alias("tkey"),
        F.shiftrightunsigned(F.xxhash64("doc_id", text), 32).alias("sum"),
    )
    inside = F.lit(True)
    for shift in (20, 8):
        # Of each language the first range in which the number of rows reaches the sample.
        counts = rows.filter(inside).groupBy("lang", F.shiftright("sum", shift).alias("range")).agg(F.count("*").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("lang").orderBy("range"))
        reached = counts.withColumn("so_far", so_far).filter(F.col("so_far") >= sample_docs)
        ends = dict(reached.groupBy("lang").agg(F.min("range")).collect())
        end = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(e)) for lang, e in ends.items()], F.lit(1 << 32))
        inside = F.shiftright("sum", shift) <= end
    first = Window.partitionBy("lang").orderBy("sum", "doc_id", "tkey")
    chosen = rows.filter(inside).distinct().withColumn("place", F.row_number().over(first))
    return stored(
        chosen.filter(F.col("place") <= sample_docs).select(F.col("doc_id").alias("in_id"), F.col("tkey").alias("in_key")).distinct(),
        "language-sample",
    )


def trained(
    docs: DataFrame, sample_docs: int = SAMPLE_DOCS, kept_words: int = KEPT_WORDS, kept_grams: int = KEPT_GRAMS
) -> Model:
    """A model from rows of ``docs`` with a language, held-out rows excepted.

    It is fitted on the ``sample_docs`` documents of each language with the smallest checksums, on their whole
    texts, and keeps ``kept_words`` words and ``kept_grams`` n-grams of a language. These bounds make its size
    independent of the input; everything counted is counted by Spark.
    """
    able = docs.filter(F.col("lang").isNotNull() & ~held_out())
    ids = sampled(able, sample_docs)
    rows = able.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    sample = rows.join(
        ids, F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.xxhash64("text") == F.col("in_key")), "left_semi"
    )
    words = stored(
        sample.select("lang", F.explode(letters(F.col("text"))).alias("word")).groupBy("lang", "word").agg(
            F.count("*").alias("n")
        ),
        "language-words",
    )
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    totals = dict(words.groupBy("lang").agg(F.sum("n")).collect())
    frequent = [tuple(r) for r in top(words, "word", kept_words).select("lang", "word", "n").collect()]
    known, word_logs = logs(frequent, languages, totals)
    codes_of, logs_of = {}, {}
    marked = F.concat(F.lit("\x02"), F.col("word"), F.lit("\x03"))
    for n in GRAMS:
        starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - (n - 1)))
        grams = (
            words.select("lang", "n", F.explode(F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))).alias("gram"))
            .groupBy("lang", "gram")
            .agg(F.sum("n").alias("n"))
        )
        found = [tuple(r) for r in top(grams, "gram", kept_grams).select("lang", "gram", "n").collect()]
        total = {}
        for lang, _, k in found:
            total[lang] = total.get(lang, 0) + k
        items, table = logs(found, languages, total)
        points = np.frombuffer("".join(items).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = gram_codes(points, n)[::n] if items else np.zeros(0, dtype=np.uint64)
        order = np.argsort(codes, kind="stable")
        codes_of[n], logs_of[n] = codes[order], table[order]
    return Model(languages, {w: i for i, w in enumerate(known)}, word_logs, codes_of, logs_of)


def predicted(docs: DataFrame, model: Model, out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score from 0 to 1, read from the whole text alone.

    ``und`` with score 0 if the text is NULL or has no letters, or the model knows no language; of languages
    with equal sums the first by name. Columns of those two names are replaced; repeated rows get a result each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in (out.lower(), score.lower())]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, found = batch.tolist(), []
            start = chars = 0
            for i, text in enumerate(texts):
                if chars and chars + len(text) > CHUNK_CHARS:
                    found.append(shared.value.predict(texts[start:i]))
                    start, chars = i, 0
                chars += len(text)
            found.append(shared.value.predict(texts[start:]))
            yield pd.DataFrame({"l": [x for f in found for x in f[0]], "s": [x for f in found for x in f[1]]}).astype(
                {"l": object, "s": float}
            )

    guess = F.pandas_udf(run, "l string, s double")
    [both] = fresh(docs, "guess")
    whole = docs.select(*[F.col(f"`{c}`") for c in kept], guess(text_of()).alias(both))
    return whole.select(*[F.col(f"`{c}`") for c in kept], F.col(f"{both}.l").alias(out), F.col(f"{both}.s").alias(score))


def languages_of(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, by a model of the rows that are not held out."""
    rows = predicted(docs.select("doc_id", "text"), trained(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all their columns."""
    pred, score = fresh(docs, "lang_pred", "score")
    rows = predicted(docs, trained(docs), pred, score).filter(F.col(pred) != UNKNOWN)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
