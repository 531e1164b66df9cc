"""Languages of a document as a mixture whose shares expectation-maximisation estimates.

Training counts letter trigrams by language over all labelled training rows (hashed into a fixed number of buckets,
so the model's size is bounded by buckets x languages, of which only the trigrams that a language has are kept). For a document, each word is taken to come from one
language; its likelihood under a language is the product of its trigrams' probabilities. EM estimates the shares of
all languages. The set of languages is the one with the best penalised likelihood: a set of k costs
``penalty * (k - 1) / 2 * log(words)``. EM on the full set gives a bound of every set's likelihood, wherever it stops, so
the best single language is settled without a search as soon as that bound cannot pay for a second language; otherwise
sets grow in the order of the full estimate's shares, until the bound cannot pay for one more.

Defined results: a null text or a text without a letter is ``und`` with score 0 and no languages; so is every text
if nothing labelled was there to learn from. Ties go to the language that sorts first. A null doc_id counts as the
empty string when rows are split into training and held-out ones. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptwatch.llm.shared import fresh, kept, text_chunks

BITS = 16
CHUNK_BYTES = 1 << 19
#: Languages whose tables are held as they are; of more, only the trigrams that they have, and chunks of text get smaller.
DENSE_LANGUAGES = 256


def _letters() -> np.ndarray:
    return kept(("letters",), lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter's trigram, index of each word's first letter, words of each text)."""
    texts = [t.lower() for t in texts]
    points = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    letter = _letters()[points]
    c = np.zeros(len(points) + 2, np.uint32)
    c[1:-1] = np.where(letter, points, 32)
    c[0] = c[-1] = 32
    at = np.flatnonzero(letter)
    with np.errstate(over="ignore"):
        h = c[at] * np.uint32(0x9E3779B1) + c[at + 1] * np.uint32(0x85EBCA77) + c[at + 2] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x27D4EB2F)
    first = np.flatnonzero(c[at] == 32)
    words = np.diff(np.searchsorted(at[first], ends), prepend=0)
    return h >> np.uint32(32 - BITS), first, words


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the rows that training never sees."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class LanguageModel:
    """Names in order, and log-probabilities by language and trigram bucket: of the trigrams it has, and of any other.

    Tables grow with the trigrams that were seen, whatever the number of labels.
    """

    def __init__(self, names: list[str], counts: list[tuple[np.ndarray, np.ndarray]], smoothing: float = 0.5):
        self.names = names
        size, seen = 1 << BITS, np.zeros(1 << BITS, bool)
        self.tables = []
        for bucket, n in counts:
            total = np.log(n.sum() + smoothing * size)
            self.tables.append((bucket.astype(np.uint16), (np.log(n + smoothing) - total).astype(np.float32), np.float32(np.log(smoothing) - total)))
            seen[bucket] = True
        #: Log-probability of a trigram in a text of no known language: as if twice those of all languages were equally frequent.
        self.noise = float(-np.log(max(2, 2 * int(seen.sum()))))


def _dense(table: tuple[np.ndarray, np.ndarray, np.float32]) -> np.ndarray:
    bucket, logp, other = table
    row = np.full(1 << BITS, other, np.float32)
    row[bucket] = logp
    return row


def _held(tables: list[tuple]) -> list:
    """Tables as whole rows where they are few."""
    return [_dense(t) for t in tables] if len(tables) <= DENSE_LANGUAGES else tables


def chunk_bytes(languages: int) -> int:
    return max(1, CHUNK_BYTES * DENSE_LANGUAGES // max(DENSE_LANGUAGES, languages))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count trigrams of every given row by its non-null language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, texts in text_chunks(batch.column(1), CHUNK_BYTES):
                for name in set(names[a:b]):
                    own = [t for n, t in zip(names[a:b], texts) if n == name]
                    total = totals.setdefault(name, np.zeros(1 << BITS, np.int64))
                    total += np.bincount(_trigrams(own)[0], minlength=1 << BITS)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                ["lang", "bucket", "n"],
            )

    rows = (
        docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
        .mapInArrow(count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    got = rows.toPandas().sort_values("lang", kind="stable")  # buckets x languages at most
    names = sorted(set(got["lang"]))
    cut = np.searchsorted(got["lang"].to_numpy(object), names) if names else []
    parts = zip(cut, [*cut[1:], len(got)])
    bucket, n = got["bucket"].to_numpy(np.int64), got["n"].to_numpy(float)
    return LanguageModel(names, [(bucket[a:b], n[a:b]) for a, b in parts])


def estimate(
    like: np.ndarray, words: np.ndarray, enough: np.ndarray | None = None, near: float = 1e-2, rounds: int = 400
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares (document, language), their log-likelihood and a bound of every mixture's, by EM.

    ``like`` has word log-likelihoods (word, language), ``words`` the number of words of each document, at least 1. By
    concavity no shares reach more than the likelihood plus words times the log of the largest factor by which EM would
    still raise a share; so the bound holds wherever EM stops. A document stops when the bound is within ``near`` of the
    likelihood, or at most ``enough``, or after ``rounds``, whatever the others do, so results do not depend on how
    rows are batched.
    """
    top = like.max(axis=1)
    p = np.exp(like - top[:, None])
    docs, langs = len(words), like.shape[1]
    shares = np.full((docs, langs), 1 / langs)
    starts = np.concatenate([[0], np.cumsum(words)[:-1]])
    base = np.add.reduceat(top.astype(float), starts)
    likelihood, bound = np.zeros(docs), np.zeros(docs)
    live = np.arange(docs)
    for step in range(rounds):
        n = words[live]
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        s = (p * np.repeat(shares[live], n, axis=0)).sum(axis=1)
        likelihood[live] = base[live] + np.add.reduceat(np.log(s), at)
        q = p / s[:, None]
        factor = np.stack([np.add.reduceat(q[:, k], at) for k in range(langs)], axis=1) / n[:, None]
        bound[live] = likelihood[live] + n * np.log(np.maximum(factor.max(axis=1), 1))
        go_on = bound[live] - likelihood[live] > near
        if enough is not None:
            go_on &= bound[live] > enough[live]
        if not go_on.any() or step == rounds - 1:
            break
        if not go_on.all():
            p, live, factor = p[np.repeat(go_on, n)], live[go_on], factor[go_on]
        shares[live] *= factor
    return shares, likelihood, bound


def _word_likelihoods(texts: list[str], logp: list, noise: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (word, language) and the number of words of each text; ``noise`` is one more language."""
    bucket, first, words = _trigrams(texts)
    if not len(first):
        return np.zeros((0, len(logp))), words
    rows = (row if isinstance(row, np.ndarray) else _dense(row) for row in logp)
    columns = [np.add.reduceat(row[bucket], first, dtype=np.float64) for row in rows]
    if noise is not None:
        columns.append(np.diff(first, append=len(bucket)) * noise)
    return np.stack(columns, axis=1), words


def mixtures(texts: list[str], logp: list, penalty: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the chosen languages (indices, largest share first) and their shares; none without a letter."""
    none = (np.zeros(0, int), np.zeros(0))
    out = [none] * len(texts)
    if not len(logp):
        return out
    like, words = _word_likelihoods(texts, logp)
    live = np.flatnonzero(words)
    if not len(live):
        return out
    words = words[live]
    starts = np.concatenate([[0], np.cumsum(words)[:-1]])
    single = np.add.reduceat(like, starts, axis=0)
    best = single.argmax(axis=1)
    cost = penalty * np.log(np.maximum(words, 2)) / 2
    alone = single[np.arange(len(live)), best]
    shares, _, most = estimate(like, words, alone + cost)  # no second language pays where no mixture reaches that
    for d, i in enumerate(live):
        chosen = (best[d : d + 1], np.ones(1))
        if most[d] > alone[d] + cost[d]:
            own, order = like[starts[d] : starts[d] + words[d]], np.argsort(-shares[d], kind="stable")
            value = alone[d]
            for k in range(2, len(order) + 1):
                if most[d] - cost[d] * (k - 1) <= value:
                    break
                s, l, _ = estimate(own[:, order[:k]], words[d : d + 1])
                if l[0] - cost[d] * (k - 1) > value:
                    by = np.lexsort((order[:k], -s[0]))
                    value, chosen = l[0] - cost[d] * (k - 1), (order[:k][by], s[0][by])
        out[i] = chosen
    return out


def foreign_letters(texts: list[str], logp: list, noise: float) -> list[tuple[int, float]]:
    """For each text its letters and how many of them, in the mixture with all languages, are in words of ``noise``."""
    like, words = _word_likelihoods(texts, logp, noise)
    live = np.flatnonzero(words)
    letters, foreign = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    if len(live):
        n = words[live]
        p = np.exp(like - like.max(axis=1, keepdims=True)) * np.repeat(estimate(like, n, near=0.5)[0], n, axis=0)
        size, at = np.rint(like[:, -1] / noise), np.concatenate([[0], np.cumsum(n)[:-1]])
        letters[live] = np.add.reduceat(size, at)
        foreign[live] = np.add.reduceat(size * p[:, -1] / p.sum(axis=1), at)
    return list(zip(letters.tolist(), foreign.tolist()))


RESULT = "struct<lang_pred:string,score:double,languages:array<string>,shares:array<double>>"


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language", penalty: float = 2.0) -> DataFrame:
    """Append ``into``: predicted language, its share, and the chosen set of languages with their shares."""
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.tables))

    @F.arrow_udf(RESULT)
    def infer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, tables = shared.value
        logp = _held(tables)
        for column in batches:
            rows = []
            for _, _, texts in text_chunks(column, chunk_bytes(len(logp))):
                for at, share in mixtures(texts, logp, penalty):
                    langs = [names[i] for i in at]
                    rows.append({
                        "lang_pred": langs[0] if langs else "und", "score": min(1.0, float(share[0])) if langs else 0.0,
                        "languages": langs, "shares": [float(x) for x in share],
                    })
            yield pa.array(rows, pa.struct([
                ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64())),
            ]))

    return docs.withColumn(into, infer(F.col(text)))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, shares: learned from the rows that are not held out."""
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", "language.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows whose letters are mostly in words of known languages; texts without a letter go, and all if nothing is known.

    A reject class, :attr:`LanguageModel.noise`, joins the mixture: words of no known language fall to it. A document goes
    if more of its letters are in those than in others, with two in doubt; a key or a number with single letters in
    it weighs little. Texts in several known languages stay.
    """
    model = train(docs.where(~held_out()))
    own = fresh(docs, "__words")
    shared = docs.sparkSession.sparkContext.broadcast((model.tables, model.noise))

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables, noise = shared.value
        logp = _held(tables)
        for column in batches:
            stays: list[bool] = []
            for _, _, texts in text_chunks(column, chunk_bytes(len(logp))):
                stays += [len(logp) > 0 and n > 0 and 2 * foreign - 4 <= n for n, foreign in foreign_letters(texts, logp, noise)]
            yield pa.array(stays, pa.bool_())

    return docs.withColumn(own, known(F.col("text"))).where(F.col(own)).drop(own)
