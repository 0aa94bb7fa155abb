"""Language ID as a mixture: EM finds each document's language shares, a penalty selects the set."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, map_batches

# Bounds of the fit: documents per language (about), and of all languages together.
DOCS_PER_LANGUAGE, DOCS = 1_500, 384_000
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")  # number-like letters such as a raised 2 are none
EDGE = "\x02"
MEMO_WORDS, MEMO_CELLS = 300_000, 8_000_000  # words looked up, and words times languages
BATCH_CELLS = 65_536  # documents times languages worked on at once
UNDETERMINED = "und"


def words(text: str | None) -> Counter:
    return Counter(LETTERS.findall((text or "").lower()))


def trigrams(word: str) -> list[str]:
    padded = EDGE + EDGE + word + EDGE
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


class LanguageModel:
    """Letter trigram model of each language, smoothed by shorter contexts."""

    def __init__(self, langs: list[str], grams: dict[str, list[int]], strength: float = 2.0):
        self.langs, self.strength = langs, strength
        k = len(langs)
        tri = {g: np.array(n, float) for g, n in grams.items()}
        self.tri, self.bi, self.uni = tri, {}, {}
        self.tri_of, self.bi_of, self.total = {}, {}, np.zeros(k)
        for g, n in tri.items():
            for store, key in ((self.bi, g[1:]), (self.uni, g[2]), (self.tri_of, g[:2]), (self.bi_of, g[1])):
                store[key] = store.get(key, 0) + n
            self.total += n
        self.none = np.zeros(k)
        self.gram_rows, self.gram_logs = {}, np.empty((0, k))
        self.word_rows, self.word_logs = {}, np.empty((0, k))

    def gram(self, g: str) -> np.ndarray:
        """Log-probability of a letter after the two before it, under each language."""
        s, none = self.strength, self.none
        one = (self.uni.get(g[2], none) + 0.5) / (self.total + 0.5 * (len(self.uni) + 1))
        two = (self.bi.get(g[1:], none) + s * one) / (self.bi_of.get(g[1], none) + s)
        return np.log((self.tri.get(g, none) + s * two) / (self.tri_of.get(g[:2], none) + s))

    def logs(self, found: list[Counter]) -> np.ndarray:
        """Log-likelihood of every word of every counter under each language; words seen before are looked up."""
        memo = min(MEMO_WORDS, MEMO_CELLS // max(1, len(self.langs)))
        if len(self.word_rows) > memo or len(self.gram_rows) > memo:
            self.gram_rows, self.gram_logs = {}, self.gram_logs[:0]
            self.word_rows, self.word_logs = {}, self.word_logs[:0]
        known = self.word_rows
        new = [w for w in set(chain.from_iterable(found)) if w not in known]
        if new:
            grams = [trigrams(w) for w in new]
            rows = self.gram_rows
            fresh = [g for g in set(chain.from_iterable(grams)) if g not in rows]
            if fresh:
                rows.update(zip(fresh, range(len(rows), len(rows) + len(fresh))))
                self.gram_logs = np.concatenate((self.gram_logs, [self.gram(g) for g in fresh]))
            at = np.fromiter((rows[g] for g in chain.from_iterable(grams)), np.int64)
            begin = np.cumsum([0] + [len(g) for g in grams[:-1]])
            self.word_logs = np.concatenate((self.word_logs, np.add.reduceat(self.gram_logs[at], begin, axis=0)))
            known.update(zip(new, range(len(known), len(known) + len(new))))
        return self.word_logs[np.fromiter((known[w] for ws in found for w in ws), np.int64)]

    def mixtures(
        self, texts: list[str | None], penalty: float = 3.0, rounds: int = 15,
    ) -> list[tuple[str, float, list[tuple[str, float]]]]:
        """For each text: likeliest language, its share, and the shares of the languages selected.

        Expectation-maximisation over the words of all texts at once. Languages are
        given up, smallest share first, while the log-likelihood falls by less than
        *penalty* times the log of the number of words for each.
        """
        out: list = [(UNDETERMINED, 0.0, [])] * len(texts)
        counted = [(i, ws) for i, t in enumerate(texts) if (ws := words(t))]
        if not counted or not self.langs:
            return out
        n = np.array([ws.total() for _, ws in counted], float)
        lengths = np.array([len(ws) for _, ws in counted])
        weight = np.concatenate([np.fromiter(ws.values(), float, len(ws)) for _, ws in counted])
        logs = self.logs([ws for _, ws in counted])
        top = logs.max(axis=1)
        like = np.exp(logs - top[:, None])

        def em(which: np.ndarray, mask: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Shares and log-likelihoods of the documents *which*, languages limited to *mask*."""
            rows = np.repeat(np.isin(np.arange(len(counted)), which), lengths)
            p, w, size = like[rows], weight[rows], lengths[which]
            begin, owner = np.concatenate(([0], np.cumsum(size)[:-1])), np.repeat(np.arange(len(which)), size)
            pi = np.where(mask, shares + 1e-3, 0)
            pi /= pi.sum(1, keepdims=True)
            for _ in range(rounds if mask.sum(1).max() > 1 else 0):  # one language has share one
                joint = p * pi[owner]
                joint *= (w / np.maximum(joint.sum(1), 1e-300))[:, None]
                pi = np.add.reduceat(joint, begin, axis=0) / n[which, None]
            mixed = np.maximum((p * pi[owner]).sum(1), 1e-300)
            return pi, np.add.reduceat(w * np.log(mixed), begin)

        every = np.arange(len(counted))
        mask = np.ones((len(counted), len(self.langs)), bool)
        shares, fit = em(every, mask, np.ones(mask.shape))
        open_ = every
        while True:
            open_ = open_[mask[open_].sum(1) > 1]
            if not len(open_):
                break
            ranked = np.where(mask[open_], shares[open_], np.inf)
            least = ranked.min(1)
            # at once what has next to no share, else the smallest
            gone = ranked <= np.maximum(least, np.minimum(0.002, ranked.max(1, where=mask[open_], initial=0) / 2))[:, None]
            trial = mask[open_] & ~gone
            pi, value = np.empty(trial.shape), np.empty(len(trial))
            alone = trial.sum(1) == 1
            for some in (np.flatnonzero(alone), np.flatnonzero(~alone)):
                if len(some):
                    pi[some], value[some] = em(open_[some], trial[some], shares[open_[some]])
            fine = fit[open_] - value < penalty * np.log(n[open_] + 1) * gone.sum(1)
            done = open_[fine]
            mask[done], shares[done], fit[done] = trial[fine], pi[fine], value[fine]
            open_ = done
        for row, (i, _) in enumerate(counted):
            best = int(shares[row].argmax())
            parts = sorted(((self.langs[j], float(shares[row, j])) for j in np.flatnonzero(mask[row])),
                           key=lambda x: (-x[1], x[0]))
            out[i] = (self.langs[best], min(1.0, float(shares[row, best])), parts)
        return out


def fit_languages(
    docs: DataFrame, *, held_out: tuple[int, int] = (4, 2), per_language: int = DOCS_PER_LANGUAGE,
    total: int = DOCS,
) -> LanguageModel:
    """Count trigrams of about *per_language* documents of each language (chosen by a hash of the id).

    Only text and lang of rows outside the held-out fold are used. Every value of lang is
    learned; where there are more than *total* / *per_language* of them, each has fewer documents.
    """
    train = docs.filter(F.col("lang").isNotNull() & ~in_fold(F.col("doc_id"), *held_out)).select("doc_id", "lang", "text")
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toArrow()
    langs = sorted(sizes.column("lang").to_pylist())
    if not langs:
        return LanguageModel([], {})
    wanted = max(1.0, min(per_language, total / len(langs)))
    # one row per language, as the model itself has one column per language
    shares = F.broadcast(docs.sparkSession.createDataFrame(sizes).select(
        "lang", F.least(F.lit(1.0), F.lit(float(wanted)) / F.col("n")).alias("share")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("lang|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8),
                  16, 10).cast("bigint") / F.lit(2.0**32)

    def run(batch: pa.RecordBatch) -> dict:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            grams = found.setdefault(lang, Counter())
            for w, n in words(text).items():
                for g in trigrams(w):
                    grams[g] += n
        rows = [(lang, g, n) for lang, grams in found.items() for g, n in grams.items()]
        return {"lang": [r[0] for r in rows], "gram": [r[1] for r in rows], "n": [r[2] for r in rows]}

    counted = (
        map_batches(train.join(shares, "lang").filter(draw < F.col("share")).select("lang", "text"), run, "lang string, gram string, n bigint")
        .groupBy("gram", "lang").agg(F.sum("n").alias("n"))
        # bounded by the sample: letters three at a time
        .groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by")).toArrow())
    place = {lang: i for i, lang in enumerate(langs)}
    grams = {}
    for g, by in zip(counted.column("gram").to_pylist(), counted.column("by").to_pylist()):
        row = [0] * len(langs)
        for x in by:
            row[place[x["lang"]]] = x["n"]
        grams[g] = row
    return LanguageModel(langs, grams)


def detect_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and languages ("en:0.91,fr:0.09") of every row.

    score is the share of the predicted language. NULL texts and texts without a letter
    are "und" with score 0. Of languages with equal shares the first by code points is named;
    repeated rows get the same result each. Words are runs of letters and their marks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        found = model.mixtures(batch.column(1).to_pylist())
        return {
            "doc_id": batch.column(0), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
            "languages": [",".join(f"{lang}:{share:.2f}" for lang, share in f[2]) for f in found]}

    return map_batches(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, languages string",
        rows=max(1, min(256, BATCH_CELLS // max(1, len(model.langs)))))


def language_documents(docs: DataFrame) -> DataFrame:
    """Language of every document, learned outside the fold that is held out (see :func:`detect_languages`).

    Documents whose lang is NULL, and those of the fold, teach nothing; without any other, all are "und".
    """
    model = fit_languages(docs)
    return detect_languages(docs, model).select(
        "doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "languages")
