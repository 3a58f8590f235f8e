"""Language identification by multilingual mixture inference.

Training counts hashed character trigrams of labelled texts, by language, on a
bounded sample: about ``train_docs`` texts of each language, drawn by a hash of
the id.  Every label is learned; a language takes BUCKETS numbers of the model.  Every text is then taken as a
mixture of these languages: expectation-maximisation finds the proportions that
make its trigrams likeliest, and of the sets of its 1, 2, ... strongest
languages the one with the greatest likelihood less a penalty (half the log of
the number of trigrams for each language, times ``penalty``) is its set.

The prediction is the strongest language of the set, the score its proportion.
A text that is null or has no letter is ``und`` with score 0, as is every text
where nothing is labelled.  Labels, sources and ids are no inputs of a
prediction.  Rows that repeat are predicted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import tidy

BUCKETS = 1 << 15
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the trigrams of a text's letters, words apart; empty without a letter."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    is_letter = _letters()[c]
    c = np.where(is_letter, c, 32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    h = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)
    return h[is_letter[1:-1]].astype(np.int64)


def mixture(counts: np.ndarray, like: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Proportions of the columns of like (trigrams x languages) by EM, and the log likelihood."""
    total, k = counts.sum(), like.shape[1]
    share = np.full(k, 1 / k)
    mean = like @ share
    for _ in range(rounds if k > 1 else 0):
        new = share * ((counts / mean) @ like) / total
        done = np.abs(new - share).max() < 1e-3
        share, mean = new, like @ new
        if done:
            break
    return share, float(counts @ np.log(mean))


def infer(ids: np.ndarray, model: np.ndarray, penalty: float) -> tuple[list[int], list[float]]:
    """Languages of a text, strongest first, and their proportions."""
    ids, counts = np.unique(ids, return_counts=True)
    like, counts = model[ids], counts.astype(float)
    share, most = mixture(counts, like)
    order = np.argsort(-share, kind="stable")
    fee = penalty * 0.5 * np.log(counts.sum())
    best, at = (order[:1], share[order[:1]]), -np.inf
    for k in range(1, len(order) + 1):
        # no set is likelier than all languages together, so none of k or more can do better
        if most - k * fee < at:
            break
        some, ll = mixture(counts, like[:, order[:k]]) if k < len(order) else (share[order], most)
        if ll - k * fee > at:
            at, best = ll - k * fee, (order[:k], some)
    by = np.argsort(-best[1], kind="stable")
    return best[0][by].tolist(), best[1][by].tolist()


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def train(docs: DataFrame, train_docs: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the (BUCKETS x languages) trigram probabilities, from labelled texts that are not held out."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    sizes = known.groupBy(F.col(lang_col).alias("l")).count().collect()  # a row a language
    langs = sorted(r["l"] for r in sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table[number[lang]] += np.bincount(trigrams(text), minlength=BUCKETS)
        for i, row in enumerate(table):
            if row.any():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])

    part = F.create_map(*[x for r in sizes for x in (F.lit(r["l"]), F.lit(min(1.0, train_docs / r["count"])))])[F.col(lang_col)]
    draw = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 20)) < part * (1 << 20)
    sample = known.where(draw).select(F.col(lang_col).alias("l"), F.col(text_col).alias("text"))
    counts = sample.mapInArrow(tidy(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # at most BUCKETS rows a language
    table = np.zeros((BUCKETS, len(langs)))
    table[got.column("bucket").to_numpy(), got.column("lang").to_numpy()] = got.column("n").to_numpy()
    table += 0.1
    return langs, table / table.sum(0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs and shares (the chosen set) of every row."""
    langs, like = model
    shared = docs.sparkSession.sparkContext.broadcast(like)  # BUCKETS numbers a language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                ids = trigrams(text) if text and langs else np.zeros(0, np.int64)
                found.append(infer(ids, shared.value, penalty) if len(ids) else ([], []))
            names = [[langs[i] for i in f[0]] for f in found]
            shares = [[min(1.0, max(0.0, s)) for s in f[1]] for f in found]
            cols = [pa.array([n[0] if n else "und" for n in names], pa.string()), pa.array([s[0] if s else 0.0 for s in shares], pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "held_out", "lang_pred", "score", "langs", "shares"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(tidy(predict), PREDICTED)
