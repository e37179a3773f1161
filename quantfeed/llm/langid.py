"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantfeed.llm.common import slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: The model is fitted on about so many labelled documents of each language, chosen by a hash of the id.
PER_LANGUAGE = 1000
SLICE_CHARS = 500_000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams of each order at every position, the positions where each text begins, and
    whether it has letters. Runs of other characters than letters count as one blank."""
    sizes, parts = [], []
    for t in texts:
        raw = t.lower().encode("utf-32-le", "surrogatepass")
        sizes.append(len(raw) // 4 + max(ORDERS))
        parts += [raw, bytes(4 * max(ORDERS))]
    codes = np.frombuffer(b"".join(parts), np.uint32)
    ink = _is_letter()[codes]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    lettered = np.add.reduceat(ink, starts) > 0
    keep = ink.copy()
    keep[1:] |= ink[:-1]
    keep[starts] = True
    doc_ends = starts + np.array(sizes) - 1
    keep[doc_ends] = True
    keep[doc_ends - 1] = True
    at = np.concatenate([[0], np.cumsum(keep)])[starts]
    codes = np.where(ink, codes, 0)[keep].astype(np.uint32)
    grams, rolled = [], np.zeros(len(codes), np.uint32)
    last = np.append(at[1:], len(codes)) - 1
    for n in range(1, max(ORDERS) + 1):
        more = codes[n - 1 :].copy()
        for back in range(n - 1):  # a gram ends with its text, so that batches don't matter
            over = last - back
            more[over[over < len(more)]] = 0
        rolled = rolled * np.uint32(0x9E3779B1)
        rolled[: len(more)] += more
        if n in ORDERS:
            h = rolled * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)
            grams.append(((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(16))
    return grams, at, lettered


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior probability."""
        if not texts:
            return [], []
        grams, at, lettered = gram_buckets(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for g in grams:
            total += np.add.reduceat(self.log_prob[g], at, axis=0, dtype=np.float64)
        total += self.log_prior
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        names = [self.languages[i] if has else UNKNOWN for i, has in zip(best, lettered, strict=True)]
        return names, [float(p[i, b]) if has else 0.0 for i, (b, has) in enumerate(zip(best, lettered, strict=True))]


def fit(labelled: DataFrame, id_col: str = "doc_id", per_language: int = PER_LANGUAGE, smoothing: float = 0.5) -> LanguageModel:
    """Fit on rows (id_col, text, lang). Rows with a null among them don't count.

    Gram counts are summed by Spark; the driver gets one row for each language and used bucket, at
    most ``BUCKETS`` for each language.
    """
    rows = labelled.select(F.col(id_col).alias("id"), "text", "lang").filter("id is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    languages = sorted(counts)
    rates = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    sample = rows.filter(draw < F.element_at(rates, F.col("lang"))).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, text in zip(langs, texts, strict=True):
                for g in gram_buckets([text])[0]:
                    sums[lang] = sums.get(lang, 0) + np.bincount(g, minlength=BUCKETS)
        for lang, v in sums.items():
            used = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(v[used], pa.int64())], ["lang", "bucket", "n"])

    sums = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((BUCKETS, len(languages)), smoothing)
    matrix[sums["bucket"].to_numpy(int), sums["lang"].map(languages.index).to_numpy(int)] += sums["n"].to_numpy(float)
    prior = np.log(np.array([counts[k] for k in languages], float) / sum(counts.values()))
    return LanguageModel(languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), prior)


def _sent(docs: DataFrame, model: LanguageModel):
    """The model's arrays for the workers, which need no copy of this package to read them."""
    return docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prob, model.log_prior))


def _scored(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    texts = [t or "" for t in texts]
    names: list[str] = []
    scores: list[float] = []
    for i, j in slices([len(t) for t in texts], SLICE_CHARS):
        a, b = model.score(texts[i:j])
        names += a
        scores += b
    return names, scores


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", extra: tuple[Column, ...] = ()) -> DataFrame:
    """Rows (id_col, extra..., lang_pred, score) of every document's whole text.

    ``und`` and 0 for a null or empty text and one without letters. A text of any length is read whole;
    long ones are scored alone. Null ids and repeated rows are predicted like others; other columns
    than ``extra`` are left out, whatever their names; an empty table gives no rows.
    """
    held = _sent(docs, model)
    picked = docs.select(F.col(id_col), *extra, F.col("text").alias("_text"))
    kept = picked.schema.fields[:-1]

    def run(batches):
        for batch in batches:
            names, scores = _scored(LanguageModel(*held.value), batch.column(len(kept)).to_pylist())
            cols = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*[f.name for f in kept], "lang_pred", "score"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "lang_pred string, score double"])
    return picked.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that no model is fitted on; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Predictions for every row, from a model fitted on the other four folds."""
    model = fit(docs.filter(~held_out()), per_language=per_language)
    return predict(docs, model, extra=(held_out().alias("held_out"),))


def accepted_documents(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents in a language that the model knows, with all their columns.

    Rejected: null texts, texts without letters, and those whose best language has a posterior below
    ``min_score``. Each row is judged for itself, so null and repeated ids and ties change nothing, and
    columns of any name come along; without labelled rows no language is known and none is accepted;
    an empty table gives no rows.
    """
    held = _sent(docs, fit(docs.filter(~held_out())))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            names, scores = _scored(LanguageModel(*held.value), batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
