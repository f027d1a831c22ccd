"""Language identification with string kernels.

The kernel of two texts counts the distinct character n-grams (one to three characters) that both hold, normalised by
the two texts' own counts. Landmark texts span a Nyström approximation; one-versus-rest kernel ridge regression is fitted in it.
As the score of a text is linear in its kernel row, the landmarks' presence matrix is multiplied with the regression
weights once, and a batch of texts is scored with one product of its presence matrix.

The model is fitted on a bounded sample: ``per_language`` labelled rows of each language, whatever the size of the table.
Scoring reads every whole text once, in parallel, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.llm.common import staged, whole_text

#: Fitting: labelled rows and landmarks per language.
PER_LANGUAGE, LANDMARKS = 300, 64
RIDGE = 1e-3
SHARPNESS = 4.0
UNKNOWN = "und"
#: Characters of a text that are cut into n-grams at once, and texts of one product.
_BLOCK, _BATCH = 1 << 18, 64


def ngrams(text: str) -> np.ndarray:
    """The distinct n-grams of one to three characters, sorted: each is its code points at 21 bits, so any two stay apart."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64) + 1
    found = np.empty(0, np.int64)
    for k in range(0, len(points), _BLOCK):  # blocks overlap by two characters
        p = points[k : k + _BLOCK + 2]
        two = p[:-1] << 21 | p[1:]
        part = np.unique(np.concatenate([p, two, two[:-1] << 21 | p[2:]]))
        found = part if not len(found) else np.union1d(found, part)
    return found


def held_rows(grams: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Which of the sorted ``grams`` each text holds."""
    held = np.zeros((len(texts), len(grams)), np.float32)
    if len(grams):
        for row, own in zip(held, texts):
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            row[at[grams[at] == own]] = 1
    return held


@dataclass
class LanguageModel:
    languages: list[str]
    grams: np.ndarray  # sorted n-grams that some landmark holds
    weights: np.ndarray  # one column per language

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression values, one row per text."""
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(0, len(texts), _BATCH):
            part = [ngrams(t) for t in texts[k : k + _BATCH]]
            norm = np.sqrt(np.maximum(1, np.array([len(g) for g in part])))
            out[k : k + _BATCH] = held_rows(self.grams, part) @ self.weights / norm[:, None]
        return out


def fit_kernel(sample: list[np.ndarray], labels: np.ndarray, landmarks: np.ndarray, languages: list[str], ridge: float = RIDGE) -> LanguageModel:
    """``sample``: the n-grams of each labelled row; ``landmarks``: positions of the landmark rows among them.

    Only the n-grams of landmarks take part in products, a few rows at a time.
    """
    norm = np.sqrt(np.maximum(1, np.array([len(g) for g in sample]))).astype(np.float64)
    grams = np.unique(np.concatenate([sample[i] for i in landmarks])) if len(landmarks) else np.empty(0, np.int64)
    marks = held_rows(grams, [sample[i] for i in landmarks])
    marks /= norm[landmarks].astype(np.float32)[:, None]
    kernel = np.concatenate([held_rows(grams, sample[k : k + _BATCH]) @ marks.T for k in range(0, len(sample), _BATCH)])
    kernel = kernel.astype(np.float64) / norm[:, None]
    values, vectors = np.linalg.eigh(kernel[landmarks])
    solid = values > 1e-8 * values.max()
    project = vectors[:, solid] / np.sqrt(values[solid])
    features = kernel @ project
    target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = features.T @ features + ridge * len(features) * np.eye(features.shape[1])
    dual = project @ np.linalg.solve(gram, features.T @ target)
    return LanguageModel(languages, grams, marks.T @ dual.astype(np.float32))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
        landmarks: int = LANDMARKS) -> LanguageModel | None:
    """A model of the languages in ``labelled``; null where no row has text and language.

    The sample is the ``per_language`` rows of each language with the smallest hash of their id and text; very long texts are read whole.
    """
    rows = labelled.select(F.xxhash64(id_col, whole_text(text_col)).alias("h"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    order = Window.partitionBy("l").orderBy("h")
    chosen = rows.select("h", "l").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    chosen = staged(chosen)
    # per_language rows of a hash and a name for each language.
    sample = staged(rows.join(chosen, ["h", "l"]).dropDuplicates(["h", "l"]))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"l": batch["l"], "n": batch["n"], "grams": [ngrams(t).tobytes() for t in batch["t"]]})

    found = sample.mapInPandas(held, "l string, n int, grams binary").orderBy("l", "n").collect()
    if not found:
        return None
    languages = sorted({r.l for r in found})
    labels = np.array([languages.index(r.l) for r in found])
    marks = np.flatnonzero([r.n <= landmarks for r in found])
    return fit_kernel([np.frombuffer(bytes(r.grams), np.int64) for r in found], labels, marks, languages)


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``id``, ``lang_pred`` and ``score`` per row (all columns of ``docs`` besides, with ``keep``).

    Null, empty and letterless texts are ``und`` with score 0, as is every text without a model. The score is the soft
    maximum of the regression values; of equal values the first language by name counts. Repeated rows are scored alike, very long texts whole;
    an empty table gives no rows.
    """

    @F.pandas_udf("lang string, value double")
    def of(texts: pd.Series) -> pd.DataFrame:
        lang, value = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        worded = [i for i, t in enumerate(texts) if next(filter(str.isalpha, t), None) is not None]
        if worded and model is not None:
            scores = SHARPNESS * model.scores([texts.iloc[i] for i in worded])
            share = np.exp(scores - scores.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            lang[worded] = np.array(model.languages, object)[share.argmax(axis=1)]
            value[worded] = share.max(axis=1)
        return pd.DataFrame({"lang": lang, "value": value})

    kept = docs.columns if keep else [id_col]
    found = docs.select(*kept, of(whole_text(text_col)).alias("_found"))
    return found.select(*kept, F.col("_found.lang").alias("lang_pred"), F.col("_found.value").alias("score"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_recognised(docs: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose language is recognised with a score of ``least``, with their columns as they are.

    The model learns from the rows of ``docs`` that are not held out.
    """
    model = fit(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), id_col, text_col)
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"), F.lit(0).alias("_id"))
    judged = predict(marked, model, "_id", "_text", keep=True)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")
