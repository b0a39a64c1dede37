"""Language ID by inference of a mixture of languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._bytes import chunks
from tidemark.llm._shared import ready

SLOTS = 1 << 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)


def slots(data: np.ndarray) -> np.ndarray:
    """Slot of every three bytes in a row: letters in lower case, all other ASCII as a space."""
    x = _FOLD[data].astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


@dataclass(frozen=True)
class Model:
    """``probability[slot, language]``: half a MB for each language, of which there are as many as labels, however many rows."""

    languages: tuple[str, ...]
    probability: np.ndarray


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Count the n-grams of every labelled text, whole, by language.

    Each task sends one count per language and slot, Spark adds them; the driver gets at most
    SLOTS x languages sums, in a row for each language. Rows with a null text or language teach
    nothing. The model has SLOTS numbers for each language, the same however many languages there are.
    """
    ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, data, offsets in chunks(batch.column(0)):
                for i in range(len(offsets) - 1):
                    if offsets[i + 1] - offsets[i] > 2:
                        at = slots(data[offsets[i] : offsets[i + 1]])
                        own = seen.setdefault(langs[first + i], np.zeros(SLOTS, dtype=np.int64))
                        own += np.bincount(at, minlength=SLOTS)
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "slot", "n"])

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = known.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("c")).select("lang", "c.slot", "c.n").toArrow()
    order = np.argsort(np.array(rows["lang"].to_pylist(), dtype=object), kind="stable") if rows.num_rows else []
    probability = np.full((SLOTS, max(1, rows.num_rows)), smoothing)
    for k, row in enumerate(order):
        slot, n = (rows[c][int(row)].values.to_numpy() for c in ("slot", "n"))
        probability[slot, k] += n
    return Model(tuple(rows["lang"][int(row)].as_py() for row in order), probability / probability.sum(axis=0))


def shares(probability: np.ndarray, counts: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Proportions of the languages by expectation-maximisation, and the log likelihood."""
    n = probability.shape[1]
    theta, total = np.full(n, 1 / n), counts.sum()
    if n == 1:
        return theta, float(counts @ np.log(probability[:, 0]))
    for _ in range(rounds):
        theta = theta * ((counts / (probability @ theta)) @ probability) / total
    return theta, float(counts @ np.log(probability @ theta))


def infer(model: np.ndarray, at: np.ndarray, penalty: float) -> list[tuple[int, float]]:
    """(language, share) of the set of languages with the best penalised likelihood, largest share first.

    Languages join in the order of their shares among all. Every n-gram overlaps two others, so
    a gain in likelihood counts a third. No set gains more than all languages do.
    """
    ordered = np.sort(at, kind="stable")
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    counts = np.diff(np.r_[heads, len(ordered)]).astype(float)
    p = model[ordered[heads]]
    theta, most = shares(p, counts)
    order = np.argsort(-theta, kind="stable")
    chosen = [int(order[0])]
    part, fit = shares(p[:, chosen], counts)
    for extra in order[1:]:
        if (most - fit) / 3 <= penalty * np.log(len(at)):
            break
        part_more, fit_more = shares(p[:, [*chosen, int(extra)]], counts)
        if (fit_more - fit) / 3 <= penalty * np.log(len(at)):
            break
        chosen, part, fit = [*chosen, int(extra)], part_more, fit_more
    found = sorted(zip(chosen, part, strict=True), key=lambda x: (-x[1], x[0]))
    if len(found) == 1:
        return [(found[0][0], float(theta[found[0][0]]))]
    return [(k, float(x)) for k, x in found]


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 5.0) -> DataFrame:
    """Add lang_pred, score and languages (language and share of each chosen) to every row.

    ``penalty`` is the gain in log likelihood per log of the number of n-grams that another
    language must bring. Texts that are null or without a letter are ``und`` with score 0, as
    are all texts if the model knows no language; those under three bytes get the model's
    first language at an even share. Columns of these names are replaced, others kept.
    """
    docs = docs.drop("lang_pred", "score", "languages")
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "languages": F.array().cast("array<struct<lang:string,share:double>>")})
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers for each language
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))])
    pairs = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    position = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, probability = shared.value.languages, shared.value.probability
        for batch in batches:
            has_letter = batch.column(batch.num_columns - 1).to_pylist()
            best, score, mixture = [], [], []
            for first, data, offsets in chunks(batch.column(position)):
                for i in range(len(offsets) - 1):
                    if not has_letter[first + i]:
                        found = []
                    elif offsets[i + 1] - offsets[i] < 3:
                        found = [(0, 1 / len(languages))]
                    else:
                        found = infer(probability, slots(data[offsets[i] : offsets[i + 1]]), penalty)
                    best.append(languages[found[0][0]] if found else "und")
                    score.append(min(1.0, max(0.0, found[0][1])) if found else 0.0)
                    mixture.append([{"lang": languages[k], "share": x} for k, x in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pairs)], schema.names)

    return docs.withColumn("__letters", letters).mapInArrow(predict, schema)
