"""Quality scores from compression with dictionaries of good and bad text (operator 3)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import piece, released

#: labelled documents drawn per class for the dictionaries, at most about; as many again calibrate the score
SAMPLE_DOCS = 1_000
#: characters used of each for a dictionary, in one piece from a place drawn by hash
SAMPLE_CHARS = 2_000
DICTIONARY_BYTES = 65_536
#: a text is compressed in pieces of so many bytes, so a long text is judged by all of its parts alike
PIECE_BYTES = 512
LEVEL = 3
#: a text of so many bytes moves the score half as far from the share of good labels as a long one
HALF_BYTES = 64


@dataclass
class QualityModel:
    """Dictionaries of the two classes, and the logistic curve from size difference to score.

    prior is the log odds of a good label. slope and shift add to it what the difference says, the more the longer the text.
    """

    good: bytes | None
    bad: bytes | None
    prior: float
    slope: float = 0.0
    shift: float = 0.0
    piece_bytes: int = PIECE_BYTES
    level: int = LEVEL

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_dict_id=False))
        return out

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        """Per text: bytes that the good dictionary saves over the bad one, per byte of text, and the weight of the text's
        length; the former times the latter first."""
        sizes = np.array([len(t or b"") for t in texts], float)
        saved = np.zeros(len(texts))
        if self.good is not None and self.bad is not None:
            good, bad = self.compressors()
            for k, text in enumerate(texts):
                for at in range(0, len(text or b""), self.piece_bytes):
                    piece = text[at : at + self.piece_bytes]
                    saved[k] += len(bad.compress(piece)) - len(good.compress(piece))
        weight = sizes / (sizes + HALF_BYTES)
        return np.column_stack([weight * saved / np.maximum(sizes, 1), weight])

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.prior + features @ [self.slope, self.shift], -30, 30)))


def without_shared_lines(samples: dict[int, list[str]]) -> dict[int, list[bytes]]:
    """The samples without lines that several of them have: what documents of either class begin or end with is no evidence.

    A class that would have nothing left stays as it is.
    """
    seen = Counter(line for texts in samples.values() for text in texts for line in set(text.split("\n")))
    out = {}
    for label, texts in samples.items():
        own = ["\n".join(line for line in text.split("\n") if seen[line] == 1) for text in texts]
        own = [text for text in own if text.strip()]
        out[label] = [text.encode() for text in own or texts]
    return out


def dictionary(samples: list[bytes], size: int) -> bytes | None:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def logistic(features: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: float, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients by Newton steps on scaled features, with a slight ridge against separable data."""
    scale = np.abs(features).max(axis=0)
    scale[scale == 0] = 1.0
    a, weight, b = features / scale, weight / weight.sum(), np.zeros(features.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(offset + a @ b, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + ridge * 1e-2 * b
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * 1e-2 * np.eye(len(b))
        step = np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        b = b - step
        if np.abs(step).max() < 1e-9:
            break
    return b / scale


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
    dictionary_bytes: int = DICTIONARY_BYTES,
    piece_bytes: int = PIECE_BYTES,
    level: int = LEVEL,
) -> QualityModel:
    """Train dictionaries on a bounded sample of labelled rows and calibrate on another.

    docs: doc_id, text. labels: doc_id, quality (0 or 1). About sample_docs labels a class, chosen by a hash of the id,
    train its dictionary, each with a piece of at most sample_chars characters from a place drawn by hash; as many others calibrate, on whole texts, each weighted to its class's share of all labels. The
    sample is drawn from the narrow labels, and its at most about 4 * sample_docs ids are broadcast, so texts are not
    shuffled. Rows with a null in a column take no part. Without rows of both classes every score is the share of good
    labels, or 0.5.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    share = (n.get(1, 0) + 1) / (total + 2)
    prior = math.log(share / (1 - share))
    if len(n) < 2:
        return QualityModel(None, None, prior)
    chance = F.when(F.col("quality") == 1, F.lit(min(0.5, sample_docs / n[1]))).otherwise(F.lit(min(0.5, sample_docs / n[0])))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    drawn = known.withColumns({"trains": draw < chance, "used": draw < 2 * chance}).filter("used").drop("used").distinct()
    drawn = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(drawn), "doc_id")
    texts: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(drawn.filter("trains").select("quality", "doc_id", piece("text", "doc_id", sample_chars).alias("text")).collect()):
        texts[r["quality"]].append(r["text"])
    samples = without_shared_lines(texts)
    model = QualityModel(dictionary(samples[1], dictionary_bytes), dictionary(samples[0], dictionary_bytes), prior, piece_bytes=piece_bytes, level=level)
    seen = measure(drawn.filter("not trains"), model).collect()
    y = np.array([r["quality"] for r in seen], float)
    if model.good is None or model.bad is None or not 0 < y.sum() < len(y):
        return QualityModel(None, None, prior)
    weight = np.where(y == 1, n[1] / y.sum(), n[0] / (len(y) - y.sum()))
    found = logistic(np.array([(r["difference"], r["weight"]) for r in seen]), y, weight, prior)
    model.slope, model.shift = map(float, found)
    return model


def measure(labelled: DataFrame, model: QualityModel) -> DataFrame:
    """quality, and the features of each text."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.features(batch.column("text").cast(pa.binary()).to_pylist())
            columns = [batch.column("quality"), pa.array(found[:, 0]), pa.array(found[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["quality", "difference", "weight"])

    return labelled.select("quality", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "quality int, difference double, weight double"
    )


def score_quality(docs: DataFrame, model: QualityModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score each document by how much better good text predicts it than bad text does.

    Every piece of the whole text is compressed with the dictionary of either class; the difference of the sizes,
    per byte of text, goes through the calibrated logistic curve. A short text says little, so its score stays near the share of
    good labels.

    Returns doc_id, the columns named in carry, score (0 to 1, higher: good likelier), predicted (1 if score >= 0.5).

    Null or empty text scores the share of good labels. Repeated rows are each scored. An empty table gives no rows. Other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", *carry, F.col("text").cast("string").alias("scored_text"))
    fields = [*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(shared.value.features(batch.columns[-1].cast(pa.binary()).to_pylist()))
            found = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[f.name for f in fields])

    return rows.mapInArrow(released(run), T.StructType(fields))
