"""Toxicity by compression distance.

zstandard trains two dictionaries: one on the windows of ordinary documents, one on
the runs of toxic documents that ordinary ones hardly have (their character grams
say so). A window of a text is compressed with the ordinary dictionary alone and
with the toxic one behind it; the bytes that the toxic one saves are its distance.
A document's distances go through calibrated thresholds: a logistic model of how
many windows save how much.

Two dictionaries that share nothing differ in the ordinary language that they
happen to hold, by more bytes than a toxic word saves; so both compressors begin
with the ordinary one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm.labelled import held_out, sample

FOLDS, FOLD = 5, 0
#: Labelled documents of each label that are learned from, at most; their texts are read whole.
MOST = 2500
WINDOW = 96
LEVEL = 12
#: Sizes that the trainer is given, and the length of its segments and of what it counts.
ORDINARY_SIZE, TOXIC_SIZE = 1 << 15, 1 << 12
ORDINARY_SEGMENT, TOXIC_SEGMENT, COUNTED = 32, 64, 8
GRAMS = (5, 8)
#: A gram (or word) is toxic if its share of toxic documents is so many times that of ordinary ones.
RATIO = 100
#: And it stands in so many toxic documents, and in one of a hundred of them.
LEAST = 5
#: Parts of the learned documents; each is calibrated on with dictionaries from the others.
PARTS = 3
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> bytes:
    """Lower-case words of letters, each between spaces."""
    return (" " + _NOT_LETTERS.sub(" ", (text or "").lower()).strip() + " ").encode("utf-8", "replace")


def windows(text: bytes) -> list[bytes]:
    """Pieces of about ``WINDOW`` bytes that end between words, of the whole text; none of a text without words."""
    out, at, n = [], 0, len(text)
    if not text.strip():
        return out
    while at < n:
        end = at + WINDOW
        if end < n:
            space = text.rfind(b" ", at + WINDOW // 2, end)
            end = space + 1 if space >= 0 else end
        out.append(text[at:end])
        at = end
    return out


def _grams(word: bytes) -> set[tuple[int, bytes]]:
    """(place, gram) of all grams of a word, and the word itself."""
    return {(0, word), *((i, word[i : i + size]) for size in GRAMS for i in range(len(word) - size + 1))}


def _word_counts(texts: list[bytes]) -> Counter[bytes]:
    """In how many texts each word stands, a space before and after it."""
    return Counter(b" " + w + b" " for text in texts for w in set(text.split()))


def toxic_runs(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The runs of toxic texts, in their order and as often as they stand there, whose grams ordinary texts hardly have."""
    words = _word_counts(toxic)
    in_toxic: Counter[bytes] = Counter()
    in_ordinary: Counter[bytes] = Counter()
    for word, n in words.items():
        for g in {g for _, g in _grams(word)}:
            in_toxic[g] += n
    for word, n in _word_counts(ordinary).items():
        for g in {g for _, g in _grams(word)}:
            if g in in_toxic:
                in_ordinary[g] += n
    least = max(LEAST, len(toxic) // 100)
    odds = RATIO * len(toxic) / max(1, len(ordinary))
    chosen = {g for g, n in in_toxic.items() if n >= least and n > odds * (in_ordinary[g] + 0.5)}
    run_of: dict[bytes, bytes] = {}
    for word in words:
        spans = [(i, i + len(g)) for i, g in _grams(word) if g in chosen]
        if spans:
            first, last = min(a for a, _ in spans), max(b for _, b in spans)
            run_of[word] = word if first <= 1 and last >= len(word) - 2 else word[first:last]
    return [run_of[w] for text in toxic for w in (b" " + x + b" " for x in text.split()) if w in run_of]


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Trained by zstandard; of too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=COUNTED, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(rows: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic one, from (normal text, label) rows."""
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    plain = dictionary([w for t in ordinary for w in windows(t)], ORDINARY_SIZE, ORDINARY_SEGMENT)
    return plain, dictionary(toxic_runs(toxic, ordinary), TOXIC_SIZE, TOXIC_SEGMENT)


def _filler(n: int) -> bytes:
    """n bytes that no text has and no reference can use, in place of a toxic dictionary."""
    blocks = (hashlib.blake2b(i.to_bytes(4, "little")).digest() for i in range(n // 64 + 1))
    return bytes(1 + b % 8 for b in b"".join(blocks))[:n]


class Distance:
    """Bytes that the toxic dictionary saves in each window.

    Without it, filler stands in its place: then ordinary text is as far back
    either way, and what a window saves comes from toxic content alone.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = self._compressor(ordinary + _filler(len(toxic))), self._compressor(ordinary + toxic)

    @staticmethod
    def _compressor(content: bytes):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            source_size=WINDOW,
            dict_size=len(content),
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        dictionary = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress

    def saved(self, text: bytes) -> np.ndarray:
        plain, both = self.plain, self.both
        return np.array([len(plain(w)) - len(both(w)) for w in windows(text)], dtype=np.float64)


def features(saved: np.ndarray) -> list[float]:
    n = len(saved)
    if not n:
        return [0.0] * 11
    top = np.sort(saved)[::-1]
    three, four = (saved >= 3).sum(), (saved >= 4).sum()
    return [
        top[0], top[:2].sum(), top[:4].sum(), saved.mean(), (saved >= 2).mean(), three / n, float(four > 0),
        np.log1p(three), np.log1p(four), 1 / n, np.log1p(n),
    ]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        x = np.concatenate([(rows - self.mean) / self.scale, np.ones((len(rows), 1))], axis=1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        w -= np.linalg.solve(hessian, x.T @ (weight * (p - y)) + w)
    return w


def train(rows: list[tuple[str, int, float]]) -> Model | None:
    """From (text, label, weight) rows; None unless both labels are there.

    Thresholds are calibrated on the distances of each of ``PARTS`` parts by the
    dictionaries of the others, which that part had no share in; the model's own
    dictionaries come from all rows.
    """
    if len({y for _, y, _ in rows}) < 2:
        return None
    texts = [(normal(t), y) for t, y, _ in rows]
    order = sorted(range(len(texts)), key=lambda i: texts[i][1])  # so that every part has its share of each label
    part = np.empty(len(texts), dtype=int)
    part[order] = np.arange(len(texts)) % PARTS
    x = np.zeros((len(texts), len(features(np.zeros(0)))))
    for p in range(PARTS):
        rest = [t for t, q in zip(texts, part, strict=True) if q != p]
        distance = Distance(*dictionaries(rest if len({y for _, y in rest}) > 1 else texts))
        for i in np.flatnonzero(part == p):
            x[i] = features(distance.saved(texts[i][0]))
    y = np.array([y for _, y in texts], dtype=np.float64)
    weight = np.array([w for _, _, w in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    weights = _logistic(np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1), y, weight / weight.mean())
    return Model(*dictionaries(texts), mean, scale, weights)


_DISTANCES: dict[bytes, Distance] = {}


def _distance(model: Model) -> Distance:
    key = hashlib.blake2b(model.ordinary + b"\0" + model.toxic).digest()
    if key not in _DISTANCES:
        _DISTANCES.clear()
        _DISTANCES[key] = Distance(model.ordinary, model.toxic)
    return _DISTANCES[key]


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row, from its whole text alone. Without a model all score 0; a text without words scores 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            if model is not None and batch.num_rows:
                distance = _distance(model)
                saved = [distance.saved(normal(t.as_py())) for t in batch.column(1)]
                found = np.where([len(s) > 0 for s in saved], model.probability(np.array([features(s) for s in saved])), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    kind = docs.select(id_col).schema[0].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Learns from at most ``MOST`` documents of each label, never from held-out
    ones. Null and empty texts score 0; rows that repeat an id are scored each by
    its own text; null ids are passed on. Unless both labels are known, all score 0.
    """
    model = train(sample(docs, labels, label, FOLDS, FOLD, MOST, id_col, text_col))
    return score(docs, model, id_col, text_col).select(
        "doc_id",
        held_out("doc_id", FOLDS, FOLD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
