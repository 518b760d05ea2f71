"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded: counts of its
characters' classes, of pairs of them, and of repeated words go through a learned
layer. Gated attention gives each passage a weight, the weighted mean of the
encodings represents the document, and a logistic layer scores it. All layers are
learned together, from the labels of documents alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm.labelled import held_out, sample

FOLDS, FOLD = 3, 1
#: Labelled documents of each label that are learned from, at most; their texts are read whole.
MOST = 2000
PASSAGE = 64  # words
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY = 12, 64, 5e-3, 1e-4
#: Bytes whose features are found at once; a longer text is a group of its own, and one of over SLICE bytes is read in slices.
GROUP, SLICE = 1 << 17, 1 << 20

_ASCII = np.zeros(256, dtype=np.int64)
_COARSE = np.zeros(256, dtype=np.int64)
for _c in range(256):
    _s = chr(_c) if _c < 128 else ""
    if _c >= 128:
        _kind, _rough = 0, 0
    elif _s.islower():
        _kind, _rough = 1, 1
    elif _s.isupper():
        _kind, _rough = 2, 2
    elif _s.isdigit():
        _kind, _rough = 3, 3
    elif _s == "\n":
        _kind, _rough = 4, 4
    elif _s.isspace() or _c < 32 or _c == 127:
        _kind, _rough = 5, 5
    else:
        _kind, _rough = 6 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".index(_s), 6 if _s in ".,;:!?'\"()-" else 7
    _ASCII[_c], _COARSE[_c] = _kind, _rough
CLASSES, ROUGH = 38, 8
FEATURES = CLASSES + ROUGH * ROUGH + 5
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers of ``base`` up to n at least; those for usual sizes are kept."""
    known = _POWERS.get(int(base))
    if known is None or len(known) <= n:
        known = np.full(max(n, GROUP) + 1, base, dtype=np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 4 * GROUP:
            _POWERS[int(base)] = known
    return known


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word, from differences of prefix sums."""
    terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data))[: len(data)]
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return (prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(data))[starts]


def _repeats(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each group, how many of its values stood in it before. 40 bits of a value tell it from others of its passage."""
    keys = np.sort(groups.astype(np.uint64) << np.uint64(40) | values >> np.uint64(24))
    again = keys[1:][keys[1:] == keys[:-1]]
    return np.bincount((again >> np.uint64(40)).astype(np.int64), minlength=n)


def slices(text: bytes) -> Iterator[tuple[bytes, int, bool]]:
    """(piece, the byte before it, whether it is the last) of a text, cut where passages begin. Words without end make a piece longer."""
    at, size = 0, SLICE
    while len(text) - at > size:
        space = _SPACE[np.frombuffer(text, np.uint8, size, at)]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        cut = (len(starts) - 1) // PASSAGE * PASSAGE
        if cut <= 0:
            size *= 2
            continue
        end = at + int(starts[cut])
        yield text[at:end], text[at - 1] if at else 10, False
        at, size = end, SLICE
    yield text[at:], text[at - 1] if at else 10, True


def passages(texts: list[bytes], before: int = 10, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages of each text). A text without words is one passage.

    A line break stands before and after each text; a slice has another byte ``before`` it, and only the last one ``ends``.
    """
    joined = b"\n".join(texts) + (b"\n" if ends else b"")
    data = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    sizes[-1] -= not ends
    begins = np.cumsum(sizes) - sizes
    space = _SPACE[data]
    after_space = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & after_space)
    stops = np.flatnonzero(space & ~after_space)
    owner = np.searchsorted(begins, starts, side="right") - 1
    first = np.searchsorted(starts, begins)
    rank = np.arange(len(starts)) - first[owner]
    inner = starts[(rank % PASSAGE == 0) & (rank > 0)]
    cut = np.sort(np.concatenate([begins, inner]))
    counts = np.diff(np.searchsorted(cut, np.append(begins, len(data))))
    n = len(cut)
    lengths = np.diff(np.append(cut, len(data)))
    kinds = np.bincount(np.repeat(np.arange(n) * CLASSES, lengths) + _ASCII[data], minlength=n * CLASSES).reshape(n, CLASSES)
    rough = _COARSE[data]
    left = np.concatenate([_COARSE[[before]], rough[:-1]])
    at_pair = np.repeat(np.arange(n) * (ROUGH * ROUGH), lengths)
    pairs = np.bincount(at_pair + (left * ROUGH + rough), minlength=n * ROUGH * ROUGH).reshape(n, -1)
    in_passage = np.searchsorted(cut, starts, side="right") - 1
    words = np.bincount(in_passage, minlength=n)
    hashes = _word_hashes(data, starts, stops)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (in_passage[1:] == in_passage[:-1]))
    inside = np.flatnonzero(in_passage[1:] == in_passage[:-1])
    double = hashes[inside] * np.uint64(3) + hashes[inside + 1]
    per_word = np.maximum(words, 1)
    more = np.stack(
        [
            np.bincount(in_passage[same], minlength=n) / per_word,
            _repeats(in_passage, hashes, n) / per_word,
            _repeats(in_passage[inside], double, n) / per_word,
            np.log1p(words),
            lengths / per_word / 8,
        ],
        axis=1,
    )
    size = lengths[:, None]
    return np.concatenate([np.sqrt(kinds / size), np.sqrt(pairs / size), more], axis=1).astype(np.float32), counts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    attend: np.ndarray
    gate: np.ndarray
    weigh: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """``x``: standardized passages of all bags in order, ``counts``: how many of each."""
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        bag = np.repeat(np.arange(len(counts)), counts)
        hidden = np.tanh(x @ self.encode + self.encode_bias)
        tanh, gate = np.tanh(hidden @ self.attend), 1 / (1 + np.exp(-hidden @ self.gate))
        energy = (tanh * gate) @ self.weigh
        energy = np.exp(energy - np.maximum.reduceat(energy, at)[bag])
        weight = energy / np.add.reduceat(energy, at)[bag]
        bags = np.add.reduceat(weight[:, None] * hidden, at, axis=0)
        score = 1 / (1 + np.exp(-np.clip(bags @ self.out + self.out_bias, -30, 30)))
        return {"at": at, "bag": bag, "hidden": hidden, "tanh": tanh, "gate": gate, "weight": weight, "bags": bags, "score": score}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, counts)["score"]

    def score_long(self, text: bytes) -> float:
        """The score of one text, slice by slice: the sums of the attention are rescaled as a larger energy comes."""
        top, total, bag = -np.inf, 0.0, np.zeros(len(self.out))
        for piece, before, last in slices(text):
            x = (passages([piece], before, last)[0] - self.mean) / self.scale
            hidden = np.tanh(x @ self.encode + self.encode_bias)
            energy = (np.tanh(hidden @ self.attend) / (1 + np.exp(-hidden @ self.gate))) @ self.weigh
            now = max(top, energy.max())
            kept, weight = np.exp(top - now), np.exp(energy - now)
            top, total, bag = now, total * kept + weight.sum(), bag * kept + weight @ hidden
        return float(1 / (1 + np.exp(-np.clip(bag / total @ self.out + self.out_bias[0], -30, 30))))

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        f = self.forward(x, counts)
        error = (f["score"] - y) * w / len(y)
        back = (error[:, None] * self.out)[f["bag"]]
        inner = (f["hidden"] * back).sum(axis=1)
        energy = f["weight"] * (inner - np.add.reduceat(f["weight"] * inner, f["at"])[f["bag"]])
        both = energy[:, None] * self.weigh
        tanh = both * f["gate"] * (1 - f["tanh"] ** 2)
        gate = both * f["tanh"] * f["gate"] * (1 - f["gate"])
        hidden = f["weight"][:, None] * back + tanh @ self.attend.T + gate @ self.gate.T
        before = hidden * (1 - f["hidden"] ** 2)
        return [
            x.T @ before,
            before.sum(axis=0),
            f["hidden"].T @ tanh,
            f["hidden"].T @ gate,
            (f["tanh"] * f["gate"]).T @ energy,
            f["bags"].T @ error,
            np.array([error.sum()]),
        ]


def train(rows: list[tuple[str, int, float]], seed: int = 7) -> Model | None:
    """From (text, label, weight) rows; None unless both labels are there."""
    if len({y for _, y, _ in rows}) < 2:
        return None
    bags = []
    for text, _, _ in rows:
        bags.append(np.concatenate([passages([piece], before, last)[0] for piece, before, last in slices(text.encode("utf-8", "replace"))]))
    y = np.array([y for _, y, _ in rows], dtype=np.float64)
    w = np.array([w for _, _, w in rows])
    w /= w.mean()
    n = sum(len(x) for x in bags)
    mean = sum(x.sum(axis=0, dtype=np.float64) for x in bags) / n
    scale = np.sqrt(sum(((x - mean) ** 2).sum(axis=0) for x in bags) / n) + 0.01
    bags = [((x - mean) / scale).astype(np.float32) for x in bags]
    random = np.random.default_rng(seed)

    def weights(*shape: int) -> np.ndarray:
        return random.normal(0, shape[0] ** -0.5, shape)

    model = Model(
        mean, scale, weights(FEATURES, HIDDEN), np.zeros(HIDDEN), weights(HIDDEN, ATTENTION), weights(HIDDEN, ATTENTION),
        weights(ATTENTION), weights(HIDDEN), np.zeros(1),
    )
    names = ["encode", "encode_bias", "attend", "gate", "weigh", "out", "out_bias"]
    first, second, step = ([np.zeros_like(getattr(model, n)) for n in names] for _ in range(2)), None, 0
    first, second = list(first)
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            counts = np.array([len(bags[i]) for i in some])
            step += 1
            for i, g in enumerate(model.gradients(np.concatenate([bags[j] for j in some]), counts, y[some], w[some])):
                value = getattr(model, names[i])
                g = g + DECAY * value
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                value -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > GROUP:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _scores(batch: pa.RecordBatch, column: int, model: Model | None) -> np.ndarray:
    found = [np.full(0, 0.5)]
    for at in range(0, batch.num_rows, 256):
        texts = [t.as_py() or b"" for t in batch.column(column).slice(at, 256).cast(pa.binary())]
        for group in _groups(texts):
            if model is None:
                found.append(np.full(len(group), 0.5))
            elif len(group[0]) > SLICE:
                found.append(np.array([model.score_long(group[0])]))
            else:
                found.append(model.score(*passages(group)))
    return np.concatenate(found)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row, from its whole text alone. Without a model all score 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(_scores(batch, 1, model), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "score"])

    kind = docs.select(id_col).schema[0].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns and without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, at, model) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    return train(sample(docs, labels, label, FOLDS, FOLD, MOST, id_col, text_col))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Learns from at most ``MOST`` documents of each label, never from held-out
    ones. Null and empty texts are scored as one passage without words; rows that
    repeat an id are scored each by its own text; null ids are passed on. Unless
    both labels are known, all score 0.5.
    """
    return score(docs, learn(docs, labels, label, id_col, text_col), id_col, text_col).select(
        "doc_id",
        held_out("doc_id", FOLDS, FOLD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
