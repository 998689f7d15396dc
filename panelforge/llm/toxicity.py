"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on windows of ordinary texts, one on
the byte runs of toxic texts that ordinary texts hardly have (5-byte sequences far more frequent
there). The dictionary of toxic text is that part before the ordinary one: two that share no ordinary
content differ by more bytes on ordinary windows than a toxic word saves. Each window of a text is
compressed with either; the bytes that the toxic one saves are the window's excess. A threshold on it
is calibrated on ordinary windows of held-back training texts, and a logistic curve over what passes
it turns a text's windows into a score. Training reads a bounded sample on the driver; scoring is one
pass over all texts in Spark tasks.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import text_of

GRAM = 5
WINDOW = 96  # bytes from one window's start to the next
OVERLAP = 12  # bytes that a window shares with the next
LEVEL = 12
#: zstandard's trainer needs a few samples; below this many the samples themselves are the dictionary.
LEAST_SAMPLES = 20


def windows_of(text: str) -> list[bytes]:
    """The whole text in lower case, as windows of its UTF-8; none for an empty text."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass") if text else b""
    return [raw[i : i + WINDOW + OVERLAP] for i in range(0, len(raw), WINDOW)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int = 1
    weights: list[float] = field(default_factory=lambda: [-5.0, 0.0, 0.0, 0.0])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    @cached_property
    def _pair(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=17
        )

        def using(content: bytes) -> zstandard.ZstdCompressor:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(dict_data=data, compression_params=params)

        return using(self.ordinary), using(self.toxic + self.ordinary)

    def excess(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves, for each window."""
        plain, both = (c.compress for c in self._pair)
        return np.array([len(plain(w)) - len(both(w)) for w in windows_of(text)], np.int32)

    def features(self, excess: np.ndarray) -> list[float]:
        passed = excess[excess >= self.threshold]
        if not len(passed):
            return [1.0, 0.0, 0.0, 0.0]
        return [1.0, float(passed.sum()) / len(excess), math.log1p(len(passed)), float(passed.max())]

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(self.excess(text)), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _marks(toxic: list[str], ordinary: list[str], least_g: float, least_ratio: float) -> set[bytes]:
    """Byte runs of length GRAM whose share of toxic texts is far above their share of ordinary ones."""
    def counts(texts: list[str]) -> Counter:
        found: Counter = Counter()
        for text in texts:
            raw = b" " + text.lower().encode("utf-8", "surrogatepass")
            found.update({raw[i : i + GRAM] for i in range(len(raw) - GRAM + 1)})
        return found

    a, b, n, m = counts(toxic), counts(ordinary), len(toxic), len(ordinary)
    out = set()
    for gram, x in a.items():
        if x < 3 or b" " in gram[1:]:
            continue
        y = b[gram]
        g = 2 * (x * math.log(x / ((x + y) * n / (n + m))) + (y * math.log(y / ((x + y) * m / (n + m))) if y else 0))
        if g >= least_g and x / n >= least_ratio * (y + 0.5) / m:
            out.add(gram)
    return out


def _runs(text: str, marks: set[bytes]) -> set[bytes]:
    """The stretches of a text that marks cover."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass")
    out, i, last = set(), 0, len(raw) - GRAM
    while i <= last:
        if raw[i : i + GRAM] in marks:
            j = i
            while j <= last and raw[j : j + GRAM] in marks:
                j += 1
            out.add(raw[i : j + GRAM - 1])
            i = j + GRAM - 1
        else:
            i += 1
    return out


def _dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    if len(samples) >= LEAST_SAMPLES:
        try:
            return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
        except zstandard.ZstdError:
            pass  # too little, or too uniform, for the trainer
    return b"".join(samples)[-size:]


def train(
    toxic: list[str],
    ordinary: list[str],
    *,
    ordinary_size: int = 32_768,
    toxic_size: int = 1_024,
    spread: int = 2_000,
    false_windows: float = 0.002,
    least_g: float = 20.0,
    least_ratio: float = 15.0,
    seed: int = 7,
) -> Model:
    """A model of labelled texts: dictionaries from one half of them, threshold and curve from the other.

    Of an ordinary text of more than `spread` characters, each n-th window trains the dictionary,
    where n is its length by `spread`: so long texts don't outweigh all others.
    Without texts of one of the labels, or without marks, every score is the share of toxic texts
    (0 if there are none at all).
    """
    toxic, ordinary = list(toxic), list(ordinary)
    rng = random.Random(seed)
    rng.shuffle(toxic)
    rng.shuffle(ordinary)
    share = (len(toxic) + 0.01) / (len(toxic) + len(ordinary) + 1)
    flat = Model(b" ", b" ", 1 << 20, [math.log(share / (1 - share)), 0.0, 0.0, 0.0])
    a, b = len(toxic) // 2, len(ordinary) // 2
    if not a or not b:
        return flat
    def dictionaries(toxic: list[str], ordinary: list[str]) -> Model | None:
        marks = _marks(toxic, ordinary, least_g, least_ratio)
        runs = [_runs(t, marks) for t in toxic]
        known = Counter(x for own in runs for x in own)
        samples = [b"".join(sorted(own, key=lambda x: (known[x], x))) for own in ({x for x in own if known[x] >= 3} for own in runs) if own]
        base = [w for t in ordinary for w in windows_of(t)[:: max(1, len(t) // spread)]]
        return Model(_dictionary(base, ordinary_size, 64), _dictionary(samples, toxic_size, 16)) if samples else None

    model = dictionaries(toxic[:a], ordinary[:b])
    if model is None:
        return flat
    yes, no = [model.excess(t) for t in toxic[a:]], [model.excess(t) for t in ordinary[b:]]
    all_no = np.concatenate([*no, np.zeros(1, np.int32)])
    model.threshold = next((d for d in range(1, 12) if (all_no >= d).mean() <= false_windows), 12)
    x = np.array([model.features(e) for e in [*yes, *no]])
    y = np.array([1.0] * len(yes) + [0.0] * len(no))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 0.02, 0.02, 0.02])
    for _ in range(50):  # Newton's method for the ridge logistic curve
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
    model.weights = w.tolist()
    return model


def held_out(id_col: str) -> Column:
    """Whether a row is kept out of training; one without an id isn't, but it has no label either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_texts(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_label: int = 5_000, max_chars: int = 20_000
) -> tuple[list[str], list[str]]:
    """Toxic and ordinary texts that aren't held out: at most `max_per_label` of each, of `max_chars`
    characters at most, those of least hash of the id. The bounds hold at every input size, so what
    the driver gets is bounded too.
    """
    of = lambda x: (
        labels.where((F.col(label_col) == x) & ~held_out(id_col)).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(max_per_label).withColumn("_y", F.lit(x))
    )
    chosen = of(1).unionByName(of(0))
    rows = (
        docs.select(id_col, text_col).where(F.col(text_col).isNotNull() & (F.length(text_col) <= max_chars))
        .join(F.broadcast(chosen), id_col).dropDuplicates([id_col])
        .select("_y", text_col, id_col).collect()
    )
    rows.sort(key=lambda r: r[2])
    return [r[1] for r in rows if r[0] == 1], [r[1] for r in rows if r[0] == 0]


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1), predicted, n_windows, n_flagged (windows that pass the threshold).

    The score depends on the text alone. A null or empty text has no windows and gets the score of a
    text in which nothing passes. Repeated rows stay repeated, an empty table gives none, other
    columns aren't looked at. Long texts are scored whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.weights)
        for batch in batches:
            excess = [model.excess(x.as_py()) for x in batch.column("_text")]
            z = np.array([model.features(e) for e in excess]).reshape(-1, len(w)) @ w
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            flagged = [int((e >= model.threshold).sum()) for e in excess]
            arrays = [batch.column("_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array([len(e) for e in excess], pa.int64()), pa.array(flagged, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "score", "predicted", "n_windows", "n_flagged"])

    schema = f"`{id_col}` {kind}, score double, predicted int, n_windows long, n_flagged long"
    return docs.select(docs[id_col].alias("_id"), text_of(text_col).alias("_text")).mapInArrow(run, schema)
