"""Quality classifier: random Fourier features over document statistics, ridge, isotonic scores.

The statistics of all texts are measured once.  Labelled rows are mapped to random Fourier
features (an approximation of a Gaussian kernel); every task sums its share of the normal
equations and only these sums meet.  Two halves of the training rows are summed apart, so that
each half gets raw scores from the other's model; isotonic regression on them turns raw scores
of the model of all training rows into probabilities.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylamp.llm.common import slices, stored

STATISTICS = [
    "log_words", "word_length", "symbols", "bars", "capitals", "exclamations", "stops", "commas",
    "digits", "lines", "variety", "top_word", "same_next", "repeat_pairs", "repeat_triples",
    "repeat_lines", "short_words", "long_words", "non_ascii", "line_words",
]

_CLASS = np.zeros((9, 256))
for _row, _characters in enumerate(
    (b"#*$%&<>", b"|", bytes(range(65, 91)), b"!", b".", b",;:", b"0123456789", b"\n", bytes(range(128, 256)))
):
    _CLASS[_row, list(_characters)] = 1
_LETTERS = np.zeros(256)
_LETTERS[list(range(65, 91)) + list(range(97, 123))] = 1


def _repeated(codes: np.ndarray) -> float:
    """Share of entries that are not the first of their value."""
    return 1 - len(np.unique(codes)) / len(codes) if len(codes) else 0.0


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; all zero where it has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols, bars, capitals, shouts, stops, commas, digits, lines, wide = _CLASS @ seen
    letters = max(1.0, _LETTERS @ seen)
    numbers: dict[bytes, int] = {}
    code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = code[:-1] * len(numbers) + code[1:]
    triples = pairs[:-1] * 2654435761 + code[2:]
    rows = [line for line in raw.split(b"\n") if line.strip()]
    return [
        np.log1p(n),
        np.log1p(lengths.mean()),
        np.sqrt(symbols / n),
        np.sqrt(bars / n),
        capitals / letters,
        np.sqrt(shouts / n),
        np.sqrt(stops / n),
        np.sqrt(commas / n),
        np.sqrt(digits / len(raw)),
        np.sqrt(lines / n),
        np.log(len(numbers)) / np.log1p(n),
        np.bincount(code).max() / n,
        float((code[1:] == code[:-1]).mean()) if n > 1 else 0.0,
        _repeated(pairs),
        _repeated(triples),
        1 - len(set(rows)) / len(rows),
        float((lengths <= 2).mean()),
        float((lengths > 12).mean()),
        wide / len(raw),
        np.log1p(n / len(rows)),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"]
        )


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, x): statistics of every row's whole text."""
    return documents.select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<double>")


class Features:
    """Standardised statistics mapped to `size` random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, size: int, width: float, seed: int):
        draw = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.slopes = draw.normal(size=(len(mean), size)) / (width * np.sqrt(len(mean)))
        self.shifts = draw.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        waves = np.cos(z @ self.slopes + self.shifts) * np.sqrt(2 / len(self.shifts))
        return np.hstack([waves, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(features: Features):
    """Upper triangles of the task's normal equations, one row per (half, matrix row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
            half = batch.column("half").to_numpy()
            for h in np.unique(half):
                z = features(x[half == h])
                both = np.hstack([z, y[half == h][:, None]])
                held[int(h)] = held.get(int(h), 0) + z.T @ both
        for h, sums in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h] * len(sums), pa.int32()),
                    pa.array(range(len(sums)), pa.int32()),
                    pa.array([row[k:] for k, row in enumerate(sums)], pa.list_(pa.float64())),
                ],
                ["half", "row", "sums"],
            )

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = defaultdict(lambda: 0)
    for batch in batches:
        for h, r, sums in zip(*(batch.column(c).to_pylist() for c in ("half", "row")), batch.column("sums")):
            held[h, r] = held[h, r] + sums.values.to_numpy()
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([h for h, _ in held], pa.int32()),
            pa.array([r for _, r in held], pa.int32()),
            pa.array(list(held.values()), pa.list_(pa.float64())),
        ],
        ["half", "row", "sums"],
    )


def _ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Solve the penalised normal equations by Cholesky's method.

    Element-wise steps on purpose: in a driver that runs a JVM beside it, threads of a linear
    algebra library have been seen to hang.
    """
    size = len(sums)
    left = np.triu(sums[:, :size])
    left = left + np.triu(left, 1).T + penalty * np.eye(size)
    x = sums[:, size].copy()
    for k in range(size):
        left[k:, k] /= np.sqrt(left[k, k])
        left[k + 1 :, k + 1 :] -= np.multiply.outer(left[k + 1 :, k], left[k + 1 :, k])
    for k in range(size):
        x[k] = (x[k] - (left[k, :k] * x[:k]).sum()) / left[k, k]
    for k in reversed(range(size)):
        x[k] = (x[k] - (left[k + 1 :, k] * x[k + 1 :]).sum()) / left[k, k]
    return x


def pool_violators(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic (rising) means of bins with the given weights and label sums."""
    blocks: list[list[float]] = []
    for w, t in zip(weight.tolist(), total.tolist()):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(n, t / w) for w, t, n in blocks]) if blocks else np.empty(0)


def _raw(features: Features, models: np.ndarray, by_half: bool):
    """Raw score of every row: by the model of the other half, or by the one model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = features(_matrix(batch.column("x"))) @ models.T
            if by_half:
                scores = scores[np.arange(len(scores)), 1 - batch.column("half").to_numpy()]
                keep = ["y"]
            else:
                scores, keep = scores[:, 0], ["doc_id"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(scores)], [*keep, "raw"]
            )

    return run


#: Raw scores lie around 0 to 1; calibration bins them over this stretch.
BINS, LOW, HIGH = 2048, -1.0, 2.0


def scores(
    documents: DataFrame,
    labels: DataFrame,
    size: int = 256,
    width: float = 0.7,
    penalty: float = 1.0,
    seed: int = 7,
) -> DataFrame:
    """Score every row of `documents` (doc_id, text) for quality, from 0 to 1.

    `labels` has doc_id and quality (0 or 1).  Rows whose crc32(doc_id as text) mod 5 is 0 are
    held out; the others with a label train, all of them.  Returns (doc_id, held_out, score).
    Null and blank texts have all-zero statistics and get a score like any other.  A null
    doc_id counts as empty text for the remainder and is never labelled; null labels are left
    out; a repeated label trains as often as it stands there.  Without training rows every
    score is 0.5.  Other columns are ignored; an empty table gives an empty one.
    """
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    facts = stored(measured(documents).withColumn("remainder", remainder))
    moments = facts.agg(
        *(F.avg(F.col("x")[k]) for k in range(len(STATISTICS))),
        *(F.stddev_pop(F.col("x")[k]) for k in range(len(STATISTICS))),
    ).first()
    moments = np.array([m or 0.0 for m in moments], float)
    features = Features(*np.split(moments, 2), size, width, seed)
    train = stored(
        facts.filter("remainder != 0")
        .join(labels.filter("quality is not null").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
        .select("x", "y", (F.col("remainder") % 2).cast("int").alias("half"))
    )
    rows, positive = train.agg(F.count("*"), F.sum("y")).first()
    held_out = (F.col("remainder") == 0).alias("held_out")
    if not rows or positive in (0, rows):
        constant = positive / rows if rows else 0.5
        return facts.select("doc_id", held_out, F.lit(float(constant)).alias("score"))

    summed = (
        train.repartition(max(8, rows >> 14)).mapInArrow(_sums(features), "half int, row int, sums array<double>")
        .repartition("half", "row").mapInArrow(_add_up, "half int, row int, sums array<double>")
    )
    halves = np.zeros((2, size + 1, size + 2))
    for h, r, sums in summed.collect():  # 2 * (size + 1) rows, whatever the input
        halves[h, r, r:] = sums
    models = np.stack([_ridge(part, penalty) for part in halves])
    crossed = train.select("x", "y", "half").mapInArrow(_raw(features, models, True), "y double, raw double")
    bin_ = F.least(F.greatest(F.floor((F.col("raw") - LOW) * BINS / (HIGH - LOW)), F.lit(0)), F.lit(BINS - 1))
    binned = crossed.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    found = sorted(tuple(r) for r in binned.collect())  # at most BINS rows
    centres = np.array([(b + 0.5) * (HIGH - LOW) / BINS + LOW for b, _, _ in found])
    level = pool_violators(np.array([n for _, n, _ in found], float), np.array([y for _, _, y in found], float))
    # Knots in the middle of each level keep the score rising between levels.
    edges = [np.flatnonzero(level == v) for v in np.unique(level)]
    knots = [float(centres[e].mean()) for e in edges]
    values = [float(level[e[0]]) for e in edges]
    whole = _ridge(halves.sum(axis=0), penalty)[None]

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _raw(features, whole, False)(batches):
            score = np.clip(np.interp(batch.column("raw").to_numpy(), knots, values), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = facts.select("doc_id", "x").mapInArrow(calibrated, "doc_id long, score double")
    return scored.select("doc_id", (remainder == 0).alias("held_out"), "score")


def reject(documents: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Keep the rows of `documents` that score at least `least`; all columns stay.

    Rows that share a doc_id stay if any of them does; rows without a doc_id stay.
    """
    poor = (
        scores(documents, labels).groupBy("doc_id").agg(F.max("score").alias("score"))
        .filter(F.col("score") < least)
    )
    return documents.join(poor.select("doc_id"), "doc_id", "left_anti")
