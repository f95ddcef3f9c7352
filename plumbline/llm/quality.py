"""Quality of texts by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import pieces_of, remainder_of, words_of, written

STATISTICS = (
    "length word_length distinct_words top_word echoed_words repeated_pairs upper digits marks symbols packed repeated_lines line_length sentence_length"
).split()


def statistics_of(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``STATISTICS``; all zero for an empty one."""
    import zlib

    text = text or ""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    echoed = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    raw = text.encode()
    chars = len(text)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=5)
    lines = [x for x in text.split("\n") if x]
    return [
        float(np.log1p(n)),
        float(np.log(chars / n)),
        float(np.log(len(counts) / n)),
        float(np.log(max(counts.values()) / n)),
        float(np.sqrt(echoed / n)),
        float(np.log((pairs + 1) / n)),
        float(np.sqrt(kinds[0] / chars)),
        float(np.sqrt(kinds[1] / chars)),
        float(np.sqrt(kinds[2] / chars)),
        float(np.sqrt(kinds[3] / chars)),
        float(np.log(len(zlib.compress(raw, 1)) / len(raw))),
        float(np.sqrt(1 - len(set(lines)) / len(lines))) if lines else 0.0,
        float(np.log1p(n / max(1, len(lines)))),
        float(np.log1p(n / (1 + text.count(".")))),
    ]


#: Bytes by kind: capital, digit, sentence mark, other symbol, rest.
_KIND = np.array(
    [
        0 if 65 <= b <= 90 else 1 if 48 <= b <= 57 else 2 if b in b".,;:!?" else 3 if 33 <= b <= 126 and not chr(b).isalpha() else 4
        for b in range(256)
    ],
    np.uint8,
)


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, statistics) from whole texts; a row whose text is null or has no word has zeros."""
    shape = T.StructType([docs.schema[id_col], T.StructField("statistics", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        for piece in pieces_of(batches, text_col, 32_000_000):
            found = pa.array([statistics_of(t) for t in piece.column(text_col).to_pylist()], pa.list_(pa.float64()))
            yield from pa.table({id_col: piece.column(id_col), "statistics": found}).to_batches()

    return docs.select(id_col, text_col).mapInArrow(run, shape)


@dataclass(frozen=True)
class Discriminant:
    """Scale of the statistics and, for the labels 0 and 1, mean, Cholesky factor, log determinant and log share.

    ``anchor`` holds the mean statistics of label 1: those of a short text are drawn to it, as a few words tell little.
    """

    anchor: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    log_dets: tuple[float, ...]
    log_shares: tuple[float, ...]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 from the difference of the two log densities."""
        if len(self.means) < 2:
            return np.full(len(rows), 0.5 if not self.log_shares else float(np.exp(self.log_shares[0])))
        x, density = (settled(rows, self.anchor) - self.centre) / self.scale, []
        for mean, factor, log_det, share in zip(self.means, self.factors, self.log_dets, self.log_shares, strict=True):
            y = np.linalg.solve(factor, (x - mean).T)
            density.append(share - 0.5 * (log_det + (y * y).sum(axis=0)))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


#: Words at which a text's own statistics weigh as much as the anchor.
SHORT = 12.0


def settled(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The statistics without the length, drawn to the anchor by the share SHORT / (words + SHORT)."""
    words = np.expm1(rows[:, :1])
    return anchor + (rows[:, 1:] - anchor) * (words / (words + SHORT))


def fit_discriminant(labelled: DataFrame, pooling: float = 0.2, ridge: float = 0.02) -> Discriminant:
    """Fit from rows (statistics, label) through sums alone: the driver receives two rows of numbers, however many rows.

    Each class covariance is drawn towards the pooled one by ``pooling`` and towards a sphere by ``ridge``.
    """
    d = len(STATISTICS) - 1
    own = [F.col("statistics")[i + 1] for i in range(d)]
    first = labelled.where("label = 1").agg(*[F.avg(v) for v in own]).first()
    anchor = np.array([v or 0.0 for v in first], float)
    words = F.expm1(F.col("statistics")[0])
    share = words / (words + SHORT)
    x = [F.lit(float(m)) + (v - float(m)) * share for v, m in zip(own, anchor, strict=True)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    drawn = labelled.select("label", *[v.alias(f"x{i}") for i, v in enumerate(x)])
    sums = drawn.groupBy("label").agg(
        F.count("*").alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(d)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs],
    )
    found = {row["label"]: row for row in sums.collect() if row["label"] in (0, 1)}
    if len(found) < 2:
        one = [float(np.log(1.0 - 1e-6 if label else 1e-6)) for label in found]
        return Discriminant(anchor, np.zeros(d), np.ones(d), (), (), (), tuple(one))
    n = {c: float(r["n"]) for c, r in found.items()}
    mean = {c: np.array([r[f"s{i}"] for i in range(d)]) / n[c] for c, r in found.items()}
    cov = {}
    for c, r in found.items():
        m = np.zeros((d, d))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"p{i}_{j}"] / n[c]
        cov[c] = m - np.outer(mean[c], mean[c])
    total = n[0] + n[1]
    centre = (n[0] * mean[0] + n[1] * mean[1]) / total
    within = (n[0] * cov[0] + n[1] * cov[1]) / total
    scale = np.sqrt(np.maximum(np.diag(within), 1e-9))
    pooled = within / np.outer(scale, scale)
    means, factors, dets, shares = [], [], [], []
    for c in (0, 1):
        shrunk = (1 - pooling) * cov[c] / np.outer(scale, scale) + pooling * pooled
        shrunk = (1 - ridge) * shrunk + ridge * max(np.trace(shrunk) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        means.append((mean[c] - centre) / scale)
        factors.append(factor)
        dets.append(float(2 * np.log(np.diag(factor)).sum()))
        shares.append(float(np.log(n[c] / total)))
    return Discriminant(anchor, centre, scale, tuple(means), tuple(factors), tuple(dets), tuple(shares))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    held_fold: int = 0,
    threshold: float = 0.3,
) -> DataFrame:
    """Rows (id, held_out, score, predicted), one for each row of ``docs``.

    Learns from documents whose crc32 of the id is not ``held_fold`` modulo ``folds`` and that have a label 0 or 1; all
    such rows count, through sums. Only the text makes the score. A document labelled several times has the rounded mean
    label (a tie is 1); null labels are left out. Null, empty and blank texts have zero statistics and get the score
    of those. Without labels of both kinds every score is the same: 0.5, or near the only label. Repeated rows and null
    ids keep their own rows; an empty table gives no rows.
    """
    found = written(document_statistics(docs, id_col, text_col), "statistics")
    fold = remainder_of(F.col(id_col), folds) == held_fold
    known = (
        labels.select(F.col(id_col), F.col(label_col).cast("double").alias("label"))
        .where(F.col("label").isNotNull())
        .groupBy(id_col)
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    model = fit_discriminant(found.where(~fold).join(known, id_col).select("statistics", "label"))
    shape = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows))], names=[id_col, "score"])

    scored = found.select(id_col, "statistics").mapInArrow(run, shape)
    return scored.select(id_col, fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """The rows and columns of ``docs`` whose text is predicted to be good, by a model fitted as in ``score_quality``."""
    found = written(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.where(F.col("quality").isNotNull()).groupBy(id_col)
    known = known.agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("label"))
    fold = remainder_of(F.col(id_col), 5) != 0
    model = fit_discriminant(found.where(fold).join(known, id_col).select("statistics", "label"))

    def run(batches):
        import pyarrow as pa

        for piece in pieces_of(batches, text_col, 32_000_000):
            rows = np.array([statistics_of(t) for t in piece.column(text_col).to_pylist()]).reshape(-1, len(STATISTICS))
            yield from piece.filter(pa.array(model.scores(rows) >= threshold)).to_batches()

    return docs.mapInArrow(run, docs.schema)
