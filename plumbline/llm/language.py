"""Language of texts by the out-of-place distance between ranked n-gram profiles."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import pieces_of, remainder_of

#: A profile holds so many n-grams of one to three characters.
PROFILE = 400
_REST = re.compile(r"[\W\d_]+")


def gram_codes(text: str | None) -> np.ndarray:
    """Codes of all n-grams of the lower-cased text, words parted by one mark; empty where there is no letter."""
    clean = _REST.sub("_", (text or "").lower()).strip("_")
    if not clean:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f"_{clean}_".encode("utf-32-le"), np.int32).astype(np.int64)
    one, two = c[c != ord("_")], c[:-1] << 21 | c[1:]
    return np.concatenate([one, two, two[:-1] << 21 | c[2:]])


def top_grams(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, best first; ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:most]]


def learn_profiles(docs: DataFrame, text_col: str, lang_col: str, most: int = PROFILE) -> DataFrame:
    """Rows (lang, gram, place): the profile of each language, from all given rows with a language."""

    def run(batches):
        import pyarrow as pa

        for piece in pieces_of(batches, text_col, 16_000_000):
            langs, texts = piece.column(lang_col).to_pylist(), piece.column(text_col).to_pylist()
            for lang in dict.fromkeys(langs):
                parts = [gram_codes(t) for t, x in zip(texts, langs, strict=True) if x == lang]
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )

    counted = docs.where(F.col(lang_col).isNotNull()).select(lang_col, text_col)
    counted = counted.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counted.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < most).drop("n")


class Profiles:
    """The learned profiles as arrays: known codes in order, and for each language the place of each, or ``most``."""

    def __init__(self, rows: list, most: int) -> None:
        self.langs = sorted({r["lang"] for r in rows})
        self.codes = np.unique(np.array([r["gram"] for r in rows], np.int64))
        self.places = np.full((len(self.langs), len(self.codes)), most, np.int64)
        self.most = most
        for r in rows:
            self.places[self.langs.index(r["lang"]), np.searchsorted(self.codes, r["gram"])] = r["place"]

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language at the least distance (ties: the first by name) and 1 less the distance's share of the greatest."""
        if not self.langs or not any(map(str.isalpha, text or "")):
            return "und", 0.0
        grams = top_grams(gram_codes(text), self.most)
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        place = np.where(self.codes[at] == grams, self.places[:, at], self.most)
        apart = np.where(place < self.most, np.abs(place - np.arange(len(grams))), self.most).sum(axis=1)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.most * len(grams)))


def predict_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 3,
    held_fold: int = 1,
    most: int = PROFILE,
) -> DataFrame:
    """Rows (id, held_out, lang_pred, score), one for each row of ``docs``.

    Profiles are learned from the text and non-null language of documents whose crc32 of the id is not ``held_fold``
    modulo ``folds``. ``most`` n-grams per language go to the tasks. A null text, or one without a letter, is ``und`` with
    score 0, and so is every text where nothing could be learned. Whole texts are read. Repeated rows and null ids keep
    their own rows; an empty table gives no rows.
    """
    fold = remainder_of(F.col(id_col), folds) == held_fold
    profiles = Profiles(learn_profiles(docs.where(~fold), text_col, lang_col, most).collect(), most)
    shape = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for piece in pieces_of(batches, text_col, 32_000_000):
            found = [profiles.nearest(t) for t in piece.column(text_col).to_pylist()]
            yield from pa.table(
                {
                    id_col: piece.column(id_col),
                    "lang_pred": pa.array([x for x, _ in found], pa.string()),
                    "score": pa.array([x for _, x in found], pa.float64()),
                }
            ).to_batches()

    scored = docs.select(id_col, text_col).mapInArrow(run, shape)
    return scored.select(id_col, fold.alias("held_out"), "lang_pred", "score")
