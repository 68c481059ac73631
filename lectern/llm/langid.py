"""Language identification by compression.

Each language has a raw-content dictionary of its own words. A text is encoded
with every dictionary; the language whose dictionary gives the smallest output
wins, and a narrow win is a rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import narrow

UNKNOWN = "und"
#: Bytes of dictionary per language, and the labelled rows that fill it at most.
DICT_BYTES, SAMPLE_ROWS = 32 * 1024, 200
#: Languages up to which a task prepares all dictionaries; with more it loads each as it is used.
PREPARED = 64
#: A win by less than this share of the runner-up's size is rejected.
MIN_MARGIN = 0.01
BLOCK, LEVEL = 4096, 6
_LETTERS = re.compile(r"[^\W\d_]+")


def signature(text: str) -> bytes:
    """The distinct lower-case words of the whole text in order of appearance.

    Repetition, digits and marks say nothing about the language, and a text
    that repeats itself would fit any dictionary equally well.
    """
    words = _LETTERS.findall(" ".join(dict.fromkeys(text.split())).lower())
    return " ".join(dict.fromkeys(words)).encode("utf-8", "replace")


def _signatures(size: int):
    """Rows (lang, h, text) to (lang, h, words): of the distinct words of a whole text what a dictionary can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [signature(text.as_py())[:size] for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], ["lang", "h", "words"])

    return run


def _filled(size: int):
    """The dictionary of one language from its sampled rows."""

    def run(rows: pa.Table) -> pa.Table:
        words = b""
        for row in sorted(zip(rows.column("h").to_pylist(), rows.column("words").to_pylist(), strict=True)):
            words += row[1] + b" "
            if len(words) >= size:
                break
        return pa.table({"lang": rows.column("lang").slice(0, 1), "n": rows.column("n").slice(0, 1), "words": pa.array([words[:size]], pa.binary())})

    return run


def fit(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    dict_bytes: int = DICT_BYTES,
    sample_rows: int = SAMPLE_ROWS,
) -> list[tuple[str, int, bytes]]:
    """(language, labelled rows, dictionary) for each non-null label of ``df``.

    A dictionary is filled with the distinct words of whole texts: of the
    ``sample_rows`` rows of the language with the smallest hash. They are read
    in tasks, a group per language of at most ``sample_rows * dict_bytes``; the
    driver gets the dictionaries, however many labels there are. Rows without
    text or label teach nothing; without any, the model is empty.
    """
    labelled = narrow(df, key=id_col, text=text_col, lang=lang_col).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = materialise(labelled.groupBy("lang").agg(F.count("*").alias("n")), "labels")
    # twice the wanted share, so that enough rows pass; what is too much is cut after sorting
    share = F.lit(2.0 * sample_rows) / F.col("n") * (1 << 30)
    hashed = labelled.withColumn("h", F.xxhash64("key", "text")).join(counts, "lang")
    picked = hashed.where(F.pmod("h", F.lit(1 << 30)) < share).select("lang", "h", "text")
    kind = dict(counts.dtypes)["lang"]
    words = picked.mapInArrow(_signatures(dict_bytes), f"lang {kind}, h long, words binary")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "words"))
    sample = words.withColumn("place", first).where(F.col("place") <= sample_rows).join(counts, "lang").select("lang", "n", "h", "words")
    made = sample.groupBy("lang").applyInArrow(_filled(dict_bytes), f"lang {kind}, n long, words binary").collect()
    model = {r.lang: (r.lang, r.n, bytes(r.words)) for r in made}
    # a label whose rows all missed the sample is known by its number of rows alone
    model |= {r.lang: (r.lang, r.n, b"") for r in counts.collect() if r.lang not in model}
    return [model[lang] for lang in sorted(model)]


def classifier(model: list[tuple[str, int, bytes]], min_margin: float = MIN_MARGIN):
    """A function from a text (or None) to (language, score, margin, accepted)."""
    coders = []
    for lang, n, words in model:
        extra = {}
        if len(words) >= 8:  # the coder takes no shorter dictionary
            known = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            if len(model) <= PREPARED:
                known.precompute_compress(level=LEVEL)
            extra = {"dict_data": known}
        coder = zstandard.ZstdCompressor(
            level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **extra
        )
        coders.append((lang, n, coder))

    def classify(text: str | None) -> tuple[str, float, float, bool]:
        seen = signature(text) if text else b""
        if not coders or not any(map(str.isalpha, seen.decode())):
            return UNKNOWN, 0.0, 0.0, False
        sizes = sorted(
            (sum(len(coder.compress(seen[at : at + BLOCK])) for at in range(0, len(seen), BLOCK)), -n, lang)
            for lang, n, coder in coders
        )
        best, second = sizes[0], sizes[1] if len(sizes) > 1 else (2 * sizes[0][0],)
        margin = 1 - best[0] / second[0]
        score = 1 - 0.5 ** (1 + min(second[0] - best[0], 50))
        return best[2], score, margin, margin >= min_margin

    return classify


def language(text: Column, model: list[tuple[str, int, bytes]], min_margin: float = MIN_MARGIN) -> Column:
    """struct(lang_pred, score, margin, accepted) of a text column.

    ``score`` is 1/2 for a tie and halves its distance to 1 with each byte of
    the difference; ties go to the language with more labelled rows, then to
    the smaller name. Null texts and texts without a letter are ``und`` with
    score 0 and are not accepted. Long texts are encoded in blocks, all of them.
    """

    @F.pandas_udf("lang_pred string, score double, margin double, accepted boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = classifier(model, min_margin)
        for batch in batches:
            found = [classify(t) for t in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "margin", "accepted"]).astype(
                {"lang_pred": object, "score": float, "margin": float, "accepted": bool}
            )

    return run(text)


def identify(
    df: DataFrame, model: list[tuple[str, int, bytes]], id_col: str = "doc_id", text_col: str = "text",
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """One row per row of ``df``: id, lang_pred, score, margin, accepted; repeated rows repeat."""
    found = narrow(df, id=id_col, text=text_col).select("id", language(F.col("text"), model, min_margin).alias("found"))
    return found.select(F.col("id").alias(id_col), "found.*")
