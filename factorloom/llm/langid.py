"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of its training texts; case, digits and marks are left out
here as in what is compressed, as they tell spelling habits and not languages. A text is compressed with every
dictionary, in windows so that the dictionary and not the text's own past decides, and the language of the smallest total
wins; a narrow margin is reported as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bound of what the classifier is fitted on: so many whole texts of each language.
TEXTS_OF_LANGUAGE = 128
#: The model has a dictionary a language; more values than this are refused.
MOST_LANGUAGES = 1_000
LEVEL = 5
WINDOW = 4_096
NARROW = 0.02

_OTHER = re.compile(r"[\W\d_]+")
PREDICTED_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", tie_col: str = "doc_id", texts: int = TEXTS_OF_LANGUAGE) -> dict[str, bytes]:
    """Dictionary content of each language, the most frequent first: the letters of `texts` whole texts, those with the least
    hashes. Rows are first cut down by hash, so that a window sorts few of each language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.lit(7), tie_col, text_col).alias("h"), F.col(text_col).alias("text")
    )
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is {lang_col} a language?")
    count = {r["lang"]: r["n"] for r in known}
    sizes = rows.sparkSession.createDataFrame(list(count.items()), "lang string, n long")
    share = F.lit(4.0 * texts + 40) / F.col("n")  # about four times the texts that the dictionary takes; a rare language keeps all
    cut = rows.join(F.broadcast(sizes), "lang").where((F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20))) < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    found: dict[str, list[str]] = {}
    for r in cut.withColumn("k", rank).where(F.col("k") <= texts).orderBy("lang", F.desc("k")).collect():  # languages * texts rows
        found.setdefault(r["lang"], []).append(r["text"])
    order = sorted(found, key=lambda k: (-count[k], k))
    return {k: " ".join(map(letters_of, found[k])).encode("utf-8", "surrogatepass") for k in order}


def letters_of(text: str) -> str:
    """A text in lower case with one space for each run of anything but letters."""
    return _OTHER.sub(" ", text.lower())


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.langs = list(dictionaries)
        self.compress = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        raw = letters_of(text).encode("utf-8", "surrogatepass")
        windows = [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]
        return [sum([len(f(w)) for w in windows]) for f in self.compress]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): margin is how much smaller the best is than the next, as a share of the next; score
        is 1/2 at a margin of 0 and nears 1. Without a letter, a text or a language: ('und', 0, 0)."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        ranked = sorted(zip(self.sizes(text), range(len(self.langs)), self.langs))
        if len(ranked) == 1:
            return ranked[0][2], 1.0, 1.0
        margin = (ranked[1][0] - ranked[0][0]) / max(1, ranked[1][0])
        return ranked[0][2], min(1.0, 1 - 0.5 * 0.5 ** (margin / NARROW)), margin


def _predict(dictionaries: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = [model.predict(t) for t in part.column(2).to_pylist()]
                lang, score, margin = (list(c) for c in zip(*found))
                yield common.batch(PREDICTED_SCHEMA, part.column(0), part.column(1), lang, score, margin, [m < NARROW for m in margin])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, margin, rejected. Null, empty and letterless texts are
    `und` with score 0 (and rejected); ties go to the language with more training texts, then by name; repeated rows stay repeated."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(dictionaries), PREDICTED_SCHEMA)


def op9_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(common.crc32_of_id("doc_id"), F.lit(3)) == 1
    return identify(docs, fit(docs.where(~held_out)), held_out)
