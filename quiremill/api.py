"""The library's surface: one object for the things users of a document workshop ask for, each giving a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.functions import lang, text
from quiremill.functions.udfs import word_changes
from quiremill.operators import documents, relational
from quiremill.sinks import books
from quiremill.sources import files


class Workshop:
    """Ingest, search, report, chunk, compare and publish documents on a SparkSession."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def ingest(self, root: str) -> DataFrame:
        """Items of all supported files under a folder."""
        return files.scan(self.spark, root)

    def documents(self, root: str) -> DataFrame:
        """path, text, lang: one row per file."""
        rows = F.array_sort(F.collect_list(F.struct("item_no", "text")))
        docs = self.ingest(root).filter("kind IN ('p', 'heading')").groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))
        return docs.withColumn("lang", lang.detect_default(F.col("text"), lang.STOPWORDS | lang.MORE))

    def catalogue(self, path: str) -> DataFrame:
        return files.catalogue(self.spark, path)

    def search(self, rows: DataFrame, words: str, limit: int = 200) -> DataFrame:
        return files.search_catalogue(rows, words, limit)

    def repair(self, docs: DataFrame) -> DataFrame:
        """docs with text repaired by the rules that need no lexicon, in their fixed order."""
        out = F.col("text")
        for rule in (text.norm, text.strip_refs, text.space_punctuation, text.collapse_repeats):
            out = rule(out)
        return docs.withColumn("text", out)

    def report(self, docs: DataFrame) -> DataFrame:
        """Per document: lines, words, letters, language."""
        c = F.col("text")
        return docs.select("doc_id", F.size(F.split(c, "\n", -1)).alias("n_lines"), text.count_of(c, text.WORD).alias("n_words"), text.letters(c).alias("letters"), lang.detect_default(c).alias("lang"))

    def chunk(self, docs: DataFrame, size: int = 3000) -> DataFrame:
        return docs.select("doc_id", F.posexplode(documents.pack(F.split("text", "\n", -1), size)).alias("part", "text"))

    def compare(self, old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
        """State of each document, with word changes where it changed."""
        state = relational.snapshot_compare(old, new, key, "text")
        texts = old.select(key, F.col("text").alias("_o")).join(new.select(key, F.col("text").alias("_n")), key)
        return state.join(texts, key, "left").select(key, "state", F.when(F.col("state") == "changed", word_changes("_o", "_n")).alias("changes"))

    def publish(self, parts: DataFrame, formats: tuple[str, ...] = ("txt", "epub")) -> DataFrame:
        return books.render(parts, formats)
