"""Problem 5: token totals by source, category and language, kept up to date by signed deltas.

State, all in one folder that can be reopened: a count table (content hash, tokenizer hash) -> tokens that only
grows, and the slice and content of every document as last seen.  An update encodes only contents the count table lacks,
compares documents with the last state and adds signed deltas to the cube: new documents count plus,
removed ones minus, changed ones both.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ..functions.text import canonical_name
from ..session import shared_dir, stored
from .lookalikes import Resolver

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNKNOWN, ALL = "unknown", "*"

# Three-letter and other names of language tags.
LANGUAGES = {
    "eng": "en", "vie": "vi", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "ell": "el", "gre": "el",
    "ara": "ar", "hin": "hi", "zho": "zh", "chi": "zh", "jpn": "ja", "py": "code", "python": "code",
}


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_id(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def token_counter(path: str = VOCABULARY):
    """Column function text -> number of tokens under the vocabulary at ``path``; NULL gives NULL."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path)
        for texts in batches:
            seen: dict = {None: None}  # copies in a batch are encoded once
            for t in texts:
                if t not in seen:
                    seen[t] = len(e.encode_ordinary(t))
            yield pd.Series([seen[t] for t in texts], index=texts.index, dtype="Int64")

    return count


def language_key(tag: str | Column) -> Column:
    """One name a language: case, region, look-alike and invisible characters and three-letter names folded."""
    c = F.col(tag) if isinstance(tag, str) else tag
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1)
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(base == "", UNKNOWN).otherwise(F.coalesce(F.try_element_at(names, base), base, F.lit(UNKNOWN)))


@F.pandas_udf(StringType())
def _plain(values: pd.Series) -> pd.Series:
    r = Resolver()
    seen: dict = {}
    out = []
    for v in values:
        if v is not None and v not in seen:
            seen[v] = r.form(v)
        out.append(None if v is None else seen[v])
    return pd.Series(out, index=values.index)


def documents(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source_id, category, language, content): one row per key, the latest delivery, in canonical spelling.

    NULL texts have no content and count as documents without tokens; NULL and blank names become
    ``unknown``.  Ties between deliveries go to the greatest content hash.
    """
    odd = lambda c: F.when(F.col(c).rlike(r"[^\x00-\x7F]"), _plain(c)).otherwise(F.col(c))
    named = lambda c: F.when(c.isNull() | (c == ""), UNKNOWN).otherwise(c)
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key), named(canonical_name(odd("source_id"))).alias("source_id"), named(F.lower(F.trim("category"))).alias("category"),
        language_key(odd("language")).alias("language"), digest().alias("content"),
        F.coalesce(F.col("ingested_at"), F.lit("1970-01-01").cast("timestamp")).alias("at"),
    )
    latest = F.max(F.struct("at", F.coalesce("content", F.lit(b"")).alias("tie"), "source_id", "category", "language", "content")).alias("d")
    return rows.groupBy(key).agg(latest).select(key, "d.source_id", "d.category", "d.language", "d.content")


BROADCAST_ROWS = 200_000  # unseen contents up to this number (16 bytes each) are sent to the tasks, more are joined
SALTS = 16
COUNTS = "content binary, tokenizer string, n_tokens bigint"


def digest(text: str = "text") -> Column:
    return F.unhex(F.md5(text))


def counted(df: DataFrame, known: DataFrame | None, path: str = VOCABULARY, most: int = BROADCAST_ROWS) -> DataFrame:
    """(content, tokenizer, n_tokens) of contents of ``df`` that ``known`` lacks.

    Hashes are compared before any text moves.  Texts are encoded where they are read; a text is shuffled
    only if more than ``most`` contents are new next to known ones, and then with a salt.
    """
    ident = tokenizer_id(path)
    rows = df.where(F.col("text").isNotNull()).select(digest().alias("content"), "text")
    if known is not None:
        have = known.where(F.col("tokenizer") == ident).select("content")
        unseen = stored(rows.select("content").distinct().join(have, "content", "left_anti"), "unseen")
        n = unseen.count()
        if not n:
            return df.sparkSession.createDataFrame([], COUNTS)
        if n <= most:
            rows = rows.join(F.broadcast(unseen), "content", "left_semi")
        else:
            salted = unseen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("salt", (F.rand(1) * SALTS).cast("int")).join(salted, ["content", "salt"], "left_semi")
    sized = rows.select("content", token_counter(path)("text").alias("n_tokens"))
    return sized.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")).select("content", F.lit(ident).alias("tokenizer"), "n_tokens")


DIMENSIONS = ["source_id", "category", "language"]


def cube(deltas: DataFrame) -> DataFrame:
    """Sums of (n_docs, n_tokens) over every combination of dimensions; ``*`` stands for all.

    Rows are summed to slices first, so the eight-fold expansion works on slices, not on documents.
    """
    slices = deltas.groupBy(*DIMENSIONS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    summed = slices.cube(*DIMENSIONS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return summed.select(*[F.coalesce(c, F.lit(ALL)).alias(c) for c in DIMENSIONS], "n_docs", "n_tokens")


GENERATIONS = 16  # count tables read side by side before they are written as one


class State:
    """Count table, last documents and cube, in the generations of one folder.

    Every update writes a generation and marks it when it is complete, so an update that is cut short leaves
    the one before in force.  With ``folder`` a state goes on where the last one ended; without it a new
    folder in the shared one is taken.
    """

    def __init__(self, spark: SparkSession, path: str = VOCABULARY, folder: str | None = None):
        self.spark, self.path = spark, path
        self.folder = (folder or f"{shared_dir(spark)}/budget-{uuid.uuid4().hex}").rstrip("/")
        self.counts: DataFrame | None = None
        self.docs: DataFrame | None = None
        self.cube: DataFrame | None = None
        done = self._generations()
        self.generation = done[-1] if done else 0
        if done:
            self._open(done)

    def _fs(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generations(self) -> list[int]:
        """Complete generations in order, from the last one that holds all counts."""
        jvm, where, fs = self._fs()
        if not fs.exists(where):
            return []
        names = {int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()}
        done = sorted(g for g in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{g:08d}/done")))
        whole = [g for g in done if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{g:08d}/whole"))]
        return [g for g in done if not whole or g >= whole[-1]]

    def _open(self, done: list[int]) -> None:
        at = lambda g, name: f"{self.folder}/{g:08d}/{name}"
        self.counts = self.spark.read.schema(COUNTS).parquet(*[at(g, "counts") for g in done])
        self.docs, self.cube = self.spark.read.parquet(at(done[-1], "documents")), self.spark.read.parquet(at(done[-1], "cube"))

    def _write(self, df: DataFrame, generation: int, name: str) -> DataFrame:
        path = f"{self.folder}/{generation:08d}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def update(self, df: DataFrame, key: str = "doc_id") -> DataFrame:
        """Bring the state to the deliveries in ``df`` and give the cube.  Keys that ``df`` lacks are removed."""
        g = self.generation + 1
        new = counted(df, self.counts, self.path)
        whole = self.counts is None or len(self._generations()) >= GENERATIONS
        if whole and self.counts is not None:
            new = self.counts.unionByName(new)
        new = self._write(new, g, "counts")
        counts = new if whole else self.counts.unionByName(new)
        ident = tokenizer_id(self.path)
        sizes = counts.where(F.col("tokenizer") == ident).select("content", "n_tokens")
        now = self._write(self.sized(documents(df, key), sizes, key), g, "documents")
        added = cube(self.deltas(now, key))
        if self.cube is not None:
            added = self.cube.unionByName(added).groupBy(*DIMENSIONS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        self._write(added.where("n_docs <> 0 or n_tokens <> 0"), g, "cube")
        jvm, _, fs = self._fs()
        for mark in (["whole"] if whole else []) + ["done"]:
            fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{g:08d}/{mark}")).close()
        self.generation = g
        self._open(self._generations())
        return self.cube

    @staticmethod
    def sized(docs: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
        """Documents with the tokens of their content; a content that many documents share is joined with a salt."""
        salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        return docs.join(salted, ["content", "salt"], "left").select(key, *DIMENSIONS, "content", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))

    def deltas(self, now: DataFrame, key: str) -> DataFrame:
        """Signed rows: +1 for what a document is now, -1 for what it was; unchanged documents give none."""
        plus = now.select(key, *DIMENSIONS, "content", F.lit(1).cast("bigint").alias("n_docs"), "n_tokens")
        if self.docs is None:
            return plus
        minus = self.docs.select(key, *DIMENSIONS, "content", F.lit(-1).cast("bigint").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
        same = [key, *DIMENSIONS, "content"]
        return plus.unionByName(minus).groupBy(*same).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
