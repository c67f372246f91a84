"""Sequence packing of an ordered token stream and the label relations over packed rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import col
from .prefix import with_running_total

LENGTH, EOS, PAD = 4096, 2, 3
SECOND_SHARE = 0.2  # fixed value: weight of the second label


def with_eos(tokens: str | Column, eos: int = EOS) -> Column:
    """Append the end token unless the array already ends with it; an empty array becomes the end token."""
    c = col(tokens)
    ended = F.try_element_at(c, F.lit(-1)) == eos
    return F.when(F.coalesce(ended, F.lit(False)), c).otherwise(F.concat(c, F.array(F.lit(eos))))


@F.pandas_udf(ArrayType(IntegerType()))
def _bytes_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else np.frombuffer(t.encode(), dtype=np.uint8).astype(np.int32) + 4 for t in texts], index=texts.index, dtype=object)


def byte_tokens(text: str | Column) -> Column:
    """One token per UTF-8 byte, shifted by 4 so the special ids stay free; NULL stays NULL."""
    return _bytes_udf(col(text))


def places(df: DataFrame, order_by: str, n_tokens: Column, length: int = LENGTH) -> DataFrame:
    """``df`` with ``off`` and ``doc_counter``, a row for every sequence ``seq_idx`` that a document of ``n_tokens`` tokens touches."""
    rows = df.withColumn("n", n_tokens)
    placed = with_running_total(rows, order_by, {"off": F.col("n"), "doc_counter": F.lit(1)}).withColumn("doc_counter", F.col("doc_counter") + 1)
    return placed.withColumn("seq_idx", F.explode(F.sequence(F.floor(F.col("off") / length), F.floor((F.col("off") + F.col("n") - 1) / length))))


def sequences(df: DataFrame, order_by: str, n_tokens: Column, length: int = LENGTH) -> DataFrame:
    """(seq_idx) of all sequences; needs the lengths of the documents only."""
    return places(df.select(order_by, n_tokens.alias("_len")), order_by, F.col("_len"), length).select("seq_idx").distinct()


def fragments(df: DataFrame, order_by: str, tokens: str = "tokens", length: int = LENGTH, eos: int = EOS,
              skip_empty: bool = False) -> DataFrame:
    """Cut the stream of documents into pieces that lie in one sequence each.

    NULL arrays are left out; empty ones give a lone end token unless ``skip_empty``.
    """
    rows = df.where(F.col(tokens).isNotNull())
    if skip_empty:
        rows = rows.where(F.size(tokens) > 0)
    rows = rows.select(F.col(order_by).alias("ord"), with_eos(tokens, eos).alias("tok"))
    cut_at = places(rows, "ord", F.size("tok"), length)
    start = F.greatest(F.col("off"), F.col("seq_idx") * length)
    end = F.least(F.col("off") + F.col("n"), (F.col("seq_idx") + 1) * length)
    return cut_at.select(
        "seq_idx", "doc_counter", "ord",
        (start - F.col("seq_idx") * length).cast("int").alias("slot"),
        (start - F.col("off")).cast("int").alias("first_pos"),
        (end - start).cast("int").alias("n_tokens"),
        F.slice("tok", (start - F.col("off") + 1).cast("int"), (end - start).cast("int")).alias("piece"),
    )


def pack(df: DataFrame, order_by: str, tokens: str = "tokens", length: int = LENGTH, eos: int = EOS, pad: int = PAD,
         skip_empty: bool = False) -> DataFrame:
    """Rows of exactly ``length`` tokens with document numbers from 1 and positions that go on across a cut."""
    parts = fragments(df, order_by, tokens, length, eos, skip_empty)
    # a sequence holds at most ``length`` tokens, so this list is bounded; numbers and positions are made after the shuffle
    rows = parts.groupBy("seq_idx").agg(F.array_sort(F.collect_list(F.struct("slot", "piece", "doc_counter", "first_pos", "n_tokens"))).alias("p"))

    def joined(made, filler: int, kind: str = "int") -> Column:
        flat = F.flatten(F.transform("p", made))
        return F.concat(flat, F.array_repeat(F.lit(filler).cast(kind), length - F.size(flat)))

    return rows.select(
        "seq_idx", joined(lambda x: x["piece"], pad).alias("input_ids"),
        joined(lambda x: F.array_repeat(x["doc_counter"], x["n_tokens"]), 0, "bigint").alias("doc_ids"),
        joined(lambda x: F.sequence(x["first_pos"], x["first_pos"] + x["n_tokens"] - 1), 0).alias("position_ids"),
    )


def shift(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def label_mask(doc_ids: str | Column, by: int = 1, exclude_pad: bool = False) -> Column:
    """1 where the token ``by`` places on belongs to the same document, over size - ``by`` places."""
    d = col(doc_ids)
    now, later = F.slice(d, 1, F.greatest(F.size(d) - by, F.lit(0))), shift(d, by)
    return F.zip_with(now, later, lambda a, b: F.when((a == b) & (a != 0 if exclude_pad else F.lit(True)), 1).otherwise(0))


def valid_count(mask: Column) -> Column:
    return F.greatest(F.aggregate(mask, F.lit(0), lambda s, x: s + x), F.lit(1)).cast("bigint")


def joint_loss(next_loss: Column, second_loss: Column, second_share: float = SECOND_SHARE) -> Column:
    """Loss of the next token plus the share of the loss of the token after it."""
    return next_loss + second_share * second_loss


def masked_mean(losses: Column, mask: Column) -> Column:
    weighted = F.aggregate(F.zip_with(losses, mask, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return weighted / valid_count(mask)
