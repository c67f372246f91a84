"""Document adapters: template scans, dialogue folding and a resumable Python data source."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..operators.hashing import content_hash, document_id

#: kind -> (templates, format of the whole text with the template and the position)
TEMPLATES: dict[str, tuple[list[str], str]] = {
    "web": (["Rivers carry sediment towards the sea.", "A bridge spreads its load over several piers.", "Tides follow the moon.",
             "Glass is made from sand.", "Bees find flowers by colour.", "Salt lowers the freezing point of water.",
             "Maps flatten a round world.", "Steel is iron with a little carbon."], "%s [Record #%d]"),
    "educational": (["Why is the sky blue?", "How do plants drink?", "What is a prime number?", "Where do echoes come from?",
                     "Who named the planets?", "When does water boil?"], "%s (Section %d)"),
    "code": (["def add(a, b):\n    return a + b\n", "fn id(x: u32) -> u32 {\n    x\n}\n", "func Half(n int) int {\n\treturn n / 2\n}\n",
              "SELECT 1;\n", "int twice(int x) { return 2 * x; }\n"], "// begin\n%s// end %d\n"),
    "math": (["a^2 + b^2 = c^2", "e^{i\\pi} + 1 = 0", "n! = n (n-1)!", "\\sum_{k=1}^n k = n(n+1)/2", "1 + 1 = 2"], "## Statement\n\n$$%s$$\n\nNo. %d"),
    "vietnamese": (["Sông chảy ra biển.", "Cây cần nước và ánh sáng.", "Trăng quay quanh trái đất.", "Muối tan trong nước.",
                    "Cầu bắc qua sông.", "Ong tìm hoa."], "%s [Mục %d]"),
    "dialogue": (["User: Is it raining?\n\nAssistant: Not yet.", "User: How far?\n\nAssistant: Two miles.",
                  "User: Why?\n\nAssistant: It is late.", "User: Done?\n\nAssistant: Done."], "%s\n\n[%d]"),
}


def template_scan(spark: SparkSession, kind: str, n: int, resume: int = 0, version: str = "v1") -> DataFrame:
    """``n`` records from position ``resume`` on, template by position modulo their number."""
    texts, form = TEMPLATES[kind]
    pos = F.col("pos")
    base = spark.range(resume, resume + n).select(F.col("id").alias("pos"))
    template = F.element_at(F.array(*[F.lit(t) for t in texts]), (pos % len(texts) + 1).cast("int"))
    rows = base.select(
        "pos", F.lit(f"{kind}_templates").alias("source_id"), F.lit(version).alias("source_version"),
        F.format_string("rec_%08d", pos).alias("source_record_id"), F.lit(kind).alias("category"),
        F.lit({"code": "code", "vietnamese": "vi"}.get(kind, "en")).alias("language"),
        F.format_string(form, template, pos).alias("text"), F.create_map(F.lit("index"), pos.cast("string")).alias("metadata"),
    )
    return rows.withColumn("content_hash", content_hash("text")).withColumn(
        "doc_id", document_id("source_id", "source_version", "source_record_id", "text")
    )


def with_fallback(live: Callable[[], DataFrame], fallback: DataFrame) -> DataFrame:
    """The live source, or ``fallback`` where it cannot be read or has no rows."""
    try:
        rows = live()
        if not rows.isEmpty():
            return rows
    except Exception as e:  # whatever a source raises when it cannot be reached
        logging.getLogger(__name__).warning("live source failed: %s", e)
    return fallback


def replicate(df: DataFrame, copies: int) -> DataFrame:
    """Every row ``copies`` times, with ``copy_no`` from 0; no join."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def fold_dialogue(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """One text a conversation: ``Role: content`` in turn order, joined by blank lines."""
    name = F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.substring(F.col(role), F.lit(2), F.length(role))))
    said = F.struct(F.col(turn).alias("t"), F.concat(name, F.lit(": "), F.col(text)).alias("said"))
    return turns.where(F.col(text).isNotNull()).groupBy(conversation).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"]), "\n\n").alias("text")
    )


def messages(text: str | Column) -> Column:
    """Array of (role, content) from text whose lines begin with a speaker label."""
    c = F.col(text) if isinstance(text, str) else text
    label = r"^([A-Za-z]+): "
    turns = F.split(c, r"\n(?=[A-Za-z]+: )")
    return F.transform(F.filter(turns, lambda t: t.rlike(label)), lambda t: F.struct(
        F.lower(F.regexp_extract(t, label, 1)).alias("role"), F.regexp_replace(t, label, "").alias("content")))


SCHEMA = "pos bigint, source_record_id string, text string"


class _Slice(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__(start)
        self.start, self.end = start, end


def _records(kind: str, start: int, end: int) -> Iterator[tuple]:
    texts, form = TEMPLATES[kind]
    for pos in range(start, end):
        yield pos, f"rec_{pos:08d}", form % (texts[pos % len(texts)], pos)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.kind, self.first = options.get("kind", "web"), int(options.get("resume", 0))
        self.n, self.parts = int(options.get("n", 100)), int(options.get("partitions", 4))

    def partitions(self):
        step = max(1, -(-self.n // self.parts))
        end = self.first + self.n
        return [_Slice(a, min(end, a + step)) for a in range(self.first, end, step)]

    def read(self, partition):
        yield from _records(self.kind, partition.start, partition.end)


class _StreamReader(SimpleDataSourceStreamReader):
    """The offset is the next position, so a restarted query goes on where the checkpoint ends."""

    def __init__(self, options):
        self.kind, self.first = options.get("kind", "web"), int(options.get("resume", 0))
        self.n, self.batch = int(options.get("n", 100)), int(options.get("batch", 25))

    def initialOffset(self):
        return {"pos": self.first}

    def read(self, start):
        end = min(self.first + self.n, start["pos"] + self.batch)
        return iter(list(_records(self.kind, start["pos"], end))), {"pos": max(end, start["pos"])}

    def readBetweenOffsets(self, start, end):
        return iter(list(_records(self.kind, start["pos"], end["pos"])))

    def commit(self, end):
        pass


class TemplateSource(DataSource):
    """``spark.read.format("templates")`` and ``spark.readStream.format("templates")``."""

    @classmethod
    def name(cls):
        return "templates"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TemplateSource)
