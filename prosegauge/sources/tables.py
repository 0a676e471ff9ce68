"""Readers and writers: text files, corpora, labelled samples, JSON lines, reports."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import JAVA_SPACE, clamp01, is_blank, more_words, trimmed

# Sample passages of our own: five in a formulaic tone, then three labelled pairs.
PASSAGES = [
    "Remote work has fundamentally changed numerous companies in recent years. Moreover, it has enabled teams to utilize new tools. Furthermore, it offers significant savings. Overall, it represents a crucial shift.",
    "Urban gardens play a pivotal role in modern cities. Additionally, they provide various benefits to residents. Furthermore, they enhance the local climate. In conclusion, they deserve comprehensive support.",
    "Careful budgeting is essential for every household. Moreover, it helps families avoid significant debt. Additionally, it builds robust habits. Overall, planning tends to pay off.",
    "Reading offers numerous benefits for people of all ages. Furthermore, it strengthens memory and focus. Additionally, it reduces stress significantly. In summary, reading is highly worthwhile.",
    "Public transport represents a key part of a sustainable future. Moreover, trains have become increasingly efficient. Furthermore, buses reduce various emissions. Overall, investing in transit yields long-term benefits.",
]
LABELLED = [(PASSAGES[0], 1.0), (PASSAGES[1], 1.0), (PASSAGES[2], 1.0)] + [
    ("i went down to the shop again, third time today, because nobody wrote milk on the list and then of course they were out.", 0.0),
    ("We argued about the fence for an hour. He wants it painted. I do not, it was fine, and the neighbours never said a word.", 0.0),
    ("grandma's bread never came out the same twice. some days flat, some days huge. she blamed the oven, then the weather.", 0.0),
]


#: Session setting: tables of fewer bytes than this are dealt out over the cores. Off where it is not set; only the bench sets it, since
#: its tables are files of one row group, each of which is otherwise one task.
SPREAD_BELOW = "spark.prosegauge.spreadBelowBytes"


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores if the session asks for it at this size; else as it was read."""
    below = int(df.sparkSession.conf.get(SPREAD_BELOW, "0"))
    if below <= 0 or int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= below:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def passages(spark: SparkSession, n: int) -> DataFrame:
    """The first n sample passages, over and over if n is larger: a range joined to the literal table."""
    table = spark.createDataFrame(list(enumerate(PASSAGES)), "k int, text string")
    return spark.range(n).withColumn("k", (F.col("id") % len(PASSAGES)).cast("int")).join(F.broadcast(table), "k").select("id", "text")


def labelled_passages(spark: SparkSession, n: int) -> DataFrame:
    table = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(LABELLED)], "k int, text string, label double")
    return spark.range(n).withColumn("k", (F.col("id") % len(LABELLED)).cast("int")).join(F.broadcast(table), "k").select("id", "text", "label")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors see. Where none is set, a session whose tasks run in this process gets one of its
    own; any other raises, since its executors could not see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return context.getCheckpointDir()


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """The paragraphs of a word-processor file, joined by line ends; tabs and breaks inside a paragraph are kept."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    paragraph = lambda p: "".join(e.text or "" if e.tag == f"{_WORD}t" else marks.get(e.tag, "") for e in p.iter())
    return "\n".join(paragraph(p) for p in root.iter(f"{_WORD}p"))


def pdf_text(data: bytes) -> str:
    """The pages of a PDF, joined by line ends; needs pypdf."""
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def file_text(path: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file by its ending: .docx, .pdf, else UTF-8."""
    ending = path.lower().rsplit(".", 1)[-1]
    try:
        return {"docx": docx_text, "pdf": pdf_text}.get(ending, lambda d: d.decode("utf-8"))(data), None
    except Exception as e:  # files of others may be broken in any way, and a reader may be missing
        return None, f"{type(e).__name__}: {e}"[:140]


def documents_in_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, text, error), one per file of any kind; a file that cannot be read has an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text, error = file_text(at, data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string, error string")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, text), one per UTF-8 file, read by the JVM alone; .docx and .pdf files are left to documents_in_files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.where(~F.lower("path").rlike(r"\.(docx|pdf)$"))


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(text)))


def paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, pos, text): pieces between blank lines, trimmed, without empty ones."""
    pieces = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n", -1), trimmed), lambda s: s != "")
    return df.select(key, F.posexplode(pieces).alias("pos", "text"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(JAVA_SPACE.replace("[", "[^", 1) + "+")), F.lit(0))


def first_long_answers(rows: DataFrame, answers: str, key: str, n: int | None = None, least: int = 30) -> DataFrame:
    """Rows (key, text): the first answer of each row with more than `least` words, in order of key; n rows at most."""
    long = F.filter(answers, lambda a: more_words(a, least))
    out = rows.where(F.size(long) > 0).select(key, trimmed(F.element_at(long, 1)).alias("text"))
    return out.orderBy(key).limit(n) if n is not None else out


def generations(rows: DataFrame, key: str, n: int | None = None, least: int = 30) -> DataFrame:
    """rows (key, generation, text, model): machine generations with more than `least` words."""
    text = F.coalesce(F.when(F.col("generation") != "", F.col("generation")), F.col("text"))
    out = rows.where((F.coalesce(F.col("model"), F.lit("human")) != "human") & more_words(text, least)).select(key, trimmed(text).alias("text"))
    return out.orderBy(key).limit(n) if n is not None else out


def machine_labelled(rows: DataFrame, key: str, n: int | None = None, least: int = 30) -> DataFrame:
    """rows (key, text, label): label 0 is machine text."""
    out = rows.where((F.coalesce(F.col("label"), F.lit(1)) == 0) & more_words(F.col("text"), least)).select(key, trimmed(F.col("text")).alias("text"))
    return out.orderBy(key).limit(n) if n is not None else out


def or_passages(df: DataFrame | None, spark: SparkSession, n: int) -> DataFrame:
    """df, or the sample passages if there is none or it is empty."""
    return passages(spark, n).select("text") if df is None or not df.head(1) else df


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows (text, label) of a CSV with columns text and score."""
    return labelled(spark.read.csv(path, header=True, schema="text string, score string", enforceSchema=False, multiLine=True, escape='"'))


def labelled(rows: DataFrame) -> DataFrame:
    """Scores that are numbers, bound to 0..1, of texts of at least five words."""
    text = trimmed(F.coalesce(F.col("text"), F.lit("")))
    return rows.select(text.alias("text"), clamp01(F.col("score").try_cast("double")).alias("label")).where("label is not null").where(more_words(F.col("text"), 4))


def balanced(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Equal numbers of both classes (cut at 0.5): the first of each by key, in a seeded order. Counts, not rows, reach the driver,
    and each task hands on no more rows of a class than the sample takes."""
    high = F.coalesce(F.col("label") >= 0.5, F.lit(False))
    got = {r.high: r["count"] for r in rows.groupBy(high.alias("high")).count().collect()}
    k = min(got.get(True, 0), got.get(False, 0), max(1, n // 2))
    first = rows.where(high).orderBy(key).limit(k).unionByName(rows.where(~high).orderBy(key).limit(k))
    return first.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def stream_sample(rows: DataFrame, key: str, n: int, seed: int = 0, reach: float = 1.3) -> DataFrame:
    """The balanced sample of a long labelled table of which only the first 1.3 n rows by key are looked at."""
    return balanced(rows.orderBy(key).limit(int(reach * n)), key, n, seed)


def to_json(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Rows (value): each row as one line of JSON. With ascii_only other characters are escapes of four hexadecimal digits, two of
    them beyond the basic plane."""
    value = F.to_json(F.struct(*df.columns))
    if ascii_only:
        code = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))

        def escaped(c: Column) -> Column:
            utf16 = F.encode(c, "UTF-16BE")
            half = lambda k: F.conv(F.hex(F.substring(utf16, k, 2)), 16, 10).cast("int")
            return F.when(F.octet_length(utf16) > 2, F.concat(code(half(1)), code(half(3)))).otherwise(code(half(1)))

        plain = F.split(value, r"[^\x00-\x7f]", -1)
        other = F.transform(F.regexp_extract_all(value, F.lit(r"[^\x00-\x7f]"), F.lit(0)), escaped)
        joined = F.array_join(F.flatten(F.zip_with(plain, other, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
        value = F.when(value.rlike(r"[^\x00-\x7f]"), joined).otherwise(value)
    return df.select(value.alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(spark: SparkSession, report: str, path: str) -> None:
    """The report as a one-line-per-row text table, through Spark's writer so that any store works."""
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(path)
