"""Helpers the operators of this folder share."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The characters the contracts call white space, [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\x0c\r"

_LOCAL_FOLDERS = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local test session
    without that setting gets a folder of its own; a cluster must name one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = context.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="llm-")
        shared = _LOCAL_FOLDERS[app]
    return shared.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once as a table in the shared folder and read back: the lineage
    ends there, later steps read it as often as they like, and a lost executor
    costs only its own tasks. The folder is scratch; whoever owns it empties it."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_texts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that no other
    column of the caller can clash; a null text counts as empty."""
    return docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")
    )


def text_blocks(texts, characters: int):
    """(position of the first, list of texts) of an Arrow column, in blocks of about so
    many characters; a longer text is a block of its own."""
    block, first, size = [], 0, 0
    for k, value in enumerate(texts):
        text = value.as_py()
        block.append(text)
        size += len(text)
        if size >= characters or k == len(texts) - 1:
            yield first, block
            block, first, size = [], k + 1, 0


def bounded_batches(spark: SparkSession, rows=1_000) -> None:
    """Job setting: Arrow batches of so many rows, since texts are long. Python workers
    hold a batch or two; the cluster's own setting stays where it is smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def text_mod(col: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a number; the fold of a row."""
    return F.crc32(col.cast("string")) % modulus


def schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
