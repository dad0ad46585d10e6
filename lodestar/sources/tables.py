"""Reading the input tables and deriving the retrieval inputs from them.

All readers return lazy DataFrames; column pruning and filters reach the
Parquet scan through Catalyst.
"""

from __future__ import annotations

import re
from fnmatch import fnmatchcase
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import range_partitions

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

FILES_AT_ONCE = 8 << 20       # bytes of files that a task hands on at a time
UNSAFE = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")  # in the name of a folder, as Spark escapes it


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with or without an embedding: ``id, source, content``."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector corpus: every embedding, with its document where there is one (else null source and content):
    ``id, source, content, embedding`` as in the chunks table of the original."""
    return _embeddings(spark, sf_dir).join(text_corpus(spark, sf_dir), "id", "left").select("id", "source", "content", "embedding")


def whole_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every embedding (a full outer join): what hybrid search looks through."""
    return text_corpus(spark, sf_dir).join(_embeddings(spark, sf_dir), "id", "full").select("id", "source", "content", "embedding")


def vector_questions(corpus_df: DataFrame) -> DataFrame:
    """Every corpus row as a question by vector: ``qid, qvec``; its own row is excluded from its results by the search
    operators (``exclude_self``)."""
    return corpus_df.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))


def text_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts as questions, whole: ``qid, question, qvec``. They have no vectors of their own; the embedding of
    the same number stands in (null where there is none), and its row is excluded from the question's results."""
    bench = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    return bench.join(_embeddings(spark, sf_dir), "id", "left").select(
        F.col("id").alias("qid"), "question", F.col("embedding").alias("qvec"))


def is_text(content: Column) -> Column:
    """Whether a file's bytes are text: valid UTF-8, no zero byte, and not the head of a PDF or of a zip archive (office files)."""
    head = F.hex(F.substring(content, 1, 4))
    return (F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.unhex(F.lit("00")))
            & ~head.startswith("25504446") & (head != "504B0304"))


def _folder(path: str) -> tuple[fs.FileSystem, str] | None:
    """The file system of ``path`` and the place there, None where Arrow has none for it."""
    try:
        return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
    except (pa.ArrowException, OSError):
        return None


def _file_per_name(path: str):
    """Writes rows ``name, text`` that come in the order of their names: ``files``, how many were made."""
    def run(batches):
        disk, top = _folder(path)
        part = f"part-{TaskContext.get().partitionId():05d}.txt"
        own = f"_{TaskContext.get().taskAttemptId()}.part"  # appears whole, by a rename
        out, now, files = None, None, 0

        def close():
            if out is not None:
                out.close()
                disk.move(f"{now}/{own}", f"{now}/{part}")

        for b in batches:
            for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist()):
                name = UNSAFE.sub(lambda c: f"%{ord(c[0]):02X}", name) if name else "__HIVE_DEFAULT_PARTITION__"
                if f"{top}/name={name}" != now:
                    close()
                    now, files = f"{top}/name={name}", files + 1
                    disk.create_dir(now)
                    out = disk.open_output_stream(f"{now}/{own}")
                out.write(((text or "") + "\n").encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])
    return run


def write_documents(docs: DataFrame, path: str) -> None:
    """``name, text`` as text files, a new folder ``path`` with a folder ``name=...`` for every name: one file of a name and a task, a
    line end after each text, as Spark's text writer leaves them. That one makes and renames files with several calls each and
    renames all of them once more in the driver when the job is done; here a task is done with its files itself. On a file
    system that Arrow does not know, Spark's writer does it."""
    rows = docs.select("name", "text")
    if _folder(path) is None:
        rows.write.mode("overwrite").partitionBy("name").text(path)
    else:
        rows.sortWithinPartitions("name").mapInArrow(_file_per_name(path), "files long").write.format("noop").mode("overwrite").save()


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _files(path: str, pattern: str, name_column: str | None):
    """Two steps over Arrow batches: what lies in the folder ``path`` itself, one row an entry, and the files of entries (those below them
    too) with their whole content. A file outside of a folder ``name_column=...`` fails the job, where there is a name column."""
    def entries(_):
        disk, top = _folder(path)
        found = [(x.path, x.type == fs.FileType.Directory) for x in disk.get_file_info(fs.FileSelector(top)) if not _hidden(x.base_name)]
        for lo in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found[lo:lo + 10_000]], kind) for n, kind in enumerate((pa.string(), pa.bool_()))],
                                             names=["path", "folder"])

    def files(disk, at, folder):
        if not folder:
            if fnmatchcase(at.rsplit("/", 1)[-1], pattern):
                yield at
            return
        for x in disk.get_file_info(fs.FileSelector(at)):
            if not _hidden(x.base_name):
                yield from files(disk, x.path, x.type == fs.FileType.Directory)

    def name_of(top, at):
        if name_column is None:
            return at.rsplit("/", 1)[-1]
        for part in at[len(top):].split("/")[:-1]:
            if part.startswith(f"{name_column}="):
                value = unquote(part[len(name_column) + 1:], errors="strict")
                return None if value == "__HIVE_DEFAULT_PARTITION__" else value
        raise ValueError(f"no folder {name_column}=... holds {at}")

    def read(batches):
        disk, top = _folder(path)
        held, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], kind) for n, kind in enumerate(
                (pa.string(), pa.string(), pa.binary(), pa.int64()))], names=["path", "name", "content", "length"])

        for b in batches:
            for at, folder in zip(b.column("path").to_pylist(), b.column("folder").to_pylist()):
                for file in files(disk, at, folder):
                    with disk.open_input_stream(file) as f:
                        content = f.read()
                    held.append((file, name_of(top, file), content, len(content)))
                    size += len(content)
                    if size > FILES_AT_ONCE or len(held) == 10_000:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()
    return entries, read


def _read_folder(spark: SparkSession, path: str, pattern: str, name_column: str | None) -> DataFrame:
    """``path, name, content, length`` of the files that ``pattern`` takes. Spark's reader lists every folder of a partitioned table, keeps
    them all in the driver and reads a few dozen files in a task; here the folder is listed in a task, its entries are dealt to
    others, and these list what is below and read it. On a file system that Arrow does not know, and for a path or pattern with more
    than ``*`` and ``?`` in it, Spark's reader does it."""
    known = None if re.search(r"[*?\[{\\]", path) or re.search(r"[\[{\\]", pattern) else _folder(path)
    if known is None or known[0].get_file_info(known[1]).type != fs.FileType.Directory:
        reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        raw = (reader if name_column else reader.option("recursiveFileLookup", "true")).load(path)
        name = F.col(name_column) if name_column else F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
        return raw.select("path", name.alias("name"), "content", "length")
    entries, read = _files(path, pattern, name_column)
    found = spark.range(0, 1, 1, 1).mapInArrow(entries, "path string, folder boolean")
    return found.repartition(range_partitions(found)).mapInArrow(read, "path string, name string, content binary, length long")


def load_documents(spark: SparkSession, path: str, pattern: str = "*", *, name_column: str | None = None, others: str = "fail") -> DataFrame:
    """A folder of text files as documents: ``source`` is the file name (or the partition
    folder value ``name_column`` when the folder is partitioned; ``unknown`` when it cannot be
    told), ``text`` the whole file, ``bytes`` its size. Files are judged by content, not by name: every text file that
    ``pattern`` takes is read as UTF-8; one that is not text fails the job (``others="skip"`` leaves it out)."""
    if others not in ("fail", "skip"):
        raise ValueError(f"unknown choice {others!r}")
    raw = _read_folder(spark, path, pattern, name_column)
    if others == "skip":
        raw = raw.where(is_text(F.col("content")))
    refused = F.raise_error(F.concat(F.lit("not a text file: "), F.col("path")))
    return raw.select(
        F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown")).alias("source"),
        F.when(is_text(F.col("content")), F.decode(F.col("content"), "UTF-8")).otherwise(refused).alias("text"),
        F.col("length").alias("bytes"),
    )


def read_questions_csv(spark: SparkSession, path: str) -> DataFrame:
    """The question set as CSV with a header: ``set, question, source, expected, previous``.

    Blank fields come back as empty strings (not null), as a CSV dict reader gives them; a quote inside a quoted field is written twice."""
    schema = "set string, question string, source string, expected string, previous string"
    df = (spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8")
          .option("quote", '"').option("escape", '"')
          .schema(schema).csv(path))
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])
