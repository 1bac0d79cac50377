"""Readers: test tables, prompts, labelled cases, rulebooks, source files, PDF files, mutation sessions."""

from __future__ import annotations

import ast
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from idiomark.functions.text import WS, is_rulebook

#: Least length of a string constant that counts as embedded text.
LEAST_EMBEDDED = 200
#: What became of a file: read, no command to read it with, the command failed.
OK, NO_TOOL, FAILED = "OK", "NO_TOOL", "FAILED"


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt out evenly if its scan has fewer splits than the cluster has cores.

    Long work on a small table would leave cores idle; a table of many splits, be it
    in one file, is never moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a test directory."""
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _text_at(parsed, path: str):
    """The string at a path of a parsed document; null where there is none, or something else."""
    value = F.try_variant_get(parsed, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, path, "string"))


def parsed_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """(prompt, session_id) of JSON lines; lines that are no objects with a visible string prompt are dropped.

    A session id that is no string is null."""
    d = lines.select(F.try_parse_json(F.col(column)).alias("m"))
    d = d.select(_text_at(F.col("m"), "$.prompt").alias("prompt"), _text_at(F.col("m"), "$.session_id").alias("session_id"))
    return d.filter(F.regexp_replace("prompt", f"[{WS}]+", "") != "")


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """(label, kind, text) of a tab-separated file."""
    return cases(spark.read.text(path))


def cases(lines: DataFrame, column: str = "value") -> DataFrame:
    r"""(label, kind, text) of tab-separated lines; a malformed row fails the query.

    Blank lines and lines that start with # are skipped, a tab in the text belongs to
    it, and \N (not \n) is a line feed."""
    v = F.col(column)
    d = lines.filter((F.regexp_replace(v, f"[{WS}]+", "") != "") & ~v.rlike(r"^\s*#"))
    f = F.split(v, "\t", 3)
    label = F.btrim(F.get(f, F.lit(0)))
    fine = (F.size(f) == 3) & label.isin("bd", "xx")
    d = d.select(F.when(fine, label).otherwise(F.raise_error(F.concat(F.lit("malformed labelled row: "), v)).cast("string")).alias("label"), f.alias("f"))
    return d.select("label", F.btrim(F.col("f")[1]).alias("kind"), F.replace(F.col("f")[2], F.lit("\\N"), F.lit("\n")).alias("text"))


def expanded(path: str) -> Path | None:
    """A path with its ~ resolved; None if that fails or it is relative."""
    try:
        p = Path(path).expanduser()
    except RuntimeError:
        return None
    return p if p.is_absolute() else None


#: Engine options: the user's own rulebook, which replaces the default, and their own overlay, which is added to any.
RULEBOOK_OPTION, OVERLAY_OPTION = "spark.idiomark.rulebook", "spark.idiomark.overlay"


def configured(spark: SparkSession, candidates: Iterable[str]) -> tuple[str | None, bool, str | None]:
    """(path of the rulebook, whether an option names it, path of the user's overlay), by the session's options."""
    own = spark.conf.get(OVERLAY_OPTION, None)
    at = expanded(own) if own else None
    return *resolve(candidates, spark.conf.get(RULEBOOK_OPTION, None)), (str(at) if at else None)


def resolve(candidates: Iterable[str], override: str | None = None) -> tuple[str | None, bool]:
    """(path of the rulebook, whether an override names it): the override if it is set, else the first that exists."""
    if override:
        p = expanded(override)
        return (str(p) if p else None), True
    return next((str(p) for c in candidates if (p := expanded(c)) and p.exists()), None), False


def rulebook(spark: SparkSession, path: str) -> DataFrame:
    """(path, body, valid) of whole files."""
    d = spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("body"))
    return d.withColumn("valid", is_rulebook(F.col("body")))


@F.arrow_udf(T.StringType())
def _real(paths):
    """Paths of local files with links resolved; others as they are."""
    import os
    from urllib.parse import unquote, urlsplit

    import pyarrow as pa

    def one(p):
        at = urlsplit(p)
        return os.path.realpath(unquote(at.path)) if at.scheme in ("", "file") else p

    return pa.array([one(p) for p in paths.to_pylist()], pa.string())


def overlays(spark: SparkSession, root: str, name: str, own: str | None = None) -> DataFrame:
    """(path, body) of the user's own overlay first, then of files projects/*/memory/<name> in order of path.

    A file under two names counts once, by the first of them; blank ones do not count."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", name).load(os.path.join(root, "projects", "*", "memory")).withColumn("_rank", F.lit(1))
    if own:
        d = d.union(spark.read.format("binaryFile").load(own).withColumn("_rank", F.lit(0)))
    d = d.select("path", "_rank", F.make_valid_utf8(F.col("content").cast("string")).alias("body"))
    first = d.groupBy(_real("path").alias("_real")).agg(F.min(F.struct("_rank", "path", "body")).alias("f")).select("f.*")
    return first.filter(F.regexp_replace("body", f"[{WS}]+", "") != "").orderBy("_rank", "path").select("path", "body")


def words_in(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct words of lists with one word a line, in lower case."""
    return lines.select(F.lower(F.btrim(F.col(column))).alias("word")).filter("word != ''").distinct()


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return words_in(spark.read.text(path))


def function_spans(source: str) -> list[tuple[int, int, str]]:
    """(first line, last line, name) of functions of a Python module and its classes; inner functions belong to theirs."""
    todo, found = list(ast.parse(source).body), []
    while todo:
        node = todo.pop()
        if isinstance(node, ast.ClassDef):
            todo += node.body
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            found.append((node.lineno, node.end_lineno or node.lineno, node.name))
    return sorted(found)


def spans(spark: SparkSession, source: str) -> DataFrame:
    return spark.createDataFrame(function_spans(source), "lo int, hi int, name string")


def _long_texts(source: str, least: int) -> dict[str, str]:
    """Name and text of the string constants of a module that are long enough, in order; of one name the last."""
    long = {}
    for statement in ast.parse(source).body:
        match statement:
            case ast.Assign(value=ast.Constant(value=str(text)), targets=names) if len(text) >= least:
                long |= {name.id: text for name in names if isinstance(name, ast.Name)}
    return long


def embedded_text(path: str, source: str, least: int = LEAST_EMBEDDED) -> tuple[str, str | None]:
    """(text, names): what a Python file holds as long constants, one line feed between them; other files are their own text."""
    long = _long_texts(source, least) if path.endswith(".py") else {}
    return ("\n".join(long.values()), ", ".join(long)) if long else (source, None)


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("names", T.StringType())]))
def _embedded(paths, sources):
    import pyarrow as pa

    rows = [embedded_text(p, s) for p, s in zip(paths.to_pylist(), sources.to_pylist(), strict=True)]
    return pa.array([{"text": t, "names": n} for t, n in rows], pa.struct([("text", pa.string()), ("names", pa.string())]))


def embedded(files: DataFrame) -> DataFrame:
    """(path, text, names) of files (path, body): what is to be measured of each."""
    return files.select("path", _embedded("path", "body").alias("e")).select("path", "e.text", "e.names")


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("status", T.StringType())]))
def _pdf(contents, tools):
    import shutil
    import subprocess

    import pyarrow as pa

    def one(data, tool):
        found = shutil.which(tool)
        if not found:
            return {"text": None, "status": NO_TOOL}
        done = subprocess.run([found, "-layout", "-", "-"], input=data, capture_output=True, check=False)
        return {"text": done.stdout.decode("utf-8", "replace"), "status": OK} if done.returncode == 0 else {"text": None, "status": FAILED}

    rows = zip(contents.to_pylist(), tools.to_pylist(), strict=True)
    return pa.array([one(d, t) for d, t in rows], pa.struct([("text", pa.string()), ("status", pa.string())]))


def pdf_texts(spark: SparkSession, path: str, tool: str = "pdftotext") -> DataFrame:
    """(path, text, status) of PDF files, through a command that reads one and writes its text.

    Where a machine has no such command the status says so and the text is null: nothing is guessed."""
    d = spark.read.format("binaryFile").load(path).select("path", _pdf("content", F.lit(tool)).alias("p"))
    return d.select("path", "p.text", "p.status")


SESSION = {"work_items": "job_id string", "work_results": "job_id string, test_outcome string", "mutation_specs": "job_id string, start_pos_row int"}


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.step = options["path"], options["table"], int(options.get("rows", 100_000))
        self.columns = ", ".join(schema.names)
        if not all(x.isidentifier() for x in (self.table, *schema.names)):
            raise ValueError("names of tables and columns are identifiers")

    def _all(self, query: str):
        import sqlite3
        from contextlib import closing

        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            yield from db.execute(query)

    def partitions(self):
        first, last = next(self._all(f"select min(rowid), max(rowid) from {self.table}"))
        return [_Rows(a, min(a + self.step - 1, last)) for a in range(first, last + 1, self.step)] if first is not None else [_Rows(0, -1)]

    def read(self, partition):
        yield from self._all(f"select {self.columns} from {self.table} where rowid between {partition.first} and {partition.last}")


class SqliteTable(DataSource):
    """A table of a SQLite file that every executor can open, read in ranges of its rows."""

    @classmethod
    def name(cls):
        return "sqlite_table"

    def schema(self):
        return SESSION[self.options["table"]]

    def reader(self, schema):
        return _SqliteReader(self.options, schema)


def mutation_session(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(work_items, work_results, mutation_specs) of a session: a SQLite file, or a folder with a Parquet table of each name."""
    if not path.endswith((".sqlite", ".db")):
        return tuple(spark.read.parquet(f"{path}/{name}.parquet") for name in SESSION)
    spark.dataSource.register(SqliteTable)
    return tuple(spark.read.format("sqlite_table").option("path", path).option("table", name).load() for name in SESSION)
