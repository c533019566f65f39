"""Tolerant reading of delimited review files.

The semantics follow a forgiving spreadsheet-style reader, file by file:

* the separator is a comma, or a tab when the file's header line has a tab and
  no comma;
* fields may be quoted with ``"``, a doubled ``""`` is a literal quote and a
  quoted field may span lines; a quote inside an unquoted field is a character
  like any other;
* a record with **more** fields than the header is dropped, one with
  **fewer** is kept and padded with nulls, blank lines are skipped (in a
  one-column file also a quoted field of blanks only);
* the file is read as UTF-8, or as Latin-1 when it is not valid UTF-8;
* every column is a string (no type inference) and the usual null tokens
  (empty field, ``NA``, ``null``, ...) become nulls;
* header names are stripped; duplicates get ``.1``, ``.2`` suffixes before
  stripping, and a clash after stripping is an error; a header line is one line;
* files with different headers are united by column name;
* an input without any data row is an error.

Spark parses lazily, so the "try a parse, fall back" choices are made before:
one distributed pass finds each file's header line and whether it is UTF-8. That
table has a row per file and stays distributed; only the *different* headers
come to the driver. The files of each kind are parsed with their own settings:
each kind scans its own files only, so every file is read twice whatever the
number of kinds. Beyond ``LISTED_FILES`` files, each kind scans all and picks its
own by a join on the path. With one kind, as usual, nothing is picked or united.
"""

from __future__ import annotations

import csv
import re
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill.session import keep_table
from tonemill.sources.quoted import read_records

EXTENSIONS = ("csv", "tsv", "txt")

# The strings a pandas-style CSV reader turns into nulls by
# default.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The ten sample reviews offered as a demo table.
SAMPLE_REVIEWS = (
    "This product exceeded all my expectations! Absolutely brilliant quality.",
    "Terrible experience. Complete waste of money. Very disappointed.",
    "It's okay, nothing special. Does what it's supposed to do.",
    "Best purchase I've ever made! Highly recommend to everyone.",
    "Poor quality and awful customer service. Would not buy again.",
    "Decent product for the price. Can't complain too much.",
    "Absolutely love it! Amazing features and great value.",
    "Not satisfied at all. Expected much better for this price.",
    "Works fine, no issues so far. Pretty standard.",
    "Outstanding! This is exactly what I was looking for!",
)

_CORRUPT, _FILE = "__tm_raw", "__tm_file"
MAX_KINDS = 1_000  # different (header, encoding) pairs in one input
LISTED_FILES = 200_000  # file names in the driver, which lists them anyway; with more, kinds are picked by a join


class EmptyInputError(ValueError):
    """The input has no parsable data row."""


def sample_reviews(spark: SparkSession) -> DataFrame:
    """The ten demo reviews as a one-column ``text`` table."""
    return spark.createDataFrame([(t,) for t in SAMPLE_REVIEWS], "text string")


def _glob(extensions) -> str:
    return "*.{" + ",".join(extensions) + "}"


def file_kinds(spark: SparkSession, path, extensions=EXTENSIONS, encoding: str | None = None) -> DataFrame:
    """``(file, encoding, header, late)`` of every input file: UTF-8 where every
    line is valid UTF-8, else ISO-8859-1 (or ``encoding``, if given), the first
    line that is not blank, and whether a line of blanks stands before it. One
    distributed pass and a join on line numbers."""
    lines = spark.read.option("pathGlobFilter", _glob(extensions)).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    named = (F.col("block") == 0) & (F.trim("value") != "")
    found = F.lit(encoding) if encoding else F.when(F.bool_and(F.is_valid_utf8("value")), "UTF-8").otherwise("ISO-8859-1")
    files = lines.groupBy("file").agg(found.alias("encoding"), F.min(F.when(named, F.col("line"))).alias("line"),
                                      F.min(F.when((F.col("block") == 0) & (F.length("value") > 0), F.col("line"))).alias("top"))
    raw = F.col("value").cast("binary")
    header = F.when(F.col("encoding") == "UTF-8", F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
    return lines.select("file", "line", "value").join(files, ["file", "line"]).select(
        "file", "encoding", F.ltrim(header, F.lit("\ufeff")).alias("header"), (F.col("top") < F.col("line")).alias("late"))


def mangle_header(names) -> list[str]:
    """Header names as a pandas-style reader makes them: empty names become
    ``Unnamed: i``, repeats get ``.1``, ``.2``; then names are stripped."""
    out, seen, counts = [], set(), {}
    for i, raw in enumerate(names):
        name = raw if raw not in (None, "") else f"Unnamed: {i}"
        if name in seen:
            k = counts.get(name, 1)
            while f"{name}.{k}" in seen:
                k += 1
            counts[name] = k + 1
            name = f"{name}.{k}"
        seen.add(name)
        out.append(name)
    stripped = [n.strip() for n in out]
    dup = {n for n in stripped if stripped.count(n) > 1}
    if dup:
        raise ValueError(f"duplicate column names after stripping: {sorted(dup)}")
    return stripped


def read_reviews(
    spark: SparkSession,
    path: str | list[str],
    *,
    sep: str | None = None,
    encoding: str | None = None,
    multi_line: bool | str = True,
    na_values=NA_VALUES,
    extensions=EXTENSIONS,
    check_nonempty: bool = True,
) -> DataFrame:
    """Read delimited review files tolerantly (see the module docstring).

    ``encoding=None`` and ``sep=None`` decide per file. ``multi_line`` allows
    quoted newlines but keeps each file in one task; ``"split"`` allows them and
    lets many tasks share a file, which is then scanned twice more
    (``sources.quoted``); pass ``False`` for huge files without embedded newlines.
    """
    files = keep_table(file_kinds(spark, path, extensions, encoding), name="review-files")
    kinds = files.select("encoding", "header", "late").distinct().limit(MAX_KINDS + 1).collect()
    if not kinds:
        raise EmptyInputError(f"no header line in {path}")
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"the files have more than {MAX_KINDS} different headers")
    named, parts = _paths_of_kinds(files) if len(kinds) > 1 else {}, []
    for kind in sorted(kinds):
        kind_sep = sep or ("\t" if "\t" in kind.header and "," not in kind.header else ",")
        fields = next(csv.reader([kind.header], delimiter=kind_sep, strict=True))
        names = mangle_header(fields)
        own_paths = named.get((kind.encoding, kind.header, kind.late), path)
        part = _parsed(spark, own_paths, names, kind_sep, kind.encoding, multi_line, extensions)
        if kind.late and multi_line != "split":  # the parser took the line of blanks for the header, and the header for a record
            same = [F.coalesce(F.col(f"`{n}`"), F.lit("")) == F.lit(f) for n, f in zip(names, fields)]
            part = part.filter(~reduce(and_, same))
        if len(kinds) > 1 and not named:
            own = files.where((F.col("encoding") == kind.encoding) & (F.col("header") == kind.header) & (F.col("late") == kind.late)).select(F.col("file").alias(_FILE))
            part = part.join(own, _FILE, "left_semi")
        parts.append(_with_nulls(part, names, na_values))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if check_nonempty and not out.take(1):
        raise EmptyInputError(f"no data rows in {path}")
    return out


def literal_path(file: str) -> str:
    """A ``_metadata.file_path`` as a path that readers take literally: decoded,
    and its pattern characters escaped."""
    return re.sub(r"([*?\[\]{}\\^])", r"\\\1", unquote(file))


def _paths_of_kinds(files: DataFrame) -> dict[tuple, list[str]]:
    """The files of each kind, as paths a reader takes literally; nothing if
    there are more than LISTED_FILES."""
    rows = files.limit(LISTED_FILES + 1).collect()
    out: dict[tuple, list[str]] = {}
    for r in rows if len(rows) <= LISTED_FILES else []:
        out.setdefault((r.encoding, r.header, r.late), []).append(literal_path(r.file))
    return out


def _parsed(spark: SparkSession, path, names: list[str], sep: str, encoding: str, multi_line: bool | str, extensions) -> DataFrame:
    """All files parsed with one header and separator, records with too many
    fields and blank lines dropped; the file's path comes along."""
    schema = T.StructType(
        [T.StructField(n, T.StringType(), True) for n in names] + [T.StructField(_CORRUPT, T.StringType(), True)]
    )
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT,
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if multi_line == "split":
        ddl = ", ".join("`" + f.name.replace("`", "``") + "` STRING" for f in schema.fields)
        records = read_records(spark, path, sep, encoding, _glob(extensions))
        raw = records.select(F.from_csv("record", ddl, options).alias("r"), F.col("file").alias(_FILE)).select("r.*", _FILE)
    else:
        raw = (
            spark.read.schema(schema)
            .options(**options)
            .option("pathGlobFilter", _glob(extensions))
            .option("header", True)
            .option("enforceSchema", True)
            .option("multiLine", multi_line)
            .option("encoding", encoding)
            .csv(path)
        )
        raw = raw.select("*", F.col("_metadata.file_path").alias(_FILE))
    # The parser flags records with too many *and* too few fields; keep the
    # short ones. Field count = delimiters outside quoted fields + 1. Without
    # its doubled quotes a quoted field is '"..."' after a delimiter or at the
    # start; a quote elsewhere is an ordinary character.
    esc = "\\t" if sep == "\t" else "\\" + sep
    single = F.replace(F.col(_CORRUPT), F.lit('""'), F.lit(""))
    unquoted = F.regexp_replace(single, f'(^|{esc})"[^"]*"', "$1")
    delimiters = F.length(F.regexp_replace(unquoted, f"[^{esc}]", ""))
    keep = F.col(_CORRUPT).isNull() | ((delimiters < F.lit(len(names))) & ~F.col(_CORRUPT).rlike(r"^[ \t\r\n]*$"))
    if len(names) == 1:
        keep = keep & ~F.coalesce(F.col(f"`{names[0]}`").rlike(r"^[ \t\r\n]+$"), F.lit(False))
    # Always true, but it names a data column: the parser refuses plans that
    # read nothing but the raw record.
    keep = keep & (F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0)
    return raw.filter(keep).drop(_CORRUPT)


def _with_nulls(df: DataFrame, names: list[str], na_values) -> DataFrame:
    columns = [F.col(f"`{n}`") for n in names]
    nas = list(na_values)
    return df.select(*[(F.when(c.isin(nas), F.lit(None).cast("string")).otherwise(c) if nas else c).alias(n) for n, c in zip(names, columns)])
