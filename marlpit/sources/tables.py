"""Reading and writing flat tables, and the roles that columns carry."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

from marlpit.functions.lineage import pinned

BAD_ROW = "_bad_row"


def normalize_column_names(names: Sequence[str | None]) -> list[str]:
    """Blank names become column_n, repeated ones name_2, name_3 ... (without regard to case)."""
    out: list[str] = []
    seen: set[str] = set()
    for n, raw in enumerate(names, 1):
        base = (raw or "").strip() or f"column_{n}"
        name, k = base, 1
        while name.lower() in seen:
            k += 1
            name = f"{base}_{k}"
        seen.add(name.lower())
        out.append(name)
    return out


#: Separators and quotes that a file may have, in order of preference, and lines from which they are told.
SEPARATORS, QUOTES, SAMPLE_LINES = (",", ";", "\t", "|", ":"), ('"', "'"), 200


def fields_of(line: str, sep: str, quote: str) -> int:
    """Number of fields of a line; separators between quotes are text, and a doubled quote is one."""
    n, inside, start = 1, False, True
    for c in line:
        if c == quote and (inside or start):
            inside, start = not inside, True
        elif c == sep and not inside:
            n, start = n + 1, True
        else:
            start = False
    return 0 if inside else n


def dialect_of(lines: Sequence[str]) -> tuple[str, str]:
    """(separator, quote) under which most lines have the same number of fields, of several the one with the most fields; a comma and double quotes where no line has two fields."""
    best, found = (0.0, 0), (SEPARATORS[0], QUOTES[0])
    lines = [x for x in lines if x.strip()]
    for sep in SEPARATORS:
        for quote in QUOTES:
            counts = Counter(fields_of(x, sep, quote) for x in lines)
            n, met = max(counts.items(), key=lambda x: (x[0] > 1, x[1], x[0]), default=(0, 0))
            now = (met / len(lines), n) if n > 1 else (0.0, 0)
            # a quote counts only if it is there: without one the first is as good
            if now > best:
                best, found = now, (sep, quote)
    return found


def csv_dialect(spark: SparkSession, path: str) -> tuple[str, str]:
    """dialect_of the first SAMPLE_LINES lines."""
    return dialect_of([r[0] for r in spark.read.text(path).limit(SAMPLE_LINES).collect()])


def read_csv(spark: SparkSession, path: str, header: bool = True, names: Sequence[str] | None = None, sep: str | None = None) -> DataFrame:
    """Typed by a pass over all rows; short rows are filled with nulls and rows with too many fields raise an error when they are read. Without a separator, it and the quote are told from a sample."""
    sep, quote = (sep, '"') if sep else csv_dialect(spark, path)
    options = {"header": header, "sep": sep, "quote": quote, "enforceSchema": True, "multiLine": False, "ignoreLeadingWhiteSpace": False}
    first = spark.read.options(**options, inferSchema=True).csv(path)
    kinds = [f.dataType for f in first.schema.fields]
    given = list(names) if names else normalize_column_names([None if not header else c for c in first.columns])
    schema = StructType([StructField(c, k) for c, k in zip(given, kinds, strict=True)])
    both = StructType([*schema.fields, StructField(BAD_ROW, StringType())])
    df = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_ROW).schema(both).csv(path)
    # short rows are marked as bad too, but keep their values; more separators than columns mean a row too long
    fields = F.size(F.regexp_extract_all(F.coalesce(F.col(BAD_ROW), F.lit("")), F.lit(f"(?:{quote}(?:[^{quote}]|{quote}{quote})*{quote}|[^{re.escape(sep)}{quote}]*)(?:{re.escape(sep)}|$)"), F.lit(0)))
    too_long = F.col(BAD_ROW).isNotNull() & (fields > len(kinds) + 1)
    checked = df.withColumn(given[0], F.when(too_long, F.raise_error(F.concat(F.lit("bad row: "), F.col(BAD_ROW))).cast(kinds[0])).otherwise(F.col(given[0])))
    return checked.drop(BAD_ROW)


def read_typed_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, **options: str) -> DataFrame:
    """Strict types; an empty field is null."""
    return spark.read.schema(schema).options(header=header, nullValue="", mode="FAILFAST", **options).csv(path)


def inspect_csv(spark: SparkSession, path: str, header: bool | None = None, sep: str | None = None) -> DataFrame:
    """A row per column: its name, kind (number, date, boolean, text, mixed or empty) and number of given values. Without a word on the header
    there is one if the first row holds no number and the second does; without a separator, it and the quote are told from a sample."""
    sep, quote = (sep, '"') if sep else csv_dialect(spark, path)
    raw = spark.read.options(header=False, sep=sep, quote=quote).csv(path)
    top = raw.limit(2).collect()
    if header is None:
        numeric = [any(_is_number(v) for v in row) for row in top]
        header = len(top) == 2 and not numeric[0] and numeric[1]
    names = normalize_column_names(list(top[0]) if header and top else [None] * len(raw.columns))
    body = spark.read.options(header=header, sep=sep, quote=quote, enforceSchema=True).schema(StructType([StructField(c, StringType()) for c in names])).csv(path)
    parts = []
    for c in names:
        text = F.when(F.trim(c) != "", F.trim(c))
        number, boolean = text.try_cast("double").isNotNull(), F.lower(text).isin("true", "false")
        date = text.try_cast("timestamp").isNotNull() & ~number & F.contains(text, F.lit("-"))
        kinds = {"number": number, "boolean": boolean, "date": date, "text": ~(number | boolean | date)}
        counts = {k: F.count_if(F.coalesce(v, F.lit(False)) & text.isNotNull()) for k, v in kinds.items()}
        met = sum(F.when(n > 0, 1).otherwise(0) for n in counts.values())
        kind = F.when(F.count(text) == 0, "empty").when(met > 1, "mixed")
        for k, n in counts.items():
            kind = kind.when(n > 0, k)
        parts.append(F.struct(F.lit(c).alias("column_name"), kind.alias("kind"), F.count(text).alias("given")))
    return body.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def _is_number(text: str | None) -> bool:
    try:
        float(text or "")
        return True
    except ValueError:
        return False


def nested_columns(df: DataFrame) -> list[tuple[str, str]]:
    """(name, type) of columns that aren't flat: nested or binary."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields if isinstance(f.dataType, StructType | ArrayType | MapType | BinaryType)]


def flat_schema_check(df: DataFrame) -> None:
    bad = nested_columns(df)
    if bad:
        raise ValueError("not flat: " + ", ".join(f"{c} {k}" for c, k in bad))


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> tuple[int, StructType]:
    """(rows, schema) of what was written. The rows are those that the new files' footers name; a failed write leaves the old files, as the new ones are put in place by a rename."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    staged, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    of = spark._jvm.org.apache.hadoop.fs.Path
    # no observe() here: once a session has observed, models that keep a training summary can't be sent to tasks any more
    df.write.option("compression", compression).parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged).count()
    there = fs.exists(where)
    if there:
        fs.rename(where, of(old))
    fs.rename(of(staged), where)
    if there:
        fs.delete(of(old), True)
    return rows, df.schema


def materialize_view(spark: SparkSession, root: str, definition: Mapping, build: Callable[[], DataFrame], newer_than: int = 0, view: str | None = None) -> DataFrame:
    """The result of a view, written once under the hash of its definition; used again unless its source (newer_than, milliseconds) changed since.
    A named view has a folder of its own, in which only the newest revision stays: others go once it is in place."""
    name = hashlib.sha256(json.dumps(definition, sort_keys=True, default=str).encode()).hexdigest()[:16]
    folder = f"{root}/{view}" if view else root
    path = f"{folder}/{name}.parquet"
    of = spark._jvm.org.apache.hadoop.fs.Path
    where = of(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or fs.getFileStatus(where).getModificationTime() < newer_than:
        fs.mkdirs(of(folder))
        write_parquet(build(), path)
        for other in fs.listStatus(of(folder)) if view else ():
            if other.getPath().getName() != where.getName():
                fs.delete(other.getPath(), True)
    return spark.read.parquet(path)


#: Name of the column by which a log is laid out, beside its group.
PERIOD = "_period"


def write_periods(df: DataFrame, path: str, time: str, group: str, unit: str = "day") -> None:
    """df in folders by group and by day (or month) of a time, so that prune_expired can drop folders; further batches may be appended."""
    df.withColumn(PERIOD, F.date_trunc(unit, time).cast("date")).repartition(group, PERIOD).write.mode("append").partitionBy(group, PERIOD).parquet(path)


def _folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, path) of the folders name=value in a folder."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(of(path)) if x.isDirectory() and "=" in x.getPath().getName()]
    return [(unquote(p.getName().split("=", 1)[1]), p.toString()) for p in found]


def prune_expired(spark: SparkSession, path: str, time: str, group: str, cutoffs: Mapping[str, datetime], unit: str = "day") -> tuple[int, int]:
    """(rows deleted, folders rewritten): of a log in periods, for each group with a cutoff, delete the rows from before it.

    Folders that end before their cutoff go without being read, but for the row counts in their files' footers; only those that hold a cutoff are read and overwritten. Other folders' files stay as they are,
    and so do rows without a time and groups without a cutoff."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    whole, part = [], []
    for value, folder in _folders(spark, path):
        if value not in cutoffs:
            continue
        for period, inner in _folders(spark, folder):
            if period.startswith("__"):  # no time
                continue
            begin = datetime.fromisoformat(period)
            end = begin + timedelta(days=1) if unit == "day" else (begin + timedelta(days=32)).replace(day=1)
            if end <= cutoffs[value]:
                whole.append(inner)
            elif begin < cutoffs[value]:
                part.append((value, period, inner))
    gone = spark.read.parquet(*whole).count() if whole else 0
    for folder in whole:
        fs.delete(of(folder), True)
    if part:
        kept, before = [], 0
        for value, period, inner in part:  # one for each group
            rows = spark.read.parquet(inner)
            before += rows.count()
            kept.append(rows.filter(F.col(time) >= F.lit(cutoffs[value])).withColumn(group, F.lit(value)).withColumn(PERIOD, F.lit(period).cast("date")))
        rows = pinned(reduce(DataFrame.unionByName, kept))
        left = {(r[group], str(r[PERIOD])): r["count"] for r in rows.groupBy(group, PERIOD).count().collect()}
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group, PERIOD).parquet(path)
        for value, period, inner in part:
            if (value, period) not in left:
                fs.delete(of(inner), True)
        gone += before - sum(left.values())
    return gone, len(part)


def preview(df: DataFrame, order_by: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in order, with total_rows, has_next and has_previous."""
    total = df.agg(F.count("*").alias("total_rows"))
    page = df.orderBy(*[F.col(c).asc_nulls_last() for c in order_by]).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_next", F.col("total_rows") > offset + limit).withColumn("has_previous", F.lit(offset > 0))  # one row


def inference_log(requests: DataFrame, items: DataFrame, since: str, until: str, source_before: str, role: str = "champion") -> DataFrame:
    """Items of a window's requests by one role's models, as they were known before source_before."""
    asked = requests.filter((F.col("created_at") >= F.lit(since).cast("timestamp")) & (F.col("created_at") < F.lit(until).cast("timestamp")))
    known = items.filter((F.col("role") == role) & (F.col("logged_at") < F.lit(source_before).cast("timestamp")))
    return known.join(asked, "request_id")


def with_roles(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """df with a role in the metadata of each named column; views that select the column keep it."""
    return df.select(*[F.col(c).alias(c, metadata=df.schema[c].metadata | {"role": roles[c]}) if c in roles else F.col(c) for c in df.columns])


def roles_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["role"] for f in df.schema.fields if "role" in f.metadata}


def roles_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(sorted(roles_of(df).items()), "column_name string, role string")
