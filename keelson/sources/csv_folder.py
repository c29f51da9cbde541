"""CSV folders as typed DataFrames: dirty rows out, types inferred from all values.

The driver looks at each file's first kilobytes (byte-order mark, delimiter, header), through
Spark's file systems, so folders may lie anywhere that Spark reads.  One pass over the raw lines
of all files tells their encodings and whether a quoted value spans lines; only such files are
parsed as a whole, others in splits.  One pass for each way of writing (encoding, delimiter, width)
counts what the types of all its files rest on.  So the number of jobs depends on the ways of
writing, not on the files; a table's rows are parsed again when they are read, with their types.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format rules.
DELIMITERS = (",", ";", "\t")
NULL_TOKENS = ("", "null", "none", "nan", "na", "n/a", "\\n")
METADATA_PREFIXES = ("export date", "exported", "source", "generated", "report")
GENERIC_FOLDERS = ("data", "dataset", "datasets", "csv", "raw")
DATES = (r"^(?<y>\d{4})-(?<m>\d{1,2})-(?<d>\d{1,2})$", r"^(?<d>\d{1,2})/(?<m>\d{1,2})/(?<y>\d{4})$")
EXTRA = "__extra"
HEAD = 1 << 16
THREADS = 16


@dataclass(frozen=True)
class Rules:
    """What counts as null and as a date; patterns name their groups y, m and d."""

    null_tokens: tuple[str, ...] = NULL_TOKENS
    dates: tuple[str, ...] = DATES


# -- what a file looks like -------------------------------------------------

def first_bytes(spark: SparkSession, path, size: int = HEAD) -> bytes:
    """The head of a file of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def csv_files(spark: SparkSession, folder) -> list[str]:
    """All .csv files below a folder, as paths relative to it, sorted."""
    root = spark._jvm.org.apache.hadoop.fs.Path(str(folder))
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(root).toString().rstrip("/") + "/"
    found, todo = [], system.listFiles(root, True)
    while todo.hasNext():
        p = todo.next().getPath().toString()
        if p.endswith(".csv"):
            found.append(p[len(base):])
    return sorted(found)


#: Encodings that their first bytes tell; the longer marks come first, as one begins with another.
MARKED = {"utf-32": (codecs.BOM_UTF32_LE, codecs.BOM_UTF32_BE), "utf-8-sig": (codecs.BOM_UTF8,), "utf-16": (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)}
#: Bytes that cp1252 leaves undefined, and what stands for the others where latin-1 has control characters.
_UNDEFINED = [b for b in range(0x80, 0xA0) if not bytes([b]).decode("cp1252", "ignore")]
_CONTROLS = [b for b in range(0x80, 0xA0) if b not in _UNDEFINED]


@dataclass(frozen=True)
class Lines:
    """What the lines of a file as raw bytes tell."""

    utf8: bool
    cp1252: bool
    spans: bool


def _plain_path(path: str) -> str:
    """A path as Spark names a file, whatever the number of slashes behind its scheme."""
    return re.sub(r"^(\w+):/+", r"\1:/", path)


def _qualified(spark: SparkSession, path) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return _plain_path(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString())


def look_at_files(spark: SparkSession, paths) -> dict[str, Lines]:
    """One pass for all files: valid UTF-8, free of what cp1252 lacks, and whether a line ends within quotes (an odd number of them)."""
    v = F.col("value")
    undefined = f"^(?:..)*(?:{'|'.join(f'{b:02X}' for b in _UNDEFINED)})"
    quotes = F.length(F.regexp_replace(F.hex(v.cast("binary")), "(?:22|(..))", "$1"))
    rows = spark.read.text([str(p) for p in paths]).select("value", F.col("_metadata.file_path").alias("path")).groupBy("path").agg(
        F.bool_and(F.is_valid_utf8(v)).alias("utf8"),
        F.bool_or(F.hex(v.cast("binary")).rlike(undefined)).alias("undefined"),
        F.bool_or((F.octet_length(v) - quotes / 2) % 2 == 1).alias("spans")).collect()  # a row for each file
    found = {_plain_path(r.path): Lines(r.utf8 is not False, not r.undefined, bool(r.spans)) for r in rows}
    return {str(p): found.get(_qualified(spark, p), Lines(True, True, False)) for p in paths}  # an empty file has no line


def look_at_lines(spark: SparkSession, path) -> Lines:
    return look_at_files(spark, [path])[str(path)]


def _encoding(head: bytes, lines: Lines) -> str:
    for name, marks in MARKED.items():
        if head.startswith(marks):
            return name
    return "utf-8-sig" if lines.utf8 else "cp1252" if lines.cp1252 else "latin-1"


def detect_encoding(spark: SparkSession, path) -> str:
    """By byte-order mark, else UTF-8 if every line is, else cp1252, else latin-1."""
    return _encoding(first_bytes(spark, path, 4), look_at_lines(spark, path))


def steadiest_delimiter(sample: str) -> str:
    """The one that cuts most of the first lines into the same number of columns, then into most columns."""
    lines = [x for x in sample.splitlines() if x.strip()][:10]
    best = (-1, -1, ",")
    for d in DELIMITERS:
        widths = [len(next(csv.reader([x], delimiter=d))) for x in lines]
        usual = max(set(widths), key=widths.count, default=0)
        if usual > 1 and (widths.count(usual), usual) > best[:2]:
            best = (widths.count(usual), usual, d)
    return best[2]


def detect_delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, "".join(DELIMITERS)).delimiter
    except csv.Error:
        return steadiest_delimiter(sample)


def clean_identifier(name: str | None) -> str:
    words = "".join(c if c.isalnum() else "_" for c in (name or "").strip()).split("_")
    out = "_".join(filter(None, words)) or "column"
    return f"col_{out}" if out[0].isdigit() else out


def dedupe(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


@dataclass(frozen=True)
class Layout:
    """Encoding, delimiter and cleaned column names of a file, and whether a value spans lines."""

    encoding: str
    delimiter: str
    columns: tuple[str, ...]
    spans: bool = True


def layout(spark: SparkSession, path, lines: Lines | None = None) -> Layout:
    lines, size = lines or look_at_lines(spark, path), HEAD
    head = first_bytes(spark, path, size)
    encoding = _encoding(head, lines)
    while True:
        text = codecs.getincrementaldecoder(encoding)("strict").decode(head)
        rows = csv.reader(io.StringIO(text, newline=""), delimiter=(delimiter := detect_delimiter(text[:8192])))
        header = next(rows, None)
        if len(head) < size or next(rows, None) is not None:  # a second row: the header is whole
            break
        size *= 8
        head = first_bytes(spark, path, size)
    if not header:
        raise ValueError(f"{path}: a header is needed")
    return Layout(encoding, delimiter, tuple(dedupe([clean_identifier(h) for h in header])), lines.spans)


def layouts(spark: SparkSession, paths) -> dict[str, Layout]:
    """Of many files: their lines in one pass, their heads from a few threads; ValueError names the first without a header."""
    lines = look_at_files(spark, paths)
    with ThreadPoolExecutor(THREADS) as pool:
        return dict(zip(lines, pool.map(lambda p: layout(spark, p, lines[p]), lines)))


def table_name(relative) -> str:
    """The file's stem, or its first folder unless that has a generic name."""
    parts = PurePosixPath(relative).parts
    return clean_identifier(parts[0] if len(parts) > 1 and parts[0].lower() not in GENERIC_FOLDERS else PurePosixPath(relative).stem)


# -- rows -------------------------------------------------------------------

#: Encodings whose line ends are no single bytes.
WIDE = ("utf-16", "utf-32")
PATH = "__path"


def _charset(encoding: str) -> str:
    return {"utf-8-sig": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}.get(encoding, encoding.upper())


def _own_characters(c: Column, encoding: str) -> Column:
    """cp1252 is read as latin-1, and its own characters put in place of the control characters."""
    return F.translate(c, bytes(_CONTROLS).decode("latin-1"), bytes(_CONTROLS).decode("cp1252")) if encoding == "cp1252" else c


def raw_rows(spark: SparkSession, paths, how: Layout, with_path: bool = False) -> DataFrame:
    """All rows of files of one layout as text; what stands beyond the header's columns is in EXTRA."""
    paths = [str(p) for p in (paths if isinstance(paths, list) else [paths])]
    names = [*how.columns, EXTRA]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    df = spark.read.csv(paths, schema=schema, header=True, sep=how.delimiter, quote='"', escape='"', multiLine=how.spans or how.encoding in WIDE,
                        encoding=_charset(how.encoding), enforceSchema=True, mode="PERMISSIVE", emptyValue="", nullValue=None, maxCharsPerColumn=-1)
    return df.select(*[_own_characters(F.col(f"c{i}"), how.encoding).alias(n) for i, n in enumerate(names)], *([F.col("_metadata.file_path").alias(PATH)] if with_path else []))


def is_dirty(columns) -> Column:
    """Blank rows, rows of dashes, and lone notes of an export."""
    values = F.filter(F.transform(F.array(*[F.col(f"`{c}`") for c in columns]), lambda v: F.trim(F.coalesce(v, F.lit("")), F.lit(" \t\r\n"))), lambda v: v != "")
    note = F.lower(F.try_element_at(values, F.lit(1))).rlike(f"^(?:{'|'.join(METADATA_PREFIXES)})")
    return (F.size(values) == 0) | F.forall(values, lambda v: v.rlike("^-+$")) | ((F.size(values) == 1) & note)


def clean_value(c: Column, rules: Rules = Rules()) -> Column:
    v = F.trim(c, F.lit(" \t\r\n"))
    return F.when(F.lower(v).isin(*rules.null_tokens), None).otherwise(v)


def clean_rows(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Without dirty rows, and with nulls for their spellings."""
    columns = [c for c in rows.columns if c not in (EXTRA, PATH)]
    kept = rows.filter(~is_dirty(columns))
    return kept.select(*[clean_value(F.col(f"`{c}`"), rules).alias(c) for c in columns], *[c for c in (EXTRA, PATH) if c in rows.columns])


# -- types ------------------------------------------------------------------

def _part(v: Column, pattern: str, name: str) -> Column:
    """A named number of a date pattern (the order of its groups tells which)."""
    order = [x[2] for x in pattern.split("(")[1:] if x.startswith("?<")]
    return F.regexp_extract(v, pattern, order.index(name) + 1).try_cast("int")


def as_date(v: Column, rules: Rules = Rules()) -> Column:
    def one(p: str) -> Column:
        y, m, d = (_part(v, p, n) for n in "ymd")
        return F.when(v.rlike(p), F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))

    return F.coalesce(*map(one, rules.dates))


def as_datetime(v: Column, rules: Rules = Rules()) -> Column:
    head, gap, clock = (F.regexp_extract(v, r"^(\S+?)([ T])(\d{1,2}:\d{1,2}:\d{1,2})$", i) for i in (1, 2, 3))
    day = as_date(head, rules)
    h, m, s = (F.try_element_at(F.split(clock, ":"), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    fits = day.isNotNull() & (gap != "") & ((gap == " ") | head.contains("-")) & h.between(0, 23) & m.between(0, 59) & s.between(0, 59)
    return F.when(fits, F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), h, m, s.cast("decimal(8,6)")))


def as_int(v: Column, rules: Rules = Rules()) -> Column:
    return F.when(v.rlike(r"^[+-]?[0-9]+$"), v.try_cast("long"))


def as_float(v: Column, rules: Rules = Rules()) -> Column:
    dotted = F.regexp_replace(v, ",", ".")
    return F.when(F.lower(dotted).rlike(r"^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"),
                  F.regexp_replace(F.lower(dotted), r"^([+-]?)inf(inity)?$", "$1Infinity").try_cast("double"))


#: In the order in which they are tried.
CASTS = (("timestamp_ntz", as_datetime), ("date", as_date), ("long", as_int), ("double", as_float))


def _type_counts(i: int, v: Column, rules: Rules) -> list[Column]:
    """What the type of column ``i`` rests on: how many values it has, and how many of each type."""
    return [F.count(v).alias(f"n{i}"), *[F.count(cast(v, rules)).alias(f"{kind}{i}") for kind, cast in CASTS]]


def _type_of(counts, i: int) -> str:
    n = counts[f"n{i}"]
    return next((kind for kind, _ in CASTS if n and counts[f"{kind}{i}"] == n), "string")


def infer_types(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(name, type, nullable) of each column, from one aggregate over all rows."""
    columns = [c for c in rows.columns if c not in (EXTRA, PATH)]
    one = rows.agg(F.count(F.lit(1)).alias("rows"), *[x for i, c in enumerate(columns) for x in _type_counts(i, F.col(f"`{c}`"), rules)])

    def row(i: int, c: str) -> Column:
        n = F.col(f"n{i}")
        kind = F.lit("string")
        for name, _ in reversed(CASTS):
            kind = F.when((n > 0) & (F.col(f"{name}{i}") == n), name).otherwise(kind)
        return F.struct(F.lit(c).alias("name"), kind.alias("type"), (n < F.col("rows")).alias("nullable"))

    return one.select(F.explode(F.array(*[row(i, c) for i, c in enumerate(columns)])).alias("c")).select("c.*")


@dataclass(frozen=True)
class Counts:
    """A file's layout and what its rows were counted for: clean rows, dirty ones, longer ones, and values by type (``n0``, ``long0``, ...)."""

    how: Layout
    rows: int = 0
    dirty: int = 0
    long: int = 0
    of: dict[str, int] = field(default_factory=dict)


def survey(spark: SparkSession, paths, rules: Rules = Rules()) -> dict[str, Counts]:
    """Files parsed once: a pass over all lines for the layouts, then a pass for each way of writing (encoding, delimiter, width)."""
    how = layouts(spark, paths)
    ways: dict[tuple, list[str]] = {}
    for p, x in how.items():
        ways.setdefault((x.encoding, x.delimiter, x.spans, len(x.columns)), []).append(p)

    def counted(way: tuple, files: list[str]) -> dict[str, Counts]:
        encoding, delimiter, spans, width = way
        columns = [f"c{i}" for i in range(width)]
        rows = raw_rows(spark, files, Layout(encoding, delimiter, tuple(columns), spans), True)
        dirty = is_dirty(columns)
        values = [F.when(~F.col("__dirty"), clean_value(F.col(c), rules)) for c in columns]
        got = rows.select(F.col(PATH), F.col(EXTRA).isNotNull().alias("__long"), dirty.alias("__dirty"), *columns).groupBy(PATH).agg(
            F.count_if(~F.col("__dirty")).alias("rows"), F.count_if("__dirty").alias("dirty"), F.count_if("__long").alias("long"),
            *[x for i, v in enumerate(values) for x in _type_counts(i, v, rules)]).collect()
        by = {_plain_path(r[PATH]): r.asDict() for r in got}
        return {p: Counts(how[p], c["rows"], c["dirty"], c["long"], c) if (c := by.get(_qualified(spark, p))) else Counts(how[p]) for p in files}

    with ThreadPoolExecutor(THREADS) as pool:
        return {p: c for part in pool.map(lambda w: counted(*w), ways.items()) for p, c in part.items()}


def types_of(counts: list[Counts]) -> dict[str, tuple[str, bool]]:
    """Column -> (type, nullable) of files together; a column that a file lacks is null there."""
    rows, sums = sum(c.rows for c in counts), {}
    for c in counts:
        for i, name in enumerate(c.how.columns):
            own = sums.setdefault(name, dict.fromkeys(["n0", *[f"{k}0" for k, _ in CASTS]], 0))
            for k in own:
                own[k] += c.of.get(f"{k[:-1]}{i}", 0)
    return {name: (_type_of(own, 0), own["n0"] < rows) for name, own in sums.items()}


# -- where a row stands -----------------------------------------------------

def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(line, value) of a file of lines, numbered from 1: splits count theirs, and each begins where those before it end."""
    lines = spark.read.text(str(path)).select("value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # a row for each split
    before, offsets = 0, []
    for r in sorted(splits):
        offsets.append((r.start, before - r.first + 1))
        before += r.n
    at = spark.createDataFrame(offsets, "start long, shift long")
    return lines.join(F.broadcast(at), "start").select((F.col("id") + F.col("shift")).alias("line"), "value")


def first_line_where(spark: SparkSession, path, how: Layout, bad) -> tuple[str, dict] | None:
    """("line 7" or, in files whose values span lines, "row 6", its values) of the first clean row for which ``bad(column names)`` holds."""
    names = [*how.columns, EXTRA]
    if how.spans or how.encoding in WIDE:  # such a file is one task
        rows = raw_rows(spark, path, how).withColumn("__at", F.monotonically_increasing_id() + 1)
        what = "row"
    else:
        options = {"sep": how.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "maxCharsPerColumn": "-1"}
        value = F.decode(F.col("value").cast("binary"), _charset(how.encoding))
        parsed = numbered_lines(spark, path).filter("line > 1").select("line", F.from_csv(value, ", ".join(f"c{i} string" for i in range(len(names))), options).alias("r"))
        rows = parsed.select(*[_own_characters(F.col(f"r.c{i}"), how.encoding).alias(n) for i, n in enumerate(names)], F.col("line").alias("__at"))
        what = "line"
    found = rows.filter(~is_dirty(how.columns)).filter(bad(how.columns)).orderBy("__at").limit(1).collect()
    return (f"{what} {found[0]['__at']}", found[0].asDict()) if found else None


def cast_rows(rows: DataFrame, types: dict[str, str], nullable: dict[str, bool] | None = None, rules: Rules = Rules()) -> DataFrame:
    """Typed columns; a value that can't be cast, or a null where none may be, is an error."""
    casts = dict(CASTS)

    def one(c: str) -> Column:
        v = F.col(f"`{c}`")
        out = casts[types[c]](v, rules) if types[c] in casts else v
        bad = v.isNotNull() & out.isNull()
        if nullable and not nullable[c]:
            bad = bad | v.isNull()
        if types[c] in casts or (nullable and not nullable[c]):
            why = F.concat(F.lit(f"column {c}: "), F.coalesce(v, F.lit("NULL")), F.lit(f" is no {types[c]}"))
            return F.when(bad, F.raise_error(why).cast(types[c])).otherwise(out).alias(c)
        return out.alias(c)

    return rows.select(*[one(c) for c in rows.columns if c not in (EXTRA, PATH)])


def first_rows_fit(rows: DataFrame, types: dict[str, str], n: int = 5, rules: Rules = Rules()) -> bool:
    """Whether the first clean rows can be cast; if not, a person should look before anything is written."""
    casts = dict(CASTS)
    bad = [F.col(f"`{c}`").isNotNull() & casts[t](F.col(f"`{c}`"), rules).isNull() for c, t in types.items() if t in casts]
    return not bad or rows.limit(n).filter(reduce(lambda a, b: a | b, bad)).isEmpty()


class NeedsReview(ValueError):
    """The first rows don't fit the types inferred from a sample: a person should look before anything is written."""


def _unfit(types: dict[str, tuple[str, bool]], c: str, rules: Rules) -> Column:
    """Whether a value doesn't fit its column; true or false."""
    casts, (kind, nullable) = dict(CASTS), types[c]
    v = clean_value(F.col(f"`{c}`"), rules)
    bad = v.isNotNull() & casts[kind](v, rules).isNull() if kind in casts else F.lit(False)
    return bad if nullable else bad | v.isNull()


def _check_rows(spark: SparkSession, counts: dict[str, Counts], types: dict[str, tuple[str, bool]], rules: Rules) -> None:
    """ValueError that names file, line, column and value of the first row that the types of a sample don't fit."""
    for p, c in counts.items():
        found = first_line_where(spark, p, c.how, lambda columns: reduce(lambda a, b: a | b, [_unfit(types, x, rules) for x in columns]))
        if found:
            at, row = found
            one = spark.createDataFrame([tuple(row[x] for x in c.how.columns)], T.StructType([T.StructField(x, T.StringType()) for x in c.how.columns]))
            flags = one.select(*[_unfit(types, x, rules).alias(f"u{i}") for i, x in enumerate(c.how.columns)]).first()
            column = c.how.columns[list(flags).index(True)]
            raise ValueError(f"{p}, {at}, column {column}: {row[column]!r} is no {'' if types[column][1] else 'non-null '}{types[column][0]}")


def read_files(spark: SparkSession, paths, sample_size: int | None = None, rules: Rules = Rules(), counts: dict[str, Counts] | None = None) -> tuple[DataFrame, dict[str, str], dict]:
    """Files of one table together: (typed rows, types, facts of the import).

    A row longer than the header is an error that names its file and line.  Types come from all
    rows, or from ``sample_size`` of them; then every row is checked against them first.
    ``counts``: a survey that holds these files, if there is one already.
    """
    counts = {str(p): counts[str(p)] for p in paths} if counts else survey(spark, paths, rules)
    for p, c in counts.items():
        if c.long:
            at, row = first_line_where(spark, p, c.how, lambda columns: F.col(EXTRA).isNotNull()) or ("a dirty row", {})
            raise ValueError(f"{p}, {at}: more values than the {len(c.how.columns)} columns of the header ({c.long} such row(s)); "
                             f"values with {c.how.delimiter!r} must be quoted: {row}")
    alike: dict[Layout, list[str]] = {}
    for p, c in counts.items():
        alike.setdefault(c.how, []).append(p)
    rows = clean_rows(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [raw_rows(spark, own, how) for how, own in alike.items()]), rules)
    if sample_size:
        types = {r.name: (r.type, r.nullable) for r in infer_types(rows.limit(sample_size), rules).collect()}
        if not first_rows_fit(rows, {c: t for c, (t, _) in types.items()}, rules=rules):
            raise NeedsReview(f"{', '.join(counts)}: the first rows don't fit the types inferred from {sample_size} rows")
        _check_rows(spark, counts, types, rules)
    else:
        types = types_of(list(counts.values()))
    some = next(iter(counts.values()))
    kinds = {c: t for c, (t, _) in types.items()}
    return (cast_rows(rows, kinds, {c: n for c, (_, n) in types.items()}, rules), kinds,
            {"skipped_dirty_rows": sum(c.dirty for c in counts.values()), "encoding": some.how.encoding, "delimiter": some.how.delimiter})


def read_table(spark: SparkSession, paths, sample_size: int | None = None, rules: Rules = Rules()) -> tuple[DataFrame, dict[str, str]]:
    """Files of one table together: (typed rows, types)."""
    return read_files(spark, paths, sample_size, rules)[:2]


def read_folder(spark: SparkSession, folder, rules: Rules = Rules()) -> dict[str, DataFrame]:
    """Every table of a folder, by name."""
    files: dict[str, list[str]] = {}
    for p in csv_files(spark, folder):
        files.setdefault(table_name(p), []).append(f"{folder}/{p}")
    counts = survey(spark, [p for ps in files.values() for p in ps], rules) if files else {}
    return {t: read_files(spark, ps, rules=rules, counts=counts)[0] for t, ps in files.items()}


def import_file(spark: SparkSession, path, target: str, if_exists: str = "append", store=None, rules: Rules = Rules(), sample_size: int | None = None,
                counts: dict[str, Counts] | None = None) -> dict:
    """One file into a Parquet table; the record of the run says how it went.

    Its status is success, failed (the error is raised again) or needs_human_review: then nothing is written.

    With a ``store`` the record joins its ``ingestion_runs``, of a failed run too.  Rows are counted as they are written.
    """
    from pyspark.sql import Observation

    modes = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}
    run = {"run_ts": time.time_ns() // 1000, "source_file": str(path), "target": target, "status": "failed", "rows": 0, "skipped_dirty_rows": 0,
           "encoding": "", "delimiter": "", "columns": "", "error": ""}
    try:
        df, types, facts = read_files(spark, [path], sample_size, rules, counts)
        run |= facts | {"columns": ",".join(f"{k} {v}" for k, v in types.items())}
        written = Observation()
        df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode(modes[if_exists]).parquet(target)
        run |= {"status": "success", "rows": written.get["rows"]}
        return run
    except NeedsReview as e:
        run |= {"status": "needs_human_review", "error": str(e)[:500]}
        return run
    except Exception as e:
        run["error"] = str(e)[:500]
        raise
    finally:
        if store is not None:
            store.put_records("ingestion_runs", [run])


def import_folder(spark: SparkSession, folder, target: str, store=None, rules: Rules = Rules(), sample_size: int | None = None) -> list[dict]:
    """All files of a folder; the first of a table replaces it, later ones append. Stops at the first that fails; files are surveyed together."""
    seen, runs = set(), []
    files = csv_files(spark, folder)
    try:
        counts = survey(spark, [f"{folder}/{p}" for p in files], rules) if files else {}
    except ValueError:  # one has no header: the others' records come first
        counts = None
    for p in files:
        t = table_name(p)
        runs.append(import_file(spark, f"{folder}/{p}", f"{target}/{t}", "append" if t in seen else "replace", store, rules, sample_size, counts))
        if runs[-1]["status"] == "success":
            seen.add(t)
    return runs
