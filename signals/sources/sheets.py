"""Raw sheets: all-text rows with banner rows above the header."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from signals.functions.text import fold_text
from signals.operators.masking import has_hint, mask_table, masked_row, rule_for
from signals.sources.scratch import write_once
from signals.sources.tables import path_exists

# Words that mark a header cell.
HEADER_HINTS = (
    "cod",
    "cód",
    "codigo",
    "nome",
    "data",
    "valor",
    "qtde",
    "quant",
    "pedido",
    "cpf",
    "email",
    "telefone",
    "origem",
    "status",
    "nivel",
    "endereco",
)
DEFAULT_HEADER_LINE = 2
SCAN_LINES = 10
LINE = "_line"


def text_schema(n_columns: int) -> StructType:
    return StructType([StructField(f"c{i}", StringType()) for i in range(n_columns)])


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, folder or pattern, by name; metadata only."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(root) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [x.getPath().toString() for x in inside if x.isFile() and x.getPath().getName()[0] not in "._"]
    return sorted(found)


def sheet_records(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """``_file, _start, _row, value``: the records of text files, those with quoted line breaks whole.

    Files are split and read in parallel. A line is inside quotes if an odd number of quote marks stands before it in its
    file: the marks before its split, a running sum over one row per split, and those before it in the split. Only splits that
    hold a line with an odd number of marks, or begin inside quotes, are numbered line by line, and only the lines of
    records that go over several are gathered, one small group a record. ``_row`` orders the records of a
    split. A file whose marks do not pair raises.
    """
    lines = spark.read.option("lineSep", "\n").text(list(files)).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
        F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)).alias("_odd"),
    )
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = write_once(
        lines.groupBy("_file", "_start")
        .agg(F.sum("_odd").alias("odd"))
        .withColumn("_open", F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)))
    )
    unpaired = splits.groupBy("_file").agg(F.sum("odd").alias("n")).where(F.col("n") % 2 == 1)
    bad = [r["_file"] for r in unpaired.orderBy("_file").limit(3).collect()]
    if bad:
        raise ValueError(f"quote marks do not pair in {bad}")
    plain = lambda text: F.regexp_replace(text, "\r$", "")
    mixed = splits.where((F.col("odd") > 0) | (F.col("_open") > 0)).select("_file", "_start", "_open")
    whole = lines.join(mixed, ["_file", "_start"], "left_anti").select("_file", "_start", "_row", plain("value").alias("value"))
    if mixed.isEmpty():
        return whole
    order = Window.partitionBy("_file", "_start").orderBy("_row")
    marks = F.coalesce(F.sum("_odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = write_once(
        lines.join(mixed, ["_file", "_start"])
        .withColumn("_inside", F.pmod(F.col("_open") + marks, F.lit(2)))
        .withColumn("_begin", F.last(F.when(F.col("_inside") == 0, F.col("_row")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_open")
    )
    single = placed.where((F.col("_inside") == 0) & (F.col("_odd") == 0)).select("_file", "_start", "_row", plain("value").alias("value"))
    # A split that begins inside a record goes on with the last record begun in a split before it.
    begun = placed.groupBy("_file", "_start").agg(F.struct("_start", F.max("_begin").alias("_row")).alias("last"))
    carried = begun.select(
        "_file", "_start", F.last(F.when(F.col("last._row").isNotNull(), F.col("last")), ignorenulls=True).over(before).alias("_from")
    )
    parts = placed.where((F.col("_inside") == 1) | (F.col("_odd") == 1)).join(carried, ["_file", "_start"])
    head = F.when(F.col("_begin").isNotNull(), F.struct("_start", F.col("_begin").alias("_row"))).otherwise(F.col("_from"))
    pieces = parts.select("_file", head.alias("_head"), F.struct("_start", "_row", "value").alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["value"]), "\n")
    several = pieces.groupBy("_file", "_head").agg(joined.alias("value"))
    return whole.unionByName(single).unionByName(
        several.select("_file", F.col("_head._start").alias("_start"), F.col("_head._row").alias("_row"), plain("value").alias("value"))
    )


def _commas(value: Column) -> Column:
    """Commas outside quotes."""
    return F.regexp_count(F.regexp_replace(value, '"([^"]|"")*"', ""), F.lit(","))


def _as_array(value: Column, width: int) -> Column:
    """The cells of a record as an array of ``width`` texts."""
    cells = F.from_csv(value, ", ".join(f"c{i} string" for i in range(width)), {"multiLine": "true", "escape": '"'})
    return F.array(*[cells[f"c{i}"] for i in range(width)])


def file_headers(records: DataFrame, line: int | None) -> DataFrame:
    """``_file, _at, names``: where the header record of each file is, and its trimmed cells.

    ``line`` is the record's number in every file, blank ones counted; None finds it in each file by its header words.
    """
    order = Window.partitionBy("_file").orderBy("_row")
    top = records.where(F.col("_start") == 0).withColumn("_n", F.row_number().over(order) - 1).where(F.col("_n") < SCAN_LINES)
    top = write_once(top)
    width = (top.agg(F.max(_commas(F.col("value"))).alias("n")).first()["n"] or 0) + 1
    cells = top.withColumn("_cells", F.transform(_as_array(F.col("value"), width), lambda x: F.trim(F.coalesce(x, F.lit("")))))
    if line is not None:
        found = cells.where(F.col("_n") == line)
    else:
        folded = F.transform("_cells", fold_text)
        score = F.size(F.filter(folded, lambda t: (F.length(t) >= 2) & has_hint(t, HEADER_HINTS)))
        best = cells.withColumn("_score", score).groupBy("_file").agg(
            F.max_by("_n", F.struct("_score", -F.col("_n"))).alias("_best"), F.max("_score").alias("_top"), F.count(F.lit(1)).alias("_lines")
        )
        place = F.when((F.col("_top") < 2) & (F.col("_lines") > 1), 1).otherwise(F.col("_best"))
        found = cells.join(best.select("_file", place.alias("_best")), "_file").where(F.col("_n") == F.col("_best"))
    own = F.slice("_cells", F.lit(1), _commas(F.col("value")).cast("int") + 1)
    return found.select("_file", F.col("_row").alias("_at"), own.alias("names"))


def read_top_lines(spark: SparkSession, file: str, lines: int = SCAN_LINES) -> DataFrame:
    """The first lines of one file as a sheet, numbered from 0 and as wide as the widest of them; a blank line has no cells.

    ``take`` at the root of the plan reads the file from its start and no further than it must.
    """
    taken = [r[0] for r in spark.read.text(file).take(lines)]
    cells = [[cell or None for cell in row] for row in csv.reader(line + "\n" for line in taken)]
    width = max((len(r) for r in cells), default=0)
    schema = StructType([StructField(LINE, IntegerType()), *text_schema(width).fields])
    return spark.createDataFrame([(i, *r, *[None] * (width - len(r))) for i, r in enumerate(cells)], schema)


def _cells(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != LINE]


def header_score(df: DataFrame, hints: Sequence[str] = HEADER_HINTS) -> Column:
    """Number of cells of a row that contain a header word."""
    folded = [fold_text(F.coalesce(F.col(c), F.lit(""))) for c in _cells(df)]
    hit = [((F.length(t) >= 2) & has_hint(t, hints)).cast("int") for t in folded]
    return sum(hit[1:], hit[0])


def header_line(sheet: DataFrame, hints: Sequence[str] = HEADER_HINTS) -> DataFrame:
    """The line among the first ten with most header words, the first on ties;
    line 1 when no line has two of them. One row."""
    top = sheet.filter(F.col(LINE) < SCAN_LINES).select(LINE, header_score(sheet, hints).alias("score"))
    best = top.agg(
        F.max_by(LINE, F.struct(F.col("score"), -F.col(LINE))).alias("line"),
        F.max("score").alias("score"),
        F.count(F.lit(1)).alias("n"),
    )
    fallback = (F.col("score") < 2) & (F.col("n") > 1)
    return best.select(F.when(fallback, 1).otherwise(F.col("line")).cast("int").alias("header_line"), "score")


def header_names(sheet: DataFrame, line: int) -> dict[str, str]:
    """Cell column to trimmed header text; columns with a blank header are left out."""
    row = sheet.filter(F.col(LINE) == line).first()
    if row is None:
        raise ValueError(f"the sheet has no line {line}")
    names = {c: (row[c] or "").strip() for c in _cells(sheet)}
    return {c: n for c, n in names.items() if n}


def promote_header(body: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Name the body columns by the header; unnamed columns are dropped."""
    return body.select(*[F.col(c).alias(n) for c, n in names.items()])


def numbered_body(sheet: DataFrame, line: int = DEFAULT_HEADER_LINE) -> DataFrame:
    """S3 for a numbered sheet: the rows below the header, under its names."""
    return promote_header(sheet.filter(F.col(LINE) > line), header_names(sheet, line))


def _read_headers(records: DataFrame, line: int | None) -> DataFrame:
    """The headers of all files that hold anything, written once; a file without one raises."""
    headers = write_once(file_headers(records, line))
    lacking = records.select("_file").distinct().join(headers, "_file", "left_anti").orderBy("_file").limit(3).collect()
    if lacking or headers.isEmpty():
        raise ValueError(f"the sheet has no line {line if line is not None else 1}: {[r['_file'] for r in lacking]}")
    return headers


def ingest_sheets(
    spark: SparkSession, path: str, line: int | None = DEFAULT_HEADER_LINE, wide: str | None = None, lenient: bool = False
) -> DataFrame:
    """S3: exported files as one text table.

    ``path`` is a file, a folder or a pattern. Each file has its own header, in record ``line`` or, with None, found by its
    header words, so banners may differ in height. Cells are taken by their name in their own file's header, so files may
    order columns differently; the first file by name sets the columns. A file that names other columns raises, or, with
    ``lenient``, gives nulls for those it lacks and drops those it has besides. Nameless columns are dropped; a name that
    stands twice raises.

    Banner and header go by their place in each file, so a body row that reads like one of them stays; blank records count
    above the header and are skipped below. A row with more cells than its header raises, or, if ``wide`` names a column, is kept with
    its whole record there (null elsewhere); shorter rows end in nulls. Quoted cells may hold commas, doubled quotes and line
    breaks (kept as line feeds, with a carriage return before them if there was one). Files may be split and read
    in any order; records are written once and read back.
    """
    files = files_of(spark, path)
    if not files:
        raise FileNotFoundError(path)
    records = write_once(sheet_records(spark, files))
    headers = _read_headers(records, line)
    named = F.filter("names", lambda x: x != "")
    first = headers.orderBy("_file").first()
    names = [n for n in first["names"] if n]
    if len(set(names)) < len(names):
        raise ValueError(f"a column name stands twice: {names}")
    wanted = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    other = headers.where(F.array_sort(named) != F.array_sort(wanted)).select("_file", named.alias("names"))
    bad = [] if lenient else other.orderBy("_file").limit(3).collect()
    if bad:
        raise ValueError(f"columns differ from {names}: " + "; ".join(f"{r['_file']} has {r['names']}" for r in bad))
    width = headers.agg(F.max(F.size("names")).alias("n")).first()["n"]
    places = headers.select(
        "_file", "_at", F.size("names").alias("_width"), F.transform(wanted, lambda n: F.array_position("names", n).cast("int")).alias("_places")
    )
    above = (F.col("_start") == 0) & (F.col("_row") <= F.col("_at"))
    body = records.join(places, "_file").where(~above & (F.trim("value") != ""))
    # Cells behind the last named one do not count: exports end rows with empty cells.
    too_wide = _commas(F.col("value")) >= F.col("_width")
    cells = body.select(_as_array(F.col("value"), width).alias("_c"), "_places", F.when(too_wide, F.col("value")).alias("_wide"))
    at = lambda i: F.element_at("_places", i + 1)
    picked = [F.when(at(i) > 0, F.try_element_at("_c", F.greatest(at(i), F.lit(1)))).alias(n) for i, n in enumerate(names)]
    if wide is not None:
        return cells.select(*picked, F.col("_wide").alias(wide))
    failed = F.raise_error(F.concat(F.lit("more cells than the header: "), "_wide"))
    return cells.filter(F.when(F.col("_wide").isNotNull(), failed.cast("boolean")).otherwise(True)).select(*picked)


def sheet_mask(sheet: DataFrame, line: int, hints: Sequence[str] = HEADER_HINTS) -> Column:
    """K7 for a numbered sheet."""
    return masked_row(F.col(LINE), F.lit(line), F.array(*_cells(sheet)), hints)


def mask_sheet(sheet: DataFrame, line: int, salt: str) -> DataFrame:
    """A numbered sheet with its personal data masked, layout kept."""
    names = header_names(sheet, line)
    rules = {c: rule_for(names[c]) if c in names else None for c in _cells(sheet)}
    rules[LINE] = None
    return mask_table(sheet, salt, [LINE], rules, sheet_mask(sheet, line))


def mask_sheet_files(spark: SparkSession, path: str, target: str, salt: str, line: int | None = None) -> int:
    """S9 for raw files: masked copies with banner, header and column order kept; returns the number of files.

    Each file's header is found like in ``ingest_sheets`` and names the rule of each of its columns. Rows below it are masked, and
    rows above that are mostly data (K7). A copy is a folder ``arquivo=<name>`` of text parts, in the order of the file. Files
    of one header are masked by one projection; there are as many as different headers.
    """
    files = files_of(spark, path)
    if not files:
        raise FileNotFoundError(path)
    records = write_once(sheet_records(spark, files))
    headers = _read_headers(records, line)
    layouts = [r["names"] for r in headers.select("names").distinct().orderBy("names").collect()]
    place = F.when((F.col("_start") == 0) & (F.col("_row") <= F.col("_at")), F.col("_row") - F.col("_at")).otherwise(1)
    held = ["_file", "_start", "_row", "value", "_wide", "_masked"]
    out = None
    for names in layouts:
        width = len(names)
        columns = [f"c{i}" for i in range(width)]
        own = headers.where(F.col("names") == F.array(*[F.lit(n) for n in names])).select("_file", "_at")
        rows = records.join(own, "_file").select(
            "_file", "_start", "_row", "value", place.alias("_line"), _as_array(F.col("value"), width).alias("_c")
        )
        hidden = masked_row(F.col("_line"), F.lit(0), F.col("_c"), HEADER_HINTS) & (F.trim("value") != "")
        cells = rows.withColumns({"_wide": _commas(F.col("value")) >= width, "_masked": hidden}).select(
            *held, *[F.element_at("_c", i + 1).alias(c) for i, c in enumerate(columns)]
        )
        rules = {c: rule_for(n) if n else None for c, n in zip(columns, names, strict=True)} | dict.fromkeys(held)
        masked = mask_table(cells, salt, ["_file", "_start", "_row"], rules, F.col("_masked"))
        # A row wider than its header has cells without a rule: nothing of it is let through.
        written = F.to_csv(F.struct(*columns), {"escape": '"'})
        text = F.when(~F.col("_masked"), F.col("value")).when(F.col("_wide"), F.lit("")).otherwise(written)
        part = masked.select("_file", "_start", "_row", text.alias("value"))
        out = part if out is None else out.unionByName(part)
    named = out.withColumn("arquivo", F.regexp_extract("_file", "([^/]+)$", 1))
    ordered = named.repartitionByRange("arquivo", "_start", "_row").sortWithinPartitions("arquivo", "_start", "_row")
    ordered.select("arquivo", "value").write.mode("overwrite").partitionBy("arquivo").text(target)
    return len(files)


def mask_files(
    spark: SparkSession, files: Mapping[str, tuple[str, Sequence[str]]], target_root: str, salt: str
) -> list[str]:
    """Masked parquet copies of the tables that exist; returns the names written.

    ``files`` maps a name to its parquet path and row key.
    """
    done = []
    for name, (path, key) in files.items():
        if path_exists(spark, path):
            masked = mask_table(spark.read.parquet(path), salt, key)
            masked.write.mode("overwrite").parquet(f"{target_root}/{name}")
            done.append(name)
    return done
