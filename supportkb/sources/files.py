"""Readers: tables, text files, header and headerless TSV, lenient JSON lines, asset listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportkb.functions.text import split_lines
from supportkb.sources import lines

# The capture log that lies among the sheet texts, file kinds, and name patterns.
CAPTURE_LOG = "_capture_log.txt"
VIDEO_TYPES = ["mp4", "mov", "avi", "mkv", "webm"]
IMAGE_TYPES = ["jpg", "jpeg", "png"]
SMALL_SCAN = 8
MANUAL_FOLDER = "说明书"
SPEC_FOLDER_WORDS = ["规格书", "规格", "spec", "Spec"]
WORKBOOK_NAME = "(?i)售后.*(方案|对应)|日本站售后"
SHEET_TEXT_NAME = r"(?i)^kdocs_.*\.txt$"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.parquet(path))


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan of a few partitions, such as one file with one row group. ``SMALL_SCAN`` partitions of the scan
    split size bound what is moved; larger scans are left as they are, whatever the number of cores."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < min(cores, SMALL_SCAN) else scan


def scan_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: stem, file, text. A leading byte-order mark is dropped and the
    capture log is left out."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return (raw.select(name.alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))
            .filter(F.col("file") != CAPTURE_LOG)
            .select(stem(F.col("file")).alias("stem"), "file", "text"))


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*\z", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)\z", 1))


def index_columns(line: Column, kind: str) -> Column:
    """Cells of one index line. ``plain``: name, blob. ``paged``: name, page, blob. ``params``:
    name, page, rest. ``chat``: id, title, project, rest. The last cell of params and chat keeps
    its tabs; extra cells of a page line are ignored."""
    cells = {"plain": 2, "params": 3, "chat": 4}
    return F.split(line, "\t", cells[kind]) if kind in cells else F.split(line, "\t")


def scan_index_tsv(rows: DataFrame, line: str, kind: str, order: str, header: bool) -> DataFrame:
    """Index lines to rows; lines with too few cells are skipped. ``order`` numbers the lines of a
    file from 0, so a header is the line numbered 0."""
    need = {"plain": 2, "paged": 3, "params": 3, "chat": 4}[kind]
    cells = rows.withColumn("_c", index_columns(F.col(line), kind)).filter(F.size("_c") >= need)
    if header:
        cells = cells.filter(F.col(order) > 0)
    c = lambda i: F.get("_c", F.lit(i))
    empty = F.lit("")
    name, page, blob, ref = {
        "plain": (c(0), empty, c(1), empty),
        "paged": (c(0), c(1), c(2), empty),
        "params": (c(0), c(1), c(2), empty),
        "chat": (c(1), c(2), c(3), c(0)),
    }[kind]
    return cells.select(F.col(order).alias("row_ord"), name.alias("name"), page.alias("page"),
                        blob.alias("blob"), ref.alias("ref"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """Lines of whole-text files with their number in the file."""
    return files.select("stem", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line")).filter(
        "line <> ''")


def numbered_file_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """stem, file, line_no, line of the non-empty lines of large files, cut into blocks."""
    found = lines.numbered_lines(spark, path, pattern)
    name = base_name(F.col("file"))
    return found.select(stem(name).alias("stem"), "file", "line_no", "line")


def read_sheet_rows(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """sheet, row_no, text: the quoted rows of large sheet files, cut into blocks; sheets go by their file's stem."""
    found = lines.quoted_rows(spark, path, pattern)
    return found.select(stem(base_name(F.col("file"))).alias("sheet"), "row_no", "text").filter(F.col("sheet") != stem(F.lit(CAPTURE_LOG)))


def read_export_documents(spark: SparkSession, path: str) -> DataFrame:
    """folder, input, ord, text of the chat exports below a folder, one row per JSON document: the whole of a .json file, a
    line of a .jsonl file, which may be of any size. ``folder`` is the project, the file's folder below ``path``, empty for
    conversations.json and conversations.jsonl. ``input`` gives the order of files: those two names first, then other
    .json, then other .jsonl, each by path; ``ord`` is the place in the file. Later inputs win in an import."""
    whole = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
             .select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("ord"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
             .filter(~F.col("file").endswith(".meta.json")))
    by_line = lines.numbered_lines(spark, path, "*.jsonl").select("file", F.col("line_no").alias("ord"), F.col("line").alias("text"))
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    below = F.substring_index(F.col("file"), root, -1)
    name, lined = base_name(F.col("file")), F.col("file").endswith(".jsonl")
    main = name.isin("conversations.json", "conversations.jsonl")
    kind = F.when(main & ~lined, 0).when(main, 1).when(~lined, 2).otherwise(3)
    folder = F.when(main, F.lit("")).otherwise(F.regexp_replace(below, r"/?[^/]*\z", ""))
    return whole.unionByName(by_line).select(folder.alias("folder"), F.struct(kind.alias("kind"), below.alias("path")).alias("input"), "ord", "text")


def read_index_tsv(spark: SparkSession, path: str, kind: str, header: bool) -> DataFrame:
    """Index rows of a TSV file. Written to Parquet once, later queries read columns and not text."""
    return scan_index_tsv(numbered_file_lines(spark, path, "*.tsv"), "line", kind, "line_no", header)


def scan_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines by schema; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def asset_inventory(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """Recursive listing: path, length, modificationTime. File contents are never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select("path", "length", "modificationTime"))
    return files.filter(extension(F.col("path")).isin(kinds))


_IMAGE_NAME = r"(?i)^(.+)_p-(\d+)\.(jpg|jpeg|png)$"


def page_image_names(images: DataFrame, path: str = "path") -> DataFrame:
    """Parse ``<base>_p-<n>.<type>``: adds base, num, parsed. Other names keep parsed = false."""
    name = base_name(F.col(path))
    return images.select(
        "*", F.regexp_extract(name, _IMAGE_NAME, 1).alias("base"),
        F.regexp_extract(name, _IMAGE_NAME, 2).try_cast("int").alias("num"),
        name.rlike(_IMAGE_NAME).alias("parsed"))


def dedupe_assets_by_name(assets: DataFrame, path: str = "path") -> DataFrame:
    """Of the files sharing a base name, the largest, then newest. The best file per name is an
    aggregate, so copies combine before the shuffle. Adds ``copies``."""
    key = F.lower(stem(base_name(F.col(path))))
    best = F.max_by(F.struct(*assets.columns), F.struct("length", "modificationTime", path))
    return (assets.groupBy(key.alias("base_key")).agg(best.alias("b"), F.count(F.lit(1)).alias("copies"))
            .select("base_key", "b.*", "copies"))


def select_source_files(assets: DataFrame, cache_prefix: str, path: str = "path") -> DataFrame:
    """Sheet texts and support workbooks, outside the cache folder. Adds kind."""
    name = base_name(F.col(path))
    kind = (F.when(name.rlike(SHEET_TEXT_NAME), "sheet_text")
            .when((extension(F.col(path)) == "xlsx") & name.rlike(WORKBOOK_NAME), "workbook"))
    return (assets.withColumn("kind", kind).filter(F.col("kind").isNotNull())
            .filter(~F.startswith(F.lower(F.col(path)), F.lit(cache_prefix.lower()))))


def spec_file_filter(assets: DataFrame, path: str = "path", words: list[str] | None = None,
                     types: tuple = ("xlsx", "pdf"), root: str | None = MANUAL_FOLDER) -> DataFrame:
    """Files of the given types whose parent folder name holds a spec word, below a folder of ``root`` (anywhere when None)."""
    parent = F.get(F.reverse(F.split(F.col(path), r"[/\\]")), F.lit(1))
    hit = F.lit(False)
    for w in words or SPEC_FOLDER_WORDS:
        hit = hit | F.contains(parent, F.lit(w))
    if root is not None:
        hit = hit & F.col(path).rlike(rf"(^|[/\\])\Q{root}\E[/\\][^/\\]+[/\\]")
    return assets.filter(extension(F.col(path)).isin(*types) & hit)


def representative_query(faq: DataFrame, rows: DataFrame) -> DataFrame:
    """A question that must be answerable: the first non-empty one of the FAQ items, else the first 12 characters of the
    first text of four or more of the sheet, manual or spec layer, in that order; ties by product and text. One minimum
    over all rows, which combines before the exchange. One row: product, q."""
    empty, first = F.lit(""), F.lit(0)
    asked = faq.filter("question <> ''").select(first.alias("a"), F.col("sheet").alias("s"), F.col("item_ord").cast("long").alias("o"),
                                                F.col("sheet").alias("product"), F.col("question").alias("q"))
    layer = F.array_position(F.array(*[F.lit(x) for x in ("KDOCS", "OCR", "SPEC")]), F.col("layer")).cast("int")
    shown = rows.filter((layer > 0) & (F.char_length("blob") >= 4)).select(
        layer.alias("a"), empty.alias("s"), F.col("row_ord").cast("long").alias("o"), empty.alias("product"),
        F.substring("blob", 1, 12).alias("q"))
    best = asked.unionByName(shown).agg(F.min(F.struct("a", "s", "o", "product", "q")).alias("b"))
    return best.filter("b IS NOT NULL").select("b.product", "b.q")
