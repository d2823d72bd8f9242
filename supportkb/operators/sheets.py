"""Support sheets: workbook cells to text rows, quoted text to cells, cells to FAQ items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supportkb import defaults as D
from supportkb.functions.text import clean_cell, contains_any, strip, unquote_stripped, with_fields
from supportkb.operators.ordered import running_sums
from supportkb.sizing import broadcast_if_small, cut_lineage

FIELDS = [name for name, _ in D.COLUMN_RULES]
ROW_BLOCK = 100_000
_TAB, _NEWLINE = "\ue000", "\ue001"


# --- quoted sheet text -------------------------------------------------------------------------

def split_quoted_rows(text: Column) -> Column:
    """array<array<string>>: rows and raw cells of tab-separated text whose quotes - anywhere in a
    cell - protect tabs and newlines. Inside quotes both are masked by private characters, so two
    plain splits remain."""
    parts = F.transform(F.split(text, '"', -1), lambda s, i: F.when(
        i % 2 == 1, F.translate(s, "\t\n", _TAB + _NEWLINE)).otherwise(s))
    rows = F.split(F.array_join(parts, '"'), "\n", -1)
    return F.transform(rows, lambda r: F.transform(
        F.split(r, "\t", -1), lambda c: F.translate(c, _TAB + _NEWLINE, "\t\n")))


def _cleaned(row: Column) -> Column:
    # Strip and unquote in passes of their own: inside a lambda a repeated expression is computed each time.
    return F.transform(F.transform(F.transform(row, strip), unquote_stripped), clean_cell)


def sheet_rows(sheets: DataFrame) -> DataFrame:
    """Cleaned, non-blank rows of each sheet as one nested array: sheet, rows."""
    cleaned = F.transform(split_quoted_rows(F.col("text")), _cleaned)
    return sheets.select("sheet", F.filter(cleaned, lambda r: F.exists(r, lambda c: c != "")).alias("rows"))


def is_header_row(cells: Column) -> Column:
    joined = F.array_join(cells, "")
    return contains_any(joined, D.HEADER_DATE) & contains_any(joined, D.HEADER_COLUMNS)


def find_header(rows: Column, within: int | None = None) -> Column:
    """Index of the first header among the non-blank rows (or the first ``within`` of them), NULL without one."""
    return F.array_min(F.transform(rows if within is None else F.slice(rows, 1, within), lambda r, i: F.when(is_header_row(r), i)))


def _field_of(cell: Column) -> Column:
    c = strip(cell)
    out = F.lit(None).cast("string")
    for name, prefixes in reversed(D.COLUMN_RULES):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith(c, F.lit(p))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def column_map(header: Column) -> Column:
    """struct<field: index> of a header row; a later column of the same field wins."""
    named = F.transform(header, lambda c: _field_of(c))
    last = lambda f: F.array_max(F.transform(named, lambda n, i: F.when(n == f, i)))
    return F.struct(*[last(f).alias(f) for f in FIELDS])


def _is_media(cell: Column) -> Column:
    return F.contains(cell, F.lit("DISPIMG")) | F.startswith(cell, F.lit("ID_"))


def _empty_media() -> Column:
    return F.array().cast("array<string>")


def map_row(cells: Column, cmap: Column) -> Column:
    """struct of the eight fields and the media cells of a row under a column map."""
    get = lambda f: F.coalesce(strip(F.get(cells, cmap[f])), F.lit(""))
    return F.struct(*[get(f).alias(f) for f in FIELDS],
                    F.transform(F.filter(cells, _is_media), strip).alias("media"))


def fallback_row(cells: Column) -> Column:
    """Row of a sheet without header: a leading date, the first text as question, the rest joined."""
    filled = F.filter(cells, lambda c: c != "")
    first = F.get(filled, F.lit(0))
    dated = F.coalesce(first.rlike(r"^20\d{2}[/\-.]\d{1,2}[/\-.]\d{1,2}"), F.lit(False))
    rest = F.when(dated, F.slice(filled, 2, F.greatest(F.size(filled) - 1, F.lit(0)))).otherwise(filled)
    value = {
        "date": F.when(dated, first).otherwise(""),
        "question": F.coalesce(F.get(rest, F.lit(0)), F.lit("")),
        "answer": F.when(F.size(rest) > 1, F.array_join(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), " | ")).otherwise(""),
    }
    return F.struct(*[value.get(f, F.lit("")).alias(f) for f in FIELDS], _empty_media().alias("media"))


def faq_items(sheets: DataFrame, header_within: int | None = None) -> DataFrame:
    """Sheets to FAQ items: sheet, item_ord, the eight fields, media. The header row is dropped
    (rows before it stay), as are rows of media references only. A sheet is one row until its
    items are exploded, so nothing is shuffled. ``header_within`` looks for the header in the first rows only."""
    found = sheet_rows(sheets).withColumn("_h", find_header(F.col("rows"), header_within))
    mapped = found.withColumn("_map", column_map(F.coalesce(F.get("rows", F.col("_h")), _empty_media())))
    # A header may name no known field at all; such a sheet reads like one without header.
    usable = F.coalesce(*[F.col(f"_map.{f}") for f in FIELDS]).isNotNull()
    # The outer form keeps the optimizer from adding a "size > 0" filter that parses the text twice.
    data = (mapped.select("sheet", "_h", "_map", usable.alias("_usable"), F.posexplode_outer("rows").alias("item_ord", "cells"))
            .filter("item_ord IS NOT NULL"))
    return _items(data)


def _items(rows: DataFrame) -> DataFrame:
    """Items of non-blank rows: sheet, item_ord, cells, the header's place _h, its map _map and whether that is _usable."""
    cells = F.col("cells")
    data = (rows.filter(~F.coalesce(F.col("item_ord") == F.col("_h"), F.lit(False)))
            .filter(F.exists(cells, lambda c: (c != "") & ~_is_media(c))))
    item = F.when(F.col("_usable"), map_row(cells, F.col("_map"))).otherwise(fallback_row(cells))
    out = with_fields(data.select("sheet", "item_ord", "_usable", "_map", "cells"), item)
    real = F.exists(F.array(*[F.col(f) for f in FIELDS]), lambda v: (v != "") & ~_is_media(v))
    return out.filter(~F.col("_usable") | real).select("sheet", "item_ord", *FIELDS, "media")


def large_sheet_rows(rows: DataFrame) -> DataFrame:
    """sheet, item_ord, cells of the non-blank rows of sheets whose rows (sheet, row_no, text) are rows of a table, so that a sheet
    of any size is many tasks."""
    # The cells are taken once: the filter reads a generated column, the running number what was written.
    cells = F.struct(_cleaned(F.get(split_quoted_rows(F.col("text")), F.lit(0))).alias("cells"))
    filled = cut_lineage(with_fields(rows, cells).select("sheet", "row_no", "cells").filter(F.exists("cells", lambda c: c != "")))
    numbered = running_sums(filled, ["sheet"], F.floor(F.col("row_no") / ROW_BLOCK), ["row_no"], _n=F.lit(1).cast("long"))
    return numbered.select("sheet", (F.col("_n") - 1).alias("item_ord"), "cells")


def large_faq_items(rows: DataFrame, header_within: int | None = None) -> DataFrame:
    """``faq_items`` of such rows: the header of a sheet is a minimum over its rows, joined to them."""
    found = large_sheet_rows(rows)
    maybe = found if header_within is None else found.filter(F.col("item_ord") < header_within)
    header = (maybe.filter(is_header_row(F.col("cells"))).groupBy("sheet").agg(F.min(F.struct("item_ord", "cells")).alias("h"))
              .select("sheet", F.col("h.item_ord").alias("_h"), column_map(F.col("h.cells")).alias("_map")))
    none = F.struct(*[F.lit(None).cast("int").alias(f) for f in FIELDS])
    joined = found.join(broadcast_if_small(header), "sheet", "left").withColumn("_map", F.coalesce("_map", none))
    return _items(joined.withColumn("_usable", F.coalesce(*[F.col(f"_map.{f}") for f in FIELDS]).isNotNull()))


# --- workbook cells ----------------------------------------------------------------------------

def column_index(ref: Column) -> Column:
    """0-based column of a cell reference such as AB12."""
    letters = F.regexp_extract(F.upper(ref), "^([A-Z]+)", 1)
    value = F.aggregate(F.split(letters, ""), F.lit(0),
                        lambda acc, ch: F.when(ch == "", acc).otherwise(acc * 26 + F.ascii(ch) - 64))
    return F.greatest(value - 1, F.lit(0))


def decode_cells(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Decoded value per cell: shared strings by index, booleans, others as they are.

    ``cells``: sheet, row, ref, t, v; ``strings``: idx, text."""
    idx = F.when((F.col("t") == "s") & F.col("v").rlike(r"^\d+$"), F.col("v").try_cast("int"))
    joined = cells.withColumn("_idx", idx).join(strings.select(F.col("idx").alias("_idx"), "text"), "_idx", "left")
    value = (F.when(F.col("_idx").isNotNull(), F.coalesce("text", F.lit("")))
             .when(F.col("t") == "b", F.when(F.col("v") == "1", "TRUE").otherwise("FALSE"))
             .otherwise(F.coalesce("v", F.lit(""))))
    return joined.select("sheet", "row", column_index(F.col("ref")).alias("col"), value.alias("value"))


def cells_to_rows(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Cells to tab-joined text rows: gaps filled, line ends to spaces, trailing tabs stripped. A row
    of empty cells is an empty line; a row without cells does not exist. Returns sheet, row, line.
    A group is one sheet row, at most 16384 cells."""
    entry = F.struct("col", F.translate("value", "\t\r\n", "   ").alias("value"))
    grouped = decode_cells(cells, strings).groupBy("sheet", "row").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    # of cells in one place the last; each cell brings the tabs since the cell before it
    last = F.filter("m", lambda e, i: F.coalesce(F.get("m", i + 1)["col"] != e["col"], F.lit(True)))
    line = F.get(F.transform(F.array(last), lambda cells: F.array_join(F.transform(cells, lambda e, i: F.concat(
        F.repeat(F.lit("\t"), (e["col"] - F.when(i > 0, F.get(cells, i - 1)["col"]).otherwise(F.lit(0))).cast("int")),
        F.coalesce(e["value"], F.lit("")))), "")), F.lit(0))
    return grouped.select("sheet", "row", F.regexp_replace(line, r"\t+\z", "").alias("line"))


def sheet_texts(rows: DataFrame) -> DataFrame:
    """One text per sheet, rows in order, trimmed, with a final newline; blank sheets are dropped. A group is one workbook
    sheet, at most 1,048,576 rows by its format; ``sheet`` must name the workbook too when there
    are several."""
    ordered = F.array_sort(F.collect_list(F.struct("row", "line")))
    text = strip(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n"))
    return rows.groupBy("sheet").agg(text.alias("text")).filter("text <> ''").select(
        "sheet", F.concat("text", F.lit("\n")).alias("text"))


def cell_media_refs(formulas: DataFrame, image_rels: DataFrame, rel_media: DataFrame, media: DataFrame) -> DataFrame:
    """Image cells joined to their media: book, image_id, sheet, ref, media_file, media_size,
    seen_order (running per workbook).

    ``formulas``: book, sheet_ord, sheet, cell_ord, ref, formula; ``image_rels``: image_id, rid;
    ``rel_media``: rid, media_file; ``media``: media_file, media_size. Cells whose media is missing
    stay, with '' and 0."""
    image_id = F.regexp_extract("formula", r'DISPIMG\(\s*"(ID_[0-9A-F]+)"', 1)
    refs = formulas.withColumn("image_id", image_id).filter("image_id <> ''")
    in_sheet = F.row_number().over(W.partitionBy("book", "sheet_ord").orderBy("cell_ord"))
    earlier = F.coalesce(F.sum("n").over(
        W.partitionBy("book").orderBy("sheet_ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = (refs.groupBy("book", "sheet_ord").agg(F.count(F.lit(1)).alias("n"))
              .select("book", "sheet_ord", earlier.alias("_before")))
    valid = rel_media.filter(F.startswith("media_file", F.lit("media/")))
    return (refs.withColumn("_in_sheet", in_sheet).join(before, ["book", "sheet_ord"])
            .join(image_rels, "image_id", "left").join(valid, "rid", "left").join(media, "media_file", "left")
            .select("book", "image_id", "sheet", "ref", F.coalesce("media_file", F.lit("")).alias("media_file"),
                    F.coalesce(F.col("media_size").cast("long"), F.lit(0)).alias("media_size"),
                    (F.col("_before") + F.col("_in_sheet")).cast("long").alias("seen_order")))


def cell_media_summary(refs: DataFrame) -> DataFrame:
    return refs.agg(F.count_distinct("image_id").alias("unique_image_ids"),
                    F.count(F.lit(1)).alias("cell_references"),
                    F.count_distinct("sheet").alias("sheets_with_images"),
                    F.count_if(F.col("media_file") == "").alias("missing_media"))
