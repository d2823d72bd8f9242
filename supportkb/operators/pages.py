"""Manuals: page texts, segments and images, parameter lines, fact snippets, weak pages, repairs.

A manual is one row (base, text) until its pages are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportkb import defaults as D
from supportkb.functions.text import (BLANKS, contains_any, json_text, norm, norm_keep_case, preview, split_lines, strip, with_fields)
from supportkb.operators.ordered import running_sums
from supportkb.operators.summary import side_by_side

# The page marker as search sees it, and as segments see it (alone on its line).
PAGE_MARKER = r"===== PAGE (\d+) ====="
_B = f"[{BLANKS}]"
SEGMENT_MARKER = f"(?md)^{_B}*====={_B}*PAGE{_B}+(\\d+){_B}*====={_B}*$"
OLD_MARKER = f"(?md)^===== PAGE (\\d+) ====={_B}*$"


# --- splitting ---------------------------------------------------------------------------------

def page_array(text: Column) -> Column:
    """array<struct<page_seq, body>>: bodies between markers, stripped; text before the first
    marker is an extra page 1; without a marker the whole text is page 1, unstripped."""
    t = F.coalesce(text, F.lit(""))
    seqs = F.regexp_extract_all(t, F.lit(PAGE_MARKER), F.lit(1))
    parts = F.split(t, PAGE_MARKER, -1)
    page = lambda seq, body: F.struct(seq.alias("page_seq"), body.alias("body"))
    marked = F.zip_with(seqs, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                        lambda s, b: page(s.try_cast("int"), strip(b)))
    before = strip(F.get(parts, F.lit(0)))
    return (F.when(F.size(seqs) == 0, F.array(page(F.lit(1), t)))
            .when(before != "", F.concat(F.array(page(F.lit(1), before)), marked)).otherwise(marked))


def split_pages(manuals: DataFrame) -> DataFrame:
    """base, place (position in the manual), page_seq, body."""
    return (manuals.select("base", F.posexplode(page_array(F.col("text"))).alias("place", "p"))
            .select("base", "place", "p.page_seq", "p.body"))


def split_segments(manuals: DataFrame) -> DataFrame:
    """base, k (from 1), marker, content: one segment per marker line, the text before the first one
    merged into segment 1, blanks kept; without a marker one segment with marker ''."""
    t = F.coalesce(F.col("text"), F.lit(""))
    marks = F.regexp_extract_all(t, F.lit(SEGMENT_MARKER), F.lit(1))
    parts = F.split(t, SEGMENT_MARKER, -1)
    seg = lambda m, c: F.struct(m.alias("marker"), c.alias("content"))
    body = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    merged = F.zip_with(marks, F.transform(body, lambda b, i: F.when(i == 0, F.concat(F.get(parts, F.lit(0)), b)).otherwise(b)), seg)
    segs = F.when(F.size(marks) == 0, F.array(seg(F.lit(""), t))).otherwise(merged)
    return (manuals.select("base", F.posexplode(segs).alias("_k", "s"))
            .select("base", (F.col("_k") + 1).alias("k"), "s.marker", "s.content"))


def renumber_page_markers(manuals: DataFrame) -> DataFrame:
    """Where every marker is odd, renumber 1..K. Adds changed."""
    t = F.coalesce(F.col("text"), F.lit(""))
    marks = F.regexp_extract_all(t, F.lit(OLD_MARKER), F.lit(1))
    parts = F.split(t, OLD_MARKER, -1)
    odd = (F.size(marks) > 0) & F.forall(marks, lambda m: F.right(m, F.lit(1)).isin("1", "3", "5", "7", "9"))
    rebuilt = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(F.lit("===== PAGE "), i.cast("string"), F.lit(" ====="), p))), "")
    out = manuals.withColumn("_new", F.when(odd, rebuilt).otherwise(t))
    return out.withColumn("changed", F.col("_new") != t).withColumn("text", F.col("_new")).drop("_new")


def choose_page_text(pages: DataFrame, least: int = 20) -> DataFrame:
    """Embedded text when its trimmed length reaches 20, else recognized text.

    ``pages``: base, page_seq, embedded, ocr. Returns base, page_seq, source, body."""
    good = F.char_length(strip(F.col("embedded"))) >= least
    return pages.select("base", "page_seq", F.when(good, "text-layer").otherwise("ocr").alias("source"),
                        F.when(good, F.col("embedded")).otherwise(F.coalesce("ocr", F.lit(""))).alias("body"))


def page_text_status(chosen: DataFrame) -> DataFrame:
    """Per manual: pages, how many came from each side, and the status."""
    return (chosen.groupBy("base").agg(F.count(F.lit(1)).alias("pages"),
                                       F.count_if(F.col("source") == "text-layer").alias("text_pages"),
                                       F.count_if(F.col("source") == "ocr").alias("ocr_pages"))
            .withColumn("status", F.when(F.col("ocr_pages") == 0, "text-layer").otherwise("ocr")))


# --- extraction --------------------------------------------------------------------------------

def param_lines(text: Column, hints: list[str] | None = None, max_rows: int | None = None) -> Column:
    """Normalized lines that name a parameter, first occurrences (at most ``max_rows``), joined by blanks."""
    found = F.filter(split_lines(text), lambda x: contains_any(x, D.PARAM_HINTS if hints is None else hints))
    lines = F.filter(F.array_distinct(F.transform(found, norm)), lambda x: x != "")
    return F.array_join(lines if max_rows is None else F.slice(lines, 1, max_rows), " ")


def fact_snippet_array(n: Column, keyword: str, window: int = 140, most: int | None = None) -> Column:
    """Distinct windows around the non-overlapping occurrences of a keyword in a text without blanks
    (the first ``most``). The text is split at the keyword and walked once; the state is the offset and the
    places found so far. Pass a plain column: for each window an expression is computed again."""
    k = "".join(keyword.split())
    pieces = F.split(n, "\\Q" + k + "\\E", -1)

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + F.char_length(piece)
        return F.struct((at + len(k)).alias("at"), F.array_append(acc["out"], at).alias("out"))

    def cut(at: Column) -> Column:
        start = F.greatest(at - 60, F.lit(0))
        return F.substr(n, start + 1, at + len(k) + window - start)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    places = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step)["out"]
    found = F.array_distinct(F.transform(places, cut))
    return found if most is None else F.slice(found, 1, most)


def fact_snippets(manuals: DataFrame, groups: dict[str, list[str]] | None = None, most: int | None = None) -> DataFrame:
    """base, grp, kw, pick, snippet for every keyword of every group (the first ``most`` per keyword and manual)."""
    def tagged(grp: str, kw: str) -> Column:
        return F.transform(fact_snippet_array(F.col("_n"), kw, most=most), lambda s, i: F.struct(
            F.lit(grp).alias("grp"), F.lit(kw).alias("kw"), (i + 1).alias("pick"), s.alias("snippet")))

    found = [tagged(g, w) for g, words in (D.FACT_KEYWORDS if groups is None else groups).items() for w in words]
    plain = manuals.select("base", norm_keep_case(F.col("text")).alias("_n"))
    return plain.select("base", F.explode(F.concat(*found)).alias("f")).select("base", "f.*")


# --- weak pages --------------------------------------------------------------------------------

def page_weakness(context: Column, body: Column, force_spec: bool = False, spec_words=None, labels=None,
                  table_words=None, file_words=None, value_pattern: str = D.VALUE_PATTERN) -> Column:
    """Why a page needs repair, '' when it does not."""
    n = norm(body)
    spec_words, labels = spec_words or D.SPEC_WORDS, labels or D.SPEC_LABELS
    table_words, file_words = table_words or D.SPEC_TABLE_WORDS, file_words or D.SPEC_FILE_WORDS
    spec, label = contains_any(n, spec_words), contains_any(n, labels)
    no_value = ~body.rlike(value_pattern)
    table = spec & contains_any(n, table_words)
    out = F.when(F.char_length(n) < 30, F.concat(F.lit("empty_ocr len="), F.char_length(n).cast("string")))
    out = out.when(table & no_value, F.lit("spec_table_missing_values"))
    if force_spec:
        out = out.when((table | (spec & label)) & no_value, F.lit("spec_page_no_values"))
    in_file = contains_any(context, file_words) | F.contains(F.lower(context), F.lit("spec"))
    return out.when(in_file & no_value, F.lit("spec_file_page_no_values")).otherwise(F.lit(""))


def repair_todo(pages: DataFrame, images: DataFrame, name_filter: str = "", force_spec: bool = False,
                min_len: int = 0, **words) -> DataFrame:
    """Weak pages that have an image: base, page_seq, image_rel, reason, preview. The last image of
    a (base, page) wins. ``images``: base, page_seq, image_rel, ord."""
    last = (images.filter("image_rel <> ''").groupBy("base", "page_seq")
            .agg(F.max_by("image_rel", "ord").alias("image_rel")))
    wanted = pages
    if name_filter:
        wanted = wanted.filter(F.contains(norm(F.col("base")), norm(F.lit(name_filter))))
    why = F.struct(page_weakness(F.col("base"), F.col("body"), force_spec, **words).alias("reason"))
    weak = with_fields(wanted, why).filter("reason <> ''")
    short = F.startswith("reason", F.lit("empty_ocr")) & (F.char_length(norm(F.col("body"))) < min_len)
    todo = weak.filter(~short).select("base", "page_seq", "place", "reason", preview(F.col("body"), 120).alias("preview"))
    return todo.join(last, ["base", "page_seq"]).select("base", "page_seq", "place", "image_rel", "reason", "preview")


def merge_repairs(repairs: DataFrame) -> DataFrame:
    """Overlay from successful repairs; the text may be JSON-encoded. ``repairs``: base, page_seq,
    text, status, ord."""
    return repairs.filter("status = 'ok'").select("base", "page_seq", json_text(F.col("text")).alias("text"), "ord")


def overlay_pages(pages: DataFrame, overlay: DataFrame) -> DataFrame:
    """Repaired text goes before the page body; of several repairs of a page the last wins."""
    last = overlay.groupBy("base", "page_seq").agg(F.max_by("text", "ord").alias("_fix"))
    return (pages.join(last, ["base", "page_seq"], "left")
            .withColumn("body", F.when(F.col("_fix").isNotNull(), F.concat_ws("\n", "_fix", "body")).otherwise(F.col("body")))
            .select(*pages.columns))


def path_context(manuals: DataFrame, pairs: DataFrame) -> DataFrame:
    """base, name: folder of the manual's first page image plus its base, or the base when that
    image lies at the top; the file name when there is no image.

    ``pairs``: base, image_rel, ord."""
    rel = F.translate("image_rel", "/", "\\")
    first = (pairs.filter("image_rel <> ''").groupBy("base").agg(F.min_by(rel, "ord").alias("_rel")))
    folder = F.regexp_extract("_rel", r"^(.*)\\[^\\]*$", 1)
    named = F.when(F.contains("_rel", F.lit("\\")), F.concat(folder, F.lit("\\"), F.col("base"))).otherwise(F.col("base"))
    return (manuals.select("base").join(first, "base", "left")
            .select("base", F.when(F.col("_rel").isNotNull(), named).otherwise(F.concat("base", F.lit(".txt"))).alias("name")))


def manual_diagnostics(manuals: DataFrame) -> DataFrame:
    """base, pages, norm_len per manual, computed inside its row."""
    return manuals.select("base", F.size(page_array(F.col("text"))).alias("pages"),
                          F.char_length(norm(F.col("text"))).alias("norm_len"))


# --- images ------------------------------------------------------------------------------------

def align_segments_images(segments: DataFrame, images: DataFrame) -> DataFrame:
    """k-th segment with k-th image (by number) of the same manual; what is left over on either side
    stays unmatched. ``segments``: base, k, marker, content; ``images``: base, num, image_rel."""
    numbered = running_sums(images.select("base", "num", "image_rel"), ["base"], F.floor(F.col("num") / 1000),
                            ["num", "image_rel"], k=F.lit(1)).withColumn("k", F.col("k").cast("int"))
    both = segments.join(numbered, ["base", "k"], "full_outer")
    empty = F.lit("")
    return both.select(
        "base", "k", F.coalesce("num", "k").alias("page_seq"), F.coalesce("marker", empty).alias("marker"),
        F.coalesce(F.char_length("content").cast("string"), empty).alias("text_len"),
        preview(F.col("content")).alias("preview"), F.coalesce("image_rel", empty).alias("image_rel"),
        (F.col("content").isNotNull() & F.col("image_rel").isNotNull()).alias("matched"))


def manual_image_counts(aligned: DataFrame) -> DataFrame:
    """Per manual: page_count, segments, images, matched."""
    seg, img = F.col("text_len") != "", F.col("image_rel") != ""
    return aligned.groupBy("base").agg(F.count(F.lit(1)).alias("page_count"), F.count_if(seg).alias("segments"),
                                       F.count_if(img).alias("images"), F.count_if("matched").alias("matched"))


def image_alignment_summary(aligned: DataFrame, unparsed: DataFrame) -> DataFrame:
    """Totals over all manuals; images whose names could not be parsed count as unmatched."""
    total = manual_image_counts(aligned).agg(
        F.count(F.lit(1)).alias("manuals"), F.sum("page_count").alias("pages"), F.sum("images").alias("_images"),
        F.sum("matched").alias("matched"), F.sum(F.col("images") - F.col("matched")).alias("_left"),
        F.sum(F.col("segments") - F.col("matched")).alias("unmatched_segments"))
    extra = unparsed.agg(F.count(F.lit(1)).alias("_x"))
    return side_by_side(total, extra).select(
        "manuals", "pages", (F.col("_images") + F.col("_x")).alias("images"), "matched",
        (F.col("_left") + F.col("_x")).alias("unmatched_images"), "unmatched_segments")


# --- index layers ------------------------------------------------------------------------------

def text_layers(sheets: DataFrame, specs: DataFrame, pages: DataFrame, names: DataFrame) -> DataFrame:
    """Index rows of the sheet, spec and manual layers: layer, name, page, blob, place. ``sheets``:
    name, text; ``specs``: name, text (blank ones dropped); ``pages`` with repairs applied;
    ``names``: base, name."""
    row = lambda df, layer: df.select(F.lit(layer).alias("layer"), "name", F.lit("").alias("page"),
                                      norm(F.col("text")).alias("blob"), F.lit(0).alias("place"))
    manual = pages.join(names, "base").select(
        F.lit("OCR").alias("layer"), "name", F.col("page_seq").cast("string").alias("page"),
        norm(F.col("body")).alias("blob"), "place")
    return row(sheets, "KDOCS").unionByName(row(specs, "SPEC").filter("blob <> ''")).unionByName(manual)


def build_params_layer(pages: DataFrame, names: DataFrame, specs: DataFrame, seeds: DataFrame,
                       hints: list[str] | None = None) -> DataFrame:
    """Parameter facts: manual pages, spec files (no page) and curated seeds with a value. Returns
    name, page, blob."""
    found = lambda df, text: with_fields(df, F.struct(param_lines(F.col(text), hints).alias("blob"))).filter("blob <> ''")
    manual = (found(pages.select("base", "page_seq", "body"), "body").join(names, "base")
              .select("name", F.col("page_seq").cast("string").alias("page"), "blob"))
    spec = found(specs, "text").select("name", F.lit("").alias("page"), "blob")
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    seed = (seeds.filter(strip(F.col("value")) != "")
            .select(F.concat(F.lit("param_seeds:"), c("product")).alias("name"), c("page").alias("page"),
                    norm(F.concat_ws(" ", c("model"), c("attribute"), c("value"))).alias("blob"))
            .filter("blob <> ''"))
    return manual.unionByName(spec).unionByName(seed)
