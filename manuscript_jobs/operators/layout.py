"""From parsed lines to formatting units: rows, pages, columns, paragraphs, roles and page marks.

Every window is partitioned by document (and page) and ordered by an explicit key; no step relies on
row order. Units: (doc_id, n, text, page_index, line_index, ...), n being the reading order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_index")


def by_doc():
    return Window.partitionBy("doc_id").orderBy("n")


def by_page():
    return Window.partitionBy(*PAGE).orderBy("n")


# What opens chapters, back matter and reference lists, and what ends a contents line.
CHAPTER = r"^(?i:chapter\s+([0-9]+|[ivxlc]+))\b"
BACK_MATTER = r"^(?i:appendix|appendices|bibliography|references|curriculum vitae)\b"
PRELIMINARY = r"^(?i:abstract|acknowledge?ments?|dedication|table of contents|list of (?:tables|figures))\b"
REFERENCE_HEADER = r"^(?i:(?:list\s+of\s+)?(?:references|bibliography|works cited|literature cited))\b"
LEADERS = r"\.{2,}|…"
FOLIO = r"(\.{2,}|…|\s)\s*([0-9]{1,3}|(?i:[ivxlc]{1,6}))$"
CAPTION = r"^\s*(?i:table|figure)\s+[0-9]+\b"
BARE_PAGE = r"^([0-9]{1,4}|(?i:[ivxlcdm]{1,7}))$"


def merge_rows(fragments: DataFrame) -> DataFrame:
    """Joins the fragments of one printed row: boxes that overlap by 60 % of the lower one's height and
    whose middles are close; a gap of over 1.6 em marks the row as a table's. A page is a small group."""

    def merge(page: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        for f in page.sort_values(["y0", "x0", "n"]).itertuples(index=False):
            for row in rows[-4:]:
                shared = min(row["y1"], f.y1) - max(row["y0"], f.y0)
                close = abs((row["y0"] + row["y1"]) - (f.y0 + f.y1)) <= 0.5 * (f.y1 - f.y0) * 2
                if shared >= 0.6 * min(row["y1"] - row["y0"], f.y1 - f.y0) and close:
                    row["parts"].append(f)
                    row["y0"], row["y1"] = min(row["y0"], f.y0), max(row["y1"], f.y1)
                    break
            else:
                rows.append({"y0": f.y0, "y1": f.y1, "parts": [f]})
        out = []
        for i, row in enumerate(sorted(rows, key=lambda r: (r["y0"], min(p.x0 for p in r["parts"])))):
            parts = sorted(row["parts"], key=lambda p: (p.x0, p.n))
            wide = any(b.x0 - a.x1 > 1.6 * (a.y1 - a.y0) for a, b in zip(parts, parts[1:]))
            first = parts[0]
            out.append((first.doc_id, first.page_index, i, " ".join(p.text for p in parts), len(parts), wide))
        return pd.DataFrame(out, columns=["doc_id", "page_index", "row", "text", "n_fragments", "table_row"])

    return fragments.groupBy(*PAGE).applyInPandas(merge, "doc_id long, page_index long, row long, text string, n_fragments long, table_row boolean")


def pdf_units(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Lines and images of a page in reading order, renumbered."""
    both = lines.select(*PAGE, "text", "x0", "y0", F.lit("line").alias("source")).unionByName(images.select(*PAGE, F.lit(None).cast("string").alias("text"), "x0", "y0", F.lit("image").alias("source")))
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "source", "text")
    return both.withColumn("line_index", F.row_number().over(order) - 1)


def dominant_font(spans: DataFrame) -> DataFrame:
    """Per line the font and size with most visible characters; the first seen on ties. Symbol-only spans and
    decorative fonts don't count. (doc_id, n, at, text, font, size)."""
    from ..functions.text import is_decorative

    seen = spans.where(F.col("text").rlike("[A-Za-z0-9]") & ~is_decorative(F.col("font")))
    sums = seen.groupBy("doc_id", "n", "font", "size").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("weight"), F.min("at").alias("first"))
    best = F.struct("weight", -F.col("first"))
    return sums.groupBy("doc_id", "n").agg(F.max_by("font", best).alias("font"), F.max_by("size", best).alias("size"), F.max("weight").alias("weight"))


def weighted_mode(df: DataFrame, keys: list[str], value: Column, weight: Column, first: Column, name: str) -> DataFrame:
    """The value of most weight; of equals the one seen first."""
    sums = df.where(value.isNotNull()).groupBy(*keys, value.alias("_v")).agg(F.sum(weight).alias("_w"), F.min(first).alias("_f"))
    return sums.groupBy(*keys).agg(F.max_by("_v", F.struct("_w", -F.col("_f"))).alias(name))


def document_body_stats(units: DataFrame) -> DataFrame:
    """Per document the prevailing size (half points), line spacing (quarters) and font."""
    w, first, keys = F.length("text"), F.col("n"), ["doc_id"]
    size = weighted_mode(units, keys, F.round(F.col("size") * 2) / 2, w, first, "body_size")
    spacing = weighted_mode(units, keys, F.round(F.col("line_spacing") * 4) / 4, w, first, "body_spacing")
    font = weighted_mode(units, keys, F.col("font"), w, first, "body_font")
    return size.join(spacing, "doc_id").join(font, "doc_id")


def page_capacity(stats: DataFrame, height: float = 11.0, width: float = 8.5, margin: float = 1.0) -> DataFrame:
    """Lines that fit a page and characters that fit a line, from size and spacing (1.15 em a single line)."""
    lines = F.floor((height - 2 * margin) * 72 / (F.col("body_size") * 1.15 * F.col("body_spacing")))
    chars = F.floor((width - 2 * margin) * 72 / (F.col("body_size") * 0.5))
    return stats.select("doc_id", lines.alias("lines_per_page"), chars.alias("chars_per_line"))


def soft_wrap(paragraphs: DataFrame, chars: int = 90) -> DataFrame:
    """(doc_id, n, lines): greedy wrapping by words; longer words are cut; a line feed ends a line."""

    @F.pandas_udf("array<string>")
    def wrapped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def wrap(text: str) -> list[str]:
            out = []
            for hard in (text or "").split("\n"):
                line = ""
                for word in hard.split(" "):
                    while len(word) > chars:
                        if line:
                            out.append(line)
                            line = ""
                        out.append(word[:chars])
                        word = word[chars:]
                    if line and len(line) + 1 + len(word) > chars:
                        out.append(line)
                        line = word
                    else:
                        line = f"{line} {word}" if line else word
                out.append(line)
            return out

        for part in parts:
            yield part.map(wrap)

    return paragraphs.select("doc_id", "n", wrapped("text").alias("lines"))


def paginate(lines: DataFrame, capacity: int = 46) -> DataFrame:
    """Pages of a flowing document: a break opens a page, and so does a full one. ``new_page`` marks breaks;
    inside what a break opens, the page is the line's position divided by the capacity."""
    block = F.sum(F.col("new_page").cast("int")).over(by_doc())
    own = lines.withColumn("_block", block)
    own = own.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id", "_block").orderBy("n")) - 1)
    sizes = own.groupBy("doc_id", "_block").agg(F.ceil(F.count("*") / capacity).alias("_pages"))
    before = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_pages").over(before), F.lit(0)))
    return own.join(sizes, ["doc_id", "_block"]).select("doc_id", "n", (F.col("_before") + F.expr(f"_at div {capacity}")).alias("page"), (F.col("_at") % capacity).cast("long").alias("line"))


def upper_median(value: Column) -> Column:
    """sorted(x)[len // 2]: never interpolated."""
    x = F.sort_array(F.collect_list(value))
    return F.element_at(x, (F.floor(F.size(x) / 2) + 1).cast("int"))


def rebalance_pages(units: DataFrame, ceiling: int = 30) -> DataFrame:
    """Pages of more lines than the ceiling are cut at the usual fill; later pages move on."""
    counts = units.groupBy(*PAGE).agg(F.count("*").alias("lines"))
    usual = counts.where(F.col("lines") <= ceiling).groupBy("doc_id").agg(upper_median(F.col("lines")).alias("usual"))
    own = counts.join(usual, "doc_id", "left").withColumn("usual", F.coalesce("usual", F.lit(ceiling)))
    extra = F.when(F.col("lines") > ceiling, F.ceil(F.col("lines") / F.col("usual")) - 1).otherwise(0)
    before = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_extra", extra).withColumn("_shift", F.coalesce(F.sum("_extra").over(before), F.lit(0)))
    nth = F.row_number().over(by_page()) - 1
    moved = units.select(*PAGE, "n", nth.alias("_nth")).join(own, list(PAGE))
    return moved.select("doc_id", "n", (F.col("page_index") + F.col("_shift") + F.when(F.col("_extra") > 0, F.expr("_nth div usual")).otherwise(0)).alias("page"))


def page_fidelity(breaks: DataFrame) -> DataFrame:
    """How far a document's pages can be trusted: (doc_id, format, rendered_breaks)."""
    sums = breaks.groupBy("doc_id").agg(F.max("format").alias("_f"), F.sum("rendered_breaks").alias("_b"))
    return sums.select("doc_id", F.when(F.col("_f") == "pdf", "pdf_source").when(F.col("_b") > 0, "word_rendered").otherwise("estimated").alias("fidelity"))


def _column(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The body column: the commonest left edge, moved to the leftmost edge 0.28 to 0.85 inches away, and
    the nine-tenths right edge; three lines at least."""
    edges = boxes.groupBy(*keys, F.col("x0").alias("_x")).agg(F.count("*").alias("_c"), F.min("n").alias("_f"))
    mode = edges.groupBy(*keys).agg(F.max_by("_x", F.struct("_c", -F.col("_f"))).alias("_mode"), F.sort_array(F.collect_set("_x")).alias("_all"))
    near = F.filter("_all", lambda x: F.abs(x - F.col("_mode")).between(0.28 * 72, 0.85 * 72))
    left = F.least(F.col("_mode"), F.coalesce(F.array_min(near), F.col("_mode")))
    rights = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list("x1")).alias("_r"), F.count("*").alias("_n")).where("_n >= 3")
    right = F.element_at("_r", (F.floor(0.9 * (F.col("_n") - 1)) + 1).cast("int"))
    return mode.join(rights, keys).select(*keys, left.alias("left"), right.alias("right"))


def text_columns(boxes: DataFrame, wide: int = 200) -> DataFrame:
    """Per page the body column from wide lines; else the document's; else one-inch margins."""
    lines = boxes.where(F.col("x1") - F.col("x0") >= wide)
    page, doc = _column(lines, list(PAGE)), _column(lines, ["doc_id"]).select("doc_id", F.col("left").alias("_l"), F.col("right").alias("_r"))
    out = boxes.select(*PAGE).distinct().join(page, list(PAGE), "left").join(doc, "doc_id", "left")
    return out.select(*PAGE, F.coalesce("left", "_l", F.lit(72)).alias("left"), F.coalesce("right", "_r", F.lit(540)).alias("right"))


def infer_alignment(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """A line's alignment from its gaps to the column."""
    lg, rg, span = F.col("x0") - F.col("left"), F.col("right") - F.col("x1"), F.greatest(F.lit(1), F.col("right") - F.col("left"))
    out = (
        F.when((rg <= F.greatest(F.lit(14.0), 0.045 * span)) & (lg <= 0.25 * span), "justify")
        .when((F.abs(lg - rg) <= 14) & (F.least(lg, rg) > 20), "center").when(rg <= 6, "right").otherwise("left")
    )
    return boxes.join(columns, list(PAGE)).select("doc_id", "n", out.alias("alignment"))


def near_any(x: np.ndarray, y: np.ndarray, cells: np.ndarray, side: int = 3, up: int = 24) -> np.ndarray:
    """Which boxes have a cell within ``side`` to the left or right and ``up`` above or below: of each column of whole
    units, the cells in a range of the sorted heights."""
    y = y - y.min()
    tall = int(y.max()) + 4 * up
    keys = np.sort(x[cells] * tall + y[cells] + up)
    found = np.zeros(len(x), bool)
    for d in range(-side, side + 1):
        at = (x + d) * tall + y + up
        found |= np.searchsorted(keys, at + up, "right") > np.searchsorted(keys, at - up, "left")
    return found


def mark_table_cells(boxes: DataFrame, rounds: int = 8) -> DataFrame:
    """(doc_id, n, cell): seeds (``seed``) grow to narrow neighbours within 1.5 lines whose left edge a cell
    of the same page shares, for at most ``rounds`` rounds. A page is a small group; a round sorts its cells and looks
    the other boxes up, so time follows the boxes and not their pairs. Places are whole units."""

    def grow(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("n").reset_index(drop=True)
        cell = page["seed"].fillna(False).to_numpy(bool).copy()
        narrow = ((page["x1"] - page["x0"]) < 300).to_numpy()
        x, y = (page[c].to_numpy(np.int64) for c in ("x0", "y0"))
        for _ in range(rounds):
            more = cell | (narrow & near_any(x, y, cell)) if cell.any() else cell
            if (more == cell).all():
                break
            cell = more
        return pd.DataFrame({"doc_id": page["doc_id"], "n": page["n"], "cell": cell})

    return boxes.select("doc_id", "page_index", "n", "x0", "x1", "y0", "seed").groupBy(*PAGE).applyInPandas(grow, "doc_id long, n long, cell boolean")


def toc_entry(text: Column) -> Column:
    """A contents line: leaders or a page number at its end; a bare section label is none without leaders."""
    value = F.trim(text)
    label = value.rlike(CHAPTER) | value.rlike(BACK_MATTER) | value.rlike(PRELIMINARY)
    return (value != "") & ~value.endswith(".") & ~(label & ~value.rlike(LEADERS)) & value.rlike(FOLIO) & (F.size(F.split(value, r"\s+")) >= 2)


def mark_toc(units: DataFrame) -> DataFrame:
    """Adds ``toc`` and ``toc_page``: contents lines, and pages of four or more that make two fifths of its lines."""
    entry = toc_entry(F.col("text"))
    by = Window.partitionBy(*PAGE)
    n, of = F.sum(entry.cast("int")).over(by), F.count(F.when(F.trim("text") != "", 1)).over(by)
    return units.select("*", entry.alias("toc"), ((n >= 4) & (n >= 0.4 * of)).alias("toc_page"))


def annotate_roles(units: DataFrame) -> DataFrame:
    """Adds ``role`` and ``level``: what a line is, in order of precedence, and the heading level in force.

    A title in bold face counts as a level-2 heading once a chapter was seen, else as uncertain."""
    from ..functions.text import caption_prose

    value = F.trim("text")
    words = F.size(F.split(value, r"\s+"))
    title = (F.col("face") == "bold") & (words <= 12) & ~value.rlike(r"[.,;]$")
    chapter = value.rlike(CHAPTER)
    seen = F.max(chapter.cast("int")).over(by_doc().rowsBetween(Window.unboundedPreceding, -1)) == 1
    role = (
        F.when(value == "", "empty").when(value.rlike(BARE_PAGE), "pagination").when(toc_entry(F.col("text")), "toc")
        .when(value.rlike(CAPTION) & ~caption_prose(value), F.when(F.lower(value).startswith("table"), "table").otherwise("figure"))
        .when(chapter, "heading1").when(value.rlike(REFERENCE_HEADER) | value.rlike(PRELIMINARY) | value.rlike(BACK_MATTER), "heading_other")
        .when(title, F.when(F.coalesce(seen, F.lit(False)), "heading2").otherwise("heading_uncertain")).otherwise("body")
    )
    out = units.withColumn("role", role)
    level = F.when(F.col("role").rlike("^heading[12]$"), F.substring("role", 8, 1).cast("int"))
    return out.withColumn("level", F.last(level, True).over(by_doc().rowsBetween(Window.unboundedPreceding, 0)))


def section_title_confidence(units: DataFrame) -> DataFrame:
    """Adds ``confidence`` in 0..1 that an unstyled line is a section title; 0.32 and more counts."""
    value = F.trim("text")
    words = F.when(value == "", 0).otherwise(F.size(F.split(value, r"\s+")))
    prev, nxt = F.length(F.trim(F.lag("text", 1, "").over(by_page()))), F.length(F.trim(F.lead("text", 1, "").over(by_page())))
    add = lambda test, x: F.when(test, x).otherwise(0)
    points = (
        add(F.col("face") == "bold", 30) + add(words.between(1, 8), 15) + add(F.col("size") > 12, 20) + add(F.col("alignment") == "center", 10) + add(value.rlike("^[A-Z]"), 8)
        + add(prev == 0, 7) + add(nxt > 60, 10) - add(value.rlike(r"[.,;:]$"), 25) - add(words > 14, 30)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), points))
    return units.select("doc_id", "n", score.alias("points"), (score >= 32).alias("title"))


def rank_headings_by_size(titles: DataFrame, levels: int = 4) -> DataFrame:
    """Pending titles: distinct sizes, largest first, become levels from 2; sizes past the last are uncertain."""
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))) + 1
    return titles.select("doc_id", "n", F.when(rank <= levels, F.concat(F.lit("heading"), rank.cast("string"))).otherwise("heading_uncertain").alias("role"))


def propagate_paragraph_role(units: DataFrame) -> DataFrame:
    """Wrapped lines take the role of their paragraph's first. (doc_id, paragraph, n, role)."""
    w = Window.partitionBy("doc_id", "paragraph").orderBy("n")
    return units.withColumn("role", F.first("role").over(w))


def mark_title_page(units: DataFrame) -> DataFrame:
    """Lines of a first page without body structure become title_page."""
    busy = F.max(F.col("role").isin("heading1", "heading2", "toc", "table", "figure").cast("int")).over(Window.partitionBy(*PAGE))
    return units.withColumn("role", F.when((F.col("page_index") == 0) & (busy == 0), "title_page").otherwise(F.col("role")))


def prose_paragraphs(boxes: DataFrame) -> DataFrame:
    """Adds ``paragraph``: a line starts one where it is indented or its gap is over 1.3 usual gaps of the page,
    where the page turns, or after a line that is no body."""
    gap = F.col("y0") - F.lag("y0").over(by_page())
    own = boxes.withColumn("_gap", gap).withColumn("_gaps", F.sort_array(F.collect_list("_gap").over(Window.partitionBy(*PAGE))))
    own = own.withColumn("_usual", F.try_element_at("_gaps", (F.floor(F.size("_gaps") / 2) + 1).cast("int"))).drop("_gaps")
    start = F.col("_gap").isNull() | (F.col("x0") > 90) | (F.col("_gap") > 1.3 * F.col("_usual"))
    return own.withColumn("paragraph", F.sum(start.cast("int")).over(by_doc())).drop("_gap", "_usual")


def indent_paragraphs(boxes: DataFrame, right: int = 540) -> DataFrame:
    """Paragraphs of a page for indentation: a line opens one after a short line (a tenth of the column and more
    before the edge), after a drop of over 1.4 pitches, or where it is set in against the one before."""
    prev = lambda c: F.lag(c).over(by_page())
    short = prev("x1") < right - 46.8
    start = prev("n").isNull() | short | (F.col("y0") - prev("y0") > 22.4) | (F.col("x0") - prev("x0") > 9)
    own = boxes.withColumn("_start", start.cast("int"))
    own = own.withColumn("paragraph", F.sum("_start").over(by_page()))
    return own.groupBy(*PAGE, "paragraph").agg(
        F.count("*").alias("lines"), F.min_by("x0", "n").alias("first_x"), F.min("x0").alias("left_x"), F.max("x1").alias("right_x"), F.min("n").alias("n")
    )


def section_starts(units: DataFrame, within: int = 6) -> DataFrame:
    """Pages that open a chapter, back matter or a preliminary section, from their first content lines; a running
    head that repeats the last start's title is none."""
    content = units.where(F.trim("text") != "").withColumn("_at", F.row_number().over(by_page())).where(F.col("_at") <= within)
    value = F.trim("text")
    kind = F.when(value.rlike(CHAPTER), "chapter").when(value.rlike(BACK_MATTER), "back_matter").when(value.rlike(PRELIMINARY), "preliminary")
    first = content.withColumn("kind", kind).where("kind is not null").groupBy(*PAGE).agg(F.min_by(F.struct("kind", F.lower(value).alias("title")), "n").alias("f"))
    same = F.lag("f.title").over(Window.partitionBy("doc_id").orderBy("page_index")) == F.col("f.title")
    return first.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same").select(*PAGE, "f.kind")


def page_marks_pdf(boxes: DataFrame, height: int = 792) -> DataFrame:
    """The printed number nearest a page's top or bottom edge (15 % of the height), with its place."""
    from ..functions.text import PAGE_DIGITS, page_token

    token = page_token(F.col("text"), PAGE_DIGITS)
    top, bottom = F.col("y0"), height - F.col("y1")
    near = boxes.withColumn("_t", token).where(F.col("_t.value").isNotNull() & (F.least(top, bottom) <= 0.15 * height))
    center = (F.col("x0") + F.col("x1")) / 2
    side = F.when(center < 204, "left").when(center > 408, "right").otherwise("center")
    mark = F.struct(F.col("_t.value").cast("int").alias("value"), F.col("_t.style").alias("style"), F.when(top <= bottom, "top").otherwise("bottom").alias("vertical"), side.alias("horizontal"))
    return near.groupBy(*PAGE).agg(F.min_by(mark, F.struct(F.least(top, bottom), F.col("n"))).alias("m")).select(*PAGE, "m.*")


def page_marks_docx(pages: DataFrame) -> DataFrame:
    """Computed numbers: a section's start restarts the count. (doc_id, page_index, section_start)."""
    w = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("section_start").isNotNull(), F.col("page_index")), True).over(w)
    base = F.last("section_start", True).over(w)
    return pages.select(*PAGE, F.coalesce(base + F.col("page_index") - at, F.col("page_index") + 1).alias("number"))


def preview_pages(docs: DataFrame, chars: int = 2200, most: int = 500) -> DataFrame:
    """Texts in chunks for preview, at most ``most`` of a document."""
    n = F.least(F.lit(most), F.ceil(F.length("text") / chars))
    pages = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("page"))
    return pages.select("doc_id", "page", F.substring("text", (F.col("page") * chars + 1).cast("int"), F.lit(chars)).alias("text"))


def caption_snippets(units: DataFrame, most: int = 40) -> DataFrame:
    """The first ``most`` caption-like lines of each document."""
    hits = units.where(F.col("text").rlike(CAPTION))
    return hits.withColumn("position", F.row_number().over(by_doc())).where(F.col("position") <= most).select("doc_id", "position", "n", F.substring(F.trim("text"), 1, 200).alias("snippet"))


def page_body_margins(boxes: DataFrame, width: int = 612, height: int = 792) -> DataFrame:
    """Measured margins of each page in points, with the document's top and bottom: the second smallest over
    full pages (ten lines and more), so that one odd page doesn't decide."""
    page = boxes.where(F.trim("text") != "").groupBy(*PAGE).agg(
        F.min("x0").alias("left"), (width - F.max("x1")).alias("right"), F.min("y0").alias("top"), (height - F.max("y1")).alias("bottom"), F.count("*").alias("lines")
    )
    second = lambda c: F.element_at(s := F.sort_array(F.collect_list(c)), F.least(F.lit(2), F.size(s)))
    doc = page.where("lines >= 10").groupBy("doc_id").agg(second("top").alias("doc_top"), second("bottom").alias("doc_bottom"))
    return page.join(doc, "doc_id", "left")
