"""Indentation of paragraphs on laid-out pages: which lines are body, how they fall into paragraphs, how far those are set in.

Lines: (doc_id, page_index, n, text, x0, y0, x1, y1, role, size) and, where known, ``source``, ``table_row``,
``column_left``, ``page_width`` and ``page_height`` in points. Everything up to paragraphs is told within a page, so
one shuffle by page serves all windows and a long document is spread over tasks; only paragraphs meet by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_indent_inches, rule_unset
from .layout import PAGE

# Distances in points, shares and tolerances in inches of the indentation check.
EDGE_BAND = 56.0
NARROW_SHARE = 0.55
COLUMNS_APART = 72.0
SET_IN = 14.0
FULL_GAP = 18.0
SHORT_GAP = 36.0
PARAGRAPH_GAP = 1.35
FLUSH_GAP = 2.8
BODY_EDGE = (0.28 * 72, 0.85 * 72)
TOLERANCE = 0.08
SAFETY = 0.02
USUAL_SHARE = 0.55
GROW_ROUNDS = 8

# Sources and roles that are no body, what list items, captions and references look like.
CHROME_SOURCES = ("header", "footer", "footnote", "endnote", "textbox")
CHROME_ROLES = ("pagination", "header", "footer")
LIST_MARKERS = (r"\([0-9]+(\.[0-9]+)*\)\s", r"\([a-z]\)\s", r"[0-9]+(\.[0-9]+)*[.)]\s", r"[a-z][.)]\s", r"[ivxlcdm]+[.)]\s", r"[-•●▪◦○]\s", r"q(uestion)?\s*[0-9]+\s*[.:)\s]")
CAPTION_WORDS = ("figure", r"fig\.?", "table", r"tbl\.?", "plate", "map", "photo", "image")
LABEL = r"^[A-Za-z][^:]{0,40}:\s+\S"
REFERENCE = r"^\([0-9]{4}[a-z]?\)|,\s*[0-9]{4}\.?$"
LIST_ITEM = "^(?i:" + "|".join(LIST_MARKERS) + ")"
CAPTION = "^(?i:" + "|".join(CAPTION_WORDS) + r")\s*[0-9.]+\b"
MID_SENTENCE = r"""^["'(\[“‘]?\p{Ll}"""


def indent_rule(raw: Column, inches: Column, kind: Column, tolerance: Column, start_page: Column) -> Column:
    """(type, inches, tolerance, start_page) of a document's rule, or null where nothing usable is set: a wording without
    a length is never guessed. Types are first_line, hanging, left, right and none; the wording tells the type where
    ``kind`` does not."""
    said = F.lower(F.concat_ws(" ", raw, kind))
    given = F.nullif(F.lower(F.trim(kind)), F.lit(""))
    told = (
        F.when(said.rlike(r"\bhanging\b"), "hanging").when(said.rlike(r"\bright\s+indent\b"), "right")
        .when(said.rlike(r"\bleft\s+indent\b") & ~said.contains("first"), "left")
        .when(said.rlike(r"\b(no|none|without)\s+indent") | F.trim(said).isin("none", "0", "0 inch", "0 inches"), "none")
    )
    form = F.coalesce(F.when(given.isin("no", "disabled"), "none").otherwise(given), told, F.lit("first_line"))
    named_unset = raw.isNotNull() & rule_unset(raw) & inches.isNull()
    read = F.array(F.struct(F.coalesce(parse_indent_inches(raw), inches).alias("said"), form.alias("type"), named_unset.alias("off")))  # each is told once

    def rule(r: Column) -> Column:
        length = F.when(r["type"] == "none", F.coalesce(r["said"], F.lit(0.0))).otherwise(r["said"])
        own = F.struct(r["type"].alias("type"), length.alias("inches"), F.coalesce(tolerance, F.lit(TOLERANCE)).alias("tolerance"), start_page.cast("long").alias("start_page"))
        return F.when(length.isNotNull() & ~r["off"], own)

    return F.element_at(F.transform(read, rule), 1)


def _filled(lines: DataFrame) -> DataFrame:
    for name, kind, value in (("source", "string", "body"), ("table_row", "boolean", False), ("column_left", "double", None), ("page_width", "double", 612.0), ("page_height", "double", 792.0)):
        lines = lines.withColumn(name, F.coalesce(F.col(name).cast(kind), F.lit(value).cast(kind)) if name in lines.columns else F.lit(value).cast(kind))
    return lines.withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")})


def mark_indent_tables(lines: DataFrame, drawings: DataFrame | None = None, rounds: int = GROW_ROUNDS) -> DataFrame:
    """Adds ``in_table``. Seeds are rows marked so, lines with tabs or three wide gaps, narrow lines that stand side by
    side, and lines within a drawn box of a cell's or table's size. In each of ``rounds`` rounds a page's lines join that begin within
    10 points of a left edge of the table and lie within 40 points of it from top to bottom; the page edge is never crossed."""
    lines = _filled(lines).repartition(*PAGE)
    text = F.coalesce(F.col("text"), F.lit(""))
    width = F.col("x1") - F.col("x0")
    peers = Window.partitionBy(*PAGE, "_band", "_narrow")
    own = lines.withColumns({"_band": F.bround(F.col("y0") / 4), "_narrow": (width <= NARROW_SHARE * F.col("page_width")) & (F.trim(text) != "")})
    own = own.withColumn("_beside", F.col("_narrow") & F.coalesce(F.col("x0") >= F.lag("x1").over(peers.orderBy("x0", "n")) - 2, F.lit(False)))
    wide = (F.length(text) - F.length(F.replace(text, F.lit("  "), F.lit("")))) >= 6
    seed = F.col("table_row") | (F.col("source") == "table") | (F.coalesce(F.col("role"), F.lit("")) == "table") | text.contains("\t") | wide
    own = own.withColumn("in_table", (F.trim(text) != "") & (seed | (F.max("_beside").over(peers) & F.col("_narrow")))).drop("_band", "_narrow", "_beside")
    if drawings is not None:
        own = own.join(_drawn(own, drawings), [*PAGE, "n"], "left").withColumn("in_table", F.col("in_table") | F.col("_drawn").isNotNull()).drop("_drawn")
    page = Window.partitionBy(*PAGE)
    edge = page.orderBy("x0").rangeBetween(-10, 10)
    for _ in range(rounds):
        box = lambda c: F.when(F.col("in_table"), F.col(c))
        own = own.withColumns({"_top": F.min(box("y0")).over(page), "_foot": F.max(box("y1")).over(page), "_edge": F.max("in_table").over(edge)})
        joins = F.col("_edge") & (width < 0.85 * F.col("page_width")) & (F.col("y1") >= F.col("_top") - 40) & (F.col("y0") <= F.col("_foot") + 40) & (F.trim(text) != "")
        own = own.withColumn("in_table", F.col("in_table") | F.coalesce(joins, F.lit(False))).drop("_top", "_foot", "_edge")
    return own


def _drawn(lines: DataFrame, drawings: DataFrame) -> DataFrame:
    """Lines within a drawn box: two or more in any box short of a page's frame, one alone in a box of a cell's size."""
    boxes = drawings.select(*PAGE, *[F.col(c).cast("double").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]).distinct()
    inside = (F.col("x0") >= F.col("_x0") - 6) & (F.col("x1") <= F.col("_x1") + 6) & (F.col("y0") >= F.col("_y0") - 6) & (F.col("y1") <= F.col("_y1") + 6)
    across, area = F.col("_x1") - F.col("_x0"), (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))
    sheet = F.col("page_width") * F.col("page_height")
    held = lines.where(F.trim("text") != "").join(boxes, list(PAGE)).where(inside & (area < 0.55 * sheet) & (across < 0.92 * F.col("page_width")))
    held = held.withColumn("_held", F.count("*").over(Window.partitionBy(*PAGE, "_x0", "_y0", "_x1", "_y1")))
    return held.where((F.col("_held") > 1) | ((area < 0.35 * sheet) & (across < 0.7 * F.col("page_width")))).select(*PAGE, "n", F.lit(True).alias("_drawn")).distinct()


def column_blocks(lines: DataFrame) -> DataFrame:
    """Adds ``place`` (order on the page from above, 1 first) and ``block``: 1 for the right one of two columns, else 0.
    A page has two where its two most common left edges are an inch apart and lines of both stand side by side; a
    cluster of first-line indents is no column."""
    page = Window.partitionBy(*PAGE)
    own = lines.withColumns({"place": F.row_number().over(page.orderBy("y0", "x0", "n")).cast("long"), "_edge": F.bround(F.col("x0") / 4) * 4})
    same = Window.partitionBy(*PAGE, "_edge")
    own = own.withColumn("_vote", F.struct(F.count("*").over(same).alias("c"), (-F.min("place").over(same)).alias("seen"), F.col("_edge").alias("edge")))
    own = own.withColumn("_a", F.max("_vote").over(page)["edge"])
    own = own.withColumn("_b", F.max(F.when(F.col("_edge") != F.col("_a"), F.col("_vote"))).over(page)["edge"])
    own = own.withColumn("_second", F.coalesce(F.abs(F.col("x0") - F.col("_b")) < F.abs(F.col("x0") - F.col("_a")), F.lit(False)))
    ends = [f(F.when(F.col("_second") == second, F.col("y0"))).over(page) for f in (F.min, F.max) for second in (False, True)]
    own = own.withColumns(dict(zip(("_top_a", "_top_b", "_foot_a", "_foot_b"), ends)))
    beside = F.least("_foot_a", "_foot_b") - F.greatest("_top_a", "_top_b") > 20
    two = F.coalesce(F.col("_top_a").isNotNull() & F.col("_top_b").isNotNull() & (F.abs(F.col("_a") - F.col("_b")) >= COLUMNS_APART) & beside, F.lit(False))
    right = F.col("_second") == (F.col("_b") > F.col("_a"))
    return own.withColumn("block", F.when(two & right, 1).otherwise(0)).drop("_edge", "_vote", "_a", "_b", "_second", "_top_a", "_top_b", "_foot_a", "_foot_b")


def _heading(text: Column) -> Column:
    loud = (text == F.upper(text)) & (text != F.lower(text)) & (F.size(F.split(text, " ")) <= 10)
    return F.coalesce(F.col("role").startswith("heading"), F.lit(False)) | ((F.length(text) <= 80) & (F.coalesce(F.col("size") >= 13, F.lit(False)) | loud))


def indented_paragraphs(lines: DataFrame, drawings: DataFrame | None = None, rounds: int = GROW_ROUNDS) -> DataFrame:
    """Body lines with ``block`` and ``paragraph``. Lines without words, in tables, in the edge bands of a page, and those of
    headers, footers, notes or page numbers are left out; headings end a paragraph.

    A block's ``baseline`` is its most common left edge, or an edge a first-line indent to its left. A line set in opens a paragraph
    after a full line, a short one or a gap. A flush one does after a short line or a wide gap, unless it goes on in mid
    sentence or the paragraph is a list item; otherwise it goes on with the paragraph."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"\s+", " "))
    own = mark_indent_tables(lines, drawings, rounds).withColumn("text", squeezed)
    edge = (F.col("y0") <= EDGE_BAND) | (F.col("y1") >= F.col("page_height") - EDGE_BAND)
    chrome = F.col("source").isin(*CHROME_SOURCES) | F.coalesce(F.col("role"), F.lit("")).isin(*CHROME_ROLES) | edge
    own = column_blocks(own.where((F.col("text") != "") & ~F.col("in_table") & ~chrome))
    block = Window.partitionBy(*PAGE, "block")
    order = block.orderBy("place")
    prev = lambda c: F.lag(c).over(order)
    same = Window.partitionBy(*PAGE, "block", "_left")
    own = own.withColumns({"_left": F.bround("x0"), "_gap": F.col("y0") - prev("y0"), "_list": F.col("text").rlike(LIST_ITEM), "_heading": _heading(F.col("text")), "_right": F.max("x1").over(block)})
    own = own.withColumn("_vote", F.struct(F.count("*").over(same).alias("c"), (-F.min("place").over(same)).alias("seen"), F.col("_left").alias("left")))
    own = own.withColumns({"_most": F.max("_vote").over(block), "_floor": F.min(F.when(F.col("_gap") > 0, F.col("_gap"))).over(block)})
    indents = F.abs(F.col("_left") - F.col("_most.left")).between(*BODY_EDGE)
    own = own.withColumns({
        "baseline": F.min(F.when((F.col("_vote.c") == F.col("_most.c")) | indents, F.col("_left"))).over(block),
        "_tight": F.when((F.col("_gap") > 0) & (F.col("_gap") <= 1.6 * F.col("_floor") + 1), F.col("_gap")),
    })
    own = own.withColumns({"_rank": F.row_number().over(block.orderBy(F.desc_nulls_last("_tight"))), "_gaps": F.count("_tight").over(block)})
    own = own.withColumn("_pitch", F.coalesce(F.max(F.when(F.col("_rank") == F.expr("_gaps - _gaps div 2"), F.col("_tight"))).over(block), F.lit(16.0)))
    inward = F.col("x0") - F.col("baseline") >= SET_IN
    room = F.col("_right") - prev("x1")
    opens = prev("n").isNull() | prev("_heading") | (inward & ((room >= SHORT_GAP) | (room <= FULL_GAP) | (F.col("_gap") > PARAGRAPH_GAP * F.col("_pitch"))))
    might = ~inward & ((room >= SHORT_GAP) | (F.col("_gap") > FLUSH_GAP * F.col("_pitch"))) & ~prev("_list") & ~F.col("text").rlike(MID_SENTENCE)
    own = own.withColumns({"_opens": F.coalesce(opens, F.lit(False)), "_might": F.coalesce(might, F.lit(False))}).where(~F.col("_heading"))
    own = own.withColumn("_run", F.sum(F.col("_opens").cast("int")).over(order))
    before = Window.partitionBy(*PAGE, "block", "_run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.max((F.col("_opens") | F.col("_might")) & F.col("_list")).over(before), F.lit(False))
    own = own.withColumn("_starts", F.col("_opens") | (F.col("_might") & ~held))
    own = own.withColumn("paragraph", F.sum(F.col("_starts").cast("int")).over(order))
    kept = ("doc_id", "page_index", "n", "text", "x0", "y0", "x1", "y1", "page_width", "column_left", "place", "block", "paragraph", "baseline")
    return own.select(*kept, F.col("_starts").alias("starts"), F.col("_list").alias("list_item"))


def page_indents(paragraph_lines: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """A row a paragraph: its first line, ``lines``, why it is left out (``skipped``), and in inches how far its first line is set in
    against those that follow (``first_line``, null for a single line), its left edge against the block's (``left``)
    and its right one against the page's (``right``). The edge of the following lines is their most common one, drawn
    to the column's or the block's where it is only a jitter away."""
    lines = paragraph_lines.withColumn("_left", F.bround("x0"))
    same = Window.partitionBy(*PAGE, "block", "paragraph", "_left")
    follows = ~F.col("starts")
    vote = F.struct(F.sum(follows.cast("int")).over(same).alias("c"), (-F.min(F.when(follows, F.col("place"))).over(same)).alias("seen"), F.col("_left").alias("left"))
    lines = lines.withColumn("_follow", F.when(follows, vote))
    first = F.struct("n", "text", "x0", "y0", "x1", "y1", "page_width", "column_left", "place", "list_item")
    paras = lines.groupBy(*PAGE, "block", "paragraph").agg(
        F.min_by(first, "place").alias("f"), F.count("*").alias("lines"), F.max("_follow").getField("left").alias("_edge"), F.first("baseline").alias("baseline"), F.min("x0").alias("_least"), F.max("x1").alias("_most")
    ).select(*PAGE, "block", "paragraph", "lines", "baseline", "_edge", "_least", "_most", "f.*")
    edge = F.when(F.abs(F.col("_edge") - F.col("column_left")) <= BODY_EDGE[0], F.col("column_left")).when(F.abs(F.col("_edge") - F.col("baseline")) < SET_IN, F.col("baseline")).otherwise(F.col("_edge"))
    text = F.col("text")
    reasons = [
        (F.col("baseline") > F.greatest(F.lit(144.0), 0.35 * F.col("page_width")), "far_right_column"), (text.rlike(CAPTION), "caption"),
        (text.rlike(LABEL) & (F.col("lines") == 1), "label_value"), (F.col("list_item"), "list"),
    ]
    if drawings is not None:
        boxes = drawings.select(*PAGE, *[F.col(c).cast("double").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
        near = (F.col("x1") >= F.col("_x0") - 8) & (F.col("x0") <= F.col("_x1") + 8) & (F.col("y1") >= F.col("_y0") - 12) & (F.col("y0") <= F.col("_y1") + 12)
        touched = paras.join(boxes, list(PAGE)).where(near).select(*PAGE, "n", F.lit(True).alias("_touched")).distinct()
        paras = paras.join(touched, [*PAGE, "n"], "left")
        reasons.append((F.col("_touched").isNotNull(), "beside_image"))
    reasons += [(text.rlike(REFERENCE) & (F.length(text) < 120), "reference"), ((F.col("page_index") > 0) & (F.col("place") == 1), "page_top")]
    skipped = reduce(lambda done, test: done.when(*test), reasons[1:], F.when(*reasons[0]))
    inch = lambda c: F.round(c / 72, 3)
    return paras.select(
        *PAGE, "block", "paragraph", "n", "lines", "text", "x0", "baseline", skipped.alias("skipped"), "list_item",
        inch(F.col("x0") - edge).alias("first_line"), inch(F.col("_least") - F.col("baseline")).alias("left"), inch(F.col("page_width") - F.col("_most")).alias("right"),
    )


def check_page_indents(indents: DataFrame, rules: DataFrame) -> DataFrame:
    """Paragraphs against their document's rule. Rules: (doc_id, rule: see ``indent_rule``); a document without one gives no rows.

    ``skipped`` ones are no units: their ``verdict`` and ``ok`` are null. A paragraph in lower case that follows a list item is its
    continuation. Within the tolerance is a pass, up to 0.02 beyond it, or without a line to measure against, is uncertain
    and counts as passed. Where 55 % of a document's measured paragraphs share one value that passes, those
    within the tolerance of it pass too; a document that is wrong throughout fails throughout."""
    doc = Window.partitionBy("doc_id")
    upto = doc.orderBy("page_index", "block", "paragraph").rowsBetween(Window.unboundedPreceding, -1)
    own = indents.join(rules.where("rule is not null").select("doc_id", "rule"), "doc_id")
    told = F.when(F.col("list_item"), True).when(F.substring("text", 1, 1).rlike(r"\p{Lu}"), False)
    after_list = F.coalesce(F.last(told, True).over(upto), F.lit(False)) & told.isNull()
    early = F.coalesce(F.col("page_index") + 1 < F.col("rule.start_page"), F.lit(False))
    own = own.withColumn("skipped", F.when(after_list, "list_continuation").when(early, "before_start_page").otherwise(F.col("skipped")))
    kind, wanted, most = F.col("rule.type"), F.col("rule.inches"), F.col("rule.tolerance")
    measured = F.when(kind == "hanging", -F.col("first_line")).when(kind == "left", F.col("left")).when(kind == "right", F.col("right")).otherwise(F.col("first_line"))
    own = own.withColumn("measured", F.when(F.col("skipped").isNull(), measured)).withColumn("_value", F.round("measured", 2))
    own = own.withColumn("_c", F.when(F.col("_value").isNotNull(), F.struct(F.count("_value").over(Window.partitionBy("doc_id", "_value")).alias("c"), (-F.col("_value")).alias("v"))))
    own = own.withColumns({"_usual": F.max("_c").over(doc), "_all": F.count("_value").over(doc)})
    apart = lambda a, b: F.round(F.abs(a - b), 4)
    off = apart(F.col("measured"), wanted)
    usual = (F.col("_usual.c") >= USUAL_SHARE * F.col("_all")) & (apart(-F.col("_usual.v"), wanted) <= most) & (apart(F.col("measured"), -F.col("_usual.v")) <= most)
    verdict = F.when(F.col("skipped").isNotNull(), None).when(F.col("measured").isNull(), "uncertain").when((off <= most) | usual, "pass").when(off <= F.round(most + SAFETY, 4), "uncertain").otherwise("fail")
    own = own.withColumn("verdict", verdict)
    opening = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
    return own.select(*PAGE, "block", "paragraph", "n", "lines", opening.alias("opening"), kind.alias("indent_type"), wanted.alias("expected"), "measured", "skipped", "verdict", (F.col("verdict") != "fail").alias("ok"))
