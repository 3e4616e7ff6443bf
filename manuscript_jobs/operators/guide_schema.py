"""What a labelled format guide lacks, section by section, and rules without what a guide ignores.

A guide is lines (guide_id, page, line, text). A section begins at the first line that is its title - alone, behind
an outline mark, or with a value behind a colon or dash - and ends at the next line that is any title; its labelled
values stand between. Lines meet by guide in windows; the schema is a fixed handful of rows laid beside every guide and
joined to what was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..functions import text as T

# Sections by id and title, with fields of (id, label, path of the rule, further paths cleared with it);
# a section of free text has a path of its own. Fields that only count where a guide lists them; other titles of a section.
FIELDS = {
    "margins": ("Margins (in inches)", tuple((x, x.capitalize(), ("margins_inches", x), ()) for x in ("top", "left", "bottom", "right", "gutter", "header", "footer"))),
    "paper": ("Paper", (
        ("size", "Size", ("paper", "size"), ()), ("orientation", "Orientation", ("paper", "orientation"), ()), ("spacing", "Spacing", ("spacing",), ()), ("word_spacing", "Word spacing", ("word_spacing",), ()),
        ("indention", "Indention", ("indention",), (("first_line_indent_inches",), ("indent_type",), ("indent_tolerance_inches",))), ("alignment", "Alignment", ("alignment",), ()),
        ("landscape_pages", "Landscape pages", ("paper", "landscape_pages"), ()),
    )),
    "font": ("Font", (
        ("heading1_size", "Heading 1 size", ("font", "heading1_size"), ()), ("heading2_size", "Heading 2 size", ("font", "heading2_size"), ()), ("body_size", "Body text size", ("font", "body_size"), ()),
        ("font_type", "Font type", ("font", "type"), ()), ("font_color", "Font color", ("font", "color"), ()),
    )),
    "heading_styles": ("Heading Styles", (("heading1_style", "Heading 1 style", ("font", "heading_styles", "heading1"), ()), ("heading2_style", "Heading 2 style", ("font", "heading_styles", "heading2"), ()))),
    "pagination": ("Pagination", (
        ("page_number_position", "Page number position", ("pagination", "position"), ()), ("title_page", "Title page", ("pagination", "title_page"), ()),
        ("first_page_of_chapter", "First page of each chapter", ("pagination", "first_page_of_chapter"), ()),
    )),
    "table_layout": ("Table Layout", ("table_layout_requirements",)),
    "figure_layout": ("Figure Layout", ("figure_layout_requirements",)),
    "citation_format": ("Citation Format", (("citation_style", "Citation style", ("citation_style",), ()),)),
}
OPTIONAL = ("heading1_size", "heading2_size", "heading1_style", "heading2_style")
ALIASES = {"font": ("font", "typeface")}
PLACEHOLDERS = ("", "na", "n/a", "n.a.", "n.a", "not applicable", "none", "-", "—")
FREE = ("table_layout", "figure_layout")


def _plain(text: Column) -> Column:
    return F.lower(T.squash(text))


def title_of(text: Column) -> Column:
    """The section whose title a line is; null for other lines."""
    got = F.regexp_replace(_plain(text), r"[.:]+$", "")
    bare = F.trim(F.regexp_replace(got, r"^([a-z]|[ivxlcdm]+|[0-9]+)[.)]\s+", ""))
    out = F.lit(None).cast("string")
    for section, (title, _) in FIELDS.items():
        names = [n.replace("(", r"\(").replace(")", r"\)") for n in ALIASES.get(section, (title.lower(),))]
        pattern = rf"^({'|'.join(names)})(\s*[:\-–—].*)?$"
        out = F.coalesce(out, F.when(bare.rlike(pattern) | got.rlike(pattern), section))
    return out


def ignored_value(text: Column) -> Column:
    return F.lower(F.trim(text)) == "ignore"


def placeholder(text: Column) -> Column:
    return _plain(text).isin(*PLACEHOLDERS)


def sections(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, labels): each guide's sections with the place of the title and the text of the body, and the labelled
    values in them, the last of a label, with their place."""
    at = F.struct("page", "line").alias("at")
    marked = lines.select("guide_id", at, "text", title_of(F.col("text")).alias("title"))
    upto = Window.partitionBy("guide_id").orderBy("at")
    inside = marked.withColumn("head", F.last(F.when(F.col("title").isNotNull(), F.struct(F.col("title").alias("section"), F.col("at").alias("begin"))), ignorenulls=True).over(upto)).where("head is not null")
    inside = inside.select("guide_id", "head.*", "at", "text").withColumn("_first", F.min("begin").over(Window.partitionBy("guide_id", "section"))).where("begin = _first")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("at") > F.col("begin")) & (F.trim("text") != ""), F.struct("at", F.trim("text").alias("t"))))), lambda x: x["t"]), "\n")
    found = inside.groupBy("guide_id", "section").agg(F.min("begin").alias("begin"), body.alias("body"))
    pattern = r"^[ \t]*([^:\n]{1,80}?)\s*:\s*(.*?)\s*$"
    said = inside.where(F.col("at") > F.col("begin")).where(F.col("text").rlike(pattern))
    said = said.select("guide_id", "section", _plain(F.regexp_extract("text", pattern, 1)).alias("label"), F.struct("at", F.regexp_extract("text", pattern, 2).alias("value")).alias("v"))
    return found, said.groupBy("guide_id", "section", "label").agg(F.max("v").alias("v")).select("guide_id", "section", "label", "v.at", "v.value")


def section_gaps(lines: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """(guide_id, code, section, field, page, line): ``missing_category`` for a title that no line is, ``missing_label`` for
    a field without its label, ``missing_value`` for a label, or a section of free text, whose value is blank or a
    placeholder. IGNORE passes, for a value or a whole section. Fields that are optional count where they are listed.

    ``covered`` (guide_id, section, field) are fields that rules have; a section of free text is a field of its own
    name. A section whose required fields all are covered may lack its title. A guide without lines has no row."""
    entries = [(s, "" if s in FREE else f[0], "" if s in FREE else f[1].lower(), s in FREE, f[0] in OPTIONAL) for s, (_, fields) in FIELDS.items() for f in (((s,),) if s in FREE else fields)]
    table = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(f or s).alias("field"), F.lit(label).alias("label"), F.lit(free).alias("free"), F.lit(optional).alias("optional")) for s, f, label, free, optional in entries])
    guides = lines.groupBy("guide_id").agg(F.min(F.struct("page", "line")).alias("top"))
    asked = guides.select("guide_id", "top", F.inline(table))
    if covered is None:
        asked = asked.withColumn("covered", F.lit(False))
    else:
        asked = asked.join(covered.select("guide_id", "section", "field").distinct().withColumn("_has", F.lit(True)), ["guide_id", "section", "field"], "left").withColumn("covered", F.coalesce("_has", F.lit(False))).drop("_has")
    found, labels = sections(lines)
    rows = asked.join(found, ["guide_id", "section"], "left").join(labels, ["guide_id", "section", "label"], "left")
    kept = ~F.col("covered") & ~ignored_value(F.coalesce("body", F.lit("")))
    empty = F.when(F.col("free"), placeholder(F.col("body"))).otherwise(placeholder(F.col("value")))
    code = F.when(F.col("begin").isNull(), "missing_category").when(~kept, None).when(~F.col("free") & F.col("value").isNull(), F.when(~F.col("optional"), "missing_label")).when(empty, "missing_value")
    place = F.when(F.col("begin").isNull(), F.col("top")).when(F.col("code").eqNullSafe("missing_value") & ~F.col("free"), F.col("at")).otherwise(F.col("begin"))
    rows = rows.withColumn("code", code).withColumn("place", place).where("code is not null")
    absent = rows.where("code = 'missing_category'").groupBy("guide_id", "section").agg(F.max(~F.col("covered") & ~F.col("optional")).alias("open"), F.first("place").alias("place"))
    absent = absent.where("open").select("guide_id", F.lit("missing_category").alias("code"), "section", F.lit("").alias("field"), "place.page", "place.line")
    return rows.where("code <> 'missing_category'").select("guide_id", "code", "section", "field", "place.page", "place.line").union(absent)


def _without(value: Column, kind, path: tuple[str, ...], off: Column) -> Column:
    """A nested value without what stands at a path, where ``off``; structs and maps left without any value are null."""
    if not path:
        return F.when(~off, value)
    if isinstance(kind, StructType) and path[0] in kind.names:
        inner = value.withField(path[0], _without(value[path[0]], kind[path[0]].dataType, path[1:], off))
        some = F.coalesce(*[inner[n].cast("string") if not isinstance(kind[n].dataType, (StructType, MapType)) else F.when(inner[n].isNotNull(), "x") for n in kind.names])
        return F.when(off, F.when(some.isNotNull(), inner)).otherwise(value)
    if isinstance(kind, MapType) and len(path) == 1:
        left = F.map_filter(value, lambda k, _: k != path[0])
        return F.when(off, F.when(F.size(left) > 0, left)).otherwise(value)
    return value


def without_ignored(rules: DataFrame, ignored: DataFrame) -> DataFrame:
    """``rules`` (guide_id, nested rules) without the fields that a guide ignores. ``ignored``: (guide_id, key), keys being
    ``section:field`` or a whole ``section``; unknown keys do nothing. Further paths of a field go with it. Paths that the
    rules don't have are passed over; a guide's keys meet as one set of at most the schema's size."""
    known = [k for s, (_, fields) in FIELDS.items() for k in (s, *(() if s in FREE else (f"{s}:{f[0]}" for f in fields)), f"{s}:{s}")]
    keys = ignored.where(F.col("key").isin(*known)).groupBy("guide_id").agg(F.collect_set("key").alias("_keys"))
    out = rules.join(keys, "guide_id", "left")
    has = lambda *k: F.coalesce(F.arrays_overlap("_keys", F.array(*[F.lit(x) for x in k])), F.lit(False))
    for section, (_, fields) in FIELDS.items():
        for off, path in [(has(section, f"{section}:{section}"), fields)] if section in FREE else [(has(section, f"{section}:{f[0]}"), p) for f in fields for p in (f[2], *f[3])]:
            if path[0] in rules.columns:
                out = out.withColumn(path[0], _without(F.col(path[0]), rules.schema[path[0]].dataType, path[1:], off))
    return out.select(*rules.columns)
