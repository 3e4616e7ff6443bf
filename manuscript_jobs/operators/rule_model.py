"""Rules told by a trained sentence model: typed values, and a fold of a guide's sentences in their order.

A model of 24 rule types and ``other`` classifies every sentence; those it is sure enough of give a typed value each, and
one grouped pass folds them into a row of rules per guide. Sentences are held per guide and rule only, so nothing
larger than a guide's own sure sentences meets in one place.

A sentence without a value of its type changes nothing, but for the types whose rule is the sentence itself. Null
sentences have no type. Guides without a sure sentence give no row. Equal sentences count once, at their first place.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import shared_path
from . import classify

# The rule types of labelled guide sentences, and the least confidence that counts.
SIZES = ("font_size", "font_size_heading1", "font_size_heading2", "font_size_content")
SIDES = ("left", "right", "top", "bottom")
RULE_TYPES = (
    "font_family", *SIZES, "font_color", "line_spacing", "paragraph_indent", *(f"margin_{s}" for s in SIDES), "citation_style", "paper_size", "paper_orientation",
    "paper_substance", "pagination", "pagination_position", "pagination_first_page", "heading_style", "page_break", "table_layout", "table_figure_layout", "figure_layout",
)
OTHER = "other"
LEAST, CAP = 0.55, 12


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def plain_number(value: Column) -> Column:
    """A double as text, whole ones without a fraction."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def first_inches(text: Column) -> Column:
    """The first number of a text where it is from 0 to 5."""
    n = _found(text, r"([0-9]+(?:\.[0-9]+)?)").try_cast("double")
    return F.when(n.between(0, 5), n)


def first_points(text: Column) -> Column:
    """The first number of one or two digits where it is a size from 6 to 72."""
    n = _found(text, r"([0-9]{1,2}(?:\.[0-9]+)?)").try_cast("double")
    return F.when(n.between(6, 72), n)


def spacing_word(text: Column) -> Column:
    low = F.lower(text)
    half = low.rlike(r"\b1\.5\b|one[\s-]+and[\s-]+a[\s-]+half")
    return F.when(half, "1.5").when(low.rlike(r"\bdouble\b|\b2(\.0)?\b"), "double").when(low.rlike(r"\bsingle\b|\b1(\.0)?\b") & ~low.contains("1.5"), "single")


def rule_value(sentence: Column, kind: Column) -> Column:
    """The value of a sentence of a rule type, as text; null where it holds none."""
    low = F.lower(sentence)
    points, inches = first_points(sentence), first_inches(sentence)
    inch = F.when(inches.isNotNull(), F.concat(plain_number(inches), F.lit(" inch")))
    family = F.coalesce(*[F.when(low.rlike(rf"\b{name.lower()}\b"), name) for name in T.FONTS])
    place = F.when(low.rlike(r"top\s+right"), "top right").when(low.rlike(r"bottom\s+cent(er|re)"), "bottom center")
    paper = F.when(low.rlike(r"8\.5\s*[x×]\s*11"), "8.5 x 11 inches").when(low.rlike(r"\ba4\b"), "A4")
    return (
        F.when(kind == "font_family", family)
        .when(kind.isin(*SIZES), F.concat(plain_number(points), F.lit("pt")))
        .when(kind == "line_spacing", spacing_word(sentence))
        .when(kind == "paragraph_indent", F.coalesce(inch, F.when(low.rlike(r"\bone\s+tab\b"), "0.5 inch")))
        .when(kind.startswith("margin_"), inch)
        .when(kind == "citation_style", _found(F.upper(sentence), r"\b(APA|MLA|IEEE)\b"))
        .when(kind == "paper_size", paper)
        .when(kind == "paper_orientation", F.when(low.contains("landscape"), "landscape").when(low.contains("portrait"), "portrait"))
        .when(kind == "paper_substance", _found(sentence, r"\b([0-9]{2,3})\b"))
        .when(kind == "font_color", F.when(low.rlike("black|automatic"), "black (automatic)"))
        .when(kind.isin("pagination", "pagination_position"), place)
        .when(kind == "pagination_first_page", "hidden on first page of chapter")
        .when(kind == "page_break", "new page per chapter")
    )


def train_rule_model(labelled: DataFrame, most: int = 4000, rounds: int = 40, dimensions: int = 1 << 12) -> PipelineModel:
    """A model of (sentence, rule_type), fitted on at most ``most`` rows of either sort, typed ones and others, drawn
    by hash: the bound of what is read for the fit, not of what is classified. Rows weigh alike, so that the many kinds
    of other sentences aren't outweighed by the few wordings of a rule."""
    key, typed = F.xxhash64("sentence", "rule_type"), F.col("rule_type") != OTHER
    rows = labelled.where("sentence is not null and rule_type is not null").withColumn("_key", key)
    drawn = []
    for some in (rows.where(typed), rows.where(~typed)):
        # The least hashes alone bound what is drawn, so that only the sentences under them are shuffled.
        bound = some.select("_key").distinct().orderBy("_key").limit(most).agg(F.max("_key")).first()[0]
        under = some.where(F.col("_key") <= F.lit(bound)).dropDuplicates(["sentence", "rule_type"])
        drawn.append(under.orderBy("_key", "sentence").limit(most))
    path = shared_path(labelled.sparkSession, "labelled-sentences")  # the fit reads them again and again
    drawn[0].union(drawn[1]).select("sentence", "rule_type").repartition("sentence").write.parquet(path)
    return classify.train_classifier(labelled.sparkSession.read.parquet(path), "sentence", "rule_type", rounds, dimensions, reg=1e-4, even=True)


def classified(model: PipelineModel, sentences: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``confidence`` to (guide_id, at, sentence)."""
    out = classify.predict(model, sentences, "sentence")
    return out.select(*sentences.columns, F.col("predicted").alias("kind"), "confidence")


def predicted_rules(sentences: DataFrame, least: float = LEAST) -> DataFrame:
    """(guide_id, at, sentence, kind, confidence) folded into one row a guide.

    A new font family goes before those known, sizes after; a later value of a single rule replaces an earlier one;
    requirements are kept as said, each once, up to CAP.
    """
    sure = sentences.where((F.col("confidence") >= least) & F.col("kind").isin(*RULE_TYPES)).withColumn("value", rule_value(F.col("sentence"), F.col("kind")))
    kind, value, said = F.col("kind"), F.col("value"), F.col("sentence")
    points, inches = first_points(value), F.coalesce(first_inches(value), F.when(value.isNull(), first_inches(said)))
    letter = (kind == "paper_size") & F.coalesce(value, said).contains("8.5")
    spacing = F.when(value == "1.5", 1.5).when(value == "double", 2.0).when(value == "single", 1.0)
    turned = F.when(F.coalesce(value, F.lower(said)).contains("landscape"), "Landscape").otherwise("Portrait")

    def last(what: Column, *kinds: str) -> Column:
        here = kind.isin(*kinds) & what.isNotNull()
        return F.max_by(F.when(here, what), F.when(here, F.col("at")))

    def listed(what: Column, *kinds: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.when(kind.isin(*kinds) & what.isNotNull(), F.struct("at", what.alias("x")))))
        return F.array_distinct(F.transform(pairs, lambda p: p["x"]))

    some = lambda what: F.max(F.when(kind == what, True))
    folded = sure.groupBy("guide_id").agg(
        F.reverse(listed(value, "font_family")).alias("families"), listed(points, "font_size").alias("sizes_points"), last(points, "font_size_heading1").alias("heading1_size"),
        last(points, "font_size_heading2").alias("heading2_size"), last(points, "font_size_content").alias("heading3_content_size"), F.when(some("font_color"), "Black/Automatic").alias("color"),
        last(spacing, "line_spacing").alias("line_spacing"), last(inches, "paragraph_indent").alias("first_line_indent_inches"),
        F.map_filter(F.map_from_arrays(F.array(*[F.lit(s) for s in SIDES]), F.array(*[last(inches, f"margin_{s}") for s in SIDES])), lambda _, v: v.isNotNull()).alias("margins_inches"),
        last(value, "citation_style").alias("citation_style"), F.max(F.when(letter, "LETTER")).alias("paper_name"), last(turned, "paper_orientation").alias("orientation"),
        last(value, "paper_substance").alias("substance"), last(value, "pagination", "pagination_position").alias("position"), some("pagination_first_page").alias("_hidden"),
        *[F.slice(listed(said, *kinds), 1, CAP).alias(f"{name}_requirements") for name, kinds in (("heading", ("heading_style",)), ("page_break", ("page_break",)), ("table_layout", ("table_layout", "table_figure_layout")), ("figure_layout", ("figure_layout",)))],
    )
    paper = F.struct(F.col("paper_name").alias("name"), F.when(F.col("paper_name") == "LETTER", 8.5).alias("width_inches"), F.when(F.col("paper_name") == "LETTER", 11.0).alias("height_inches"), "orientation", "substance")
    first = F.when(F.col("_hidden"), "No page number on the first page of every chapter")
    return folded.select(
        "guide_id", F.struct("families", F.try_element_at("families", F.lit(1)).alias("type"), "sizes_points", "heading1_size", "heading2_size", "heading3_content_size", "color").alias("font"),
        "line_spacing", plain_number(F.col("line_spacing")).alias("spacing"), "first_line_indent_inches", F.concat(plain_number(F.col("first_line_indent_inches")), F.lit(" inch")).alias("indention"), "margins_inches",
        "citation_style", paper.alias("paper"), F.struct("position", first.alias("first_page_of_chapter")).alias("pagination"),
        "heading_requirements", "page_break_requirements", "table_layout_requirements", "figure_layout_requirements",
    )
