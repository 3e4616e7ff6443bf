"""What the indentation check on pages takes for a paragraph, and what it says of it."""

from pyspark.sql import functions as F


def _page_lines(rows):
    """(doc_id, page, x0, y0, x1, text): lines numbered as they come."""
    return [(d, p, i, t, float(x), float(y), float(r), float(y + 12), "body", 11.0) for i, (d, p, x, y, r, t) in enumerate(rows)]


_LINE = "doc_id long, page_index long, n long, text string, x0 double, y0 double, x1 double, y1 double, role string, size double"


def _indents(spark, cases):
    """Each case (lines without a document, inches, type, drawn boxes) is a document; its paragraphs' (n, lines, measured, verdict)."""
    from manuscript_jobs.operators import indentation as I

    rows, rules, boxes = [], [], []
    for d, (own, inches, kind, drawn) in enumerate(cases):
        rows += _page_lines([(d, *r) for r in own])
        rules.append((d, (kind, float(inches), 0.08, None)))
        boxes += [(d, *b) for b in drawn]
    lines = spark.createDataFrame(rows, _LINE)
    boxes = spark.createDataFrame(boxes, "doc_id long, page_index long, x0 double, y0 double, x1 double, y1 double")
    rules = spark.createDataFrame(rules, "doc_id long, rule struct<type:string,inches:double,tolerance:double,start_page:long>")
    got = I.check_page_indents(I.page_indents(I.indented_paragraphs(lines, boxes), boxes), rules).orderBy("page_index", "block", "paragraph").collect()
    return [[(r.n, r.lines, r.measured, r.skipped or r.verdict) for r in got if r.doc_id == d] for d in range(len(cases))]


def _case(own, inches=0.5, kind="first_line", drawn=()):
    return own, inches, kind, drawn


def test_page_indents_pass_or_fail_by_the_rule_alone(spark):
    """Half an inch passes a rule of that, fails others; documents that are wrong throughout fail throughout."""
    rows = []
    for i in range(4):
        rows += [(0, 108, 80 + 56 * i, 540, f"Half inch opening of paragraph {i}"), (0, 72, 96 + 56 * i, 540, "goes on at the body edge")]
    flush = [(0, 72, 80 + 16 * i + 32 * (i // 2), 540, "Flush line of an unindented paragraph") for i in range(20)]
    hanging = [(0, 72, 60, 540, "WORKS")] + [(0, 72 + 36 * (i % 3 > 0), 80 + 16 * i, 515 if i % 3 < 2 else 300, "Entry of a list of works") for i in range(9)]
    cases = [_case(rows, v) for v in (0.5, 0.7, 1.0, 0.4)] + [_case(flush), _case(flush, 0, "none"), _case(hanging, kind="hanging")]
    got = [[v for *_, v in one] for one in _indents(spark, cases)]
    assert got == [["pass"] * 4, ["fail"] * 4, ["fail"] * 4, ["uncertain"] * 4, ["fail"] * 10, ["pass"] * 10, ["pass"] * 3]


def test_page_indents_paragraphs_and_what_is_left_out(spark):
    """A short line that goes on in lower case, a small gap, and the wrap of a list item open no paragraph; heads,
    page numbers, captions, labels, references, tables, images and first lines of later pages are no units."""
    wrap = [(0, 108, 100, 522, "Opening line of a paragraph"), (0, 72, 116, 540, "that goes on"), (0, 72, 132, 182, "Short wrap end,"), (0, 72, 148, 512, "and families go on here.")]
    bump = [(0, 72, 100, 540, "Full line one"), (0, 72, 116, 540, "Full line two"), (0, 72, 136, 540, "Line after a small gap")]
    item = [(0, 72, 100, 300, "1. An item of a list"), (0, 72, 116, 300, "The wrap of the item"), (0, 72, 200, 540, "its rest after a wide gap"), (0, 108, 216, 540, "A real paragraph"), (0, 72, 232, 540, "and more")]
    body = [(0, 108, 300, 540, "A paragraph of the body"), (0, 72, 316, 540, "and its second line")]
    chrome = [(0, 72, 30, 540, "Running head"), (0, 300, 770, 310, "7"), (0, 72, 400, 540, "LOUD HEADING"), (0, 72, 60, 540, ""), (0, 72, 500, 540, None), (0, 72, 520, 540, "   ")]
    lone = [[(0, 72, 100, 540, text)] for text in ("Figure 3 A caption of some words", "Adviser: Someone", "Someone wrote it, 2019.", "A line by itself")]
    top = [(1, 72, 100, 540, "Continues a page"), (1, 72, 116, 540, "and goes on")]
    far = [(0, 300, 100 + 16 * i, 540, "A line far to the right") for i in range(3)]
    boxed = [(0, 80, 100, 200, "Cell of a table"), *body]
    cases = [*map(_case, (wrap, bump, item, body + chrome, *lone, top, far)), _case(boxed, drawn=[(0, 76.0, 96.0, 210.0, 116.0)]), _case(body, drawn=[(0, 545.0, 290.0, 560.0, 310.0)])]
    got = _indents(spark, cases)
    assert got[0] == [(0, 4, 0.5, "pass")] and [(n, c) for n, c, *_ in got[1]] == [(0, 3)]
    assert got[2] == [(0, 3, None, "list"), (3, 2, 0.5, "pass")] and got[3] == [(0, 2, 0.5, "pass")]
    assert [[v for *_, v in one] for one in got[4:10]] == [["caption"], ["label_value"], ["reference"], ["uncertain"], ["page_top"], ["far_right_column"]]
    assert got[10] == [(1, 2, 0.5, "pass")] and [v for *_, v in got[11]] == ["beside_image"]


def test_indent_tables_stay_on_their_page(spark):
    """A contents row on one page takes in no line of the next; wraps below a table's columns are of the table."""
    from manuscript_jobs.operators import indentation as I

    rows = [(1, 0, 72, 120, 272, "Chapter One"), (1, 0, 352, 120, 372, "12"), (1, 0, 72, 150, 250, "wrap of a cell"), (1, 0, 72, 180, 250, "next wrap"), (1, 0, 200, 150, 300, "no column"), (1, 0, 72, 400, 540, "Far below")]
    rows += [(1, 1, 72, 120, 540, "Same place on the next page")]
    lines = spark.createDataFrame(_page_lines(rows), _LINE)
    assert [r.in_table for r in I.mark_indent_tables(lines).orderBy("n").collect()] == [True, True, True, True, False, False, False]
    assert [r.in_table for r in I.mark_indent_tables(lines, rounds=0).orderBy("n").collect()] == [True, True] + [False] * 5


def test_column_blocks_need_lines_side_by_side(spark):
    from manuscript_jobs.operators import indentation as I

    two = [(1, 0, x, 100 + 16 * i, x + 200, "w") for x in (72, 330) for i in range(5)]
    below = [(1, 1, 72 if i < 5 else 330, 100 + 16 * i, 500, "w") for i in range(10)]
    inset = [(1, 2, 72 + 36 * (i % 2), 100 + 16 * i, 500, "w") for i in range(10)]
    got = {(r.page_index, r.x0): r.block for r in I.column_blocks(spark.createDataFrame(_page_lines(two + below + inset), _LINE)).collect()}
    assert got == {(0, 72.0): 0, (0, 330.0): 1, (1, 72.0): 0, (1, 330.0): 0, (2, 72.0): 0, (2, 108.0): 0}


def test_indent_rules_are_never_guessed(spark):
    from manuscript_jobs.operators import indentation as I

    rows = [
        (0, None, 0.5, None, None), (1, "0.5 inch", None, None, None), (2, "36 pt", None, None, None), (3, "0.5 inch TAB", None, None, None), (4, "1 tab", None, None, None), (5, "IGNORE", None, "hanging", None),
        (6, None, None, None, None), (7, None, 0.5, "Hanging", None), (8, None, 0.0, "none", None), (9, None, 0.5, None, 0.05), (10, "as usual", None, None, None), (11, "hanging, 1 inch", None, None, None), (12, None, None, "disabled", None),
    ]
    df = spark.createDataFrame(rows, "k long, raw string, inches double, kind string, tolerance double")
    got = {r.k: r.rule and (r.rule.type, r.rule.inches, r.rule.tolerance) for r in df.selectExpr("*", "cast(null as long) as s").select("k", I.indent_rule(*[F.col(c) for c in ("raw", "inches", "kind", "tolerance", "s")]).alias("rule")).collect()}
    half = ("first_line", 0.5, 0.08)
    assert [got[i] for i in range(5)] == [half] * 5 and got[5] is None and got[6] is None and got[7] == ("hanging", 0.5, 0.08) and got[8] == ("none", 0.0, 0.08)
    assert got[9] == ("first_line", 0.5, 0.05) and got[10] is None and got[11] == ("hanging", 1.0, 0.08) and got[12] == ("none", 0.0, 0.08)


def test_page_indents_of_nothing(spark):
    from manuscript_jobs.operators import indentation as I

    assert I.page_indents(I.indented_paragraphs(spark.createDataFrame([], _LINE))).count() == 0
