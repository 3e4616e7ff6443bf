"""Dimensions and schemas that several operators share."""

from __future__ import annotations

# The scored categories in display order, severities from worst to least.
CATEGORIES = ("Fonts", "Margins", "Indentation", "Spacing", "Alignment", "Pagination", "Captions", "Citations")
SEVERITIES = ("critical", "moderate", "minor")

SPAN = "struct<text:string,font:string,size:double,bold:boolean,italic:boolean,color:int,bbox:array<double>>"
PARSED = (
    "doc_id long, text string, metadata struct<format:string>, "
    f"pages array<struct<page_index:int,width_points:double,height_points:double,image_count:int,"
    f"lines:array<struct<line_index:int,text:string,table_row:boolean,bbox:array<double>,spans:array<{SPAN}>>>>>, "
    "paragraphs array<struct<paragraph_index:int,section_index:int,style:string,text:string,"
    "runs:array<struct<text:string,font:string,size:double,bold:boolean,italic:boolean,color:string>>>>, "
    "sections array<struct<section_index:int,page_width_inches:double,page_height_inches:double,top_margin_inches:double,"
    "bottom_margin_inches:double,left_margin_inches:double,right_margin_inches:double>>"
)
