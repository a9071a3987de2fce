"""Declared schemas of the tables that the engine reads and makes."""

from __future__ import annotations

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
COLOR = "struct<r:int,g:int,b:int>"
SPAN = f"struct<span_seq:bigint,text:string,page_number:int,bbox:{BBOX},font_size:double,font_color:{COLOR},background_color:{COLOR}>"
SPANS = f"doc_id long, span_seq long, text string, page_number int, bbox {BBOX}, font_size double, font_color {COLOR}, background_color {COLOR}"
OCR_TOKENS = "doc_id long, page_index int, token_seq int, text string, conf int, left int, top int, width int, height int, dpi int"
PIXELS = "doc_id long, box_id long, r int, g int, b int"
PDF_PAGES = "doc_id long, page int, width double, height double"
IMAGE_RECTS = "doc_id long, page int, width double, height double"

VISIBLE, SUSPICIOUS, INVISIBLE, UNKNOWN = "visible", "suspicious", "invisible", "unknown"
LEVELS = ("safe", "low", "medium", "high", "critical")
STRATEGIES = ("strip", "flag", "preserve")
