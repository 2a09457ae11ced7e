"""Records the engine reads and writes, and the registries of metrics."""

from __future__ import annotations

LAYER = "struct<median:double,part:bigint,n:bigint,lo:double,hi:double,min:double,max:double,cv:double,verdict:string>"
RULES = (
    "corpus string, metric string, n long, median double, lo double, hi double, min double, max double, cv double, verdict string, "
    f"n_all long, n_layers int, layers array<{LAYER}>, n_entities long, n_entities_all long, is_rule boolean"
)
OBSERVATION = "corpus string, entity string, ord long, metric string, value double"

BLOCK = "struct<x1:int,y1:int,x2:int,y2:int,n:int,xh:double,lead:int,bases:array<int>,caps:array<int>,xtops:array<int>>"
COLOR = "struct<ground_share:double,n_colors:int,saturation:double,value:double,gray_share:double>"
PHOTO = "struct<depth_grad:double,objects:array<struct<label:string,score:double>>,verdict:string,note:string>"
POSTER = f"corpus string, file string, ord long, angle double, size array<int>, region array<double>, n_columns int, color {COLOR}, blocks array<{BLOCK}>, photo {PHOTO}"

LAYOUT = (
    "layout string, layer int, canvas struct<w:double,h:double>, "
    "blocks array<struct<id:string,x:double,x_width:double,cap_height:double,lines:array<struct<baseline:double>>>>"
)
PLACEMENT = "layout string, layer int, grid_lead double, blocks array<struct<id:string,x:double,y:double,cap_height:double,n_lines:int>>"

# A rule needs so many observations, at most this spread, and layers part at gaps so wide.
N_MIN = 20
CV_MAX = 0.30
LAYER_GAP = 10.0

# Metric, label, unit. A unit of "" is a plain number.
METRICS = (
    ("lead_over_cap", "leading / cap height", "ratio"),
    ("gap_px", "leading minus cap height", "px"),
    ("asc_over_xh", "ascender / x-height", "ratio"),
    ("align_ratio", "alignment lines / blocks", "ratio"),
    ("margin_left", "left margin", "share of width"),
    ("margin_right", "right margin", "share of width"),
    ("margin_top", "top margin", "share of height"),
    ("margin_bottom", "bottom margin", "share of height"),
    ("n_columns", "columns", "count"),
    ("cap_range", "largest / smallest letter height", "ratio"),
    ("text_area", "text area", "share of plate"),
    ("n_blocks", "blocks", "count"),
    ("ground_share", "ground colour", "share of plate"),
    ("n_colors", "colours", "count"),
    ("saturation", "saturation", "0..1"),
    ("value", "brightness", "0..1"),
    ("gray_share", "grey area", "share of plate"),
)
# Metrics that are declared but can't be measured.
BLOCKED = ("cap_ratio", "descender", "margin_const")
# Metrics that rotated posters give no value of.
EXCLUDED = ("margin_left", "margin_right", "margin_top", "margin_bottom", "text_area")

CONSTRAINT, FREE, INSUFFICIENT, MIXED, NO_VALUE = "constraint", "free", "insufficient", "mixed", "no_value"
