"""Fixed schemas of the document relations, as DDL."""

RECT = "struct<x: double, y: double, width: double, height: double>"
SPAN = (
    f"struct<seq: int, text: string, href: string, has_leading_space: boolean, text_adjustment_before: double, natural_width: double, "
    f"character_spacing: double, word_spacing: double, bounds: {RECT}, direction: string, font_name: string, font_family: string, "
    "color: string, fill_opacity: double, stroke_color: string, rendering_mode: int, font_size: double, transform: array<double>>"
)
#: Clips are the paths that bound what is painted, outermost first.
CLIPS = "array<struct<d: string, fill_rule: string>>"
#: ``visible``: the area inside the clips, where there are any.
FILL = "struct<points: array<struct<x: double, y: double>>, color: string, opacity: double, visible: double>"
PATH = (
    "struct<d: string, fill: string, stroke: string, stroke_width: double, fill_opacity: double, stroke_opacity: double, "
    f"dasharray: array<double>, dashoffset: double, linecap: string, linejoin: string, fill_rule: string, clips: {CLIPS}>"
)
IMAGE = f"struct<width: int, height: int, format: string, data: binary, transform: array<double>, opacity: double, clips: {CLIPS}>"
ERROR = "struct<code: string, message: string>"
PAGES = (
    f"doc_id string, page int, width double, height double, rotate int, spans array<{SPAN}>, "
    f"fills array<{FILL}>, paths array<{PATH}>, images array<{IMAGE}>, error {ERROR}"
)
FONTS = (
    "doc_id string, page int, font_name string, font_id string, family string, format string, data binary, "
    f"glyphs array<struct<code: int, advance: double, own_colour: boolean, fills: array<{FILL}>, paths: array<{PATH}>>>, error {ERROR}"
)
