"""Rules for single values as SQL expressions: typed properties, half-points, colours, date pictures, XML text, markers, metrics, validity."""

from __future__ import annotations

from lamina.functions import formats
from lamina.functions import text as T

#: Pictures of fields and the patterns that Spark's date_format takes for them, longest first.
PICTURES = {"MMMM": "MMMM", "dddd": "EEEE", "yyyy": "yyyy", "AM/PM": "a", "am/pm": "a", "MMM": "MMM", "ddd": "EEE", "dd": "dd", "MM": "MM", "yy": "yy", "HH": "HH", "hh": "hh", "mm": "mm", "ss": "ss"}


def coerced(text: str, kind: str) -> str:
    """Struct (number, moment, flag, text) of a property: whole numbers, times and truth values by their type, the text always."""
    t = f"trim({text})"
    return f"named_struct('number', if({kind} IN ('i4', 'int', 'r8'), try_cast({t} AS double), if({kind} = 'app' AND {t} RLIKE '^[0-9]+$', try_cast({t} AS double), NULL)), 'moment', if({kind} IN ('filetime', 'date', 'created', 'modified', 'lastPrinted'), try_to_timestamp({t}), NULL), 'flag', if({kind} = 'bool', lower({t}) IN ('true', '1'), NULL), 'text', {t})"


def half_points(size: str) -> str:
    """A font size as half-points; what is no number stays, an empty one is null."""
    return f"if(coalesce({size}, '') = '', NULL, coalesce(cast(cast(try_cast({size} AS double) * 2 AS int) AS string), {size}))"


def valid_color(text: str) -> str:
    """Whether a text is a hex colour (#rrggbb or #rgb) or a known name."""
    names = ", ".join(f"'{k}'" for k in formats.COLORS)
    return f"coalesce({text} RLIKE '^#([0-9A-Fa-f]{{6}}|[0-9A-Fa-f]{{3}})$' OR lower({text}) IN ({names}), false)"


def valid_channels(r: str, g: str, b: str) -> str:
    return f"coalesce({r} BETWEEN 0 AND 255 AND {g} BETWEEN 0 AND 255 AND {b} BETWEEN 0 AND 255, false)"


def shown(moment: str, picture: str) -> str:
    """``moment`` in a field's picture (a Python string, known when the plan is made); letters that no picture has stay as they are."""
    out, rest = "", picture
    while rest:
        name = next((k for k in PICTURES if rest.startswith(k)), None)
        if name:
            out, rest = out + PICTURES[name], rest[len(name) :]
        else:
            out, rest = out + ("''" if rest[0] == "'" else f"'{rest[0]}'" if rest[0].isalpha() else rest[0]), rest[1:]
    escaped = out.replace("'", "\\'")
    return f"date_format({moment}, '{escaped}')"


def xml_text(xml: str, tag: str) -> str:
    """Texts of all elements of a local name, in order."""
    return f"xpath({xml}, '//*[local-name()=\"{tag}\"]/text()')"


def xml_count(xml: str, tag: str) -> str:
    return f"xpath_int({xml}, 'count(//*[local-name()=\"{tag}\"])')"


def xml_attribute(xml: str, tag: str, name: str) -> str:
    return f"xpath_string({xml}, '//*[local-name()=\"{tag}\"]/@*[local-name()=\"{name}\"]')"


def normalized_xml(xml: str) -> str:
    """Without declaration, namespace declarations, prefixes and white space between tags."""
    out = f"regexp_replace({xml}, '<[?][^>]*[?]>', '')"
    out = f"regexp_replace({out}, ' xmlns(:[A-Za-z0-9]+)?=\"[^\"]*\"', '')"
    out = f"regexp_replace({out}, '(</?)[A-Za-z0-9]+:', '$1')"
    return f"btrim(regexp_replace({out}, '>[ \\\\t\\\\n\\\\r]+<', '><'), ' \\t\\n\\r')"


def scoped_marker(template: str, n: str, form: str) -> str:
    """The marker of a counter that is scoped to its parent: number words, hex and binary are digits, a template without `%` gives way to the counter."""
    f = f"lower(coalesce({form}, ''))"
    counter = f"CASE {f} WHEN 'lowerletter' THEN {formats.letters(n)} WHEN 'upperletter' THEN upper({formats.letters(n)}) WHEN 'lowerroman' THEN lower({formats.roman(n)}) WHEN 'upperroman' THEN {formats.roman(n)} WHEN 'ordinal' THEN {formats.ordinal(n)} WHEN 'ordinaltext' THEN {formats.ordinal(n)} ELSE cast({n} AS string) END"
    return f"if(contains(coalesce({template}, ''), '%'), regexp_replace({template}, '%[1-9]', {counter}), {counter})"


def level_points(x: str) -> str:
    """A level's measure in points: over 144 it is in twips."""
    return f"if({x} > 144, {x} / 20D, cast({x} AS double))"


def spaced_width(width: str, text: str, spacing: str) -> str:
    """A text's width with character spacing added behind each of its characters."""
    return f"{width} + {spacing} * char_length({text})"


def text_ok(text: str) -> str:
    """Whether a text has anything in it and no run of ten blanks."""
    return f"(length({text}) > 0 AND NOT {text} RLIKE '[ \\\\t\\\\n]{{10,}}')"


def balanced(html: str, a: str, b: str) -> str:
    return f"(length({html}) - length(replace({html}, '{a}', ''))) * {len(b)} = (length({html}) - length(replace({html}, '{b}', ''))) * {len(a)}"


def json_ok(text: str) -> str:
    """Whether a text is one JSON value; the parser alone would pass what follows it."""
    whole = f"concat('[', {text}, ']')"
    return f"coalesce(try_parse_json({whole}) IS NOT NULL AND json_array_length({whole}) = 1, false)"


def filled_tokens(template: str, values: dict[str, str]) -> str:
    """``template`` with every token (`[PAGE]`, `{{Id}}`) replaced by its expression."""
    for token, value in values.items():
        template = f"replace({template}, '{token}', cast({value} AS string))"
    return template


def kept_stops(stops: str) -> str:
    """Tab stops at 0 or more, as texts."""
    return f"transform(filter({stops}, t -> t >= 0), t -> cast(t AS string))"


def valid_style(style: str) -> str:
    """Whether a style's properties (a map of texts) hold no font size of 0 or less, no negative spacing or indent and no unknown colour."""
    least = " AND ".join(f"coalesce(try_cast({style}['{k}'] AS double) >= 0, true)" for k in ("before", "after", "line", "left", "right", "first_line", "hanging"))
    color = f"{style}['color']"
    return f"(coalesce(try_cast({style}['size'] AS double) > 0, true) AND {least} AND (coalesce({color}, '') = '' OR {valid_color(color)} OR {color} RLIKE '^[0-9A-Fa-f]{{6}}$'))"


def rgb(text: str) -> str:
    """Struct (r, g, b) of a hex colour of three or six digits, with or without `#`; null for anything else."""
    bare = f"regexp_replace({text}, '^#', '')"
    six = f"if(length({bare}) = 3, regexp_replace({bare}, '(.)', '$1$1'), {bare})"
    part = lambda k: f"cast(conv(substring({six}, {2 * k + 1}, 2), 16, 10) AS int)"
    return f"if({bare} RLIKE '^([0-9A-Fa-f]{{3}}|[0-9A-Fa-f]{{6}})$', named_struct('r', {part(0)}, 'g', {part(1)}, 'b', {part(2)}), NULL)"


def rgb_hex(r: str, g: str, b: str) -> str:
    return "concat('#', " + ", ".join(f"lower(lpad(hex({c}), 2, '0'))" for c in (r, g, b)) + ")"


def hsl_rgb(h: str, s: str, light: str) -> str:
    """Struct (r, g, b) of a hue in degrees, saturation and lightness from 0 to 1."""
    span = f"(1 - abs(2 * {light} - 1)) * {s} / 2"
    # a channel is the lightness plus half the span times a trapezoid of the hue, shifted by a third of the circle for each
    part = lambda shift: f"cast(round(255 * ({light} + 2 * {span} * (greatest(0D, least(1D, 2 - abs(pmod({h} / 60D + {shift}, 6D) - 3))) - 0.5D))) AS int)"
    return f"named_struct('r', {part(3)}, 'g', {part(1)}, 'b', {part(5)})"


def united(a: str, b: str) -> str:
    """The least rectangle (struct x, y, w, h) that holds both."""
    low = lambda s: f"least({a}.{s}, {b}.{s})"
    size = lambda s, e: f"greatest({a}.{s} + {a}.{e}, {b}.{s} + {b}.{e}) - {low(s)}"
    return f"named_struct('x', {low('x')}, 'y', {low('y')}, 'w', {size('x', 'w')}, 'h', {size('y', 'h')})"


def number_or_text(text: str) -> str:
    """A numeric text with blanks and a decimal comma as its number's text; any other text as it is."""
    return f"coalesce(cast(try_cast(replace(replace({text}, ' ', ''), ',', '.') AS double) AS string), {text})"


def field_parts(instruction: str) -> str:
    """Struct of a field: name, target (the first word behind it that is no switch), levels (`\\o "1-3"`), picture (`\\@`), number_format (`\\*`), display (`\\#`), flags (single-letter switches)."""
    t = f"trim({instruction})"
    option = lambda s: f"nullif(regexp_extract({t}, '\\\\\\\\{s} *\"?([^\"\\\\\\\\]*[^\"\\\\\\\\ ])\"?', 1), '')"
    return f"named_struct('name', upper(regexp_extract({t}, '^(\\\\S+)', 1)), 'target', nullif(regexp_extract({t}, '^\\\\S+ +([^\\\\\\\\ ]+)', 1), ''), 'levels', {option('o')}, 'picture', {option('@')}, 'number_format', {option('[*]')}, 'display', {option('#')}, 'flags', array_sort(array_distinct(regexp_extract_all({t}, '\\\\\\\\([a-np-z])(?= |$)', 1))))"


def page_tokens(text: str, page: str, pages: str, moment: str) -> str:
    """`[PAGE]`, `[NUMPAGES]`, `[DATE]` and `[TIME]` of a header or footer replaced."""
    return filled_tokens(text, {"[PAGE]": page, "[NUMPAGES]": pages, "[DATE]": f"date_format({moment}, 'dd.MM.yyyy')", "[TIME]": f"date_format({moment}, 'HH:mm')"})


def text_paragraph(text: str, kind: str, level: str, form: str, bold: str, italic: str, width: int) -> str:
    """A paragraph in plain text: marked-up, then as a heading, a list item or wrapped."""
    marked = T.inline_markup(text, bold, italic, "false")
    return f"CASE {kind} WHEN 'heading' THEN {T.heading(marked, level)} WHEN 'list_item' THEN concat({T.list_marker(form, level)}, ' ', {marked}) ELSE {T.wrap(marked, width)} END"
