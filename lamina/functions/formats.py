"""Counters, units, colours, fields, media and geometry as SQL expressions."""

from __future__ import annotations

# Factors of the unit converter, which goes through millimetres.
TO_MM = {"emu": "0.000027778D", "twip": "0.0176389D"}
MM_TO_PT = "2.834645669D"
# Colour names of HTML attributes.
COLORS = {
    "black": "000000", "white": "FFFFFF", "red": "FF0000", "green": "008000", "blue": "0000FF", "yellow": "FFFF00", "cyan": "00FFFF",
    "magenta": "FF00FF", "gray": "808080", "grey": "808080", "orange": "FFA500", "purple": "800080", "brown": "A52A2A", "pink": "FFC0CB",
}
# Number words and signs.
CARDINALS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
KOREAN, KOREAN_TEN, CHINESE = "일이삼사오육칠팔구", "십", "一二三四五六七八九"
# First bytes of media formats, in hexadecimal, and the class of each.
MAGIC = {"png": "89504E47", "jpg": "FFD8FF", "bmp": "424D", "gif": "47494638", "emf": "01000000", "wmf": "D7CDC69A"}
CLASSES = {"image": ("89504E47", "FFD8FF", "424D", "474946383761", "474946383961"), "font": ("4F54544F", "00010000", "774F4646", "774F4632"), "pdf": ("25504446",), "archive": ("504B",)}


def _place(n: str, divisor: int, one: str, five: str, ten: str) -> str:
    forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    return f"element_at(array({', '.join(repr(f) for f in forms)}), CAST(({n} div {divisor}) % 10 AS int) + 1)"


def roman(n: str) -> str:
    body = ", ".join(_place(n, d, *s) for d, s in ((1000, ("M", "", "")), (100, ("C", "D", "M")), (10, ("X", "L", "C")), (1, ("I", "V", "X"))))
    return f"CASE WHEN {n} <= 0 THEN '' WHEN {n} > 3999 THEN CAST({n} AS string) ELSE concat({body}) END"


def letters(n: str) -> str:
    """a to z, aa, ab ...: the digits of a number system without zero, folded from the right."""
    step = "(acc, i) -> if(acc.n < 0, acc, named_struct('n', CAST(acc.n div 26 - 1 AS bigint), 's', concat(char(97 + CAST(acc.n % 26 AS int)), acc.s)))"
    return f"if({n} <= 0, '', aggregate(sequence(1, 14), named_struct('n', CAST({n} - 1 AS bigint), 's', ''), {step}, acc -> acc.s))"


def ordinal(n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN '' ELSE concat({n}, CASE WHEN {n} % 100 BETWEEN 10 AND 20 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END) END"


def cardinal(n: str) -> str:
    ones = f"element_at(array({', '.join(map(repr, CARDINALS))}), CAST({n} AS int))"
    tens = f"element_at(array({', '.join(map(repr, TENS))}), CAST({n} div 10 AS int) - 1)"
    return f"CASE WHEN {n} <= 0 THEN '' WHEN {n} < 20 THEN {ones} WHEN {n} < 100 AND {n} % 10 = 0 THEN {tens} ELSE CAST({n} AS string) END"


def korean(n: str) -> str:
    digit = lambda d: f"substring('{KOREAN}', CAST({d} AS int), 1)"
    return f"CASE WHEN {n} <= 0 THEN '' WHEN {n} < 10 THEN {digit(n)} WHEN {n} < 100 THEN concat(if({n} >= 20, {digit(f'({n} div 10)')}, ''), '{KOREAN_TEN}', if({n} % 10 > 0, {digit(f'({n} % 10)')}, '')) ELSE CAST({n} AS string) END"


def chinese(n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN '' WHEN {n} < 10 THEN substring('{CHINESE}', CAST({n} AS int), 1) ELSE CAST({n} AS string) END"


def counter(n: str, form: str) -> str:
    f = f"lower({form})"
    return f"""CASE WHEN {f} = 'lowerletter' THEN {letters(n)} WHEN {f} = 'upperletter' THEN upper({letters(n)}) WHEN {f} = 'lowerroman' THEN lower({roman(n)})
        WHEN {f} = 'upperroman' THEN {roman(n)} WHEN {f} IN ('korean', 'koreanlegal') THEN {korean(n)}
        WHEN {f} IN ('chinesenum', 'chinesetraditional', 'chinesesimplified') THEN {chinese(n)} WHEN {f} IN ('ordinal', 'ordinaltext') THEN {ordinal(n)}
        WHEN {f} = 'cardinaltext' THEN {cardinal(n)} WHEN {f} = 'hex' THEN lower(hex({n})) WHEN {f} = 'binary' THEN bin({n}) ELSE CAST({n} AS string) END"""


def marker(template: str, n: str, form: str) -> str:
    """The marker of a list level: every `%1` to `%9` gets the same counter; bullets map private glyphs to plain ones."""
    bullet = f"CASE {template} WHEN '\\uf0b7' THEN '•' WHEN '\\uf0d8' THEN '◘' WHEN '\\uf0a7' THEN '►' WHEN '\\uf0fc' THEN '▪' ELSE coalesce(nullif({template}, ''), '•') END"
    return f"CASE WHEN {form} = 'bullet' THEN {bullet} WHEN {form} IN ('none', 'nothing') THEN '' ELSE regexp_replace(coalesce(nullif({template}, ''), '%1.'), '%[1-9]', {counter(n, form)}) END"


def marker_token(text: str) -> str:
    """What makes markers equal: the first word, counters as their numbers (`%1.` is `1`), without closing punctuation."""
    return f"rtrim(').,:;', regexp_extract(trim(regexp_replace({text}, '%([0-9]+)', '$1')), '^(\\\\S*)', 1))"


def convert(x: str, a: str, b: str, dpi: int = 96) -> str:
    """Units through millimetres, by the fixed factors."""
    units = ("emu", "twip", "pt", "mm", "px")
    if a not in units or b not in units:
        raise ValueError(f"no conversion from {a} to {b}")
    mm = {"emu": f"({x} * {TO_MM['emu']})", "twip": f"({x} * {TO_MM['twip']})", "pt": f"({x} / {MM_TO_PT})", "mm": f"({x})", "px": f"({x} * 25.4D / {dpi})"}[a]
    return {"emu": f"({mm} / {TO_MM['emu']})", "twip": f"({mm} / {TO_MM['twip']})", "pt": f"({mm} * {MM_TO_PT})", "mm": mm, "px": f"({mm} * {dpi} / 25.4D)"}[b]


def points(x: str, unit: str, dpi: int = 96) -> str:
    return {"twip": f"({x} / 20.0D)", "emu": f"({x} * 72.0D / 914400.0D)", "px": f"({x} * 72.0D / {dpi}.0D)"}[unit]


def html_font_size(text: str) -> str:
    """CSS font sizes in half-points, as text."""
    value = f"CAST(nullif(regexp_extract(trim({text}), '^([0-9.]+)', 1), '') AS double)"
    return f"CAST(CAST(floor({value} * 2 * CASE WHEN lower({text}) LIKE '%px%' THEN 0.75D WHEN lower({text}) LIKE '%em%' THEN 12D ELSE 1D END) AS int) AS string)"


def rounded_spacing(x: str) -> str:
    return f"nullif(greatest(CAST(bround({x} / 120.0D) AS int) * 120, 0), 0)"


def html_color(text: str) -> str:
    low = f"lower(trim({text}))"
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COLORS.items())
    byte = lambda k: f"lpad(hex(CAST(regexp_extract({low}, 'rgb\\\\(([0-9]+),\\\\s*([0-9]+),\\\\s*([0-9]+)\\\\)', {k}) AS int)), 2, '0')"
    return f"""CASE WHEN {low} LIKE '#%' AND length({low}) = 4 THEN upper(regexp_replace(substring({low}, 2), '(.)', '$1$1')) WHEN {low} LIKE '#%' AND length({low}) = 7 THEN upper(substring({low}, 2))
        WHEN {low} RLIKE 'rgb\\\\([0-9]+,\\\\s*[0-9]+,\\\\s*[0-9]+\\\\)' THEN concat({byte(1)}, {byte(2)}, {byte(3)}) ELSE CASE {low} {names} END END"""


def hex_color(text: str) -> str:
    bare = f"regexp_replace(trim({text}), '^#', '')"
    return f"if({bare} RLIKE '^[0-9A-Fa-f]{{6}}$', upper({bare}), {bare})"


def channel(color: str, k: int) -> str:
    """Red (0), green (1) or blue (2) of six hexadecimal digits."""
    return f"CAST(conv(substring({color}, {2 * k + 1}, 2), 16, 10) AS int)"


def hsl(r: str, g: str, b: str) -> str:
    """Hue in degrees, saturation and lightness of channels from 0 to 255."""
    r, g, b = (f"({c} / 255.0D)" for c in (r, g, b))
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    span, light = f"({top} - {low})", f"(({top} + {low}) / 2)"
    hue = f"CASE WHEN {span} = 0 THEN 0D WHEN {top} = {r} THEN 60 * pmod(({g} - {b}) / {span}, 6) WHEN {top} = {g} THEN 60 * (({b} - {r}) / {span} + 2) ELSE 60 * (({r} - {g}) / {span} + 4) END"
    return f"named_struct('h', {hue}, 's', if({span} = 0, 0D, {span} / (1 - abs(2 * {light} - 1))), 'l', {light})"


def field_type(instruction: str) -> str:
    text = f"upper(trim({instruction}))"
    return "CASE " + " ".join(f"WHEN {text} LIKE '{k}%' THEN '{k}'" for k in ("PAGE", "DATE", "REF", "TOC", "NUMPAGES", "TIME", "AUTHOR", "TITLE")) + " ELSE 'unknown' END"


def field_date_picture(instruction: str) -> str:
    return f"nullif(regexp_extract({instruction}, '\\\\\\\\@ *\"([^\"]*)\"', 1), '')"


def sniff(content: str) -> str:
    return "CASE " + " ".join(f"WHEN startswith({content}, X'{m}') THEN '{k}'" for k, m in MAGIC.items()) + " END"


def media_class(content: str) -> str:
    tests = " ".join("WHEN {} THEN '{}'".format(" OR ".join(f"startswith({content}, X'{m}')" for m in ms), k) for k, ms in CLASSES.items())
    return f"CASE WHEN octet_length({content}) = 0 THEN 'unknown' {tests} ELSE 'other' END"


def valid_id(x: str) -> str:
    return f"{x} RLIKE '^[A-Za-z0-9_-]{{1,100}}$'"


def text_width(text: str, size: str) -> str:
    return f"(length({text}) * 0.6D * {size})"


def block_height(kind: str, text: str, rows: str, height: str) -> str:
    """Millimetres of a block: lines of 80 characters, rows of 20, an image's own height or 50."""
    return f"CASE {kind} WHEN 'paragraph' THEN greatest(1, CAST(length({text}) div 80 AS int)) * 12 * 1.2D * 0.35D WHEN 'image' THEN coalesce({height}, 50D) WHEN 'table' THEN {rows} * 20D ELSE 20D END"


def aligned_x(x: str, width: str, text: str, how: str) -> str:
    return f"CASE {how} WHEN 'center' THEN {x} + ({width} - {text}) / 2 WHEN 'right' THEN {x} + {width} - {text} ELSE {x} END"


def intersects(a: str, b: str) -> str:
    """Rectangles as structs x, y, w, h."""
    return f"NOT ({a}.x + {a}.w < {b}.x OR {b}.x + {b}.w < {a}.x OR {a}.y + {a}.h < {b}.y OR {b}.y + {b}.h < {a}.y)"


def table_width(kind: str, x: str, usable: str) -> str:
    return f"CASE {kind} WHEN 'pct' THEN least(greatest({x} / 5000.0D, 0D), 1D) * {usable} WHEN 'dxa' THEN {x} / 20.0D ELSE {usable} END"
