"""String, number and date rules as SQL expressions: each function takes expressions and gives one, for select, filter or spark.sql."""

from __future__ import annotations

# Prefixes of placeholders and the types they stand for.
PLACEHOLDER_TYPES = {
    "text": "TEXT", "qr": "QR", "table": "TABLE", "image": "IMAGE IMG", "date": "DATE", "time": "TIME", "datetime": "DATETIME",
    "number": "NUMBER NUM", "currency": "CURRENCY PLN", "percent": "PERCENT PCT", "boolean": "BOOLEAN BOOL", "list": "LIST",
    "checkbox": "CHECKBOX CHECK", "radio": "RADIO", "select": "SELECT", "signature": "SIGNATURE SIG", "barcode": "BARCODE",
    "hyperlink": "HYPERLINK LINK URL", "email": "EMAIL MAIL", "phone": "PHONE TEL", "address": "ADDRESS", "watermark": "WATERMARK WM",
    "footnote": "FOOTNOTE FN", "endnote": "ENDNOTE EN", "crossref": "CROSSREF REF", "formula": "FORMULA MATH EQUATION",
}
# Words of cross-references.
CROSSREF = {"heading": "Rozdział %", "figure": "Rysunek %", "table": "Tabela %", "equation": "Równanie (%)"}

PLACEHOLDER = r"(\\{\\{|\\{)\\s*([^{}]+?)\\s*(\\}\\}|\\})"
SPACES = r"' \t\n\u000B\u000C\r'"


def placeholder_names(text: str) -> str:
    """The names of all `{{ NAME }}` and `{ NAME }` in order."""
    return f"regexp_extract_all({text}, '{PLACEHOLDER}', 2)"


def sorted_names(text: str) -> str:
    """Each name of a placeholder once, in order."""
    return f"array_sort(array_distinct({placeholder_names(text)}))"


def placeholder_type(name: str) -> str:
    prefix = f"upper(substring_index({name}, ':', 1))"
    branches = " ".join("WHEN {} IN ({}) THEN '{}'".format(prefix, ", ".join(f"'{w}'" for w in words.split()), kind) for kind, words in PLACEHOLDER_TYPES.items())
    return f"CASE WHEN instr({name}, ':') = 0 THEN 'text' {branches} ELSE 'text' END"


def placeholder_key(name: str) -> str:
    return f"if(instr({name}, ':') = 0, {name}, substring({name}, instr({name}, ':') + 1))"


def spellings(key: str) -> str:
    """All spellings that a value for ``key`` replaces, the longest first; with a prefix also those of the bare name."""
    forms = lambda k: [f"concat('{a}', {k}, '{b}')" for a, b in (("{{ ", " }}"), ("{{ ", "}}"), ("{{", " }}"), ("{{", "}}"), ("{ ", " }"), ("{", "}"))]
    return f"if(instr({key}, ':') = 0, array({', '.join(forms(key))}), array({', '.join(forms(key) + [f for f in forms(placeholder_key(key)) if '{{ ' not in f or ' }}' in f])}))"


def currency(x: str) -> str:
    return f"concat(translate(format_number({x}, 2), ',.', ' ,'), ' PLN')"


def percent(x: str) -> str:
    return f"concat(replace(format_number({x}, 1), ',', ''), '%')"


def number(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN replace(format_number({x}, 0), ',', ' ') ELSE translate(format_number({x}, 2), ',.', ' ,') END"


def parsed_number(text: str) -> str:
    """A numeric text with blanks and a decimal comma, or null."""
    return f"try_cast(replace(replace({text}, ' ', ''), ',', '.') AS double)"


def date(x: str, kind: str = "date") -> str:
    picture = {"date": "dd.MM.yyyy", "time": "HH:mm", "datetime": "dd.MM.yyyy HH:mm"}[kind]
    return f"date_format({x}, '{picture}')"


def date_text(text: str, kind: str = "date") -> str:
    """ISO texts in the picture of ``kind``; others as they are."""
    return f"coalesce({date(f'try_to_timestamp({text})', kind)}, {text})"


def phone(text: str) -> str:
    bare = f"translate({text}, ' -()', '')"
    grouped = "'\\\\+48 $1 $2 $3'"
    three = "([0-9]{3})([0-9]{3})([0-9]{3})"
    return f"CASE WHEN {bare} RLIKE '^[0-9]{{9}}$' THEN regexp_replace({bare}, '^{three}$', {grouped}) WHEN {bare} LIKE '+48%' AND length({bare}) = 12 THEN concat('+48 ', substring({bare}, 4, 3), ' ', substring({bare}, 7, 3), ' ', substring({bare}, 10, 3)) ELSE {text} END"


def boolean(text: str) -> str:
    return f"if(lower({text}) IN ('true', 'yes', 'tak', '1'), 'Tak', 'Nie')"


def email(text: str) -> str:
    bare = f"trim({text})"
    return f"if(instr({bare}, '@') > 0 AND instr(split_part({bare}, '@', 2), '.') > 0, {bare}, {text})"


def hyperlink(label: str, url: str) -> str:
    return f"concat(coalesce({label}, {url}), ' (', {url}, ')')"


def crossref(kind: str, n: str, label: str = "''") -> str:
    branches = " ".join(f"WHEN '{k}' THEN replace('{form}', '%', {n})" for k, form in CROSSREF.items())
    return f"CASE {kind} {branches} ELSE coalesce(nullif({label}, ''), concat('Odwołanie ', {n})) END"


def footnote(marker: str, text: str) -> str:
    return f"if(coalesce({marker}, '') <> '', concat({marker}, '. ', {text}), concat('* ', {text}))"


def endnote(marker: str, text: str) -> str:
    return f"if(coalesce({marker}, '') <> '', concat({marker}, '. ', {text}), concat('[', {text}, ']'))"


def formula(text: str) -> str:
    return rf"concat('(', replace(replace({text}, '\\sum', 'Σ'), '\\int', '∫'), ')')"


def collapse_spaces(text: str) -> str:
    return f"regexp_replace({text}, ' +', ' ')"


def escape_html(text: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\\'", "&#39;")):
        text = f"replace({text}, '{plain}', '{entity}')"
    return text


def running(numbers: str) -> str:
    """The running sums of an array of ints. Blocks of 256 keep the growing arrays short, so the work is all but linear."""
    prefix = lambda a, start: f"slice(aggregate({a}, array({start}), (s, v) -> array_append(s, element_at(s, -1) + v)), 2, size({a}))"
    once = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    sums = once("os", f"concat(array(0), {prefix('ts', '0')})", f"flatten(zip_with(bs, slice(os, 1, size(bs)), (x, o) -> {prefix('x', 'o')}))")
    blocks = once("bs", "transform(sequence(0, (size(ns) - 1) div 256), b -> slice(ns, b * 256 + 1, 256))", once("ts", "transform(bs, x -> aggregate(x, 0, (s, v) -> s + v))", sums))
    return once("ns", numbers, f"if(size(ns) = 0, cast(array() AS array<int>), {blocks})")


def wrap(text: str, width: int) -> str:
    """Greedy wrap in one fold over the words. The first line of a text counts a column more than the next ones, as the rule has it."""
    words = f"filter(split({text}, '\\\\s+'), w -> w <> '')"
    start = "named_struct('done', '', 'line', '', 'cur', 0)"
    fits = f"acc.cur + length(w) + 1 <= {width}"
    add = "if(acc.done = '', '', concat(acc.done, '\\n'))"
    step = f"""(acc, w) -> CASE
        WHEN {fits} THEN named_struct('done', acc.done, 'line', if(acc.line = '', w, concat(acc.line, ' ', w)), 'cur', acc.cur + length(w) + 1)
        WHEN acc.line <> '' THEN named_struct('done', concat({add}, acc.line), 'line', w, 'cur', length(w))
        ELSE named_struct('done', concat({add}, w), 'line', '', 'cur', 0) END"""
    end = f"acc -> if(acc.line = '', acc.done, concat({add}, acc.line))"
    return f"if({text} IS NULL OR {text} = '' OR {width} <= 0, {text}, aggregate({words}, {start}, {step}, {end}))"


def metric_lines(text: str, width: float, size: float) -> str:
    """Lines that a text of font ``size`` takes in ``width`` points, at 0.6 of the size a character."""
    columns = max(1, int(width / (0.6 * size)))
    words = f"filter(split({text}, '\\\\s+'), w -> w <> '')"
    step = f"(acc, w) -> if(acc.cur > 0 AND acc.cur + length(w) + 1 > {columns}, named_struct('n', acc.n + 1, 'cur', length(w) + 1), named_struct('n', acc.n, 'cur', acc.cur + length(w) + 1))"
    return f"aggregate({words}, named_struct('n', 0, 'cur', 0), {step}, acc -> acc.n + if(acc.cur > 0, 1, 0))"


def heading(text: str, level: str) -> str:
    return f"CASE {level} WHEN 1 THEN concat({text}, '\\n', repeat('=', length({text}))) WHEN 2 THEN concat({text}, '\\n', repeat('-', length({text}))) ELSE concat(repeat('#', {level}), ' ', {text}) END"


def markdown_heading(text: str, level: str) -> str:
    return f"concat(repeat('#', least({level}, 6)), ' ', {text})"


def list_marker(kind: str, level: str) -> str:
    return f"concat(repeat('  ', {level}), CASE {kind} WHEN 'number' THEN '1.' WHEN 'alpha' THEN 'a.' WHEN 'roman' THEN 'i.' ELSE '•' END)"


def inline_markup(text: str, bold: str, italic: str, underline: str, strike: str = "false", code: str = "false") -> str:
    """A run's look as marks around its text, bold innermost."""
    for flag, a in ((bold, "**"), (italic, "*"), (underline, "_"), (strike, "~~"), (code, "`")):
        text = f"if({flag}, concat('{a}', {text}, '{a}'), {text})"
    return text


def ligatures(text: str) -> str:
    """Places (from 0) and forms of fi, fl, ff, ffi, ffl and ft, overlapping ones too.

    The text is cut at each f once and the pieces are bound to a variable, so no place is looked for from the text's start again.
    """
    starts = "aggregate(slice(ps, 1, size(ps) - 1), CAST(array() AS array<int>), (a, p) -> array_append(a, coalesce(try_element_at(a, -1), -1) + 1 + length(p)))"
    behind = "concat(left(ps[k + 1], 2), if(ps[k + 1] = '' AND k + 2 < size(ps), concat('f', left(get(ps, k + 2), 1)), ''))"
    found = f"transform({starts}, (at, k) -> transform(filter(array('ffi', 'ffl', 'fi', 'fl', 'ff', 'ft'), l -> startswith({behind}, substring(l, 2))), l -> named_struct('at', at, 'form', l)))"
    return f"transform(array(split({text}, 'f', -1)), ps -> flatten({found}))[0]"


def heading_level(style: str) -> str:
    return f"try_cast(nullif(regexp_extract(lower({style}), 'heading\\\\s*([0-9]+)', 1), '') AS int)"


def font_name(text: str) -> str:
    words = f"filter(split(trim({text}), '\\\\s+'), w -> w <> '')"
    return f"nullif(array_join(transform({words}, (w, i) -> if(i > 0 AND lower(w) IN ('new', 'of', 'the'), lower(w), concat(upper(substring(w, 1, 1)), lower(substring(w, 2))))), ' '), '')"


def similarity(a: str, b: str) -> str:
    """Equal characters at equal places against the longer length."""
    same = f"size(filter(sequence(1, greatest(least(length({a}), length({b})), 1)), i -> i <= least(length({a}), length({b})) AND substring({a}, i, 1) = substring({b}, i, 1)))"
    return f"if({a} = {b}, 1.0D, {same} / CAST(greatest(length({a}), length({b}), 1) AS double))"


def occurrences(text: str, part: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {part}, ''))) / length({part}) AS int)"
