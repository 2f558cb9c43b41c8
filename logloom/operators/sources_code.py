"""Declarations in source text: a conditional preprocessor, resource bindings, record layouts.

Extraction needs offsets inside a file and conditions that span lines, which no built-in expression has;
it runs per file in mapInPandas, one file in memory at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions import columns as C

DIRECTIVE = re.compile(r"^\s*#\s*(ifdef|ifndef|if|elif|else|endif|define|undef)\b\s*(.*?)\s*(?://.*)?$")
LINE = re.compile(r'^#line (\d+) ".*"', re.M)
_LEXEME = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<word>\w+|&&|\|\||[<>=!]=|<<|>>|\S)", re.S)
#: Binary operators of conditions by how tightly they bind.
_BINDING = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_NUMBER = re.compile(r"(0[xX][0-9a-fA-F]+|\d+)[uUlL]*")


def words_of(text: str) -> list[str]:
    """Words and signs of source text without comments."""
    return [m["word"] for m in _LEXEME.finditer(text) if m["word"]]


def _operate(sign: str, a: int | None, b: int | None) -> int | None:
    """A binary operator on 64-bit numbers; None is nonsense, which only a decided && or || forgives."""
    if sign == "&&":
        return 0 if a == 0 or b == 0 else None if a is None or b is None else 1
    if sign == "||":
        return 1 if a or b else None if a is None or b is None else 0
    if a is None or b is None or sign in ("/", "%") and b == 0 or sign in ("<<", ">>") and not 0 <= b < 64:
        return None
    if sign in ("/", "%"):
        whole = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        value = whole if sign == "/" else a - b * whole
    else:
        value = {"|": a | b, "^": a ^ b, "&": a & b, "==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "+": a + b, "-": a - b, "*": a * b, "<<": a << b if sign == "<<" else 0, ">>": a >> b if sign == ">>" else 0}[sign]
    return (int(value) + (1 << 63)) % (1 << 64) - (1 << 63)


def _expanded(words: list[str], defines: dict[str, str], most: int = 1_000_000) -> list[str] | None:
    """The words of a condition with defined() decided and names replaced; None where that does not end in `most` steps."""
    out: list[str] = []
    todo = [(w, frozenset()) for w in reversed(words)]
    steps = 0
    while todo:
        word, hidden = todo.pop()
        steps += 1
        if steps > most:
            return None
        if word == "defined":
            name = todo.pop()[0] if todo else ""
            if name == "(":
                name = todo.pop()[0] if todo else ""
                if not todo or todo.pop()[0] != ")":
                    return None
            out.append(str(int(name in defines)))
        elif word[0].isalpha() or word[0] == "_":
            value = defines.get(word) if word not in hidden else None
            if value is None:
                out.append("0")
            elif not (inner := words_of(value)):
                out.append("1")
            else:
                todo += [(w, hidden | {word}) for w in reversed(["(", *inner, ")"])]
        else:
            out.append(word)
    return out


def holds(expression: str, defines: dict[str, str]) -> bool:
    """Value of a condition: 64-bit integers, defined(), comparison, arithmetic, bits, logic. Unknown names are 0; nonsense is false."""
    words = _expanded(words_of(expression), defines)
    if words is None:
        return False
    values: list[int | None] = []
    signs: list[str] = []

    def reduce_to(least: int) -> bool:
        """Applies the waiting operators that bind at least so tightly; False where an operand is missing."""
        while signs and signs[-1] != "(" and (signs[-1][0] == "u" or _BINDING[signs[-1]] >= least):
            sign = signs.pop()
            if len(values) < (1 if sign[0] == "u" else 2):
                return False
            b = values.pop()
            if sign[0] == "u":
                values.append(None if b is None else {"u!": int(not b), "u-": -b, "u+": b, "u~": ~b}[sign])
            else:
                values.append(_operate(sign, values.pop(), b))
        return True

    operand = True
    for w in words:
        if operand:
            if w in "!-+~":
                signs.append("u" + w)
            elif w == "(":
                signs.append(w)
            elif m := _NUMBER.fullmatch(w):
                number = int(m[1], 16 if m[1][:2] in ("0x", "0X") else 10) if len(m[1]) <= 20 else 1 << 64
                values.append(number if number < 1 << 63 else None)
                operand = False
            else:
                return False
        elif w == ")":
            if not reduce_to(0) or not signs:
                return False
            signs.pop()
        elif w in _BINDING:
            if not reduce_to(_BINDING[w]):
                return False
            signs.append(w)
            operand = True
        else:
            return False
    return not operand and reduce_to(0) and not signs and len(values) == 1 and bool(values[0])


def active_lines(text: str, defines: list[str] | dict[str, str]) -> list[tuple[int, str]]:
    """(line number from 1, line) of the lines that remain under the defines; directives themselves don't."""
    known = dict(defines) if isinstance(defines, dict) else {d.partition("=")[0]: d.partition("=")[2] or "1" for d in defines}
    stack: list[list[bool]] = []  # [branch active, some branch taken, parent active]
    out = []
    for number, line in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        m = DIRECTIVE.match(line)
        live = not stack or stack[-1][0]
        if not m:
            if live:
                out.append((number, line))
            continue
        word, rest = m[1], m[2]
        if word in ("if", "ifdef", "ifndef"):
            name = rest.split()[0] if rest.split() else ""
            yes = holds(rest, known) if word == "if" else (name in known) == (word == "ifdef")
            stack.append([live and yes, yes, live])
        elif word in ("elif", "else") and stack:
            top = stack[-1]
            yes = not top[1] and (word == "else" or holds(rest, known))
            top[0], top[1] = top[2] and yes, top[1] or yes
        elif word == "endif" and stack:
            stack.pop()
        elif live and word == "define" and rest:
            name, _, value = rest.partition(" ")
            known[name.split("(")[0]] = value.strip()
        elif live and word == "undef":
            known.pop(rest.strip(), None)
    return out


def matches_with_lines(pattern: re.Pattern[str], text: str) -> Iterator[tuple[int, re.Match[str]]]:
    """All matches with the line, from 1, where each starts; a #line directive renumbers the lines after it."""
    turns = [(m.start(), int(m[1])) for m in LINE.finditer(text)]
    line, at, shift = 1, 0, 0
    for m in pattern.finditer(text):
        while turns and turns[0][0] <= m.start():
            start, number = turns.pop(0)
            line += text.count("\n", at, start)
            at, shift = start, number - line - 1
        line += text.count("\n", at, m.start())
        at = m.start()
        yield line + shift, m


def line_matches(files: DataFrame, pattern: str, group: int = 0) -> DataFrame:
    """(path, line, found): lines that start with the pattern; stays in the JVM."""
    from logloom.sources.files import lines_of

    anchored = f"^(?:{pattern})"
    rows = lines_of(files, "content", "path").where(F.col("line").rlike(anchored))
    return rows.select("path", F.col("line_no").alias("line"), F.regexp_extract("line", anchored, group).alias("found"))


#: The resource types whose bindings are reported; all but samplers also with RW before.
SAMPLERS = ("SamplerState", "SamplerComparisonState")
RESOURCES = ("Buffer", "StructuredBuffer", "Texture1D", "Texture2D", "Texture3D", "TextureCube")
BOUND = {*SAMPLERS, *RESOURCES, *(f"RW{r}" for r in RESOURCES)}
#: The letters of register classes that count.
REGISTER_LETTERS = "butsg"


class Reader:
    """Words of source text with their lines, read from left to right."""

    def __init__(self, text: str) -> None:
        self.words: list[str] = []
        self.lines: list[int] = []
        line, at = 1, 0
        for m in _LEXEME.finditer(text):
            if m["word"]:
                line += text.count("\n", at, m.start())
                at = m.start()
                self.words.append(m["word"])
                self.lines.append(line)
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.words[self.at + ahead] if self.at + ahead < len(self.words) else ""

    def take(self, *wanted: str) -> bool:
        """Moves over these words if they come next."""
        if tuple(self.words[self.at : self.at + len(wanted)]) != wanted:
            return False
        self.at += len(wanted)
        return True

    def name(self) -> str | None:
        word = self.peek()
        if not (word[:1].isalnum() or word[:1] == "_"):
            return None
        self.at += 1
        return word

    def argument(self) -> str | None:
        """The name in <name>."""
        if self.peek() == "<" and self.peek(2) == ">":
            self.at += 1
            found = self.name()
            if found and self.take(">"):
                return found
        return None

    def register(self) -> tuple[str, int] | None:
        """Class and number of `: register(x0)`."""
        start = self.at
        if self.take(":", "register", "("):
            word = self.name() or ""
            if word[:1].isalpha() and word[:1].islower() and word[1:].isdecimal() and self.take(")"):
                return word[0], int(word[1:])
        self.at = start
        return None

    def body(self) -> list[list[str]]:
        """The members, as words between semicolons, of the braces that come next; what holds braces itself is no member."""
        members: list[list[str]] = [[]]
        depth = 0
        while self.at < len(self.words):
            word = self.words[self.at]
            self.at += 1
            if word == "{":
                depth += 1
                members[-1] = []
            elif word == "}":
                depth -= 1
                members[-1] = members[-1] if depth <= 0 else []
                if depth <= 0:
                    break
            elif depth == 1 and word == ";":
                members.append([])
            elif depth == 1:
                members[-1].append(word)
        return members


def field_size(type_: str, count: int, corrected: bool = False) -> tuple[int, bool]:
    """(bytes, unknown) of a field; the Python twin of columns.field_size."""
    m = re.fullmatch(r"(.+?)\[(\d+)\]", type_)
    base, count = (m[1], count * int(m[2])) if m else (type_, count)
    if base.endswith("*"):
        return schemas.POINTER_SIZE * count, False
    shape = re.search(r"FLOAT(\d)X(\d)", base.upper())
    if shape and (corrected or "XM" not in base.upper()):
        return 4 * int(shape[1]) * int(shape[2]) * count, False
    sizes = schemas.TYPE_SIZES | (schemas.MORE_TYPE_SIZES if corrected else {})
    name = base.rpartition("::")[2].lower()
    return sizes.get(name, schemas.DEFAULT_SIZE) * count, bool(shape) or name not in sizes


def parse_member(text: str | list[str], host: bool) -> dict | None:
    """A member's type, name and dimensions; what follows them is not judged. None where it has no type and name."""
    r = Reader("")
    r.words = words_of(text) if isinstance(text, str) else text
    if not host and r.peek() in ("row_major", "column_major"):
        r.at += 1
    parts = [r.name() or ""]
    while parts[-1] and r.take(":", ":"):
        parts += ["::", r.name() or ""]
    if not parts[-1]:
        return None
    kind = "".join(parts)
    if argument := r.argument():
        kind += f"<{argument}>"
    if host and r.take("*"):
        kind += "*"
    name = r.name()
    if not name:
        return None
    pack = None
    if not host and r.take(":", "packoffset", "("):
        inside = r.words[r.at : r.words.index(")", r.at)] if ")" in r.words[r.at :] else []
        pack, r.at = "".join(inside) or None, r.at + len(inside) + 1
    count = 1
    while r.peek() == "[" and r.peek(1).isdecimal() and r.peek(2) == "]":
        count *= int(r.peek(1))
        r.at += 3
    size, unknown = field_size(kind, count)
    return {"name": f"{name}[{count}]" if count > 1 else name, "type": kind, "size": size, "array_size": count, "is_unknown_type": unknown, "packoffset": pack}


def aligned(fields: list[dict]) -> int:
    return sum(-(-f["size"] // 16) * 16 for f in fields)


def _layouts_in(text: str, host: bool) -> Iterator[tuple[str, int, str, list[dict]]]:
    """(kind, line, name, fields) of every record, inner ones too."""
    r = Reader(text)
    while r.at < len(r.words):
        word, line = r.peek(), r.lines[r.at]
        r.at += 1
        if word == "ConstantBuffer" and not host:
            if not r.argument():
                continue
        elif word != "struct" and (host or word != "cbuffer"):
            continue
        if host and r.take("alignas", "("):
            r.at += 1
            if not r.take(")"):
                continue
        name = r.name()
        if not name:
            continue
        if not host:
            r.register()
        if r.peek() != "{":
            continue
        inner = r.at + 1
        members = [m for m in r.body() if m and not (host and m[0] == "static")]
        r.at = inner
        yield word, line, name, [f for m in members if (f := parse_member(m, host))]


def shader_layouts(text: str) -> list[dict]:
    """Layouts by name (the last of a name stays), then element types of structured buffers not defined in the file."""
    found: dict[str, dict] = {}
    for kind, line, name, fields in _layouts_in(text, False):
        if name.lower() in schemas.TYPE_SIZES:
            continue
        cbuffer, constant = kind == "cbuffer", kind == "ConstantBuffer"
        size = aligned(fields) if cbuffer or constant else sum(f["size"] for f in fields)
        found[name] = {"name": name, "fields": fields, "line": line, "is_cbuffer": cbuffer, "is_constant_buffer": constant, "is_template": False, "template_type": None, "size": size}
    r = Reader(text)
    while r.at < len(r.words):
        word, line = r.peek(), r.lines[r.at]
        r.at += 1
        if word not in ("StructuredBuffer", "RWStructuredBuffer") or not (element := r.argument()) or not (name := r.name()) or not r.register():
            continue
        known = found.get(element)
        if element in schemas.TYPE_SIZES or known and known["fields"] and not known["is_template"]:
            continue
        empty = {"fields": [], "line": line, "is_cbuffer": False, "is_constant_buffer": False, "is_template": True, "size": None}
        found.setdefault(element, {"name": element, "template_type": None, **empty})
        found.setdefault(name, {"name": name, "template_type": element, **empty})
    return list(found.values())


def host_layouts(text: str) -> list[dict]:
    """Layouts without static members; none for a struct without members or with a pointer."""
    found: dict[str, dict] = {}
    for _, line, name, fields in _layouts_in(text, True):
        if name.lower() in schemas.TYPE_SIZES or not fields or any("*" in f["type"] for f in fields):
            continue
        found[name] = {"name": name, "fields": fields, "line": line, "is_cbuffer": False, "is_constant_buffer": False, "is_template": False, "template_type": None, "size": sum(f["size"] for f in fields)}
    return list(found.values())


def layouts(files: DataFrame) -> DataFrame:
    """Record layouts of (path, content): shader sources by extension, host sources else; shader stage records fall out.

    A template element gives way to a real definition of its name in any file.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["content"]):
                shader = path.lower().endswith((".hlsl", ".hlsli"))
                for s in shader_layouts(text or "") if shader else host_layouts(text or ""):
                    rows.append({"language": "shader" if shader else "host", "file": path, **s})
            yield pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in re.sub(r"<.*>", "", schemas.STRUCT).split(", ")]
    found = files.select("path", "content").mapInPandas(run, schemas.STRUCT).where(~((F.col("language") == "shader") & C.is_io_name("name")))
    real = found.where(~F.col("is_template") & (F.size("fields") > 0)).select("language", "name").distinct()
    return found.where(~F.col("is_template")).unionByName(found.where("is_template").join(real, ["language", "name"], "left_anti"))


BINDINGS = "path string, combo string, defines array<string>, line int, name string, type string, template_type string, register_class string, number int"


def bindings_in(line: str) -> list[tuple[str, str, str | None, str, int]]:
    """(name, type, template type, register class, number) of the declarations that a line closes."""
    r, found = Reader(line), []
    while r.at < len(r.words):
        word, start = r.peek(), r.at + 1
        r.at = start
        element = r.argument() if word == "ConstantBuffer" or word in BOUND else None
        if word == "cbuffer" or word in BOUND or element:
            name = r.name()
            place = r.register() if name else None
            if place and place[0] in REGISTER_LETTERS and r.peek() in (";", ""):
                found.append((name, word + (f"<{element}>" if element else ""), element, *place))
                continue
        r.at = start
    return found


def bindings(files: DataFrame) -> DataFrame:
    """Resource bindings of (path, content, combo, defines): one row per declaration that is active under the combination."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text, combo, defines in zip(part["path"], part["content"], part["combo"], part["defines"]):
                for number, line in active_lines(text or "", list(defines)):
                    for name, kind, element, letter, place in bindings_in(line):
                        if name.lower() not in schemas.TYPE_SIZES and not name.upper().endswith(("_INPUT", "_OUTPUT")):
                            rows.append((path, combo, list(defines), number, name, kind, element, letter, place))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BINDINGS.split(", ")])

    return files.select("path", "content", "combo", "defines").mapInPandas(run, BINDINGS)


def registers(found: DataFrame) -> DataFrame:
    """One row per declaration (path, line): attributes of the first combination, flags and combinations merged."""
    first = F.min_by(F.struct("name", "type", "template_type", "register_class", "number"), "combo").alias("d")
    flags = [F.bool_or(F.array_contains("defines", d)).alias(d.lower()) for d in ("PSHADER", "VSHADER", "VR")]
    merged = found.groupBy("path", "line").agg(first, *flags, F.array_sort(F.collect_set("combo")).alias("combos"))
    register = F.concat(F.lower("d.register_class"), F.col("d.number").cast("string"))
    register_type = F.coalesce(C.lookup(schemas.REGISTER_CLASSES, F.lower("d.register_class")), F.lit("Unknown"))
    return merged.select("path", "line", register.alias("register"), C.feature_of("path").alias("feature"), "d.*", register_type.alias("register_type"), "pshader", "vshader", "vr", "combos")


def conflicts_by_unit(rows: DataFrame, unit: list[str], register: str, feature: str) -> DataFrame:
    """Registers that more than one feature uses in a unit."""
    used = rows.groupBy(*unit, register).agg(F.count_distinct(feature).alias("features"), F.array_join(F.array_sort(F.collect_set(feature)), ", ").alias("feature_list"))
    return used.where("features > 1")


def conflicts_by_combo(rows: DataFrame, register: str, combo: str) -> DataFrame:
    """(register, combination) that more than one declaration uses."""
    return rows.groupBy(register, combo).agg(F.count("*").alias("uses")).where("uses > 1")


def report_rows(found: DataFrame) -> DataFrame:
    """The last declaration of each (path, name) without case, ordered by register and name as strings."""
    key = [F.lower("path").alias("__p"), F.lower("name").alias("__n")]
    last = found.groupBy(*key).agg(F.max_by(F.struct(*found.columns), "line").alias("r")).select("r.*")
    return last.where((F.trim("type") != "") & (F.trim("name") != "") & (F.trim("path") != "")).orderBy("register", "name", "path")
