"""Extractors that make rows of source text; stateful parsing, so table functions in Python.

Each takes a table of (path, content) and returns rows; what can be said relationally
(rule kinds, hazards, profiles) is done on those rows with built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keelstone.functions import patterns as P
from keelstone.functions import text as X
from keelstone.schemas import OPERATION


def _table_function(files: DataFrame, parse: Callable[[str, str], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """Rows that ``parse(path, content)`` yields for every file."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(parse(path or "", content or ""))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


# -- rewrite rules (X1 to X3) --------------------------------------------------------------

RULE_BLOCK = T.StructType().add("path", "string").add("module", "string").add("ord", "integer").add("block", "string").add("line_start", "integer").add("line_end", "integer").add("comment", "string")
_ENDS = re.compile(r"^\s*(rule|context|syntax|configuration|endmodule|module|imports)\b")


def _rule_blocks(path: str, content: str) -> Iterator[dict]:
    module = re.search(r"module\s+([A-Z0-9_-]+)", content)
    comment, in_comment, pending, block, start, n = [], False, None, None, 0, 0

    def done(last: int):
        text = "\n".join(block).rstrip()
        return {"path": path, "module": module[1] if module else "UNKNOWN", "ord": n, "block": text, "line_start": start, "line_end": start + text.count("\n"), "comment": pending}

    note = None
    for i, line in enumerate(content.split("\n"), 1):
        if in_comment or line.lstrip().startswith("/*@"):
            if block is not None:
                yield done(i)
                n, block, pending = n + 1, None, None
            comment.append(line)
            in_comment = "*/" not in line
            if not in_comment:
                note, comment = "\n".join(comment), []
            continue
        opens = _ENDS.match(line)
        if opens or (block is not None and not line.strip()):
            if block is not None:
                yield done(i)
                n, block, pending = n + 1, None, None
        if opens and opens[1] == "rule":
            block, start, pending, note = [line], i, note, None
        elif block is not None:
            block.append(line)
        elif opens:
            note = None
    if block is not None:
        yield done(0)


def rule_blocks(files: DataFrame) -> DataFrame:
    """The rules of each file, with the comment that stands before each."""
    return _table_function(files, _rule_blocks, RULE_BLOCK)


def parsed_rules(blocks: DataFrame) -> DataFrame:
    """Left and right side, condition, error marker, attributes, function and standard reference of each block."""
    get = lambda regex, i: F.nullif(F.regexp_extract("block", regex, i), F.lit(""))
    both = r"(?s)rule\s+(.+?)\s*=>\s*(.+?)(?=\s+requires|\s+\[|\s*$)"
    alone = r"(?s)rule\s+\(\.K\s*=>\s*([^)]+)\)"
    marker = r'(UNDEF|CV|IMPL|UNSPEC|SE|IMPLUB)\s*\(\s*"([^"]+)"\s*,\s*"([^"]+)"'
    para = r"\\para\s*\{([^}]+)\}\s*\{([^}]+)\}"
    note = lambda regex, i: F.nullif(F.regexp_extract("comment", regex, i), F.lit(""))
    said = F.regexp_replace(F.regexp_replace(note(r"(?s)\}\}\s*\{([^}]+(?:\}[^}]+)*)\}\s*\*/", 1), r"\\cinline\{([^}]+)\}", "$1"), r"\s+", " ")
    lhs = F.coalesce(X.strip(get(both, 1)), F.when(get(alone, 1).isNotNull(), F.lit("(.K)")))
    rows = blocks.select(
        "path", "module", "ord", "line_start", "line_end", "comment", "block", lhs.alias("lhs"), F.coalesce(X.strip(get(both, 2)), X.strip(get(alone, 1)), F.lit("")).alias("rhs"),
        F.regexp_replace(X.strip(get(r"(?s)requires\s+(.+?)(?=\s+\[|\s*$)", 1)), r"\s*\n\s*", " ").alias("requires"),
        get(marker, 1).alias("error_type"), get(marker, 2).alias("error_code"), get(marker, 3).alias("error_message"),
        F.regexp_extract_all("block", F.lit(r"\[([^\]]+)\]"), F.lit(1)).alias("attributes"),
        F.concat_ws("/", note(para, 1), note(para, 2)).alias("std_ref"), F.coalesce(note(r"\\source\s*\[([^\]]+)\]", 1), F.lit("unknown")).alias("std_source"), F.coalesce(X.strip(said), F.lit("")).alias("std_text"),
    )
    return rows.where("lhs is not null").withColumn("function", X.function_name(F.col("block"), F.col("lhs"))).drop("block")


def rules_from(parsed: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """Rules of parsed blocks: kind by the first case that fits, id, tags and the right side.

    A condition without an error is a precondition; a standard's text on a function a
    postcondition; an error on a function a constraint; any other library function an effect.
    """
    known = P.MODULE_HEADERS if headers is None else headers
    has_error, fn = F.col("error_type").isNotNull(), F.col("function").isNotNull()
    library = F.startswith("module", F.lit("LIBC-")) | F.contains("lhs", F.lit('builtin("')) | F.col("module").isin(*known)
    header = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("module")) if known else F.lit(None).cast("string")
    kind = (
        F.when(F.col("requires").isNotNull() & ~has_error, "precondition").when((F.col("std_text") != "") & fn, "postcondition")
        .when(has_error & fn, "constraint").when(fn & library, "effect")
    )
    op = X.operation_of(F.col("lhs"))
    spec = F.coalesce(F.when(kind == "precondition", F.col("requires")), F.when(kind == "constraint", F.concat(F.lit("error: "), F.col("error_code"))), F.col("rhs"))
    content = F.coalesce(F.nullif(F.col("std_text"), F.lit("")), F.when(kind == "constraint", F.col("error_message")), F.concat(F.initcap(op), F.lit(" requires: "), F.array_join(X.conditions(F.coalesce("requires", F.col("rhs"))), ", "), F.lit(".")))
    rows = parsed.withColumn("rule_type", kind).where("rule_type is not null")
    return rows.select(
        X.rule_id(F.col("module"), op, spec).alias("id"), content.alias("content"), spec.alias("formal_spec"), "rule_type", "function", header.alias("header"), "module", "path", "line_start", "line_end",
        X.spec_tags(F.coalesce("requires", F.lit("")), F.col("lhs")).alias("tags"), F.nullif("std_ref", F.lit("")).alias("std_ref"), "rhs", "ord", "error_code",
    )


# -- annotations (X4, J21) -----------------------------------------------------------------

ANNOTATION = T.StructType().add("path", "string").add("function", "string").add("key", "string").add("value", "string").add("block", "integer")


def annotations(files: DataFrame, mark: str = "@rule:") -> DataFrame:
    """``mark`` key value lines of comments, with the function that is declared right after.

    Between the comment and the declaration there may be only white space or a comment.
    """
    m = re.escape(mark)
    tag = re.compile(m + r"(\w+)\s+([^\n@*]+?)\s*(?=\n|\*/|" + m + r"|$)")
    comment = re.compile(r"/\*.*?\*/|(?:[ \t]*//[^\n]*(?:\n|$))+", re.S)
    declared = re.compile(r"^[ \t]*(?:[\w:<>~]+[\s*&]+)+([A-Za-z_]\w*)\s*\(", re.M)

    def parse(path: str, content: str):
        n = 0
        for c in comment.finditer(content):
            found = tag.findall(c[0])
            if not found:
                continue
            d = declared.search(content, c.end())
            gap = content[c.end() : d.start()].strip() if d else None
            if gap is None or gap and not gap.startswith("//"):
                continue
            for key, value in found:
                yield {"path": path, "function": d[1], "key": key.lower(), "value": value.strip(), "block": n}
            n += 1

    return _table_function(files, parse, ANNOTATION)


def annotated_pairs(notes: DataFrame, prefix: str = "rule_for_") -> tuple[DataFrame, DataFrame]:
    """Pairings (required unless said otherwise) and idioms (with name and template) of annotations."""
    by = notes.groupBy("path", "block", "function").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("a"))
    a = lambda k: F.element_at("a", k)
    pairs = by.where(a("pairs_with").isNotNull()).select(
        F.concat(F.lit(prefix), "function").alias("opener_id"), F.concat(F.lit(prefix), a("pairs_with")).alias("closer_id"), (F.lower(F.coalesce(a("required"), F.lit("true"))) == "true").alias("required"),
        F.lit("comment_annotation").alias("source"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("cell"), F.concat(F.lit("pairs_with in "), F.element_at(F.split("path", "/"), -1)).alias("evidence"),
    )
    idioms = by.where(a("idiom").isNotNull() & a("template").isNotNull()).select(
        F.concat(F.lit("idiom_"), a("idiom")).alias("id"), a("idiom").alias("name"), F.array(F.concat(F.lit(prefix), "function")).alias("participants"), a("template").alias("template"), F.lit("comment_annotation").alias("source"),
    )
    return pairs, idioms


# -- declarations and macros (X5, X8) ------------------------------------------------------

SIGNATURE = T.StructType().add("path", "string").add("ord", "integer").add("name", "string").add("return_type", "string").add("parameters", T.ArrayType(T.StructType().add("type", "string").add("name", "string"))).add("signature", "string")
MACRO = T.StructType().add("path", "string").add("name", "string").add("params", T.ArrayType(T.StringType())).add("body", "string").add("is_function_like", "boolean").add("line_start", "integer").add("line_end", "integer")
_PROTOTYPE = re.compile(r"(?:^|[;}])\s*((?:[A-Za-z_]\w*[\s*]+)+?)([A-Za-z_]\w*)\s*\(([^(){};]*)\)\s*(?=;|\{)", re.M)
_NOT_TYPES = frozenset("return else if while for switch typedef goto case sizeof".split())


def _no_comments(content: str) -> str:
    """The same text with comments blanked, so places stay."""
    return re.sub(r"/\*.*?\*/|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), content, flags=re.S)


def _signatures(path: str, content: str):
    for n, m in enumerate(_PROTOTYPE.finditer(_no_comments(content))):
        kind = " ".join(m[1].split()).replace(" *", "*")
        if kind.split(" ")[0] in _NOT_TYPES or m[2] in _NOT_TYPES:
            continue
        params = []
        for p in [x for x in m[3].split(",") if x.strip() and x.strip() != "void"]:
            q = re.match(r"^(.*?[\s*])([A-Za-z_]\w*)(\s*\[[^\]]*\])?$", p.strip(), re.S)
            params.append({"type": " ".join((q[1] if q else p).split()), "name": q[2] if q else ""})
        text = f"{kind} {m[2]}({', '.join((p['type'] + ' ' + p['name']).strip() for p in params) or 'void'})"
        yield {"path": path, "ord": n, "name": m[2], "return_type": kind, "parameters": params, "signature": text}


def signatures(files: DataFrame) -> DataFrame:
    """Prototypes and definitions of plain C functions (no function pointers)."""
    return _table_function(files, _signatures, SIGNATURE)


def last_signatures(found: DataFrame) -> DataFrame:
    """One signature per function, of the last path and place."""
    return found.groupBy("name").agg(F.max_by(F.struct("signature", "return_type", "path"), F.struct("path", "ord")).alias("s")).select("name", "s.*")


def _macros(path: str, content: str):
    lines = content.split("\n")
    i = 0
    while i < len(lines):
        start = i
        text = lines[i]
        while text.endswith("\\") and i + 1 < len(lines):
            i += 1
            text = text[:-1] + " " + lines[i].strip()
        i += 1
        m = re.match(r"\s*#\s*define\s+([A-Za-z_]\w*)(\(([^)]*)\))?\s*(.*)$", text)
        if m:
            yield {"path": path, "name": m[1], "params": [p.strip() for p in (m[3] or "").split(",") if p.strip()], "body": m[4].strip(), "is_function_like": m[2] is not None, "line_start": start + 1, "line_end": i}


def macros(files: DataFrame, hazardous: bool = False) -> DataFrame:
    """Macro definitions with what their bodies do; with ``hazardous``, those that may need rules."""
    out = _table_function(files, _macros, MACRO).withColumn("_f", X.macro_features(F.col("body")))
    out = out.withColumns({"has_hazard": X.macro_hazard(F.col("_f")), "signature": X.macro_signature(F.col("name"), F.col("params"), F.col("is_function_like"))})
    out = out.select("*", "_f.*").drop("_f")
    return out.where("has_hazard") if hazardous else out


# -- operations (X6, X7) -------------------------------------------------------------------

_BINARY = {
    "+": "addition", "-": "subtraction", "*": "multiplication", "/": "division", "%": "modulo", "<<": "left_shift", ">>": "right_shift", "&": "bitwise_and", "|": "bitwise_or", "^": "bitwise_xor",
    "&&": "logical_and", "||": "logical_or", "==": "equal", "!=": "not_equal", "<": "less", ">": "greater", "<=": "less_equal", ">=": "greater_equal", ",": "comma",
}
_LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_UNARY = {"*": "pointer_deref", "&": "address_of", "-": "negation", "+": "unary_plus", "!": "logical_not", "~": "bitwise_not"}
_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*(?:::~?\w+)*)|(0[xX][0-9a-fA-F]+\w*|\d+(?:\.\d+)?\w*)|(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(->|\+\+|--|<<=|>>=|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|.))", re.S)
_TYPES = frozenset("int char long short float double void unsigned signed bool size_t const struct auto int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t".split())


class _Code:
    """A recursive-descent reader of a subset of C and C++ function bodies, emitting operations."""

    def __init__(self, path: str, fn: str, body: str, line: int):
        self.path, self.fn, self.text, self.line = path, fn, body, line
        self.tokens = [(next(g for g in m.groups() if g is not None), m.end() - len(m[0].lstrip()), m.end()) for m in _TOKEN.finditer(body) if m[0].strip()]
        self.at, self.rows, self.guards, self.parents = 0, [], [], []

    def peek(self, n: int = 0) -> str:
        return self.tokens[self.at + n][0] if self.at + n < len(self.tokens) else ""

    def take(self) -> str:
        t = self.peek()
        self.at += 1
        return t

    def text_of(self, a: int, b: int) -> str:
        if b <= a or a >= len(self.tokens):
            return ""
        return " ".join(self.text[self.tokens[a][1] : self.tokens[min(b, len(self.tokens)) - 1][2]].split())

    def emit(self, kind: str, a: int, operands: list[str], operator: str = "", called: str | None = None, lvalue: bool = False):
        begin = self.tokens[min(a, len(self.tokens) - 1)][1]
        stop = self.tokens[max(a, min(self.at, len(self.tokens)) - 1)][2]
        place = lambda p: (self.line + self.text.count("\n", 0, p), p - (self.text.rfind("\n", 0, p) + 1))
        (l1, c1), (l2, c2) = place(begin), place(stop)
        n = len(self.rows)
        self.rows.append({
            "file": self.path, "fn": self.fn, "ord": n, "id": f"{self.fn}_{kind}_{l1}_{c1}_{n}", "op_type": kind, "operator": operator, "snippet": self.text_of(a, self.at), "operands": operands,
            "guards": list(self.guards), "function_called": called, "call_arguments": operands if called else [], "parent_id": self.parents[-1] if self.parents else None, "is_lvalue": lvalue,
            "line_start": l1, "line_end": l2, "col_start": c1, "col_end": c2,
        })

    def skip_group(self, close: str = ")") -> str:
        """After an opening sign: to its end, unread; the text inside."""
        opening = {")": "(", "]": "[", "}": "{"}[close]
        depth, a = 1, self.at
        while self.at < len(self.tokens) and depth:
            t = self.take()
            depth += (t == opening) - (t == close)
        return self.text_of(a, self.at - 1)

    # expressions return the place of their first token
    def expression(self) -> int:
        a = self.assignment()
        while self.peek() == ",":
            self.take()
            self.assignment()
        return a

    def assignment(self) -> int:
        a = self.conditional()
        if self.peek() in _ASSIGN:
            b = self.at
            op = self.take()
            c = self.at
            self.assignment()
            self.emit("assignment" if op == "=" else "compound_assignment", a, [self.text_of(a, b), self.text_of(c, self.at)], op, lvalue=True)
        return a

    def conditional(self) -> int:
        a = self.binary(0)
        if self.peek() == "?":
            b = self.at
            self.take()
            c = self.at
            self.expression()
            d = self.at
            if self.peek() == ":":
                self.take()
            e = self.at
            self.assignment()
            self.emit("ternary", a, [self.text_of(a, b), self.text_of(c, d), self.text_of(e, self.at)], "?:")
        return a

    def binary(self, level: int) -> int:
        if level == len(_LEVELS):
            return self.unary()
        a = self.binary(level + 1)
        while self.peek() in _LEVELS[level]:
            b = self.at
            op = self.take()
            c = self.at
            self.binary(level + 1)
            self.emit(_BINARY.get(op, "unknown"), a, [self.text_of(a, b), self.text_of(c, self.at)], op)
        return a

    def unary(self) -> int:
        a, t = self.at, self.peek()
        if t in _UNARY:
            self.take()
            b = self.at
            self.unary()
            self.emit(_UNARY[t], a, [self.text_of(b, self.at)], t)
        elif t in ("++", "--"):
            self.take()
            b = self.at
            self.unary()
            self.emit("increment" if t == "++" else "decrement", a, [self.text_of(b, self.at)], t)
        elif t == "sizeof":
            self.take()
            if self.peek() == "(":
                self.take()
                inner = self.skip_group()
            else:
                b = self.at
                self.unary()
                inner = self.text_of(b, self.at)
            self.emit("sizeof", a, [inner], "sizeof")
        elif t == "new":
            self.take()
            b = self.at
            while re.match(r"[A-Za-z_*]", self.peek() or ""):
                self.take()
            name = self.text_of(b, self.at)
            if self.peek() in ("(", "["):
                self.skip_group({"(": ")", "[": "]"}[self.take()])
            self.emit("new", a, [name], "new")
        elif t == "delete":
            self.take()
            if self.peek() == "[":
                self.take()
                self.take()
            b = self.at
            self.unary()
            self.emit("delete", a, [self.text_of(b, self.at)], "delete")
        elif t == "throw":
            self.take()
            b = self.at
            if self.peek() != ";":
                self.assignment()
            self.emit("throw", a, [self.text_of(b, self.at)] if self.at > b else [], "throw")
        elif t == "(" and self.is_cast():
            self.take()
            kind = self.skip_group()
            b = self.at
            self.unary()
            self.emit("cast", a, [kind, self.text_of(b, self.at)], "cast")
        else:
            self.postfix()
        return a

    def is_cast(self) -> bool:
        i = 1
        words = []
        while re.match(r"[A-Za-z_*]", self.peek(i) or ""):
            words.append(self.peek(i))
            i += 1
        return bool(words) and self.peek(i) == ")" and (words[0].split("::")[0] in _TYPES or "*" in words or words[0].endswith("_t")) and bool(re.match(r"[\w(*&\"'!~]", self.peek(i + 1) or ""))

    def postfix(self):
        a = self.at
        t = self.take()
        if t == "(":
            self.expression()
            if self.peek() == ")":
                self.take()
        elif t == "{":
            self.skip_group("}")
        while True:
            t, b = self.peek(), self.at
            if t == "(":
                self.take()
                args = []
                while self.peek() not in (")", ""):
                    c = self.at
                    self.assignment()
                    args.append(self.text_of(c, self.at))
                    if self.peek() != ",":
                        break
                    self.take()
                if self.peek() == ")":
                    self.take()
                self.emit("function_call", a, args, "()", called=self.text_of(a, b))
            elif t == "[":
                self.take()
                c = self.at
                self.expression()
                inner = self.text_of(c, self.at)
                if self.peek() == "]":
                    self.take()
                self.emit("array_access", a, [self.text_of(a, b), inner], "[]")
            elif t in (".", "->"):
                self.take()
                field = self.take()
                self.emit("member_access" if t == "." else "arrow_access", a, [self.text_of(a, b), field], t)
            elif t in ("++", "--"):
                self.take()
                self.emit("increment" if t == "++" else "decrement", a, [self.text_of(a, b)], t)
            else:
                return

    def header(self) -> str:
        """A condition in parentheses; not read further."""
        if self.peek() == "(":
            self.take()
            return self.skip_group()
        return ""

    def guarded(self, condition: str, parent: str | None):
        self.guards.append(condition)
        self.parents.append(parent)
        self.statement()
        self.guards.pop()
        self.parents.pop()

    def statement(self):
        a, t = self.at, self.peek()
        before = self.at
        if t == "{":
            self.take()
            while self.peek() not in ("}", ""):
                self.statement()
            self.take()
        elif t == "if":
            self.take()
            cond = self.header()
            self.emit("branch", a, [cond], "if")
            parent = self.rows[-1]["id"]
            self.guarded(cond, parent)
            if self.peek() == "else":
                self.take()
                self.guarded(f"!({cond})", parent)
        elif t in ("while", "for", "switch"):
            self.take()
            cond = self.header()
            self.emit("switch" if t == "switch" else "loop", a, [cond], t)
            self.parents.append(self.rows[-1]["id"])
            self.statement()
            self.parents.pop()
        elif t == "do":
            self.take()
            self.emit("loop", a, [], "do")
            self.parents.append(self.rows[-1]["id"])
            self.statement()
            self.parents.pop()
            if self.peek() == "while":
                self.take()
                self.rows_condition(self.header())
        elif t == "return":
            self.take()
            b = self.at
            if self.peek() != ";":
                self.expression()
            self.emit("return", a, [self.text_of(b, self.at)] if self.at > b else [], "return")
        elif t in ("case", "default"):
            while self.peek() not in (":", ""):
                self.take()
            self.take()
            return
        elif t in ("break", "continue", "goto"):
            while self.peek() not in (";", ""):
                self.take()
        elif self.is_declaration():
            while re.match(r"[A-Za-z_*&]", self.peek() or "") and re.match(r"[A-Za-z_*&]", self.peek(1) or ""):
                self.take()
            names = []
            while self.peek() not in (";", ""):
                while self.peek() in ("*", "&"):
                    self.take()
                names.append(self.take())
                while self.peek() == "[":
                    self.take()
                    self.skip_group("]")
                if self.peek() == "=":
                    self.take()
                    self.assignment()
                if self.peek() != ",":
                    break
                self.take()
            self.emit("variable_decl", a, names, "")
        elif t != ";":
            self.expression()
        if self.peek() == ";":
            self.take()
        if self.at == before:
            self.take()

    def rows_condition(self, cond: str):
        for r in reversed(self.rows):
            if r["op_type"] == "loop" and r["operator"] == "do" and not r["operands"]:
                r["operands"] = [cond]
                return

    def is_declaration(self) -> bool:
        t = self.peek()
        if not re.match(r"[A-Za-z_]", t or "") or t in ("sizeof", "new", "delete", "throw"):
            return False
        if t.split("::")[0] in _TYPES or t.endswith("_t"):
            return True
        i = 1
        while self.peek(i) in ("*", "&"):
            i += 1
        return bool(re.match(r"[A-Za-z_]", self.peek(i) or "")) and self.peek(i + 1) in ("=", ";", ",", "[")


_FUNCTION = re.compile(r"(?:^|(?<=[;}\n]))[ \t]*((?:[A-Za-z_][\w:<>]*[\s*&]+)+)([A-Za-z_~][\w:~]*)\s*\(([^(){};]*)\)\s*(?:const\s*)?\{", re.M)


def _operations(path: str, content: str):
    plain = _no_comments(content)
    at = 0
    while m := _FUNCTION.search(plain, at):
        depth, i = 1, m.end()
        while i < len(plain) and depth:
            depth += (plain[i] == "{") - (plain[i] == "}")
            i += 1
        at = i
        if m[1].split()[0] in _NOT_TYPES:
            continue
        code = _Code(path, m[2], plain[m.end() : i - 1], plain.count("\n", 0, m.end()) + 1)
        while code.at < len(code.tokens):
            code.statement()
        yield from code.rows


def operations(files: DataFrame) -> DataFrame:
    """The operations of every function definition, one row each, in textual order; each definition once."""
    return _table_function(files, _operations, OPERATION)


def profiles(ops: DataFrame) -> DataFrame:
    """Per function what its operations are, whether it may need rules, and what to search for."""
    is_ = lambda kinds: F.col("op_type").isin(*kinds)
    out = ops.groupBy("file", "fn").agg(
        F.count(F.lit(1)).alias("n_ops"), F.max(is_(P.DIVISIONS)).alias("has_division"), F.max(is_(P.POINTER_OPS)).alias("has_pointer"), F.max(F.col("op_type") == "array_access").alias("has_array"),
        F.max(is_(P.MEMORY_OPS)).alias("has_memory"), F.array_sort(F.collect_list(F.struct("ord", "function_called"))).alias("c"),
    )
    calls = F.transform(F.filter("c", lambda x: x["function_called"].isNotNull()), lambda x: x["function_called"])
    out = out.withColumn("calls", calls).drop("c")
    hazard = F.col("has_division") | F.col("has_pointer") | F.col("has_memory") | (F.size("calls") > 0)
    return out.withColumns({"has_hazard": hazard, "queries": X.retrieval_queries(*[F.col(c) for c in ("has_division", "has_pointer", "has_array", "has_memory", "calls")])})


def model_stage(items: DataFrame, prompt, complete: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """``items`` with ``prompt`` and ``response`` of a pluggable model, called in batches; without one, empty answers."""
    rows = items.withColumn("prompt", prompt)
    if complete is None:
        return rows.withColumn("response", F.lit(""))

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        return pd.Series(complete(list(prompts)))

    return rows.withColumn("response", answer("prompt"))


def toml_records(rows: DataFrame, response: str = "response", key: str = "prompt_id") -> DataFrame:
    """records of a TOML answer, fenced or whole; malformed answers and records without content give none."""
    import tomllib

    schema = T.StructType().add(key, rows.schema[key].dataType).add("id", "string").add("content", "string").add("formal_spec", "string").add("confidence", "double")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fenced = re.search(r"```(?:toml)?\s*(.*?)```", text or "", re.S)
                try:
                    data = tomllib.loads(fenced[1] if fenced else text or "")
                except tomllib.TOMLDecodeError:
                    continue
                lists = [v for v in data.values() if isinstance(v, list)]
                for r in (r for v in lists for r in v if isinstance(r, dict) and r.get("content")):
                    sure = r.get("confidence", 0.7)
                    out.append({key: k, "id": r.get("id"), "content": str(r["content"]), "formal_spec": str(r.get("formal_spec", "")), "confidence": float(sure) if isinstance(sure, (int, float)) else 0.7})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.select(key, response).mapInArrow(run, schema)
