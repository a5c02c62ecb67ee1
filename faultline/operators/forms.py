"""Syntax rows of plain files, of which a line is parsed once for each form: what the line is without its indent and its numerals.

A plain file is printable ASCII, and every line of it is blank, a comment, whole statements, a decorator or the head of a function or class. Functions of it hold
statements alone; classes hold statements and functions. As each line ends all that it opens, the file is the sequence of its lines, so its rows are those of
its lines, moved to where these stand and put in the order of ``extract.Scan``, which finds them. ``Plain.rows`` gives None for any other file.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Collection, Iterator
from inspect import cleandoc
from operator import itemgetter

from .. import schemas
from . import extract

KNOWN = extract.RELATIONS - extract.BY_WORD - {"test_item"}
FUNCTIONAL = extract.BY_FUNCTION - {"func"}
#: A numeral, and what stands for one while a form is parsed.
NUMERAL = re.compile(r"(\d+)")
MARK, MARKED, WIDTH = "9173{:02d}461", re.compile(r"9173(\d\d)461"), 9
#: Where a numeral (\0) is more than the end of a name or a whole number, or a line may say something else than it shows: such a line is a form of its own.
OWN = re.compile(r"[\"\\{}#`]|\0[A-Za-z_.]|\.\0|(?:^|;)\s*import\b")
MEMO_LINES, MEMO_CHARS = 10_000, 400
EMPTY = dict(posonlyargs=[], args=[], vararg=None, kwonlyargs=[], kw_defaults=[], kwarg=None, defaults=[])


class Unsuited(Exception):
    """A form whose rows depend on its numerals in more than their text."""


def function(**fields) -> ast.FunctionDef:
    return ast.FunctionDef(**{"name": "f", "args": ast.arguments(**EMPTY), "body": [], "decorator_list": [], "returns": None, "type_params": [], "lineno": 1, "col_offset": 0, "end_lineno": 1, "end_col_offset": 0} | fields)


class Recorder(extract.Scan):
    """Keeps what the passes of Scan find below some nodes, and how far below."""

    def __init__(self, text: str, wanted: Collection[str], roots: list[ast.AST]):
        super().__init__("", text, wanted)
        self.found, self.at, self.level = [], None, dict.fromkeys(roots, 0)
        self.nodes = list(roots)
        for n in self.nodes:
            for x in self.kids(n):
                self.level[x] = self.level[n] + 1
                self.nodes.append(x)

    def add(self, rec: str, node: ast.AST | None = None, **values) -> None:
        if rec in self.wanted:
            self.found.append((self.level.get(node, 0) if self.at is None else self.at, rec, node, values))


class Form:
    """A parsed form: ``kind`` is simple, decorator, def or class."""

    def __init__(self, text: str, wanted: frozenset[str]):
        self.text, self.wanted = text, wanted
        self.ends = [m.end() for m in MARKED.finditer(text)]
        self.doc = self.exports = None
        # a line that is whole by itself is never a head
        head = re.match(r"(async +def|def|class)\b", text)
        if text.startswith("@"):
            self.kind, (d,) = "decorator", ast.parse(text + "\ndef f(): pass").body[0].decorator_list
            self.decorator(d)
        elif head:
            (n,) = ast.parse(text + "\n pass").body
            if [type(x) for x in n.body] != [ast.Pass] or n.body[0].lineno != 2 or n.type_params:
                raise SyntaxError
            self.kind, self.name = "class" if head[1] == "class" else "def", self.told(n.name)
            self.class_head(n) if self.kind == "class" else self.def_head(n)
        else:
            self.kind, body = "simple", ast.parse(text).body
            if not body or any(isinstance(x, (*extract.DEFS, ast.ClassDef)) for s in body for x in ast.walk(s)):
                raise SyntaxError
            self.simple(body)

    def told(self, value: str | None) -> str | None:
        """A text with the places of its numerals."""
        if value is None or not self.ends:
            return value if value is None else value.replace("{", "{{").replace("}", "}}")
        return MARKED.sub(lambda m: f"{{{int(m[1])}}}", value.replace("{", "{{").replace("}", "}}"))

    def place(self, col: int) -> tuple[int, int]:
        """A column, and how many numerals end before it."""
        return col, sum(e <= col for e in self.ends)

    def events(self, found: list) -> list[tuple]:
        """(level, known values, texts with numerals, columns) of rows, in order."""
        out = []
        for level, rec, node, values in found:
            values = {"col": node.col_offset, "end_col": node.end_col_offset} | values
            cols = [(k, *self.place(values.pop(k))) for k in ("col", "end_col")]
            texts = [(k, self.told(v)) for k, v in values.items() if isinstance(v, str) and k != "snippet" and MARKED.search(v)]
            if MARKED.search(str([values.get("items"), values.get("extra")])):
                raise Unsuited  # lists may be sorted or without repeats
            known = {k: v for k, v in values.items() if k not in ("line", "end_line", "snippet", *map(itemgetter(0), texts))}
            out.append((level, extract.NONE | known | {"rec": rec}, texts, cols))
        return out

    def below(self, roots: list[ast.AST], fake: ast.FunctionDef | None) -> None:
        """Events of the passes over functions and over relations."""
        self.inside = self.related = []
        if fake is not None and self.wanted & FUNCTIONAL:
            r = Recorder(self.text, self.wanted & FUNCTIONAL, roots)
            r.function(fake)
            self.inside = self.events(r.found)
        if self.wanted & extract.BY_NODE:
            r = Recorder(self.text, self.wanted & extract.BY_NODE, roots)
            for n in r.nodes:
                if type(n) in extract.RELATED:
                    r.at = r.level[n]
                    r.relation(n)
            self.related = self.events(r.found)

    def simple(self, body: list[ast.stmt]) -> None:
        self.end = self.place(body[-1].end_col_offset)
        self.below(body, function(body=body))
        s = body[0]
        if isinstance(s, ast.Expr) and (text := extract.literal(s.value)) is not None:
            self.doc = self.told(text)
        for s in body:
            if self.exports is None and isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in s.targets) and isinstance(s.value, (ast.List, ast.Tuple)):
                self.exports = [self.told(v) for e in s.value.elts if (v := extract.literal(e)) is not None]
        r = Recorder(self.text, self.wanted & {"field", "validator"}, body)
        r.model(ast.ClassDef(name="", bases=[], keywords=[], body=body, decorator_list=[], lineno=1, col_offset=0, end_lineno=1, end_col_offset=0))
        self.fields = self.events(r.found)

    def decorator(self, d: ast.expr) -> None:
        self.below([d], function(decorator_list=[d]))
        text, call = extract.shown(d), isinstance(d, ast.Call)
        named = [v for a in d.args if (v := extract.literal(a)) is not None] if call else []
        self.shown, self.named = self.told(text), [self.told(v) for v in named]
        self.validates, self.serializes, self.whole = "validator" in text, "serializer" in text, "model_serializer" in text
        self.all = not named and "model_validator" in (extract.shown(d.func) if call else text)
        routed = call and isinstance(d.func, ast.Attribute) and d.func.attr.lower() in schemas.HTTP_ROUTES and d.args and extract.literal(d.args[0]) is not None
        self.route = (d.func.attr.upper(), self.told(d.args[0].value)) if routed else None

    def def_head(self, n: ast.FunctionDef) -> None:
        self.below([n.args], function(args=n.args))
        before = self.inside, self.related
        self.below([n.returns] if n.returns else [], function(returns=n.returns))
        self.after, (self.inside, self.related) = (self.inside, self.related), before
        self.signature, self.is_async = self.told(extract.signature(n.args)), str(isinstance(n, ast.AsyncFunctionDef)).lower()

    def class_head(self, n: ast.ClassDef) -> None:
        self.below([*n.bases, *n.keywords], None)
        self.bases = [self.told(extract.shown(b)) for b in n.bases]
        r = Recorder(self.text, self.wanted & {"base"}, [n])
        r.relation(n)
        self.base_rows = [(0, *e[1:]) for e in self.events([(level, rec, node, {k: v for k, v in values.items() if k != "extra"}) for level, rec, node, values in r.found])]


class Line:
    """A line of a file: its form, where it stands, and its numerals."""

    __slots__ = ("form", "numerals", "shift", "number", "indent", "text")

    def __init__(self, form: Form, numerals: list[str], shift: list[int], number: int, indent: int, text: str):
        self.form, self.numerals, self.shift, self.number, self.indent, self.text = form, numerals, shift, number, indent, text

    def say(self, told: str) -> str:
        return told.format(*self.numerals)

    def col(self, place: tuple[int, int]) -> int:
        return place[0] + self.indent + self.shift[place[1]]

    def row(self, known: dict, texts: list, cols: list) -> dict:
        row = known.copy()
        for key, told in texts:
            row[key] = told.format(*self.numerals)
        for key, col, nth in cols:
            row[key] = col + self.indent + self.shift[nth]
        row["line"] = row["end_line"] = self.number
        row["snippet"] = self.text[: schemas.SNIPPET_STRUCTURE]
        return row


class Block:
    """A function or class: its head, decorators, and body of lines and functions."""

    __slots__ = ("head", "decorators", "body", "inner", "name")

    def __init__(self, head: Line, decorators: list[Line]):
        self.head, self.decorators, self.body, self.inner = head, decorators, [], None
        self.name = head.say(head.form.name)

    def last(self) -> Line:
        return self.body[-1].last() if isinstance(self.body[-1], Block) else self.body[-1]

    def doc(self) -> str | None:
        return doc_of(self.body)

    def at(self) -> dict:
        """Where it stands, for rows of it."""
        last = self.last()
        return {"line": self.head.number, "col": self.head.indent, "end_line": last.number, "end_col": last.col(last.form.end), "snippet": self.head.text[: schemas.SNIPPET_STRUCTURE]}


def doc_of(body: list) -> str | None:
    if body and isinstance(body[0], Line) and body[0].form.doc is not None:
        return cleandoc(body[0].say(body[0].form.doc))
    return None


class Plain:
    """Rows of plain files, of the relations that are wanted; forms are kept from file to file. ``scoped``: rows of relations say which definition holds them.

    Nothing here may refer to itself through its own names, as the collector of cycles is off while files are read: a function that calls itself by a
    name of an enclosing one would keep each file's rows until the task ends.
    """

    def __init__(self, wanted: Collection[str], scoped: bool = False):
        self.wanted, self.scoped = frozenset(wanted), scoped
        self.lines: dict[str, tuple] = {}
        self.forms: dict[str, Form | None] = {}

    def form(self, text: str) -> Form | None:
        """The form of this text; None if it is none by itself."""
        try:
            return None if text.endswith("\\") else Form(text, self.wanted)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None

    def shared(self, key: str) -> Form | None:
        """The form of the lines that are this without their numerals; None if they have none in common."""
        if len(key) > MEMO_CHARS or key.count("\0") > 99 or OWN.search(key):
            return None
        first, *rest = key.split("\0")
        try:
            return self.form(first + "".join(MARK.format(k) + x for k, x in enumerate(rest)))
        except Unsuited:
            return None

    def read(self, text: str) -> tuple:
        """Form, numerals and shifts of columns of a line without its indent."""
        found = self.lines.get(text)
        if found is not None:
            return found
        parts = NUMERAL.split(text)
        numerals = parts[1::2]
        if numerals and not any(n[0] == "0" and len(n) > 1 or len(n) > 99 for n in numerals):
            key = "\0".join(parts[::2])
            try:
                form = self.forms[key]
            except KeyError:
                if len(self.forms) >= MEMO_LINES:
                    self.forms.clear()
                form = self.forms[key] = self.shared(key)
            if form is not None:
                shift = [0]
                at = 0
                for n in numerals:
                    at += len(n) - WIDTH
                    shift.append(at)
                return form, numerals, shift
        found = self.form(text), (), (0,)
        if len(text) <= MEMO_CHARS:
            if len(self.lines) >= MEMO_LINES:
                self.lines.clear()
            self.lines[text] = found
        return found

    def blocks(self, lines: list[str]) -> list[Line | Block] | None:
        """What stands at the top, if the file is plain."""
        top: list[Line | Block] = []
        opened: list[Block] = []
        waiting: list[Line] = []
        for number, text in enumerate(lines, 1):
            rest = text.lstrip(" ")
            if not rest or rest[0] == "#":
                continue
            form, numerals, shift = self.read(rest)
            if form is None:
                return None
            line = Line(form, numerals, shift, number, len(text) - len(rest), text)
            while opened and opened[-1].inner is not None and line.indent < opened[-1].inner:
                opened.pop()
            if opened:
                b = opened[-1]
                if b.inner is None and line.indent > b.head.indent:
                    b.inner = line.indent
                inner = b.inner
            else:
                inner = 0
            if line.indent != inner or waiting and (form.kind == "simple" or waiting[0].indent != line.indent):
                return None
            if form.kind == "decorator":
                waiting.append(line)
                continue
            into = opened[-1].body if opened else top
            if form.kind == "simple":
                into.append(line)
                continue
            if opened and (opened[-1].head.form.kind == "def" or form.kind == "class"):
                return None
            into.append(Block(line, waiting))
            opened.append(into[-1])
            waiting = []
        return None if waiting or opened and not opened[-1].body or any(isinstance(x, Block) and x.inner is None for x in top) else top

    def rows(self, path: str, text: str) -> list[dict] | None:
        """Those of ``Scan``, or None if the file isn't plain."""
        wanted = self.wanted
        if not wanted <= KNOWN or not text.isascii() or not text.replace("\n", "").isprintable() or "yield" in text or "route" in wanted and ("APIRouter" in text or "add_api_route" in text):
            return None
        lines = text.split("\n")
        top = self.blocks(lines)
        if top is None:
            return None
        out: list[dict] = []
        counts: dict[str, int] = {}
        module = extract.module_name(path)

        def put(row: dict) -> None:
            n = row["ord"] = counts.get(row["rec"], 0)
            counts[row["rec"]] = n + 1
            row["file"] = path
            out.append(row)

        functions = [b for b in top if isinstance(b, Block) and b.head.form.kind == "def"]
        classes = [b for b in top if isinstance(b, Block) and b.head.form.kind == "class"]
        if "node" in wanted:
            self.nodes(put, path, module, text, top)
        if "chunk" in wanted:
            for b in top:
                if isinstance(b, Block):
                    for f, above in [(b, "")] if b.head.form.kind == "def" else [(f, f"{b.name}.") for f in b.body if isinstance(f, Block)]:
                        put(extract.NONE | {"rec": "chunk", **f.at(), "name": above + f.name, "text": "\n".join(lines[f.head.number - 1 : f.last().number])})
        if wanted & extract.BY_NODE:
            at = len(out)
            self.relations(put, top)
            if self.scoped:
                extract.set_scopes(out[at:], module, [(b.head.number, b.last().number, name) for b, name, *_ in self.definitions(top, module)])
        if wanted & extract.BY_FUNCTION:
            for f in functions + [f for c in classes for f in c.body if isinstance(f, Block)]:
                self.function(put, path, module, f)
        if wanted & extract.BY_CLASS:
            for c in classes:
                self.model(put, c)
        if "route" in wanted:
            for f in functions:
                for d in f.decorators:
                    if d.form.route is not None:
                        put(extract.NONE | {"rec": "route", **f.at(), "name": f.name, "kind": d.form.route[0], "text": d.say(d.form.route[1]), "qname": f"{module}.{f.name}"})
        return out

    def nodes(self, put, path: str, module: str, text: str, top: list) -> None:
        exports = next((x for x in top if isinstance(x, Line) and x.form.exports is not None), None)
        exports = "" if exports is None else "\n".join(map(exports.say, exports.form.exports))
        put(extract.NONE | {"rec": "node", "name": module.rpartition(".")[2], "qname": module, "kind": "module", "line": 1, "col": 0, "end_line": max(1, len(text.splitlines())), "end_col": 0, "items": [], "extra": {"docstring": doc_of(top), "exports": exports}})
        for b, qname, in_class, prefix, at in self.definitions(top, module):
            h, decorators, extra = b.head, [d.say(d.form.shown) for d in b.decorators], {"docstring": b.doc()}
            row = extract.NONE | {"rec": "node", **b.at(), "name": b.name, "qname": qname, "items": decorators, "end_col": 0}
            if self.scoped:
                row["scope"], row["scope_line"] = prefix, at
            if h.form.kind == "class":
                put(row | {"kind": "class", "extra": extra | {"bases": "\n".join(map(h.say, h.form.bases))}})
            else:
                extra |= {"is_async": h.form.is_async, "is_generator": "false", "is_property": str("property" in decorators).lower()}
                put(row | {"kind": "method" if in_class else "function", "text": h.say(h.form.signature), "extra": extra})

    def definitions(self, body: list, prefix: str, in_class: bool = False, at: int = 1) -> Iterator[tuple[Block, str, bool, str, int]]:
        """Functions and classes with their full names, whether a class holds them, and the full name and first line of what does, in the order of the file."""
        for b in body:
            if isinstance(b, Block):
                qname, is_class = f"{prefix}.{b.name}", b.head.form.kind == "class"
                yield b, qname, in_class, prefix, at
                if is_class:
                    yield from self.definitions(b.body, qname, True, b.head.number)

    def relations(self, put, top: list) -> None:
        """Level by level, as a walk from the top meets them."""
        met: list[tuple[int, dict]] = []
        self.meet_below(met, top, 1)
        met.sort(key=itemgetter(0))
        for _, row in met:
            put(row)

    def meet(self, met: list, line: Line, events: list, depth: int, **more) -> None:
        for level, *event in events:
            met.append((level + depth, line.row(*event) | more))

    def meet_below(self, met: list, body: list, depth: int) -> None:
        for b in body:
            if isinstance(b, Line):
                self.meet(met, b, b.form.related, depth)
                continue
            h = b.head
            if h.form.kind == "class":
                self.meet(met, h, h.form.base_rows, depth, owner=b.name, extra={"class_line": str(h.number)})
            self.meet(met, h, h.form.related, depth + 1)
            self.meet_below(met, b.body, depth + 1)
            for d in b.decorators:
                self.meet(met, d, d.form.related, depth + 1)
            if h.form.kind == "def":
                self.meet(met, h, h.form.after[1], depth + 1)

    def function(self, put, path: str, module: str, f: Block) -> None:
        at, h = f.at(), f.head
        key, owner = f"{module}.{f.name}", f"{path}\n{f.name}\n{h.number}\n{h.indent}"
        if "func" in self.wanted:
            put(extract.NONE | {"rec": "func", **at, "name": f.name, "qname": key, "owner": owner})
        met = [(e, line) for line in (h, *f.body, *f.decorators) for e in line.form.inside]
        met += [(e, h) for e in h.form.after[0]]
        met.sort(key=lambda m: m[0][0])
        for (_, known, texts, cols), line in met:
            row = line.row(known, texts, cols)
            row["owner"], row["qname"] = owner, key
            put(row)

    def model(self, put, c: Block) -> None:
        h, at = c.head, {"class_line": str(c.head.number)}
        if "class" in self.wanted:
            put(extract.NONE | {"rec": "class", **c.at(), "name": c.name, "items": [h.say(b) for b in h.form.bases]})
        for b in c.body:
            if isinstance(b, Line):
                for _, *event in b.form.fields:
                    row = b.row(*event)
                    put(row | {"owner": c.name, "extra": row["extra"] | at})
                continue
            for d in b.decorators:
                if d.form.validates and "validator" in self.wanted:
                    fields = list(map(d.say, d.form.named)) or ["__all__"] * d.form.all
                    put(extract.NONE | {"rec": "validator", **b.at(), "owner": c.name, "name": b.name, "kind": "pydantic_validator", "items": fields, "text": (b.doc() or "")[:120] or f"validator {b.name}", "extra": at})
            deciding = next((d for d in b.decorators if d.form.serializes), None)
            if deciding is not None and "serializer" in self.wanted:
                put(extract.NONE | {"rec": "serializer", **b.at(), "owner": c.name, "name": b.name, "items": list(map(deciding.say, deciding.form.named)), "flag": deciding.form.whole, "extra": at})
