"""Files that are read line by line give the rows of a whole parse."""

import random

import pytest

from faultline.operators import extract
from faultline.operators.forms import Plain

SIMPLE = [
    "x{a} = y{b}.z{a}[{b}]", "self.a = b.get('k{a}', {b})", "part['b{a}'] = o.describe(p{b}).c.strip()", "if p.s{a} is None: raise ValueError('s{b}', {a})", "return p.price or p.b{a}.strip().c{b}", "f{a}(g{b}(1, h{a}), *k, **m)",
    "'''doc {a}'''", "'doc {a} of {b}'", '"""  doc {a}  """', "__all__ = ['a{a}', 'b{b}']", "__all__ = ('c{a}',); x = 1", "import a{a}.b, c as d{b}", "from a{a}.b import c{b} as d, e", "from .. import q{a}", "a{a} = {b}; c = d.pop('e{a}'); f = g.pop('h')",
    "x: int = Field({a}, ge={b}, alias='al{a}')", "y{a}: float", "z: A{a} = {b}", "w: int = Field(..., ge=1)", "v{a}: int = Field(default={b}, le={a}, pattern='p')", "int(a.b{a}.c, d['e{b}'])", "str(p.s{a}) + p.get('note', '')", "q = a if b.c{a} else d.e{b}",
    "a = 0x1{a}", "a = 1e{b} + 1.{a} + .{b}", "a = 0{a}", "a = '0{a}' 'b{b}'", "a = b'{a}' + r'x{b}'", "a = f'{{x.y{a}}}'", "a = {{'k{a}': v.w{b}}}", "a = 1_{a}", "a1b{a} = b{b}_c", "lambda x{a}: x.y{b}", "[i.j{a} for i in k if i.l{b}]", "a.b.c.x{a} += d.e", "x = y.z  # note {a}",
    "u'a{a}'.encode()", "a[{a}:{b}].lower()", "a = b  .c{a} .d ( e )", "a['k'] = b['k{a}'] = c", "del a{a}.b['c']", "for a in b{a}: c.d", "with a as b{a}: b.c", "global g{a}", "a = b == c{a} <= {b}", "-{a}", "{a}", "f('{a}', '{b}').title()", "assert a{a}.b, 'c{b}'", "x{a}: 'T{b}' = None", "@", "a = (", "else: pass", "a = b \\", "def f(): return 1", "x = 'a\\n{a}'", "1if a{a} else {b}", "pass", "a = {a}.real", "a = {a} .real", "k = 'yie' 'ld'",
]
ODD = {"@", "a = (", "else: pass", "a = b \\", "def f(): return 1", "a = 0{a}", "a = {a}.real"}
DECORATORS = ["@app.post('/p/{a}/{b}')", "@app.get('/x')", "@property", "@field_validator('s{a}', 't{b}')", "@model_validator(mode='after')", "@validator", "@field_serializer('s{a}')", "@model_serializer", "@a{a}.b(c.d{b}, e=1)", "@router.delete(x{a})"]
DEFS = ["def f{a}(x, y{b}=1, *, z=g.h{a}):", "async def supply_{a}(part):", "def check(cls, value) -> A{a}.b:", "def k(a: b.c{a} = {b}, /, *args: d, **kw): # note", "def f(self): "]
CLASSES = ["class A{a}(BaseModel):", "class B:", "class C{a}(x.D{b}, E[f{a}], metaclass=M.n):", "class D(): "]


def made(pick: random.Random, odd: bool) -> str:
    fill = lambda t: t.format(a=pick.choice([0, 7, 12, 345, 60001, 10**9]), b=pick.choice([1, 2, 44, 9999]))
    simple = lambda: fill(pick.choice(SIMPLE if odd else [x for x in SIMPLE if x not in ODD]))
    out = []

    def block(heads: list[str], indent: int, body) -> None:
        out.extend(" " * indent + fill(pick.choice(DECORATORS)) for _ in range(pick.choice([0, 0, 1, 2])))
        out.append(" " * indent + fill(pick.choice(heads)))
        inner = indent + pick.choice([1, 2, 4])
        for _ in range(pick.randint(0 if odd and pick.random() < 0.1 else 1, 5)):
            body(inner)
        if pick.random() < 0.3:
            out.append(pick.choice(["", "   ", "# c", "      # c"]))

    statement = lambda indent: out.append(" " * (indent + (odd and pick.random() < 0.02)) + simple())
    function = lambda indent: block(DEFS, indent, statement)
    member = lambda indent: (function if pick.random() < 0.5 else statement)(indent)
    for _ in range(pick.randint(0, 5)):
        pick.choice([statement, function, lambda indent: block(CLASSES, indent, member)])(0)
    return "\n".join(out) + pick.choice(["", "\n", "\n\n"])


WANTED = [sorted(extract.RELATIONS - extract.BY_WORD - {"test_item"}), ["route"], ["chunk"], ["class", "field", "validator"], ["access", "callee", "transform", "guard"], ["node", "import", "call", "base"], ["node", "import", "ref"], ["func", "callee"], ["import"], ["serializer"]]


@pytest.mark.parametrize("wanted", WANTED, ids=",".join)
def test_lines_give_the_rows_of_the_whole_file(wanted):
    pick, plain, met = random.Random(",".join(wanted)), Plain(wanted), 0
    order = lambda rows: sorted(map(repr, rows))
    for n in range(400):
        text = made(pick, odd=n % 4 == 0)
        got = plain.rows("a/m.py", text)
        met += got is not None
        if got is not None:
            assert order(got) == order(extract.scan_text("a/m.py", text.encode(), wanted)), text
    assert met > 200


@pytest.mark.parametrize("text", ["def f():\n    x = 1\n   y = 2\n", "  x = 1\n", "def f():\n", "@a\n", "@a\nx = 1\n", "class A:\n  def f(self):\n    x\n y\n", "class A:\n  def f(self):\n  x\n", "def f():\n  x\n    y\n", "x = '''\ny\n'''\n", "if a:\n    b\n", "def f():\n    def g():\n        pass\n", "x = 'é'\n", "x\ty\n", "def f(): yield 1\n", "a\x0cb\n", "def f[T](x):\n    x\n", "class A:\n  @a\n x\n", "class A:\n  x\n  @a\ndef f():\n  x\n"])
def test_other_files_are_parsed_whole(text):
    assert Plain({"node", "func"}).rows("m.py", text) is None
    assert extract.scan_text("m.py", text.encode(), {"node", "func"}, Plain({"node", "func"}).rows) == extract.scan_text("m.py", text.encode(), {"node", "func"})


def test_a_form_is_parsed_once(monkeypatch):
    parsed = []
    parse = extract.ast.parse
    monkeypatch.setattr(extract.ast, "parse", lambda text, *a, **k: parsed.append(text) or parse(text, *a, **k))
    plain = Plain({"route", "callee"})
    files = [(f"m{k}.py", f"@app.post('/parts/{k}')\ndef supply_{k}(part):\n    supply_{k + 1}(part, {k % 50})\n    return part.size\n") for k in range(500)]
    rows = [r for path, text in files for r in extract.scan_text(path, text.encode(), plain.wanted, plain.rows)]
    assert len(parsed) == 4 and [r["text"] for r in rows if r["rec"] == "route"] == [f"/parts/{k}" for k in range(500)] and {r["name"] for r in rows if r["rec"] == "callee"} == {"app.post", *(f"supply_{k + 1}" for k in range(500))}


def test_kept_forms_are_bounded(monkeypatch):
    from faultline.operators import forms

    monkeypatch.setattr(forms, "MEMO_LINES", 10)
    plain = Plain({"callee"})
    for k in range(100):
        name = "z" + "".join(chr(97 + int(c)) for c in str(k))
        assert [r["name"] for r in plain.rows("m.py", f"def f():\n    {name}(1)\n    {name}()\n")] == [name, name]
        assert len(plain.lines) <= 10 and len(plain.forms) <= 10
