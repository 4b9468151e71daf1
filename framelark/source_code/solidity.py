"""Solidity sources: tokens, declarations, and what each exposed function can do.

Sources are cut into tokens once; declarations are found by matching brackets over tokens, and bodies are read as token
runs: a mention of a state variable is a write if an assignment ends its access path, a call is told by the tokens around
its name. It is no compiler: what can't be told stays out, or is noted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

DEPTH = 12
_TOKEN = re.compile(
    r"""(?P<doc>///[^\n]*|/\*\*(?!/).*?\*/)|(?P<skip>//[^\n]*|/\*.*?\*/|\s+)|(?P<string>(?:hex|unicode)?"(?:\\.|[^"\\])*"|(?:hex|unicode)?'(?:\\.|[^'\\])*')"""
    r"""|(?P<number>0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE]-?\d+)?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<sign>>>>=|<<=|>>=|\*\*|=>|->|\+\+|--|[-+*/%&|^!=<>]=|&&|\|\||<<|>>|.)""",
    re.S | re.X,
)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}
LOW_LEVEL = {"call": "call", "staticcall": "staticcall", "delegatecall": "delegatecall", "transfer": "call", "send": "call"}
VISIBILITY = ("external", "public", "internal", "private")
MUTABILITY = ("view", "pure", "payable")
KEYWORDS = {"if", "for", "while", "return", "returns", "require", "assert", "revert", "emit", "new", "delete", "else", "do", "try", "catch", "unchecked", "assembly", "memory", "storage", "calldata", "abi", "type", "this", "super", "msg", "block", "tx", "using", "mapping", "function"}
_ELEMENTARY = re.compile(r"^(u?int\d*|bytes\d*|address|bool|string|u?fixed\w*|byte)$")


@dataclass
class Token:
    kind: str
    text: str
    line: int


@dataclass
class Param:
    type: str
    name: str | None = None
    indexed: bool = False


@dataclass
class Function:
    name: str
    kind: str
    params: list
    returns: list
    visibility: str
    mutability: str
    modifiers: list
    body: list | None
    line: int
    doc: str | None
    unit: str = ""
    file: str = ""


@dataclass
class Variable:
    name: str
    type: str
    visibility: str
    constant: bool
    immutable: bool
    value: list
    unit: str = ""


@dataclass
class Unit:
    kind: str
    name: str
    file: str
    bases: list = field(default_factory=list)
    functions: list = field(default_factory=list)
    variables: list = field(default_factory=list)
    modifiers: dict = field(default_factory=dict)
    events: dict = field(default_factory=dict)
    structs: dict = field(default_factory=dict)
    enums: set = field(default_factory=set)
    aliases: dict = field(default_factory=dict)
    using: list = field(default_factory=list)


def tokens(source: str) -> list[Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(source):
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line))
        line += m[0].count("\n")
    return out


def closing(run: list[Token], at: int) -> int:
    """Index of the bracket that closes the one at ``at``; the end of the run if none does."""
    if at >= len(run) or run[at].text not in _CLOSE:
        return len(run)
    end, depth = _CLOSE[run[at].text], 0
    for i in range(at, len(run)):
        if run[i].kind == "sign":
            depth += (run[i].text == run[at].text) - (run[i].text == end)
            if not depth:
                return i
    return len(run)


def split(run: list[Token], by: str = ",") -> list[list[Token]]:
    out, part, i = [], [], 0
    while i < len(run):
        if run[i].kind == "sign" and run[i].text in _CLOSE:
            end = closing(run, i)
            part += run[i : end + 1]
            i = end + 1
            continue
        if run[i].text == by:
            out.append(part)
            part = []
        else:
            part.append(run[i])
        i += 1
    return [p for p in [*out, part] if p]


def text_of(run: list[Token]) -> str:
    return "".join(t.text for t in run)


def type_and_rest(run: list[Token]) -> tuple[str, list[Token]]:
    """The type at the start of a declaration as text without blanks, and what follows."""
    if not run:
        return "", []
    if run[0].text in ("mapping", "function") and len(run) > 1 and run[1].text == "(":
        i = closing(run, 1) + 1
    else:
        i = 1
        while i + 1 < len(run) and run[i].text == "." and run[i + 1].kind == "name":
            i += 2
    while i < len(run) and run[i].text == "[":
        i = closing(run, i) + 1
    return text_of(run[:i]), run[i:]


def params(run: list[Token]) -> list[Param]:
    out = []
    for part in split(run):
        part = [t for t in part if t.kind != "doc"]
        kind, rest = type_and_rest(part)
        names = [t.text for t in rest if t.kind == "name" and t.text not in ("memory", "storage", "calldata", "indexed", "payable")]
        out.append(Param(kind, names[-1] if names else None, any(t.text == "indexed" for t in rest)))
    return out


class File:
    """Declarations of one file: units, file-level types and functions, imports."""

    def __init__(self, path: str, source: str):
        self.path, self.units, self.imports = path, [], []
        self.free = Unit("file", "", path)
        self._members(self._without_docs(tokens(source)), self.free, top=True)

    def _without_docs(self, run):
        """Docs are kept beside the token that follows them."""
        self.docs, out, pending = {}, [], []
        for t in run:
            if t.kind == "doc":
                pending.append(re.sub(r"^\s*(///|/\*\*|\*/|\*)\s?|\s*\*/$", "", t.text, flags=re.M).strip())
            else:
                if pending:
                    self.docs[id(t)] = "\n".join(pending)
                pending = []
                out.append(t)
        return out

    def _members(self, run, unit, top=False):
        i = 0
        while i < len(run):
            word = run[i].text
            if top and word == "import":
                end = next((j for j in range(i, len(run)) if run[j].text == ";"), len(run))
                self.imports += [t.text.strip("\"'") for t in run[i:end] if t.kind == "string"]
                i = end + 1
            elif top and word in ("contract", "library", "interface") or (top and word == "abstract"):
                i = self._unit(run, i + (word == "abstract"))
            elif word in ("function", "constructor", "receive", "fallback", "modifier") and run[i].kind == "name" and not (word == "function" and i + 1 < len(run) and run[i + 1].text == "("):
                i = self._function(run, i, unit)
            elif word in ("struct", "enum") and i + 2 < len(run):
                brace = i + 2
                end = closing(run, brace)
                name = run[i + 1].text
                if word == "enum":
                    unit.enums.add(name)
                else:
                    unit.structs[name] = [Param(*self._declared(p)) for p in split(run[brace + 1 : end], ";")]
                i = end + 1
            elif run[i].text in ("{", "("):
                i = closing(run, i) + 1
            else:
                end = i
                while end < len(run) and run[end].text != ";":
                    end = closing(run, end) + 1 if run[end].text in _CLOSE else end + 1
                self._statement(run[i:end], unit)
                i = end + 1

    @staticmethod
    def _declared(run):
        kind, rest = type_and_rest(run)
        names = [t.text for t in rest if t.kind == "name"]
        return kind, names[-1] if names else None

    def _statement(self, run, unit):
        if not run:
            return
        word = run[0].text
        if word == "using":
            words = [t.text for t in run]
            at = words.index("for") if "for" in words else len(words)
            libraries = [text_of(p).split("as")[0] for p in split([t for t in run[1:at] if t.text not in "{}"])]
            unit.using += [(lib, text_of([t for t in run[at + 1 :] if t.text != "global"])) for lib in libraries]
        elif word == "event" and len(run) > 2:
            unit.events[run[1].text] = params(run[3 : closing(run, 2)])
        elif word == "type" and len(run) > 3:
            unit.aliases[run[1].text] = text_of(run[3:])
        elif word in ("error", "pragma", "import"):
            return
        else:
            equals = next((i for i, t in enumerate(run) if t.text == "="), len(run))
            head, value = run[:equals], run[equals + 1 :]
            kind, rest = type_and_rest(head)
            names = [t.text for t in rest if t.kind == "name" and t.text not in (*VISIBILITY, "constant", "immutable", "override", "transient", "payable")]
            if names:
                words = {t.text for t in rest}
                seen = next((v for v in VISIBILITY if v in words), "internal")
                unit.variables.append(Variable(names[-1], kind, seen, "constant" in words, "immutable" in words, value, unit.name))

    def _unit(self, run, i):
        brace = next((j for j in range(i, len(run)) if run[j].text == "{"), len(run))
        if brace == len(run):
            return brace
        unit = Unit(run[i].text, run[i + 1].text, self.path)
        head = run[i + 2 : brace]
        if head and head[0].text == "is":
            unit.bases = [type_and_rest(p)[0] for p in split(head[1:])]
        end = closing(run, brace)
        self._members(run[brace + 1 : end], unit)
        self.units.append(unit)
        return end + 1

    def _function(self, run, i, unit):
        kind, at = run[i].text, i + 1
        name = ""
        if kind in ("function", "modifier") and at < len(run):
            name, at = run[at].text, at + 1
        doc, line = self.docs.get(id(run[i])), run[i].line
        given = []
        if at < len(run) and run[at].text == "(":
            end = closing(run, at)
            given, at = params(run[at + 1 : end]), end + 1
        visibility, mutability, modifiers, returned, body = "public", "nonpayable", [], [], None
        while at < len(run):
            t = run[at]
            if t.text == "{":
                end = closing(run, at)
                body, at = run[at + 1 : end], end + 1
                break
            if t.text == ";":
                at += 1
                break
            if t.text in VISIBILITY:
                visibility = t.text
            elif t.text in MUTABILITY:
                mutability = t.text
            elif t.text == "returns":
                end = closing(run, at + 1)
                returned, at = params(run[at + 2 : end]), end
            elif t.text in ("virtual", "override"):
                if at + 1 < len(run) and run[at + 1].text == "(":
                    at = closing(run, at + 1)
            elif t.kind == "name":
                modifiers.append(t.text)
                if at + 1 < len(run) and run[at + 1].text == "(":
                    at = closing(run, at + 1)
            at += 1
        if kind == "modifier":
            unit.modifiers[name] = body or []
        else:
            if unit.kind == "interface":
                visibility = "external"
            unit.functions.append(Function(name or kind, kind, given, returned, visibility, mutability, modifiers, body, line, doc, unit.name, self.path))
        return at


class Project:
    """All files of one contract: names, imports, the deployed unit and its chain."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = {path: File(path, source) for path, source in files}
        self.units: dict[str, list[Unit]] = {}
        for f in self.files.values():
            for u in f.units:
                self.units.setdefault(u.name, []).append(u)
        self.reach = {p: self._reach(p) for p in self.files}

    def target(self, path: str, spec: str) -> str | None:
        """The file that an import means: relative to the importing one, else by its ending, else by its name."""
        import posixpath

        exact = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec)) if spec.startswith(".") else spec
        for test in (lambda p: posixpath.normpath(p) == exact, lambda p: p.endswith("/" + spec.lstrip("./")), lambda p: posixpath.basename(p) == posixpath.basename(spec)):
            if found := [p for p in self.files if test(p)]:
                return found[0]
        return None

    def _reach(self, path: str) -> set[str]:
        seen, queue = {path}, [path]
        while queue:
            here = queue.pop()
            for spec in self.files[here].imports:
                if (to := self.target(here, spec)) and to not in seen:
                    seen.add(to)
                    queue.append(to)
        return seen

    def unit(self, name: str, file: str) -> Unit | None:
        """Of units of one name the last that the file reaches, else the last."""
        found = self.units.get(name.split(".")[-1], [])
        return next((u for u in reversed(found) if u.file in self.reach.get(file, ())), found[-1] if found else None)

    def chain(self, unit: Unit) -> list[Unit]:
        """The unit and its bases, depth first from left to right, each at its first visit."""
        out, seen = [], set()

        def visit(u):
            if (u.name, u.file) in seen:
                return
            seen.add((u.name, u.file))
            out.append(u)
            for base in u.bases:
                if found := self.unit(base, u.file):
                    visit(found)

        visit(unit)
        return out

    def scope(self, file: str, unit: Unit | None = None) -> list[Unit]:
        """Where a type name is looked up: the chain, then the free declarations and units of reachable files."""
        reached = [self.files[p] for p in self.files if p in self.reach.get(file, ())]
        return (self.chain(unit) if unit else []) + [f.free for f in reached] + [u for f in reached for u in f.units]

    def deployed(self, name: str | None, abi_names: set[str]) -> Unit | None:
        every = [u for f in self.files.values() for u in f.units if u.kind == "contract"]
        if name and (found := [u for u in every if u.name == name]):
            return found[-1]
        scored = [(len({f.name for f in u.functions} & abi_names), -i) for i, u in enumerate(every)]
        if scored and max(scored)[0]:
            return every[-max(scored)[1]]
        return every[-1] if every else None

    def abi_type(self, kind: str, file: str, unit: Unit | None, seen: tuple = ()) -> str | None:
        """Canonical type of a parameter: structs as tuples, enums uint8, aliases what they name, contracts address; None if unknown."""
        if kind.endswith("]"):
            at = kind.rindex("[")
            inner = self.abi_type(kind[:at], file, unit, seen)
            return inner and inner + kind[at:]
        if _ELEMENTARY.match(kind):
            return {"uint": "uint256", "int": "int256", "byte": "bytes1"}.get(kind, kind)
        if kind == "addresspayable":
            return "address"
        owner, _, name = kind.rpartition(".")
        places = [u for u in self.scope(file, unit) if not owner or u.name == owner.split(".")[-1]]
        if name in seen:
            return None
        for u in places:
            if name in u.structs:
                inner = [self.abi_type(p.type, u.file, u if u.kind != "file" else None, (*seen, name)) for p in u.structs[name]]
                return None if None in inner else f"({','.join(inner)})"
            if name in u.enums:
                return "uint8"
            if name in u.aliases:
                return self.abi_type(u.aliases[name], u.file, u if u.kind != "file" else None, (*seen, name))
        return "address" if self.unit(name, file) else None

    def signature(self, name: str, given: list[Param], file: str, unit: Unit | None) -> str | None:
        kinds = [self.abi_type(p.type, file, unit) for p in given]
        return None if None in kinds else f"{name}({','.join(kinds)})"


@dataclass
class Found:
    """What a walk of a function's body gathers, in the order of the walk."""

    reads: dict = field(default_factory=dict)
    writes: dict = field(default_factory=dict)
    internal: list = field(default_factory=list)
    external: list = field(default_factory=list)
    events: list = field(default_factory=list)
    notes: list = field(default_factory=list)


class Walk:
    def __init__(self, project: Project, unit: Unit):
        self.project, self.unit, self.chain = project, unit, project.chain(unit)
        self.members = {v.name: v for u in reversed(self.chain) for v in u.variables}
        self.out, self.visited = Found(), set()

    def lookup(self, name: str, start: int = 0):
        return next((f for u in self.chain[start:] for f in u.functions if f.name == name and f.body is not None), None)

    def run(self, fn: Function, via=(), depth=0, known=None):
        """Walk a body once; ``known`` says what its parameters stand for in the caller."""
        key = (fn.file, fn.unit, fn.name, len(fn.params))
        if key in self.visited or depth > DEPTH or fn.body is None:
            return
        self.visited.add(key)
        for name in fn.modifiers:
            body = next((u.modifiers[name] for u in self.chain if name in u.modifiers), None)
            if body is not None:
                self.out.internal.append({"name": name, "kind": "modifier", "declared_in": next(u.name for u in self.chain if name in u.modifiers), "depth": depth + 1, "via": list(via)})
                self.body(body, fn, (*via, name), depth + 1, {}, {})
        types = {p.name: p.type for p in [*fn.params, *fn.returns] if p.name}
        self.body(fn.body, fn, via, depth, types, known or {})

    # a body's tokens are read from left to right; every rule looks at the name at i and what stands around it
    def body(self, run, fn, via, depth, types, known):
        project = self.project
        for i, t in enumerate(run):  # declarations of locals
            if t.kind == "name" and t.text not in KEYWORDS and (i == 0 or run[i - 1].text in ("{", "}", ";", "(", ",")):
                kind, rest = type_and_rest(run[i : i + 40])
                while rest and rest[0].text in ("memory", "storage", "calldata", "payable"):
                    rest = rest[1:]
                if len(rest) > 1 and rest[0].kind == "name" and rest[0].text not in KEYWORDS and rest[1].text in ("=", ";", ",", ")") and (_ELEMENTARY.match(kind.split("[")[0]) or kind[:1].isupper() or "." in kind):
                    types.setdefault(rest[0].text, kind)
        for i, t in enumerate(run):
            if t.kind != "name":
                continue
            before = run[i - 1].text if i else ""
            after = run[i + 1].text if i + 1 < len(run) else ""
            if before == "emit":
                self.event(t.text, fn)
            elif before == "." and (after in ("(", "{")):
                self.dotted(run, i, fn, via, depth, types, known)
            elif after == "(" and before not in (".", "new", "function", "emit"):
                callee = self.lookup(t.text)
                library = project.unit(fn.unit, fn.file)
                if library and library.kind == "library":
                    callee = next((f for f in library.functions if f.name == t.text and f.body is not None), callee)
                free = next((f for u in project.scope(fn.file) if u.kind == "file" for f in u.functions if f.name == t.text), None)
                callee = callee or free
                if callee and t.text != fn.name:
                    self.inner(callee, "internal", run, i + 1, via, depth, types, known, t.text)
            if t.text in self.members and before != "." and t.text not in types:
                self.access(run, i, via)

    def inner(self, callee, kind, run, paren, via, depth, types, known, label, receiver=None):
        self.out.internal.append({"name": callee.name, "kind": kind, "declared_in": callee.unit, "depth": depth + 1, "via": list(via)})
        given = [self.destination(a, types, known) for a in split(run[paren + 1 : closing(run, paren)])]
        if receiver is not None:
            given = [receiver, *given]
        self.run(callee, (*via, label), depth + 1, {p.name: d for p, d in zip(callee.params, given) if p.name})

    def access(self, run, i, via):
        name, j = run[i].text, i + 1
        while j < len(run):
            if run[j].text == "[":
                j = closing(run, j) + 1
            elif run[j].text == "." and j + 1 < len(run) and run[j + 1].kind == "name" and not (j + 2 < len(run) and run[j + 2].text == "("):
                j += 2
            else:
                break
        following = run[j].text if j < len(run) else ""
        called = run[j + 1].text if following == "." and j + 1 < len(run) else ""
        before = run[i - 1].text if i else ""
        writes = following in ASSIGN or following in ("++", "--") or before in ("delete", "++", "--") or called in ("push", "pop")
        into = self.out.writes if writes else self.out.reads
        if self.members[name].constant:
            return
        if name not in into or len(into[name]) > len(via):
            into[name] = list(via)
        if writes and following not in ("=", "") and following in ASSIGN and name not in self.out.reads:
            self.out.reads[name] = list(via)

    def event(self, name, fn):
        for u in [*self.chain, *self.project.scope(fn.file)]:
            if name in u.events:
                said = self.project.signature(name, u.events[name], u.file, u if u.kind != "file" else None)
                if said and said not in self.out.events:
                    self.out.events.append(said)
                return
        if name not in self.out.events:
            self.out.events.append(name)

    def destination(self, run, types, known) -> dict:
        """What an expression names: kind, name and type; seen from the exposed function."""
        run = list(run)
        while len(run) > 3 and run[1].text == "(" and closing(run, 1) == len(run) - 1 and (run[0].text == "address" or run[0].text == "payable" or run[0].text[:1].isupper()):
            run = run[2:-1]  # a cast
        name = run[0].text if run else ""
        if len(run) == 1 and name in known:
            return known[name]
        if len(run) == 1 and run[0].kind == "number" and len(name) == 42:
            return {"kind": "literal", "name": None, "address": name.lower(), "type": None}
        if name == "this":
            return {"kind": "this", "name": "this", "address": None, "type": self.unit.name}
        if name in types:
            return {"kind": "parameter", "name": name, "address": None, "type": types[name]} if len(run) == 1 else {"kind": "unknown", "name": text_of(run), "address": None, "type": None}
        if name in self.members:
            v = self.members[name]
            address = next((t.text.lower() for t in v.value if t.kind == "number" and len(t.text) == 42), None) if v.constant else None
            return {"kind": "immutable" if v.immutable else "constant" if v.constant else "state", "name": name, "address": address, "type": v.type.split("=>")[-1].rstrip(")") if len(run) > 1 else v.type}
        return {"kind": "unknown", "name": text_of(run) or None, "address": None, "type": None}

    def dotted(self, run, i, fn, via, depth, types, known):
        """``receiver.name(``: a cast's or variable's call, a library's, super's, or a low-level call."""
        name, project = run[i].text, self.project
        start = i - 2
        while start >= 0:
            if run[start].text in (")", "]"):
                start = self._opening(run, start) - 1
                if start >= 0 and run[start].kind == "name" and run[start].text not in KEYWORDS - {"this", "super", "type", "abi"}:
                    pass
                else:
                    start += 1
                    break
            if start > 0 and run[start - 1].text == ".":
                start -= 2
                continue
            break
        receiver = run[max(start, 0) : i - 1]
        paren = i + 1
        options = run[paren].text == "{"
        if options:
            paren = closing(run, paren) + 1
            if paren >= len(run) or run[paren].text != "(":
                return
        if not receiver or receiver[0].text in ("abi", "type", "msg", "block", "tx") or (receiver[0].text == "super"):
            if receiver and receiver[0].text == "super":
                here = next((n for n, u in enumerate(self.chain) if u.name == fn.unit), 0)
                if callee := self.lookup(name, here + 1):
                    self.inner(callee, "super", run, paren, via, depth, types, known, name)
            return
        head = receiver[0].text
        arguments = run[paren + 1 : closing(run, paren)]
        if len(receiver) == 1 and head not in types and head not in self.members and (library := project.unit(head, fn.file)) and library.kind == "library":
            if callee := next((f for f in library.functions if f.name == name and f.body is not None), None):
                self.inner(callee, "library", run, paren, via, depth, types, known, f"{library.name}.{name}")
            return
        to = self.destination(receiver, types, known)
        own = types.get(head) if len(receiver) == 1 and head in types else self.members[head].type if len(receiver) == 1 and head in self.members else None
        cast = receiver[0].text if len(receiver) > 2 and receiver[1].text == "(" and closing(receiver, 1) == len(receiver) - 1 else None
        kind = cast if cast and project.unit(cast, fn.file) else own or to["type"]
        owner = project.unit(kind, fn.file) if kind and not _ELEMENTARY.match(kind) else None
        if owner and owner.kind != "library":
            member = next((f for u in project.chain(owner) for f in u.functions if f.name == name and len(f.params) == len(split(arguments))), None)
            member = member or next((f for u in project.chain(owner) for f in u.functions if f.name == name), None)
            if member:
                said = project.signature(name, member.params, member.file, owner)
                how = "staticcall" if member.mutability in ("view", "pure") else "call"
                self.call(name, said, how, to, owner.name, via, arguments)
                return
            getter = next((v for u in project.chain(owner) for v in u.variables if v.name == name and v.visibility == "public"), None)
            if getter:
                self.call(name, f"{name}()" if not arguments else None, "staticcall", to, owner.name, via, arguments)
                return
        for u in [*self.chain, project.files[fn.file].free, *( [project.unit(fn.unit, fn.file)] if fn.unit else [])]:
            for library, for_type in u.using if u else ():
                if for_type in ("*", kind or "*") and (lib := project.unit(library, u.file)):
                    if callee := next((f for f in lib.functions if f.name == name and f.body is not None), None):
                        self.inner(callee, "library", run, paren, via, depth, types, known, f"{lib.name}.{name}", to)
                        return
        if name in LOW_LEVEL and (owner is None):
            said = next((t.text.strip("\"'") for k, t in enumerate(arguments) if t.kind == "string" and k >= 2 and arguments[k - 2].text in ("encodeWithSignature",)), None)
            how = LOW_LEVEL[name] if said or name != "call" else "dynamic"
            self.call(said.split("(")[0] if said else name, said, how, to, None, via, arguments)
        elif owner is None and to["kind"] == "unknown" and name not in ("push", "pop", "concat", "encode", "length"):
            note = f"unresolved call of {name}"
            if note not in self.out.notes:
                self.out.notes.append(note)

    @staticmethod
    def _opening(run, at):
        pair, depth = {")": "(", "]": "["}[run[at].text], 0
        for i in range(at, -1, -1):
            depth += (run[i].text == run[at].text) - (run[i].text == pair)
            if not depth:
                return i
        return 0

    def call(self, name, signature, how, to, kind, via, arguments):
        self.out.external.append({
            "function_name": name, "signature": signature, "call_type": how, "destination_kind": to["kind"], "destination": to["name"], "address": to["address"],
            "contract_type": kind, "arguments": len(split(arguments)), "via": list(via),
        })


OWNER, ROLE = re.compile(r"owner|admin|governance|timelock", re.I), re.compile(r"role|auth|guardian|keeper|operator|minter|manager|curator|allocator", re.I)


def access_of(fn: Function, walk: Walk) -> tuple[str, list[str]]:
    """Who may call: by the names of modifiers, then by what they and the body compare the sender with."""
    for m in fn.modifiers:
        if ROLE.search(m):
            return "role", [m]
        if OWNER.search(m):
            return "owner", [m]
    bodies = [(m, next((u.modifiers[m] for u in walk.chain if m in u.modifiers), [])) for m in fn.modifiers] + [(None, fn.body or [])]
    for gate, run in bodies:
        for i, t in enumerate(run):
            if t.text == "msg" and i + 2 < len(run) and run[i + 2].text == "sender":
                near = [x.text for x in run[max(0, i - 3) : i + 6]]
                if "==" in near or "!=" in near:
                    other = next((x for x in near if x in walk.members), "")
                    kind = "role" if ROLE.search(other) else "owner" if OWNER.search(other) else "restricted"
                    return kind, [gate or f"msg.sender check on {other or 'an expression'}"]
    return "open", []


def exposed(project: Project, unit: Unit) -> list[Function]:
    """Public and external functions of the chain, the most derived of each name and types."""
    out, seen = [], set()
    for u in project.chain(unit):
        for f in u.functions:
            if f.kind == "constructor" or (f.kind == "function" and f.visibility not in ("public", "external")) or (f.body is None and u.kind != "contract"):
                continue
            key = (f.name, tuple(p.type for p in f.params))
            if key not in seen:
                seen.add(key)
                out.append(f)
    return out


def analyse(files: list[tuple[str, str]], contract: str | None = None, abi: list[str] = ()) -> list[dict]:
    """A record for each exposed function of the deployed contract; with ``abi`` signatures, exactly those of the interface.

    A source function that the interface lacks is left out, one that only the interface has is added without source.
    """
    project = Project(files)
    wanted: dict[tuple, list[str]] = {}
    for s in abi:
        name, _, rest = s.partition("(")
        depth, n = 0, 1 if rest.rstrip(")") else 0
        for c in rest[:-1]:
            depth += (c in "([") - (c in ")]")
            n += c == "," and not depth
        wanted.setdefault((name, n), []).append(s)
    unit = project.deployed(contract, {n for n, _ in wanted})
    if unit is None:
        return [_shell(s) for s in abi]
    rows, used = [], set()
    for fn in exposed(project, unit):
        declared = project.unit(fn.unit, fn.file)
        said = project.signature(fn.name, fn.params, fn.file, declared) if fn.kind == "function" else None
        if abi and fn.kind == "function":
            fits = wanted.get((fn.name, len(fn.params)), [])
            said = fits[0] if len(fits) == 1 else said if said in fits else None
            if said is None:
                continue
            used.add(said)
        walk = Walk(project, unit)
        walk.run(fn)
        kind, gates = access_of(fn, walk)
        found = walk.out
        rows.append({
            "name": fn.name, "signature": said, "declared_in": fn.unit, "visibility": fn.visibility, "mutability": fn.mutability, "has_source": True, "access": kind, "gates": gates,
            "reads": list(found.reads), "writes": list(found.writes), "events": found.events, "internal_calls": found.internal, "external_calls": found.external, "notes": found.notes,
            "natspec": fn.doc, "line": fn.line, "chain": [u.name for u in walk.chain],
        })
    return rows + [_shell(s) for s in abi if s not in used]


def _shell(signature: str) -> dict:
    return {
        "name": signature.split("(")[0], "signature": signature, "declared_in": None, "visibility": "external", "mutability": None, "has_source": False, "access": "unknown", "gates": [],
        "reads": [], "writes": [], "events": [], "internal_calls": [], "external_calls": [], "notes": ["no source for this function"], "natspec": None, "line": None, "chain": [],
    }
