"""Vyper sources: logical lines by indentation, declarations, and what each exposed function can do."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .solidity import _shell

DEPTH = 8
#: The interface that needs no declaration: functions, whether they only read.
BUILT_IN = {
    "ERC20": {
        "transfer": ("transfer(address,uint256)", False), "transferFrom": ("transferFrom(address,address,uint256)", False), "approve": ("approve(address,uint256)", False),
        "balanceOf": ("balanceOf(address)", True), "allowance": ("allowance(address,address)", True), "totalSupply": ("totalSupply()", True),
    }
}
BUILT_IN["IERC20"] = BUILT_IN["ERC20"]
OWNER, ROLE = re.compile(r"owner"), re.compile(r"role|minter|guardian|operator|keeper|manager|governor")
_ELEMENTARY = re.compile(r"^(u?int\d+|bytes\d+|address|bool|decimal)$")


@dataclass
class Line:
    number: int
    indent: int
    text: str


def lines(source: str) -> list[Line]:
    """Logical lines without comments and docstrings; a line goes on while brackets are open."""
    out, open_brackets, i, number = [], 0, 0, 1
    begun, indent, parts = 1, None, []
    while i <= len(source):
        c = source[i] if i < len(source) else "\n"
        if source.startswith('"""', i) or source.startswith("'''", i):
            end = source.find(source[i : i + 3], i + 3)
            end = len(source) if end < 0 else end + 3
            number += source.count("\n", i, end)
            i = end
            continue
        if c in "\"'":
            end = i + 1
            while end < len(source) and source[end] != c and source[end] != "\n":
                end += 2 if source[end] == "\\" else 1
            parts.append(source[i : end + 1])
            i = end + 1
            continue
        if c == "#":
            i = source.find("\n", i)
            i = len(source) if i < 0 else i
            continue
        if c == "\n":
            text = "".join(parts)
            if open_brackets <= 0 or i >= len(source):
                if text.strip():
                    out.append(Line(begun, len(text) - len(text.lstrip()), " ".join(text.split())))
                parts, open_brackets = [], 0
                begun = number + 1
            else:
                parts.append(" ")
            number += 1
        else:
            open_brackets += (c in "([{") - (c in ")]}")
            parts.append("    " if c == "\t" else c)
        i += 1
    return out


def matching(text: str, at: int) -> int:
    """Index of the bracket that closes the one at ``at``, strings aside; -1 without one."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        else:
            depth += (c in "([{") - (c in ")]}")
            if not depth:
                return i
    return -1


def arguments(text: str) -> list[str]:
    out, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
        else:
            depth += (c in "([{") - (c in ")]}")
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


@dataclass
class Function:
    name: str
    params: list
    returns: str | None
    decorators: list
    body: list
    line: int


@dataclass
class Module:
    variables: dict = field(default_factory=dict)
    functions: dict = field(default_factory=dict)
    events: dict = field(default_factory=dict)
    structs: dict = field(default_factory=dict)
    enums: set = field(default_factory=set)
    interfaces: dict = field(default_factory=dict)
    implements: list = field(default_factory=list)
    imports: list = field(default_factory=list)

    def visibility(self, fn: Function) -> str:
        return "external" if {"external", "deploy"} & set(fn.decorators) else "public" if "public" in fn.decorators else "internal"


def mutability(decorators: list[str]) -> str:
    return next((m for m in ("pure", "view", "payable") if m in decorators), "nonpayable")


_DEF = re.compile(r"def (\w+)\s*\(")


def header(text: str) -> tuple[str, list[tuple[str, str, bool]], str | None] | None:
    """Name, parameters ``(name, type, has a default)`` and return type of a def line."""
    m = _DEF.match(text)
    if not m or (end := matching(text, m.end() - 1)) < 0:
        return None
    given = []
    for p in arguments(text[m.end() : end]):
        name, _, kind = p.partition(":")
        kind, default, _ = kind.partition("=")
        given.append((name.strip(), kind.strip(), bool(default)))
    returned = re.search(r"->\s*(.+?)\s*:?\s*\w*$", text[end:]) if "->" in text[end:] else None
    return m[1], given, returned and returned[1].rstrip(":").strip()


def parse(source: str) -> Module:
    out, rows, i, decorators = Module(), lines(source), 0, []

    def block(at):
        end = at + 1
        while end < len(rows) and rows[end].indent > rows[at].indent:
            end += 1
        return rows[at + 1 : end], end

    while i < len(rows):
        text = rows[i].text
        if text.startswith("@"):
            decorators.append(re.match(r"@(\w+)", text)[1])
            i += 1
            continue
        inner, end = block(i)
        word = text.split(" ")[0].rstrip(":")
        if word == "def" and (found := header(text)):
            out.functions[found[0]] = Function(*found, decorators, inner, rows[i].number)
        elif word in ("event", "struct"):
            name = text.split(" ")[1].rstrip(":")
            (out.events if word == "event" else out.structs)[name] = [tuple(x.strip() for x in r.text.split(":", 1)) for r in inner if ":" in r.text]
        elif word in ("enum", "flag"):
            out.enums.add(text.split(" ")[1].rstrip(":"))
        elif word == "interface":
            stubs = [(header(r.text), r.text) for r in inner]
            out.interfaces[text.split(" ")[1].rstrip(":")] = {h[0]: (h, bool(re.search(r":\s*(view|pure)$", t))) for h, t in stubs if h}
        elif word in ("import", "from"):
            out.imports.append(text)
        elif word == "implements":
            out.implements.append(text.split(":", 1)[1].strip())
        elif m := re.match(r"(\w+)\s*:\s*(.+)$", text):
            kind, _, value = m[2].partition(" = ")
            flags = set()
            while w := re.match(r"(public|constant|immutable|transient)\((.*)\)$", kind.strip()):
                flags.add(w[1])
                kind = w[2]
            out.variables[m[1]] = (kind.strip(), flags, value.strip())
        decorators, i = [], end
    return out


def abi_type(kind: str, module: Module, depth: int = 0) -> str | None:
    """Canonical type; None for maps and what is not declared."""
    kind = kind.strip()
    if depth > 8 or kind.startswith("HashMap"):
        return None
    if kind == "decimal":
        return "int168"
    if _ELEMENTARY.match(kind):
        return kind
    if m := re.match(r"(Bytes|String)\[", kind):
        return m[1].lower()
    if m := re.match(r"DynArray\[(.*)\]$", kind):
        inner = abi_type(", ".join(arguments(m[1])[:-1]), module, depth + 1)
        return inner and inner + "[]"
    if m := re.match(r"(.+)\[(\w+)\]$", kind):
        inner, size = abi_type(m[1], module, depth + 1), m[2]
        size = size if size.isdigit() else module.variables.get(size, ("", (), ""))[2]
        return f"{inner}[{size}]" if inner and size.isdigit() else None
    if kind in module.structs:
        parts = [abi_type(t, module, depth + 1) for _, t in module.structs[kind]]
        return None if None in parts else f"({','.join(parts)})"
    if kind in module.enums:
        return "uint256"
    return "address" if kind in module.interfaces or kind in BUILT_IN else None


def signature(name: str, kinds: list[str], module: Module) -> str | None:
    parts = [abi_type(k, module) for k in kinds]
    return None if None in parts else f"{name}({','.join(parts)})"


def getter(name: str, kind: str, module: Module) -> tuple[str | None, str | None]:
    """Signature and result of the function that the compiler makes for a public variable: map keys and indices are its parameters."""
    keys = []
    while True:
        if m := re.match(r"HashMap\[(.*)\]$", kind):
            key, *rest = arguments(m[1])
            keys.append(key)
            kind = ", ".join(rest)
        elif m := re.match(r"DynArray\[(.*)\]$", kind):
            keys.append("uint256")
            kind = ", ".join(arguments(m[1])[:-1])
        elif not kind.startswith(("Bytes[", "String[")) and (m := re.match(r"(.+)\[\w+\]$", kind)):
            keys.append("uint256")
            kind = m[1]
        else:
            return signature(name, keys, module), abi_type(kind, module)


def assignment(text: str) -> tuple[str, str] | None:
    """``target, operator`` of a top-level assignment."""
    depth, quote = 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        else:
            depth += (c in "([{") - (c in ")]}")
            if c == "=" and not depth and text[i + 1 : i + 2] != "=" and text[i - 1] not in "=!<>":
                op = text[i - 1] if text[i - 1] in "+-*/%&|^" else ""
                return text[: i - len(op)].rstrip("*/ ").strip(), op + "="
    return None


class Walk:
    def __init__(self, module: Module, fn: Function):
        self.module, self.fn = module, fn
        self.reads, self.writes, self.internal, self.external, self.events, self.notes, self.statements = {}, {}, [], [], [], [], []

    def run(self, fn: Function, via: tuple = (), path: tuple = ()):
        if len(via) > DEPTH or fn.name in path:
            return
        params = {n: k for n, k, _ in fn.params}
        for row in fn.body:
            text = row.text
            self.statements.append(text)
            self.state(text, via)
            self.calls(text, params, via)
            if m := re.match(r"log (\w+)\(", text):
                kinds = [re.sub(r"^indexed\((.*)\)$", r"\1", k) for _, k in self.module.events.get(m[1], [])]
                said = signature(m[1], kinds, self.module) if m[1] in self.module.events else None
                if (said or f"{m[1]}(...)") not in self.events:
                    self.events.append(said or f"{m[1]}(...)")
            for m in re.finditer(r"\bself\.(\w+)\(", text):
                if callee := self.module.functions.get(m[1]):
                    self.internal.append({"name": m[1], "kind": "internal", "declared_in": "", "depth": len(via) + 1, "via": list(via)})
                    self.run(callee, (*via, m[1]), (*path, fn.name))

    def state(self, text, via):
        found = assignment(text)
        plain = re.sub(r"\"[^\"]*\"|'[^']*'", '""', text)
        for m in re.finditer(r"\bself\.(\w+)\b(?!\()", plain):
            name = m[1]
            if name not in self.module.variables:
                continue
            stays = found and plain.startswith("self.") and m.start() == 0
            grows = re.match(r"\.(append|pop)\(", plain[m.end() :])
            if stays or grows:
                self.writes.setdefault(name, list(via))
                if stays and found[1] != "=":
                    self.reads.setdefault(name, list(via))
            else:
                self.reads.setdefault(name, list(via))
        for name, (_, flags, _) in self.module.variables.items():
            if flags & {"immutable"} and re.search(rf"(?<![\w.]){name}\b", plain):
                self.reads.setdefault(name, list(via))

    def destination(self, text, params):
        text = text.strip()
        if m := re.match(r"\w+\((.*)\)$", text):
            text = m[1].strip()
        if text == "self":
            return {"kind": "this", "name": "self", "address": None}
        if re.fullmatch("0x[0-9a-fA-F]{40}", text):
            return {"kind": "literal", "name": None, "address": text.lower()}
        if m := re.match(r"self\.(\w+)", text):
            return {"kind": "state", "name": m[1], "address": None}
        if text in params:
            return {"kind": "parameter", "name": text, "address": None}
        if text in self.module.variables:
            kind, flags, value = self.module.variables[text]
            return {"kind": "constant" if "constant" in flags else "immutable", "name": text, "address": value.lower() if re.fullmatch("0x[0-9a-fA-F]{40}", value) else None}
        return {"kind": "local" if re.fullmatch(r"\w+", text) else "unknown", "name": text, "address": None}

    def member(self, interface, name):
        """Signature of an interface's function and whether it only reads."""
        if interface in self.module.interfaces and name in self.module.interfaces[interface]:
            (_, given, _), reads = self.module.interfaces[interface][name]
            return signature(name, [k for _, k, _ in given], self.module), reads
        return BUILT_IN.get(interface, {}).get(name)

    def add(self, name, said, how, to, kind, n, via):
        self.external.append({
            "function_name": name, "signature": said, "call_type": how, "destination_kind": to["kind"], "destination": to["name"], "address": to["address"], "contract_type": kind, "arguments": n, "via": list(via),
        })

    def calls(self, text, params, via):
        for m in re.finditer(r"(?:(extcall|staticcall)\s+)?\b([A-Z]\w*)\(", text):
            end = matching(text, m.end() - 1)
            after = re.match(r"\.(\w+)\(", text[end + 1 :]) if end > 0 else None
            if after and (m[2] in self.module.interfaces or m[2] in BUILT_IN):
                self.interface_call(text, end + 1 + after.end() - 1, after[1], m[2], m[1], self.destination(text[m.end() : end], params), via)
        for m in re.finditer(r"(?:(extcall|staticcall)\s+)?(?<![\w.])(?:(self\.)(\w+)|(\w+))\.(\w+)\(", text):
            name = m[3] or m[4]
            kind = self.module.variables.get(name, (None,))[0] if m[3] or name in self.module.variables else params.get(name)
            if kind in self.module.interfaces or kind in BUILT_IN:
                self.interface_call(text, m.end() - 1, m[5], kind, m[1], self.destination((m[2] or "") + name, params), via)
        for m in re.finditer(r"\braw_call\(", text):
            given = arguments(text[m.end() : matching(text, m.end() - 1)])
            flags = " ".join(given[2:])
            literal = re.search(r"method_id\(\s*[\"']([^\"']+)[\"']", " ".join(given))
            how = "delegatecall" if "is_delegate_call=True" in flags else "staticcall" if "is_static_call=True" in flags else "call" if literal else "dynamic"
            self.add(literal[1].split("(")[0] if literal else "raw_call", literal and literal[1], how, self.destination(given[0] if given else "", params), None, len(given), via)
            if not literal:
                self.notes.append("raw_call with dynamically computed calldata: its selector is not known from the source")
        if m := re.search(r"(?<![\w.])send\(", text):
            given = arguments(text[m.end() : matching(text, m.end() - 1)])
            self.add("send", None, "call", self.destination(given[0] if given else "", params), None, len(given), via)
        for m in re.finditer(r"\b(create_\w+)\(", text):
            given = arguments(text[m.end() : matching(text, m.end() - 1)])
            self.add(m[1], None, "create", self.destination(given[0] if given else "", params), None, len(given), via)

    def interface_call(self, text, paren, name, interface, keyword, to, via):
        said, reads = self.member(interface, name) or (None, False)
        how = "staticcall" if keyword == "staticcall" or (not keyword and reads) else "call"
        self.add(name, said, how, to, interface, len(arguments(text[paren + 1 : matching(text, paren)])), via)


def access_of(statements: list[str]) -> tuple[str, list[str]]:
    """The last check of the sender among all statements that run, its kind by what it compares with."""
    kind, gates = "open", []
    for text in statements:
        if "msg.sender" in text and re.match(r"(assert|if)\b", text):
            other = re.search(r"self\.(\w+)", text)
            name = other[1] if other else ""
            kind = "owner" if OWNER.search(name) else "role" if ROLE.search(name) else "restricted"
            gates = [f"self.{name}" if name else text]
    return kind, gates


def analyse(files: list[tuple[str, str]], contract: str | None = None, abi: list[str] = ()) -> list[dict]:
    """A record for each exposed function, generated getters among them; with ``abi`` signatures one for each of those, matched by name."""
    module = Module()
    for _, source in files:
        one = parse(source)
        for kind in ("variables", "functions", "events", "structs", "interfaces"):
            for name, value in getattr(one, kind).items():
                getattr(module, kind).setdefault(name, value)
        module.enums |= one.enums
        module.imports += one.imports
        module.implements += one.implements
    rows = []
    for fn in module.functions.values():
        if module.visibility(fn) == "internal" or fn.name == "__init__":
            continue
        walk = Walk(module, fn)
        walk.run(fn)
        kind, gates = access_of(walk.statements)
        rows.append({
            "name": fn.name, "signature": "" if fn.name == "__default__" else signature(fn.name, [k for _, k, _ in fn.params], module), "declared_in": contract, "visibility": "external",
            "mutability": mutability(fn.decorators), "has_source": True, "access": kind, "gates": gates, "reads": list(walk.reads), "writes": list(walk.writes), "events": walk.events,
            "internal_calls": walk.internal, "external_calls": walk.external, "notes": list(dict.fromkeys(walk.notes)), "natspec": None, "line": fn.line, "chain": [contract] if contract else [],
        })
    for name, (kind, flags, _) in module.variables.items():
        if "public" in flags:
            said, _ = getter(name, kind, module)
            rows.append(_shell(said or name) | {
                "name": name, "signature": said, "declared_in": contract, "mutability": "view", "has_source": True, "access": "open", "reads": [name],
                "notes": ["Vyper generated this getter for a public variable"], "chain": [contract] if contract else [],
            })
    if not abi:
        return rows
    by_name = {r["name"]: r for r in rows}
    matched = [by_name[s.split("(")[0]] | {"signature": s} if s.split("(")[0] in by_name else _shell(s) for s in abi]
    return matched
