"""Queries of source analysis over the landed sources of many contracts, of several kinds each; the expected rows follow from a contract's kind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from framelark.functions.udfs import vectorised
from framelark.operators import sourcecode
from framelark.plans.keccaksql import keccak
from framelark.plans.registry import query
from framelark.source_code import solidity, vyper
from framelark.sources.testcontracts import expected, instances

VAULT = """
// SPDX-License-Identifier: MIT
interface IToken { function pull(address from, uint256 amount) external returns (bool); function held(address who) external view returns (uint256); }
interface IPool { function supply(address asset, uint256 amount) external; }
library Mover { function movePull(IToken token, address from, uint256 amount) internal { bool ok = token.pull(from, amount); require(ok, "pull { failed"); } }
contract Roles {
    address public owner;
    modifier onlyOwner() { require(msg.sender == owner, "no"); _; }
    function rolesOwner() external view returns (address) { return owner; }
}
/// @notice A vault of one asset.
contract Vault¤ is Roles {
    using Mover for IToken;
    IToken public immutable asset¤; IPool public pool; mapping(address => uint256) public shares¤; uint256 internal fee;
    event Put¤(address indexed who, uint256 amount);
    function put¤(uint256 amount) external returns (uint256) {
        asset¤.movePull(msg.sender, amount); // a library wraps the call
        pool.supply(address(asset¤), amount);
        shares¤[msg.sender] += amount;
        emit Put¤(msg.sender, amount);
        return amount;
    }
    function held() external view returns (uint256) { return IToken(asset¤).held(address(this)); }
    function setFee(uint256 newFee) external onlyOwner { _set(newFee); }
    function _set(uint256 value) internal { fee = value; }
    function forward(address target, bytes calldata data) external returns (bool) { (bool ok, ) = target.call(data); return ok; }
    function ping() external view returns (bool) { (bool ok, ) = owner.staticcall(abi.encodeWithSignature("ping()")); return ok; }
}
"""
TYPES = """
struct Market { address loan; address collateral; uint256 ltv; } struct Allocation { Market market; uint256[] parts; }
enum Status { Idle, Active } type Id is bytes32; interface IAdapter { function ping() external; }
contract Types¤ {
    function cap(Market calldata m) external {} function allocate(Allocation[] calldata a) external {} function revoke(Id id) external {}
    function setStatus(Status s) external {} function setAdapter(IAdapter a) external {} function plain¤(uint a, address payable b) external {}
    function odd(Nowhere n) external {}
}
"""
#: Kinds of contracts: two whole ones, one with an interface alone, and such that no parser can make sense of.
KINDS = ("vault", "types", "interface", "broken", "empty")
FILES = (("vault", "Vault.sol", VAULT), ("types", "Types.sol", TYPES), ("broken", "x.sol", 'not a contract }} at ¤ all "'), ("empty", "e.sol", ""), ("empty", None, None))
TARGETS = (("vault", "Vault¤", None), ("types", "Types¤", None), ("interface", "Vault", ["only¤(uint256)"]), ("broken", "X", None), ("empty", "Empty", None))

TOKEN_VY = '''
# @version 0.3.7
"""A token."""
interface Vaulty:
    def sweep(_to: address, _n: uint256) -> bool: nonpayable
event Moved¤:
    sender: indexed(address)
    amount: uint256
balanceOf: public(HashMap[address, uint256])
vault¤: Vaulty
owner: address
@internal
def _move(_from: address, _to: address, _n: uint256):
    self.balanceOf[_from] -= _n
    self.balanceOf[_to] += _n
    log Moved¤(_from, _n)
@external
def transfer¤(_to: address, _n: uint256) -> bool:
    self._move(msg.sender, _to, _n)
    return True
@external
def set_owner(_new: address):
    assert msg.sender == self.owner, "not # owner"
    self.owner = _new
@external
def sweep(_to: address, _n: uint256):
    extcall self.vault¤.sweep(_to, _n)
    raw_call(_to, concat(method_id("note(uint256)"), convert(_n, bytes32)))
@external
def raw(_to: address, _data: Bytes[64]):
    raw_call(_to, _data)
'''
VY_KINDS = ("token", "broken", "empty")
VY_FILES = (("token", "t.vy", TOKEN_VY), ("broken", "b.vy", "def broken¤(:\n  x ="), ("empty", "e.vy", ""))
VY_TARGETS = (("token", "Token", None), ("broken", "B", None), ("empty", "E", None))

FILE, TARGET = "path string, content string", "contract string, abi array<string>"


def files(spark, sf_dir):
    return instances(spark, sf_dir, KINDS, FILES, FILE)


def vyper_files(spark, sf_dir):
    return instances(spark, sf_dir, VY_KINDS, VY_FILES, FILE)


def solidity_functions(spark, sf_dir):
    return sourcecode.functions(files(spark, sf_dir), instances(spark, sf_dir, KINDS, TARGETS, TARGET))


def vyper_functions(spark, sf_dir):
    return sourcecode.functions(vyper_files(spark, sf_dir), instances(spark, sf_dir, VY_KINDS, VY_TARGETS, TARGET), "vyper")


def of_files(frame, function, ddl, kind="solidity"):
    """``addr`` and the rows that a function of a file's text makes of each distinct text; by the text, as contracts share files."""
    column = vectorised(f"array<struct<{ddl}>>")(lambda c: c.map(lambda x: function(x or "")))
    texts = frame.select(F.md5(F.coalesce("content", F.lit(""))).alias("_h"), "content").dropDuplicates(["_h"]).select("_h", F.explode(column("content")).alias("r"))
    return frame.select("addr", F.md5(F.coalesce("content", F.lit(""))).alias("_h")).join(texts, "_h").select("addr", "r.*")


def units_of(function):
    return lambda text: function(solidity.File("x.sol", text))


joined = lambda c: F.array_join(c, ",").alias(c)
vault = lambda rows, names, **more: expected(KINDS, [("vault", *r) for r in rows], names, **more)
token = lambda rows, names, **more: expected(VY_KINDS, [("token", *r) for r in rows], names, **more)

SIGNATURES = ("cap((address,address,uint256))", "allocate(((address,address,uint256),uint256[])[])", "revoke(bytes32)", "setStatus(uint8)", "setAdapter(address)", "plain¤(uint256,address)", None)
SOL_ROWS = [
    ("vault", "put¤(uint256)", "Vault¤", "nonpayable", "open", True), ("vault", "held()", "Vault¤", "view", "open", True), ("vault", "setFee(uint256)", "Vault¤", "nonpayable", "owner", True),
    ("vault", "forward(address,bytes)", "Vault¤", "nonpayable", "open", True), ("vault", "ping()", "Vault¤", "view", "open", True), ("vault", "rolesOwner()", "Roles", "view", "open", True),
    *(("types", s, "Types¤", "nonpayable", "open", True) for s in SIGNATURES), ("interface", "only¤(uint256)", None, None, "unknown", False),
]


@query(expected(KINDS, SOL_ROWS, ("signature", "declared_in", "mutability", "access", "has_source")))
def sol_analyze(spark, sf_dir):
    """Exposed functions with those of bases, and what only an interface names."""
    return solidity_functions(spark, sf_dir).select("addr", "signature", "declared_in", "mutability", "access", "has_source")


@query(expected(KINDS, [("types", s) for s in SIGNATURES if s], ("signature",)))
def sol_types(spark, sf_dir):
    """Signatures with every type that a file declares resolved; a function of an undeclared type has none."""
    return solidity_functions(spark, sf_dir).where("declared_in like 'Types%' and signature is not null").select("addr", "signature")


@query(expected(KINDS, [("types", s) for s in SIGNATURES], ("signature",)))
def sol_signatures(spark, sf_dir):
    """A signature, or nothing where a type is not declared."""
    return solidity_functions(spark, sf_dir).where("declared_in like 'Types%'").select("addr", "signature")


HASHED = expected(KINDS, [r[:2] for r in SOL_ROWS if r[1]], ("signature",))


@query(f"WITH RECURSIVE {keccak(f'SELECT signature AS k FROM ({HASHED})')} SELECT addr, signature, substr(digest, 1, 10) AS selector FROM ({HASHED}) JOIN keccak ON k = signature")
def sol_functions(spark, sf_dir):
    from framelark.functions import hashing

    found = solidity_functions(spark, sf_dir).where("signature is not null")
    return found.select("addr", "signature", hashing.selector(F.col("signature")).alias("selector"))


@query(vault([("put¤(uint256)", "pull(address,uint256)", "call", "immutable", "asset¤", "IToken", "Mover.movePull"), ("put¤(uint256)", "supply(address,uint256)", "call", "state", "pool", "IPool", ""),
              ("held()", "held(address)", "staticcall", "immutable", "asset¤", "IToken", "")], ("fn", "signature", "call_type", "destination_kind", "destination", "contract_type", "via")))
def sol_calls(spark, sf_dir):
    found = sourcecode.external_calls(solidity_functions(spark, sf_dir)).where("contract_type is not null")
    return found.select("addr", "fn", "signature", "call_type", "destination_kind", "destination", "contract_type", joined("via"))


@query(vault([("forward(address,bytes)", None, "dynamic", "parameter", "target"), ("ping()", "ping()", "staticcall", "state", "owner")], ("fn", "signature", "call_type", "destination_kind", "destination")))
def sol_low_level(spark, sf_dir):
    found = sourcecode.external_calls(solidity_functions(spark, sf_dir)).where("contract_type is null")
    return found.select("addr", "fn", "signature", "call_type", "destination_kind", "destination")


@query(vault([("put¤(uint256)", "shares¤", "write"), ("setFee(uint256)", "fee", "write"), ("put¤(uint256)", "shares¤", "read"), ("put¤(uint256)", "asset¤", "read"), ("put¤(uint256)", "pool", "read"), ("held()", "asset¤", "read"), ("setFee(uint256)", "owner", "read"), ("ping()", "owner", "read"), ("rolesOwner()", "owner", "read")], ("signature", "variable", "access")))
def sol_state_access(spark, sf_dir):
    return sourcecode.accesses(solidity_functions(spark, sf_dir)).select("addr", "signature", "variable", "access")


@query(vault([("setFee(uint256)", "owner", "onlyOwner")], ("signature", "access", "gates")))
def sol_access(spark, sf_dir):
    return solidity_functions(spark, sf_dir).where("access not in ('open', 'unknown')").select("addr", "signature", "access", joined("gates"))


@query(vault([("put¤(uint256)", "Put¤(address,uint256)")], ("signature", "event")))
def sol_emits(spark, sf_dir):
    return solidity_functions(spark, sf_dir).select("addr", "signature", F.explode("events").alias("event"))


@query(vault([("put¤(uint256)", "movePull", "library", "Mover", 1), ("setFee(uint256)", "onlyOwner", "modifier", "Roles", 1), ("setFee(uint256)", "_set", "internal", "Vault¤", 1)], ("fn", "name", "kind", "declared_in", "depth")))
def graph_call_walk(spark, sf_dir):
    return sourcecode.internal_calls(solidity_functions(spark, sf_dir)).select("addr", "fn", "name", "kind", "declared_in", "depth")


TREE = [("put¤(uint256)", "movePull", "internal", "Mover.movePull()", 1), ("put¤(uint256)", "movePull>#0", "external", "IToken.pull()", 2), ("put¤(uint256)", "#1", "external", "IPool.supply()", 1),
        ("held()", "#0", "external", "IToken.held()", 1), ("setFee(uint256)", "onlyOwner", "internal", "onlyOwner()", 1), ("setFee(uint256)", "_set", "internal", "_set()", 1)]


@query(vault([r[:4] for r in TREE], ("fn", "path", "kind", "label")))
def tree_execution(spark, sf_dir):
    found = sourcecode.execution_tree(solidity_functions(spark, sf_dir)).where("fn not in ('forward(address,bytes)', 'ping()')")
    return found.select("addr", "fn", F.array_join("path", ">").alias("path"), "kind", "label")


@query(vault([(f, p, k, d) for f, p, k, _, d in TREE], ("fn", "path", "kind", "depth")))
def tree_render(spark, sf_dir):
    """A tree from the top: the order of paths is the order of a walk, their length is how far a line is set in."""
    found = sourcecode.execution_tree(solidity_functions(spark, sf_dir)).where("fn not in ('forward(address,bytes)', 'ping()')")
    return found.select("addr", "fn", F.array_join("path", ">").alias("path"), "kind", F.size("path").alias("depth"))


@query(vault([("put¤(uint256)", "The function reads asset¤, pool and shares¤ from storage. It runs the internal function movePull(). It can call IToken.pull(). It can call IPool.supply(). It writes shares¤. It emits Put¤."),
              ("setFee(uint256)", "The function reads owner from storage. It runs the internal functions onlyOwner() and _set(). It writes fee."), ("rolesOwner()", "The function reads owner from storage.")], ("signature", "narrative")))
def text_narrative(spark, sf_dir):
    told = sourcecode.narrated(solidity_functions(spark, sf_dir).where("signature like 'put%' or signature in ('setFee(uint256)', 'rolesOwner()')"))
    return told.select("addr", "signature", "narrative")


CLASS_KINDS = ("a", "b", "c", "d")
CLASSED = [("a", ["ERC20", "ERC4626", "Ownable"], "VLT¤", 3, True, True), ("b", ["ERC20"], "ERC20", 3, False, False), ("c", [], None, 0, False, True), ("d", [], "", 2, True, False)]


@query(expected(CLASS_KINDS, [("a", "ERC4626 tokenised vault (VLT¤), with an admin role, behind a proxy"), ("b", "ERC20 token, source not verified"), ("c", "read-only contract"), ("d", "contract with no matched standard, behind a proxy, source not verified")], ("class",)))
def text_classify(spark, sf_dir):
    return sourcecode.classified(instances(spark, sf_dir, CLASS_KINDS, CLASSED, "standards array<string>, symbol string, state_changing int, is_proxy boolean, verified boolean"))


@query(vault([("interface", "IToken", "", 2, 0), ("interface", "IPool", "", 1, 0), ("library", "Mover", "", 1, 0), ("contract", "Roles", "", 1, 1), ("contract", "Vault¤", "Roles", 6, 4)], ("kind", "name", "bases", "functions", "variables")))
def sol_units(spark, sf_dir):
    """Declarations of files, one row for each unit."""
    rows = units_of(lambda f: [{"kind": u.kind, "name": u.name, "bases": ",".join(u.bases), "functions": len(u.functions), "variables": len(u.variables)} for u in f.units])
    found = of_files(files(spark, sf_dir), rows, "kind:string,name:string,bases:string,functions:int,variables:int")
    return found.where("name not like 'Types%' and name <> 'IAdapter'")


@query(vault([("Vault¤", "Put¤", "address indexed,uint256")], ("unit", "event", "params")))
def sol_events(spark, sf_dir):
    rows = units_of(lambda f: [{"unit": u.name, "event": e, "params": ",".join(p.type + " indexed" * p.indexed for p in ps)} for u in f.units for e, ps in u.events.items()])
    return of_files(files(spark, sf_dir), rows, "unit:string,event:string,params:string")


@query(vault([("put¤", 0, "uint256", "amount"), ("forward", 0, "address", "target"), ("forward", 1, "bytes", "data"), ("setFee", 0, "uint256", "newFee"), ("_set", 0, "uint256", "value")], ("fn", "ord", "type", "name")))
def sol_params(spark, sf_dir):
    rows = units_of(lambda f: [{"fn": x.name, "ord": i, "type": p.type, "name": p.name} for u in f.units if u.name.startswith("Vault") for x in u.functions for i, p in enumerate(x.params)])
    return of_files(files(spark, sf_dir), rows, "fn:string,ord:int,type:string,name:string")


@query(vault([("asset¤", "IToken", "public", True), ("pool", "IPool", "public", False), ("shares¤", "mapping(address=>uint256)", "public", False), ("fee", "uint256", "internal", False)], ("name", "type", "visibility", "immutable")))
def sol_state_vars(spark, sf_dir):
    rows = units_of(lambda f: [{"name": v.name, "type": v.type, "visibility": v.visibility, "immutable": v.immutable} for u in f.units if u.name.startswith("Vault") for v in u.variables])
    return of_files(files(spark, sf_dir), rows, "name:string,type:string,visibility:string,immutable:boolean")


@query(vault([(n, "external") for n in ("put¤", "held", "setFee", "forward", "ping", "rolesOwner")], ("name", "visibility")))
def flt_exposed(spark, sf_dir):
    return solidity_functions(spark, sf_dir).where("declared_in like 'Vault%' or declared_in = 'Roles'").select("addr", "name", "visibility")


PROJECT_KINDS = ("deep", "flat", "none")
PROJECT = (("deep", 'import "./b/B¤.sol"; import {X} from "lib/C.sol"; contract A {}'), ("flat", 'import "./b/B¤.sol";'), ("none", "contract A¤ {}"))


@query(expected(PROJECT_KINDS, [("deep", "./b/B¤.sol", "b/B¤.sol"), ("deep", "lib/C.sol", "x/lib/C.sol"), ("flat", "./b/B¤.sol", "b/B¤.sol")], ("spec", "target")))
def sol_imports(spark, sf_dir):
    def edges(text):
        import re

        others = [(f"b/{n}", "") for n in re.findall(r"B\d+\.sol", text)]
        project = solidity.Project([("A.sol", text), *others, ("x/lib/C.sol", "")])
        return [{"spec": s, "target": project.target("A.sol", s)} for s in project.files["A.sol"].imports]

    return of_files(instances(spark, sf_dir, PROJECT_KINDS, PROJECT, "content string"), edges, "spec:string,target:string")


STRIPPED = (("deep", 'contract A¤ { // }\n/* } */ string s = "}"; /* \n */\n function f() external {} }\n'), ("flat", "contract A¤ { function f() external {} /* function g() external {} */ function h() external {} }"), ("none", "// contract A¤ {}"))


@query(expected(PROJECT_KINDS, [("deep", "A¤", 1), ("flat", "A¤", 2)], ("unit", "functions")))
def sol_strip(spark, sf_dir):
    """Comments and what strings hold are no tokens of a declaration: brackets in them open nothing."""
    rows = units_of(lambda f: [{"unit": u.name, "functions": len(u.functions)} for u in f.units])
    return of_files(instances(spark, sf_dir, PROJECT_KINDS, STRIPPED, "content string"), rows, "unit:string,functions:int")


ABI_TYPES = (("Market", "(address,address,uint256)"), ("Allocation[]", "((address,address,uint256),uint256[])[]"), ("Status", "uint8"), ("Id", "bytes32"), ("IAdapter", "address"), ("Nowhere", None))


@query(expected(KINDS, [(k, t, a if k == "types" else None) for k in ("types", "vault") for t, a in ABI_TYPES], ("type", "abi")))
def sol_abi_types(spark, sf_dir):
    def rows(text):
        project = solidity.Project([("T.sol", text)])
        return [{"type": t, "abi": project.abi_type(t, "T.sol", None)} for t, _ in ABI_TYPES]

    return of_files(files(spark, sf_dir).where("path in ('Vault.sol', 'Types.sol')"), rows, "type:string,abi:string")


EDGE_KINDS = ("cycle", "line", "self")
EDGES = (("cycle", "a.sol", "b¤.sol"), ("cycle", "b¤.sol", "c.sol"), ("cycle", "c.sol", "a.sol"), ("cycle", "d.sol", "c.sol"), ("line", "a.sol", "b.sol"), ("line", "b.sol", "c¤.sol"), ("self", "a¤.sol", "a¤.sol"))
REACHED = [("cycle", x, y) for x in ("a.sol", "b¤.sol", "c.sol", "d.sol") for y in ("a.sol", "b¤.sol", "c.sol")] + [("cycle", "d.sol", "d.sol")]
REACHED += [("line", "a.sol", "a.sol"), ("line", "a.sol", "b.sol"), ("line", "a.sol", "c¤.sol"), ("line", "b.sol", "b.sol"), ("line", "b.sol", "c¤.sol"), ("line", "c¤.sol", "c¤.sol"), ("self", "a¤.sol", "a¤.sol")]


@query(expected(EDGE_KINDS, REACHED, ("path", "reaches")))
def graph_import_reach(spark, sf_dir):
    return sourcecode.reach(instances(spark, sf_dir, EDGE_KINDS, EDGES, "path string, target string"))


BASES = (("cycle", "D¤", 0, "B"), ("cycle", "D¤", 1, "C"), ("cycle", "B", 0, "A"), ("cycle", "C", 0, "A"), ("cycle", "C", 1, "E"), ("cycle", "A", 0, None), ("cycle", "E", 0, None), ("line", "X¤", 0, "Y"), ("line", "Y", 0, None), ("self", "Z", 0, "Z"))
LINES = [("cycle", *r) for r in (("D¤", "D¤", 0), ("D¤", "B", 1), ("D¤", "A", 2), ("D¤", "C", 3), ("D¤", "E", 4), ("B", "B", 0), ("B", "A", 1), ("C", "C", 0), ("C", "A", 1), ("C", "E", 2), ("A", "A", 0), ("E", "E", 0))]
LINES += [("line", "X¤", "X¤", 0), ("line", "X¤", "Y", 1), ("line", "Y", "Y", 0), ("self", "Z", "Z", 0)]


@query(expected(EDGE_KINDS, LINES, ("unit", "base", "place")))
def graph_linearize(spark, sf_dir):
    return sourcecode.linearised(instances(spark, sf_dir, EDGE_KINDS, BASES, "unit string, ord int, base string"))


COMPLETE = (("vault", "Vault¤", ["put¤(uint256)", "ghost¤()"]), ("types", "Types¤", ["setStatus(uint8)"]), ("interface", "Vault", None), ("broken", "X", ["only()"]), ("empty", "Empty", []))


@query(expected(KINDS, [("vault", "put¤(uint256)", True), ("vault", "ghost¤()", False), ("types", "setStatus(uint8)", True), ("broken", "only()", False)], ("signature", "has_source")))
def join_abi_complete(spark, sf_dir):
    """With an interface exactly its functions: others of the source go, and what the source lacks is added."""
    found = sourcecode.functions(files(spark, sf_dir), instances(spark, sf_dir, KINDS, COMPLETE, TARGET))
    return found.where("signature <> ''").select("addr", "signature", "has_source")


@query(expected(KINDS, [("interface", "only¤(uint256)", "no source for this function")], ("signature", "notes")))
def sol_abi_only(spark, sf_dir):
    return solidity_functions(spark, sf_dir).where("not has_source").select("addr", "signature", joined("notes"))


VY_ROWS = [("transfer¤(address,uint256)", "nonpayable", "open", "balanceOf"), ("set_owner(address)", "nonpayable", "owner", "owner"), ("sweep(address,uint256)", "nonpayable", "open", ""), ("raw(address,bytes)", "nonpayable", "open", ""), ("balanceOf(address)", "view", "open", "")]


@query(token(VY_ROWS, ("signature", "mutability", "access", "writes")))
def vy_analyze(spark, sf_dir):
    return vyper_functions(spark, sf_dir).select("addr", "signature", "mutability", "access", joined("writes"))


@query(token([("sweep(address,uint256)", "sweep(address,uint256)", "call", "state", "vault¤", "Vaulty"), ("sweep(address,uint256)", "note(uint256)", "call", "parameter", "_to", None), ("raw(address,bytes)", None, "dynamic", "parameter", "_to", None)], ("fn", "signature", "call_type", "destination_kind", "destination", "contract_type")))
def vy_calls(spark, sf_dir):
    return sourcecode.external_calls(vyper_functions(spark, sf_dir)).select("addr", "fn", "signature", "call_type", "destination_kind", "destination", "contract_type")


@query(token([("note", "note(uint256)", "call"), ("raw_call", None, "dynamic")], ("function_name", "signature", "call_type")))
def vy_raw_call(spark, sf_dir):
    return sourcecode.external_calls(vyper_functions(spark, sf_dir)).where("contract_type is null").select("addr", "function_name", "signature", "call_type")


@query(token([("set_owner(address)", "owner", "self.owner")], ("signature", "access", "gates")))
def vy_access(spark, sf_dir):
    return vyper_functions(spark, sf_dir).where("access <> 'open'").select("addr", "signature", "access", joined("gates"))


@query(token([("transfer¤(address,uint256)", "Moved¤(address,uint256)", "_move")], ("signature", "event", "internal")))
def vy_events(spark, sf_dir):
    return vyper_functions(spark, sf_dir).where(F.size("events") > 0).select("addr", "signature", F.col("events")[0].alias("event"), F.array_join("internal_calls.name", ",").alias("internal"))


@query(token([("balanceOf", "HashMap[address, uint256]", "public"), ("vault¤", "Vaulty", ""), ("owner", "address", "")], ("name", "type", "flags")))
def vy_module(spark, sf_dir):
    rows = lambda text: [{"name": n, "type": k, "flags": ",".join(sorted(f))} for n, (k, f, _) in vyper.parse(text).variables.items()]
    return of_files(vyper_files(spark, sf_dir), rows, "name:string,type:string,flags:string")


@query(token([(n, "internal" if n == "_move" else "external", "nonpayable") for n in ("_move", "transfer¤", "set_owner", "sweep", "raw")], ("name", "visibility", "mutability")))
def vy_functions(spark, sf_dir):
    def rows(text):
        module = vyper.parse(text)
        return [{"name": f.name, "visibility": module.visibility(f), "mutability": vyper.mutability(f.decorators)} for f in module.functions.values()]

    return of_files(vyper_files(spark, sf_dir).where("path = 't.vy'"), rows, "name:string,visibility:string,mutability:string")


@query(token([("transfer¤",), ("set_owner",), ("sweep",), ("raw",)], ("name",)))
def flt_external(spark, sf_dir):
    rows = lambda text: [{"name": f.name, "decorators": f.decorators} for f in vyper.parse(text).functions.values()]
    found = of_files(vyper_files(spark, sf_dir), rows, "name:string,decorators:array<string>")
    return found.where(F.exists("decorators", lambda d: d.isin("external", "public"))).select("addr", "name")


@query(token([("balanceOf(address)", "uint256")], ("signature", "returns")))
def vy_getters(spark, sf_dir):
    def rows(text):
        module = vyper.parse(text)
        found = [vyper.getter(n, k, module) for n, (k, f, _) in module.variables.items() if "public" in f]
        return [{"signature": s, "returns": r} for s, r in found]

    return of_files(vyper_files(spark, sf_dir), rows, "signature:string,returns:string")


VY_TYPES = (("DynArray[S, 3]", "(address,uint256[¤])[]"), ("Bytes[32]", "bytes"), ("uint256[N]", "uint256[¤]"), ("decimal", "int168"), ("HashMap[address, uint256]", None), ("ERC20", "address"))


@query(expected(VY_KINDS, [("token", *t) for t in VY_TYPES] + [("broken", "uint256[¤]", "uint256[¤]")], ("type", "abi")))
def vy_types(spark, sf_dir):
    """Types by the constants and structs of their file, whose text stands beside them."""
    module = "N: constant(uint256) = ¤\nstruct S:\n    a: address\n    b: uint256[N]\n"
    rows = instances(spark, sf_dir, VY_KINDS, [("token", module, t) for t, _ in VY_TYPES] + [("broken", "", "uint256[¤]")], "module string, type string")
    named = vectorised("string")(lambda modules, types: pd.Series([vyper.abi_type(t, vyper.parse(m)) for m, t in zip(modules, types)]))
    return rows.select("addr", "type", named("module", "type").alias("abi"))


VY_LINES = (("self.a¤[b == c] += d", "self.a¤[b == c]", "+="), ("x¤: uint256 = y", "x¤: uint256", "="), ("assert a¤ == b", None, None))


@query(expected(VY_KINDS, [("token", *r) for r in VY_LINES] + [("empty", "pass", None, None)], ("text", "target", "op")))
def vy_lines(spark, sf_dir):
    rows = vectorised("array<string>")(lambda t: t.map(lambda x: list(vyper.assignment(x) or (None, None))))
    texts = instances(spark, sf_dir, VY_KINDS, [("token", r[0]) for r in VY_LINES] + [("empty", "pass")], "text string").withColumn("a", rows("text"))
    return texts.select("addr", "text", F.col("a")[0].alias("target"), F.col("a")[1].alias("op"))
