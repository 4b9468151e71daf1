"""Golden call trees, the greedy sample, hashes, bytecode and source analysis."""

import pytest

from framelark.functions import hashing
from framelark.operators import bytecode, discovery, merge, trace
from framelark.source_code import solidity, vyper

FRAMES = "tx string, block long, tx_ord long, path array<int>, from_addr string, to_addr string, selector string, call_type string"
IDENTITY = ("proxy", "impl")
TREE = [
    ("tx2", 101, 0, [], "eoa2", "callerA", "run", "call"),
    ("tx2", 101, 0, [0], "callerA", "proxy", "deposit", "call"),
    ("tx2", 101, 0, [0, 0], "proxy", "ext1", "transfer", "call"),
    ("tx1", 100, 1, [], "eoa1", "proxy", "deposit", "call"),
    ("tx1", 100, 1, [0], "proxy", "impl", "withdraw", "delegatecall"),
    ("tx1", 100, 1, [0, 0], "proxy", "ext1", "transfer", "call"),
    ("tx1", 100, 1, [0, 0, 0], "ext1", "ext2", "approve", "call"),
    ("tx1", 100, 1, [0, 1], "proxy", "ext1", "transfer", "call"),
    ("tx1", 100, 1, [1], "proxy", "ext2", "approve", "call"),
    ("tx1", 100, 1, [2], "proxy", "lib1", "helper", "delegatecall"),
]


@pytest.fixture(scope="module")
def walked(spark):
    return trace.analysed(spark.createDataFrame(TREE, FRAMES), IDENTITY).cache()


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame([("eoa1", False), ("ext1", True)], "addr string, is_contract boolean")


def test_outbound_edges(walked):
    got = {(r.target_selector, r.destination, r.destination_selector, r.calls, r.txs, r.last_tx) for r in trace.outbound_edges(trace.outbound(walked)).collect()}
    assert got == {("deposit", "ext1", "transfer", 3, 2, "tx1"), ("deposit", "ext2", "approve", 1, 1, "tx1")}


def test_delegatecalls_keep_the_context(walked):
    got = [(r.target_selector, r.destination, r.calls) for r in trace.outbound_edges(trace.delegatecalls(walked)).collect()]
    assert got == [("deposit", "lib1", 1)]


def test_inbound_edges_and_eoa_flag(walked, book):
    got = {(r.caller, r.caller_selector, r.target_selector, r.caller_is_eoa) for r in trace.inbound_edges(trace.inbound(walked), book).collect()}
    assert got == {("eoa1", None, "deposit", True), ("callerA", "run", "deposit", False)}


def test_proofs_newest_first_one_a_transaction(walked, spark):
    got = [(r.tx, r.path) for r in trace.proofs(trace.outbound(walked), ("to_addr",)).where("to_addr = 'ext1'").orderBy("proof_no").collect()]
    assert got == [("tx2", [0, 0]), ("tx1", [0, 0])]
    many = spark.createDataFrame([(f"t{b}", b, -b, [], "a", "x", "s", "call") for b in (300, 301, 302, 303)], FRAMES)
    assert [r.block for r in trace.proofs(many, ("to_addr",)).orderBy("proof_no").collect()] == [303, 302, 301]


def test_kinds(walked, book, spark):
    ends = spark.createDataFrame([("callerA",), ("eoa1",), ("ext1",), ("eoa2",)], "address string")
    assert {(r.address, r.kind) for r in trace.kinds(ends, walked, book).collect()} == {("callerA", "contract"), ("eoa1", "eoa"), ("ext1", "contract"), ("eoa2", "unknown")}
    silent = book.limit(0)
    assert {(r.address, r.kind) for r in trace.kinds(ends, walked, silent).collect()} == {("callerA", "contract"), ("eoa1", "unknown"), ("ext1", "contract"), ("eoa2", "unknown")}


def test_short_calldata_resets_the_context(spark):
    rows = [("t", 1, 0, [], "e", "proxy", "f", "call"), ("t", 1, 0, [0], "proxy", "impl", None, "call"), ("t", 1, 0, [0, 0], "impl", "x", "g", "call")]
    got = trace.outbound(trace.analysed(spark.createDataFrame(rows, FRAMES), IDENTITY)).collect()
    assert [(r.to_addr, r.enclosing) for r in got] == [("x", None)]


def test_orphans_are_not_reachable(spark):
    rows = [("t", 1, 0, p, "a", "b", "s", "call") for p in ([], [0], [0, 1], [2, 0], [3, 0, 0])]
    assert sorted(r.path for r in trace.reachable(spark.createDataFrame(rows, FRAMES)).collect()) == [[], [0], [0, 1]]


def test_greedy_sample(spark):
    rows = [(0, "t1", 10, ["a"], ["x"]), (0, "t2", 11, ["a", "b"], ["x"]), (0, "t3", 12, ["a"], []), (0, "t4", 9, ["c"], ["y", "z"]), (1, "u1", 5, [], [])]
    df = spark.createDataFrame(rows, "slice_index long, tx string, block long, selectors array<string>, counterparties array<string>")
    got = [(r.slice_index, r.tx, r.place) for r in discovery.greedy(df, 3).orderBy("slice_index", "place").collect()]
    assert got == [(0, "t2", 1), (0, "t4", 2), (0, "t3", 3), (1, "u1", 1)]
    assert [r.tx for r in discovery.interleaved(discovery.greedy(df, 3), 3).collect()] == ["t2", "u1", "t4"]


def test_segments_and_islands(spark):
    parts = discovery.segments(spark.createDataFrame([(0, 99)], "low long, head long"), 3).orderBy("slice_index").collect()
    assert [(r.from_block, r.to_block) for r in parts] == [(66, 99), (32, 65), (0, 31)]
    slices = spark.createDataFrame([(10, 20), (21, 30), (50, 60), (55, 58), (32, 40)], "from_block long, to_block long")
    assert sorted((r.from_block, r.to_block, r.slices) for r in discovery.islands(slices).collect()) == [(10, 30, 2), (32, 40, 1), (50, 60, 2)]


def test_first_site_takes_an_edge(spark):
    sites = spark.createDataFrame([("f", 1, "s", "n", None), ("f", 2, "s", "n", None), ("f", 3, None, "m", "0xA")], "fn string, site_ord long, selector string, name string, address string")
    edges = spark.createDataFrame([("f", "e1", "s", "n", "0xb", 4, 2), ("f", "e2", "t", "m", "0xa", 1, 1), ("f", "e3", "t", "m", "0xc", 7, 3)], "fn string, edge_id string, selector string, name string, destination string, calls long, txs long")
    got = {(r.site_ord, r.edge_id, r.possible, r.observed, r.calls) for r in merge.merged(sites, edges).collect()}
    assert got == {(1, None, True, True, 4), (2, None, True, False, 0), (3, None, True, True, 1), (None, "e3", False, True, 7)}


def test_keccak_of_many_lengths():
    assert hashing.keccak([b""])[0].hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    texts = [bytes([i % 251]) * i for i in range(0, 420, 7)]
    assert hashing.keccak(texts) == [hashing.keccak([t])[0] for t in texts]


def test_decoding_pads_and_skips_the_trailer():
    assert [(i.pc, bytecode.name_of(i.op), i.operand.hex()) for i in bytecode.decode("0x6001615b")] == [(0, "PUSH1", "01"), (2, "PUSH2", "5b00")]
    assert [bytecode.name_of(i.op) for i in bytecode.decode("0x60015ba1656970667358221220aabb000c")] == ["PUSH1", "JUMPDEST"]
    assert bytecode.decode(None) == [] and bytecode.decode("0xzz") == [] and bytecode.name_of(0x0C) == "UNKNOWN_0x0c"


def test_walk_is_bounded():
    loop = bytecode.decode("0x5b6001600101600056")
    assert not bytecode.walk(loop).writes
    assert bytecode.walk(bytecode.decode("0x5b" + "60015f55" * 10 + "600056")).writes == {"0x0"}


CHAINED = """
library Lib {
    function hop1(IT t, uint256 n) internal { hop2(t, n); }
    function hop2(IT t, uint256 n) internal { hop3(t, n); }
    function hop3(IT t, uint256 n) internal { t.pull(n); }
}
interface IT { function pull(uint256 n) external; }
contract C { function run(IT token) external { Lib.hop1(token, 1); } }
"""


def test_library_chains_name_the_callers_destination():
    (run,) = solidity.analyse([("a.sol", CHAINED)], "C")
    (call,) = run["external_calls"]
    assert call["via"] == ["Lib.hop1", "hop2", "hop3"] and (call["destination_kind"], call["destination"], call["signature"]) == ("parameter", "token", "pull(uint256)")


def test_imports_tell_units_of_one_name_apart():
    files = [
        ("A.sol", "library U { function tag(I i) internal { i.markA(); } } interface I { function markA() external; function markB() external; }"),
        ("B.sol", "library U { function tag(I i) internal { i.markB(); } } interface I { function markA() external; function markB() external; }"),
        ("C.sol", 'import "./A.sol"; contract C { function go(I i) external { U.tag(i); } }'),
    ]
    (go,) = solidity.analyse(files, "C")
    assert [c["function_name"] for c in go["external_calls"]] == ["markA"]


def test_sources_that_are_broken_do_not_stop_it():
    for text in ("", "contract", "contract A {", "contract A { function", "}}}}", 'contract A { string s = "', "contract A is B { function f() external { x.y(z; } }"):
        solidity.analyse([("a.sol", text)])
        vyper.analyse([("a.vy", text)])


def test_interface_decides_which_functions_count():
    got = {r["signature"]: r["has_source"] for r in solidity.analyse([("a.sol", CHAINED)], "C", ["run(address)", "ghost()"])}
    assert got == {"run(address)": True, "ghost()": False}


def test_dispatchers_are_run():
    run = lambda text, selector: bytecode.enter(bytecode.decode(text), selector)
    load = "60003560e01c"
    # no match; a selector kept in memory; a division instead of a shift; a test that is turned round; a loop; an unknown jump
    assert run("0x" + load + "6311111111" + "14" + "600f" + "57" + "00" + "5b00", 0x22222222) == (None, "the code ends before the selector is found")
    assert run("0x" + load + "600052" + "600051" + "6311111111" + "14" + "6016" + "57" + "00" + "5b00", 0x11111111) == (22, None)
    assert run("0x" + "7c01" + "00" * 28 + "600035" + "04" + "6311111111" + "14" + "602c" + "57" + "00" + "5b00", 0x11111111) == (44, None)
    assert run("0x" + load + "6311111111" + "14" + "15" + "6011" + "57" + "00" + "5b00", 0x11111111) == (16, None)
    assert run("0x5b600056", 1) == (None, "the dispatcher comes back to where it was")
    assert run("0x" + "600154" + "56", 1) == (None, "a jump of the dispatcher has no constant target")
    order, truncated = bytecode.traverse(bytecode.basic_blocks(bytecode.decode("0x" + "5b60016002576000" * 50)), cap=10)
    assert truncated and len(order) == 10
