"""What stands between a caller and an analysis, as columns: requests, who may ask, which file is meant, links to a next page, registries, probe tables, drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Depths that a request may name, and addresses of the machine itself.
DEPTHS, LOOPBACK = ("quick", "standard", "deep"), ("127.0.0.1", "localhost", "::1")
#: Kinds of files by the end of their names.
KINDS = {"html": "text/html; charset=utf-8", "js": "text/javascript; charset=utf-8", "css": "text/css; charset=utf-8", "json": "application/json; charset=utf-8", "svg": "image/svg+xml"}


def parsed_request(params: Column) -> Column:
    """``struct<address, chain, depth>`` of a map of parameters: trimmed; an unknown depth is standard, no chain is ethereum."""
    given = lambda k, other: F.trim(F.coalesce(F.try_element_at(params, F.lit(k)), F.lit(other)))
    depth = given("depth", "standard")
    return F.struct(given("address", "").alias("address"), given("chain", "ethereum").alias("chain"), F.when(depth.isin(*DEPTHS), depth).otherwise("standard").alias("depth"))


def authorised(header: Column, query: Column, token: Column) -> Column:
    """Whether a caller's token, from a header or a query, is the one that is set; without one that is set all may ask."""
    set_one = F.nullif(F.trim(token), F.lit(""))
    same = lambda c: F.coalesce(F.sha2(F.trim(c), 256) == F.sha2(set_one, 256), F.lit(False))  # noqa: E731  (of digests, so that time tells nothing)
    return set_one.isNull() | same(header) | same(query)


def may_start(host: Column, token: Column) -> Column:
    """A server that other machines reach starts only with a token."""
    return F.coalesce(F.trim(host), F.lit(LOOPBACK[0])).isin(*LOOPBACK) | (F.coalesce(F.trim(token), F.lit("")) != "")


def static_file(path: Column) -> Column:
    """``struct<status, file, kind>``: the file of a path and what it is; 400 for a path that climbs."""
    file = F.when(path == "/", "/index.html").otherwise(path)
    end = F.element_at(F.split(file, r"\."), -1)
    kind = F.lit("application/octet-stream")
    for name, text in KINDS.items():
        kind = F.when(end == name, text).otherwise(kind)
    good = ~F.contains(file, F.lit(".."))
    return F.struct(F.when(good, 200).otherwise(400).alias("status"), F.when(good, file).alias("file"), F.when(good, kind).alias("kind"))


def query_string(params: Column) -> Column:
    """``&name=value`` of an array of ``struct<name, value>`` in its order, encoded as forms are; entries without a value go, none gives nothing."""
    # a form leaves * and writes ~ as %7E; the URL codec of the JVM does both
    pairs = F.transform(F.filter(params, lambda p: p["value"].isNotNull()), lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("&"), F.array_join(pairs, "&"))).otherwise("")


def env_rows(files: DataFrame) -> DataFrame:
    """``addr, name, value`` of the ``NAME=value`` lines of ``files(addr, text)``: comments and empty values go, and one quote at each end."""
    lines = files.select("addr", F.explode(F.split("text", "\n")).alias("line")).select("addr", F.trim("line").alias("line"))
    parts = lines.where("line not like '#%' and instr(line, '=') > 1")
    name = F.trim(F.substring_index("line", "=", 1))
    value = F.trim(F.substr("line", F.instr("line", "=") + 1))
    value = F.regexp_replace(F.regexp_replace(value, "^[\"']", ""), "[\"']$", "")
    return parts.select("addr", name.alias("name"), value.alias("value")).where("name <> '' and value <> ''")


def usable(value: Column, placeholders) -> Column:
    """The value without blanks at its ends; null if it is empty or what documentation puts where a value belongs."""
    text = F.trim(value)
    return F.when((text != "") & ~F.lower(text).isin(*sorted(placeholders)), text)


def explorers(registry: DataFrame, host: str) -> DataFrame:
    """``chain_id, urls`` of registry documents ``(json)``, a map from chain ids to explorers: those that ``host`` runs come first, slashes at the end go."""
    entry = "map<string,struct<explorers:array<struct<url:string,hostedBy:string>>>>"
    rows = registry.select(F.explode(F.from_json("json", entry)).alias("id", "e"))
    ordered = lambda own: F.filter("e.explorers", lambda x: F.coalesce(x["hostedBy"] == host, F.lit(False)) == own)
    urls = F.transform(F.concat(ordered(True), ordered(False)), lambda x: F.regexp_replace(x["url"], "/+$", ""))
    return rows.select(F.col("id").try_cast("long").alias("chain_id"), urls.alias("urls")).where("chain_id is not null and size(urls) > 0")


def supported_chains(documents: DataFrame) -> DataFrame:
    """``chain_id`` of the chains that ``documents(json)``, lists of chains, say are supported."""
    rows = documents.select(F.explode(F.from_json("json", "array<struct<chainId:long,supported:boolean>>")).alias("c"))
    return rows.where("c.supported").select(F.col("c.chainId").alias("chain_id")).distinct()


def fixed_width(cells: list[tuple[Column, int]]) -> Column:
    """One line of a table: cells cut or filled to their widths."""
    return F.concat_ws(" | ", *(F.rpad(F.coalesce(c.cast("string"), F.lit("n/a")), w, " ") for c, w in cells))


def columns_layout(nodes: DataFrame, step: int = 40) -> DataFrame:
    """``nodes(side, name, calls)`` with ``x, y``: three columns (callers, the target's functions, destinations), the most called on top."""
    order = Window.partitionBy("side").orderBy(F.col("calls").desc(), "name")
    x = F.when(F.col("side") == "caller", 0).when(F.col("side") == "function", 1).otherwise(2)
    return nodes.withColumns({"x": x, "y": ((F.row_number().over(order) - 1) * step).cast("long")})


def hub_layout(nodes: DataFrame, radius: float = 100.0) -> DataFrame:
    """``nodes(name, calls)`` with ``x, y`` on a circle round the target, the most called at its top, then clockwise."""
    order = Window.orderBy(F.col("calls").desc(), "name")
    angle = 2 * F.pi() * (F.row_number().over(order) - 1) / F.count("*").over(Window.partitionBy())
    return nodes.withColumns({"x": F.round(radius * F.sin(angle), 3) + 0.0, "y": F.round(-radius * F.cos(angle), 3) + 0.0})
