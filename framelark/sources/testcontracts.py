"""Adapter: landed tables of contracts out of the part table, so that queries of code, source and documents run on any TPC-H-like folder.

Part p is the contract with p as its address. Its key settles of which kind it is, and what each kind has (files, code, documents)
is written once with marks that stand for the part's numbers: contracts of a kind are many, alike but for names, and many are equal.
``expected`` states rows that follow from such a table, as SQL over the same parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.sources.testtables import table

#: Marks and what they stand for, in Spark and in DuckDB: the part's size in decimal, hexadecimal and two hexadecimal digits; its key in 40 and 39 digits.
MARKS = {
    "¤": (lambda: F.col("p_size").cast("string"), "p_size::VARCHAR"),
    "§": (lambda: F.lower(F.hex("p_size")), "printf('%x', p_size)"),
    "¶": (lambda: F.lpad(F.lower(F.hex("p_size")), 2, "0"), "lpad(printf('%x', p_size), 2, '0')"),
    "°": (lambda: F.lpad(F.lower(F.hex("p_partkey")), 40, "0"), "lpad(printf('%x', p_partkey), 40, '0')"),
    "·": (lambda: F.lpad(F.lower(F.hex("p_partkey")), 39, "0"), "lpad(printf('%x', p_partkey), 39, '0')"),
}
ADDRESS_SQL = "'0x' || lpad(printf('%x', p_partkey), 40, '0')"


def address() -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("p_partkey")), 40, "0"))


def filled(text: Column) -> Column:
    for mark, (value, _) in MARKS.items():
        text = F.replace(text, F.lit(mark), value())
    return text


def instances(spark: SparkSession, sf_dir: str, kinds: Sequence[str], rows: Sequence[tuple], schema: str) -> DataFrame:
    """``addr`` and the columns of ``schema``: for each part the rows ``(kind, *values)`` of its kind, marks filled in. The rows are constants, so they are sent along."""
    cases = spark.createDataFrame([(kinds.index(r[0]), *r[1:]) for r in rows], f"_kind int, {schema}")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    joined = parts.join(F.broadcast(cases), F.col("p_partkey") % len(kinds) == F.col("_kind"))
    columns = []
    for field in cases.schema[1:]:
        kind, c = field.dataType.simpleString(), F.col(f"`{field.name}`")
        columns.append((filled(c) if kind == "string" else F.transform(c, filled) if kind == "array<string>" else c).alias(field.name))
    return joined.select(address().alias("addr"), *columns)


def literal_sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def expected(kinds: Sequence[str], rows: Sequence[tuple], names: Sequence[str], longs: Sequence[str] = (), addr: bool = True) -> str:
    """SQL of ``addr`` (unless it is left out) and the named columns: for each part the rows ``(kind, *values)`` of its kind."""
    columns = [f"{ADDRESS_SQL} AS addr"] if addr else []
    for n, name in enumerate(names, 1):
        text = all(r[n] is None or isinstance(r[n], str) for r in rows)
        value = f'"{name}"' + ("::VARCHAR" if text else "::BIGINT" if name in longs else "")
        for mark, (_, sql) in MARKS.items():
            if text and any(mark in (r[n] or "") for r in rows):
                value = f"replace({value}, '{mark}', {sql})"
        columns.append(f'{value} AS "{name}"')
    listed = ", ".join("(" + ", ".join([str(kinds.index(r[0])), *map(literal_sql, r[1:])]) + ")" for r in rows)
    named = ", ".join(["_kind", *(f'"{n}"' for n in names)])
    return f"SELECT {', '.join(columns)} FROM part JOIN (VALUES {listed}) AS t({named}) ON p_partkey % {len(kinds)} = _kind"
