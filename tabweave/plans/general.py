"""Queries of the two general corpus problems: nested records, and a few keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import nested, skew
from tabweave.plans.common import table


def _routed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return nested.route(nested.nodes(table(spark, d, "new_tables_tokenized_full")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value is in the subtype table of its role and kind; its keys are the supertype's."""
    return nested.value_positions(_routed(spark, d)).distinct()


def p1_variants(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and tables of each variant."""
    found = nested.nodes(table(spark, d, "new_tables_tokenized_full"), values=False).select("id", "role", "variant")
    return found.groupBy("role", "variant").agg(F.count("*").alias("n_nodes"), F.count_distinct("id").alias("n_tables"))


def p1_tuples(spark: SparkSession, d: str) -> DataFrame:
    t = _routed(spark, d)["tuples"]
    return t.select("id", "tuple_pos", "n_cells").distinct()


def p1_cell_text(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d)["cell_text"].select("id", "tuple_pos", "cell_pos", "value", "type_tag").distinct()


def p1_cell_number(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d)["cell_number"].select("id", "tuple_pos", "cell_pos", "value", "number_text").distinct()


def p1_alternatives_with_cells(spark: SparkSession, d: str) -> DataFrame:
    """Text alternatives beside the text of their cell: the parent by dropping the last position."""
    t = _routed(spark, d)
    cell = t["cell_text"].select("id", "tuple_pos", "cell_pos", F.col("value").alias("cell_value"))
    return t["alternative_text"].select("id", "tuple_pos", "cell_pos", "alt_pos", "value").join(cell, ["id", "tuple_pos", "cell_pos"], "left").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_keys(table(spark, d, "main_tokenized"), ["tokenized", "tableid"], 0.02)


def p3_value_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_stats(table(spark, d, "main_tokenized"), "tokenized")[0]


def p3_table_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_stats(table(spark, d, "main_tokenized"), "tableid")[0]


def p3_cells_with_stored_idf(spark: SparkSession, d: str) -> DataFrame:
    """Per table, its cells and those whose value has a stored idf: cells against the replicated statistics."""
    cells = table(spark, d, "main_tokenized").where("tokenized is not null").select("tableid", "colid", "rowid", "tokenized")
    stored = table(spark, d, "inverse_document_frequency").select(F.col("term").alias("tokenized"), "number_occurence").distinct()
    joined = skew.join(cells, stored, "tokenized", "left", shard_by=["tableid", "colid", "rowid"])
    return joined.groupBy("tableid").agg(F.count("*").alias("n_cells"), F.count("number_occurence").alias("n_listed"))


_KEY = "select cast({k} as varchar) key_value, count(*) n_rows, count(distinct (tableid, colid)) n_columns, count(distinct tableid) n_tables from main_tokenized where {k} is not null group by {k}"

_NODES = """with docs as (select distinct id, content from new_tables_tokenized_full where json_valid(content)),
 o as (select id, case json_type(content) when 'OBJECT' then content::json when 'VARCHAR' then case when json_valid(content ->> '$') and json_type(content ->> '$') = 'OBJECT' then (content ->> '$')::json end end j from docs),
 t as (select id, unnest((j -> '$.tuples')::json[]) t, unnest(range(json_array_length(j, '$.tuples')::bigint)) tuple_pos from o where json_type(j, '$.tuples') = 'ARRAY'),
 c as (select id, tuple_pos, unnest((t -> '$.cells')::json[]) c, unnest(range(json_array_length(t, '$.cells')::bigint)) cell_pos from t where json_type(t, '$.cells') = 'ARRAY'),
 a as (select id, tuple_pos, cell_pos, unnest((c -> '$.alternatives')::json[]) a, unnest(range(json_array_length(c, '$.alternatives')::bigint)) alt_pos from c where json_type(c, '$.alternatives') = 'ARRAY'),
 ct as (select distinct id, tuple_pos, cell_pos, c ->> '$.value' "value", case when json_type(c, '$.type') = 'VARCHAR' then c ->> '$.type' end type_tag from c where json_type(c, '$.value') = 'VARCHAR')
"""
_NUMBER = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')"

QUERIES = {f.__name__: f for f in (p1_found, p1_variants, p1_tuples, p1_cell_text, p1_cell_number, p1_alternatives_with_cells, p3_found, p3_value_stats, p3_table_stats, p3_cells_with_stored_idf)}
SQL = {
    "p1_found": _NODES + "select distinct id, tuple_pos::int tuple_pos, cell_pos::int cell_pos, -1 alt_pos from c where json_type(c, '$.value') <> 'NULL' union select id, tuple_pos::int, cell_pos::int, alt_pos::int from a where json_type(a, '$.value') <> 'NULL'",
    "p1_tuples": _NODES + "select distinct id, tuple_pos::int tuple_pos, case when json_type(t, '$.cells') = 'ARRAY' then json_array_length(t, '$.cells')::int else 0 end n_cells from t",
    "p1_cell_text": _NODES + "select id, tuple_pos::int tuple_pos, cell_pos::int cell_pos, \"value\", type_tag from ct",
    "p1_cell_number": _NODES + f"select distinct id, tuple_pos::int tuple_pos, cell_pos::int cell_pos, (c ->> '$.value')::double \"value\", c ->> '$.value' number_text from c where json_type(c, '$.value') in {_NUMBER}",
    "p1_alternatives_with_cells": _NODES + "select distinct a.id, a.tuple_pos::int tuple_pos, a.cell_pos::int cell_pos, alt_pos::int alt_pos, a ->> '$.value' \"value\", ct.value cell_value from a left join ct on ct.id = a.id and ct.tuple_pos = a.tuple_pos and ct.cell_pos = a.cell_pos where json_type(a, '$.value') = 'VARCHAR'",
    "p3_found": " union all ".join(f"select '{k}' field, cast({k} as varchar) key_value from main_tokenized where {k} is not null group by {k} having count(*) >= 0.02 * (select count(*) from main_tokenized)" for k in ("tokenized", "tableid")),
    "p3_value_stats": _KEY.format(k="tokenized"),
    "p3_table_stats": _KEY.format(k="tableid").replace("cast(tableid as varchar)", "tableid"),
    "p3_cells_with_stored_idf": "select tableid, count(*) n_cells, count(number_occurence) n_listed from main_tokenized m left join (select distinct term t, number_occurence from inverse_document_frequency) i on i.t = m.tokenized where tokenized is not null group by tableid",
}
