"""One query per (type, operator) pair."""

from __future__ import annotations

from factloom.functions.predicates import emit

from . import tables as t
from .base import query

P, D, O = (t.parts, "part", "p_partkey"), (t.documents, t.DOCS_SQL, "doc_id"), (
    t.orders, t.ORDERS_SQL, "o_orderkey")
CUT = t.at("1997-06-15")
OLD, NEW = "TIMESTAMP '1998-08-02' - INTERVAL 400 DAY", "TIMESTAMP '1998-08-02' - INTERVAL 90 DAY"


def _list(test: str) -> str:
    return f"CASE WHEN flags IS NOT NULL THEN {test} END"


def _big(test: str) -> str:
    return f"CASE WHEN big_flags IS NOT NULL THEN {test} END"


# name, fixture, fact, operator, operand, WHERE of the SQL
CASES = [
    ("num_eq", P, "part.size", "eq", 20, "p_size = 20"),
    ("num_ne", D, "label.quality", "ne", 1, "quality IS NOT NULL AND quality <> 1"),
    ("num_gt", P, "part.size", "gt", 40, "p_size > 40"),
    ("num_gte", P, "part.price", "gte", "905.5", "p_retailprice >= 905.5"),
    ("num_lt", P, "part.size", "lt", 3, "p_size < 3"),
    ("num_lte", D, "doc.chars", "lte", 500, "n_chars <= 500"),
    ("num_between", P, "part.price", "between", [940, 903.5],
     "p_retailprice BETWEEN 903.5 AND 940"),
    ("num_in", P, "part.size", "in", [1, 5, 9, 49], "p_size IN (1, 5, 9, 49)"),
    ("num_not_in", D, "label.quality", "not_in", [1, 7],
     "quality IS NOT NULL AND quality NOT IN (1, 7)"),
    ("num_is_null", D, "label.quality", "is_null", None, "quality IS NULL"),
    ("num_is_not_null", D, "label.quality", "is_not_null", None, "quality IS NOT NULL"),
    ("date_before", O, "order.placed", "before", "1997-06-15T00:00:00Z",
     "o_orderdate < TIMESTAMP '1997-06-15'"),
    ("date_after", O, "order.shipped", "after", CUT, "shipped > TIMESTAMP '1997-06-15'"),
    ("date_between", O, "order.placed", "between", ["1999-01-01", str(CUT)],
     "o_orderdate BETWEEN TIMESTAMP '1997-06-15' AND TIMESTAMP '1999-01-01'"),
    ("date_in_last_days", O, "order.placed", "in_last_days", 90, f"o_orderdate >= {NEW}"),
    ("date_not_in_last_days", O, "order.shipped", "not_in_last_days", 400,
     f"shipped IS NOT NULL AND shipped < {OLD}"),
    ("date_is_null", O, "order.shipped", "is_null", None, "shipped IS NULL"),
    ("date_is_not_null", O, "order.shipped", "is_not_null", None, "shipped IS NOT NULL"),
    ("str_eq", P, "part.name", "eq", "RED Bolt", "lower(p_name) = 'red bolt'"),
    ("str_ne", O, "order.mark", "ne", "mark R", "last_flag IS NOT NULL AND last_flag <> 'R'"),
    ("str_contains", P, "part.name", "contains", "GE", "contains(lower(p_name), 'ge')"),
    ("str_not_contains", P, "part.name", "not_contains", "g",
     "NOT contains(lower(p_name), 'g')"),
    ("str_starts_with", P, "part.name", "starts_with", "Small",
     "starts_with(lower(p_name), 'small')"),
    ("str_ends_with", P, "part.name", "ends_with", "ANVIL",
     "ends_with(lower(p_name), 'anvil')"),
    ("str_in", P, "part.brand", "in", ["brand#2", "BRAND#17"],
     "lower(p_brand) IN ('brand#2', 'brand#17')"),
    ("str_not_in", O, "order.mark", "not_in", ["mark R", "MARK A"],
     "last_flag IS NOT NULL AND last_flag NOT IN ('R', 'A')"),
    ("str_is_null", O, "order.mark", "is_null", None, "last_flag IS NULL"),
    ("str_is_not_null", O, "order.mark", "is_not_null", None, "last_flag IS NOT NULL"),
    ("enum_eq", O, "order.status", "eq", "p", "o_orderstatus = 'P'"),
    ("enum_ne", O, "order.last_flag", "ne", "R", "last_flag IS NOT NULL AND last_flag <> 'R'"),
    ("enum_in", P, "part.type", "in", ["promo", "LARGE"], "p_type IN ('PROMO', 'LARGE')"),
    ("enum_not_in", O, "order.last_flag", "not_in", ["R", "A"],
     "last_flag IS NOT NULL AND last_flag NOT IN ('R', 'A')"),
    ("enum_is_null", O, "order.last_flag", "is_null", None, "last_flag IS NULL"),
    ("enum_is_not_null", O, "order.last_flag", "is_not_null", None, "last_flag IS NOT NULL"),
    ("bool_is_true", D, "label.toxic", "is_true", None, "toxic = 1"),
    ("bool_is_false", D, "label.toxic", "is_false", None, "toxic IS NOT NULL AND toxic <> 1"),
    ("bool_is_null", D, "label.toxic", "is_null", None, "toxic IS NULL"),
    ("bool_is_not_null", D, "label.toxic", "is_not_null", None, "toxic IS NOT NULL"),
    ("list_contains", O, "order.flags", "contains", "r", _list("list_contains(flags, 'R')")),
    ("list_not_contains", O, "order.flags", "not_contains", "R",
     _list("NOT list_contains(flags, 'R')")),
    ("list_contains_any", O, "order.big_flags", "contains_any", ["a", "N"],
     _big("(list_contains(big_flags, 'A') OR list_contains(big_flags, 'N'))")),
    ("list_contains_all", O, "order.flags", "contains_all", ["a", "N", "A"],
     _list("(list_contains(flags, 'A') AND list_contains(flags, 'N'))")),
    ("list_length_gte", O, "order.flags", "length_gte", 2.9, _list("len(flags) >= 2")),
    ("list_length_lte", O, "order.big_flags", "length_lte", 1, _big("len(big_flags) <= 1")),
    ("list_is_empty", O, "order.big_flags", "is_empty", None, _big("len(big_flags) = 0")),
    ("list_is_not_empty", O, "order.big_flags", "is_not_empty", None, _big("len(big_flags) > 0")),
]


def _register(name, fixture, key, op, value, where):
    frame, source, id_column = fixture

    @query(name, f"SELECT {id_column} AS item_id FROM {source} WHERE {where}")
    def run(spark, sf):
        test = emit(t.REGISTRY.require(key), op, value, now=t.ORDERS_NOW)
        return frame(spark, sf).filter(test).select("item_id")


for case in CASES:
    _register(*case)
