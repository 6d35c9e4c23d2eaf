"""The given tables in the roles of the library: items with sparse facts, children, history."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.registry import Registry
from factloom.functions.scalars import seconds
from factloom.functions.spec import date, enum, flag, measure, text, words
from factloom.operators.providers import Provider


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def at(iso: str) -> int:
    return int(datetime.fromisoformat(iso).replace(tzinfo=timezone.utc).timestamp())


# The clocks that stand for "now".
ORDERS_NOW = at("1998-08-02")
EVENTS_NOW = at("2024-01-31")


class Parts(Provider):
    id = "parts"
    applies_to = ("part",)
    facts = (
        measure("part.size"), measure("part.price"), text("part.name"), text("part.brand"),
        enum("part.type", "STANDARD", "PROMO", "LARGE", "SMALL", "ECONOMY", "MEDIUM"),
    )


class Lines(Provider):
    id = "lines"
    applies_to = ("line",)
    facts = (measure("line.price"), measure("line.quantity"), measure("line.discount"))


class Documents(Provider):
    id = "documents"
    applies_to = ("document",)
    facts = (measure("doc.chars"), enum("doc.lang", "en", "fr", "de", "es", folded=True),
             text("doc.source"))


class Labels(Provider):
    id = "labels"
    applies_to = ("document",)
    facts = (measure("label.quality"), flag("label.toxic"))


class Orders(Provider):
    id = "orders"
    applies_to = ("order",)
    facts = (
        measure("order.price"), date("order.placed"), date("order.shipped"),
        enum("order.status", "P", "F", "O"), enum("order.last_flag", "A", "N", "R"),
        text("order.priority"), text("order.mark"), words("order.flags"), words("order.big_flags"),
    )


REGISTRY = Registry([Parts(), Lines(), Documents(), Labels(), Orders()])


def _catalogue_columns(item_type, key, title, library, size, year=None, added=None):
    nothing = F.lit(None)
    return [
        key.alias("item_id"), key.cast("string").alias("rating_key"),
        F.lit(item_type).alias("item_type"), library.alias("library_key"),
        title.alias("title"), title.alias("sort_title"),
        (nothing if year is None else year).cast("int").alias("year"),
        (nothing if added is None else added).cast("bigint").alias("added_at"),
        size.cast("bigint").alias("file_size"), nothing.cast("bigint").alias("deleted_at"),
    ]


def parts(spark, sf) -> DataFrame:
    """Dense facts."""
    t = table(spark, sf, "part")
    return t.select(
        *_catalogue_columns("part", F.col("p_partkey"), F.col("p_name"), F.col("p_brand"),
                            F.col("p_size")),
        F.struct(
            F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"),
            F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
            F.col("p_type").alias("type"),
        ).alias("part"))


def lines(spark, sf) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.select(
        *_catalogue_columns("line", F.col("l_orderkey"), F.col("l_returnflag"),
                            F.col("l_linestatus"), F.col("l_quantity")),
        "l_partkey", "l_suppkey", "l_linenumber",
        F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
                 F.col("l_discount").alias("discount")).alias("line"))


def documents(spark, sf) -> DataFrame:
    """Sparse facts: labels cover only some of the documents."""
    t = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return t.select(
        *_catalogue_columns("document", F.col("doc_id"), F.col("text"), F.col("source"),
                            F.col("n_chars")),
        F.col("lang"),
        F.struct(F.col("n_chars").cast("double").alias("chars"), F.col("lang"),
                 F.col("source")).alias("doc"),
        F.struct(F.col("quality").cast("double").alias("quality"),
                 (F.col("toxic") == 1).alias("toxic")).alias("label"))


def orders(spark, sf) -> DataFrame:
    """List and date facts: orders without lines have unknown flags, some have empty ones."""
    ship = table(spark, sf, "lineitem")
    per_order = ship.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("flags"),
        F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 45, F.col("l_returnflag"))))
        .alias("big_flags"),
        F.max("l_returnflag").alias("last_flag"),
        F.max(seconds(ship, "l_shipdate")).alias("shipped"),
    )
    t = table(spark, sf, "orders")
    placed = seconds(t, "o_orderdate")
    return t.join(per_order, "o_orderkey", "left").select(
        *_catalogue_columns("order", F.col("o_orderkey"), F.col("o_orderpriority"),
                            F.col("o_orderstatus"), F.col("o_totalprice"),
                            F.year("o_orderdate"), placed),
        F.struct(
            F.col("o_totalprice").alias("price"), placed.alias("placed"), F.col("shipped"),
            F.col("o_orderstatus").alias("status"), F.col("last_flag"),
            F.col("o_orderpriority").alias("priority"),
            F.concat(F.lit("Mark "), "last_flag").alias("mark"), F.col("flags"), F.col("big_flags"),
        ).alias("order"))


# SQL for the same frames.
DOCS_SQL = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"
ORDERS_SQL = """(
    SELECT o.*, flags, big_flags, last_flag, shipped FROM orders o LEFT JOIN (
        SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags,
               coalesce(list_sort(list(DISTINCT l_returnflag) FILTER (WHERE l_quantity > 45)), [])
                   AS big_flags,
               max(l_returnflag) AS last_flag, max(l_shipdate) AS shipped
        FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""


def history(spark, sf) -> DataFrame:
    """Events as history rows of customers: the user is ``props.k``, a purchase completes."""
    t = table(spark, sf, "events")
    return t.select(
        F.col("user_id").cast("string").alias("rating_key"),
        seconds(t, "ts").alias("date"), F.lit(None).cast("bigint").alias("stopped"),
        F.get_json_object("props", "$.k").alias("user"),
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("watched_status"))


def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        *_catalogue_columns("movie", F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"),
                            F.col("c_nationkey")))
