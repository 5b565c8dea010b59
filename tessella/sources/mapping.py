"""The graph over the sales, event and conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import PropertyGraph


#: Bits of the second part of a paired key; a table where it takes more is refused as it is read.
PAIR_BITS = 16


def paired(high: str, low: str) -> Column:
    """One number of two; never two pairs with one number."""
    fits = F.col(low).between(0, (1 << PAIR_BITS) - 1)
    return F.col(high).cast("long") * (1 << PAIR_BITS) + F.when(fits, F.col(low)).otherwise(F.raise_error(F.concat(F.lit(f"{low} beyond {PAIR_BITS} bits: "), F.col(low).cast("string"))).cast("long"))


_KNOWN: dict[tuple, PropertyGraph] = {}


def sales_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The catalog of one folder's tables, made once a session; updates make graphs of their own."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = _sales_graph(spark, sf_dir)
    return _KNOWN[key]


def _sales_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    g = PropertyGraph(spark)
    region, nation, customer, supplier, part, orders, lineitem, events, talks = map(read, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations"))
    g.add_nodes("Region", region, "r_regionkey").add_nodes("Nation", nation, "n_nationkey").add_nodes("Customer", customer, "c_custkey", ("Party",)).add_nodes("Supplier", supplier, "s_suppkey", ("Party",))
    g.add_nodes("Part", part, "p_partkey").add_nodes("Order", orders, "o_orderkey")
    g.add_nodes("User", events.select("user_id").distinct(), "user_id").add_nodes("Event", events, "event_id")
    turn = paired("conv_id", "turn")
    g.add_nodes("Turn", talks, turn)
    g.add_rels("IN_REGION", nation, ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey", holds="src")
    g.add_rels("LIVES_IN", customer, ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "c_custkey", holds="src")
    g.add_rels("BASED_IN", supplier, ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "s_suppkey", holds="src")
    g.add_rels("PLACED", orders, ("Customer", "o_custkey"), ("Order", "o_orderkey"), "o_orderkey", holds="dst")
    line = paired("l_orderkey", "l_linenumber")
    g.add_rels("CONTAINS", lineitem, ("Order", "l_orderkey"), ("Part", "l_partkey"), line, ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    g.add_rels("SHIPPED", lineitem, ("Supplier", "l_suppkey"), ("Part", "l_partkey"), line, ("l_orderkey", "l_linenumber", "l_quantity"))
    g.add_rels("DID", events, ("User", "user_id"), ("Event", "event_id"), "event_id", holds="dst")
    following = events.select("event_id", F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_id")).where("next_id IS NOT NULL")
    g.add_rels("NEXT", following, ("Event", "event_id"), ("Event", "next_id"), "event_id", derived=True)
    after = talks.select("conv_id", "turn", F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn")).alias("t2")).where("t2 = turn + 1")
    g.add_rels("REPLY", after, ("Turn", turn), ("Turn", paired("conv_id", "t2")), turn, derived=True)
    return g
