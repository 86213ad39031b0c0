"""The given tables read as code facts.

No table holds program text, so each one stands for a fact relation: customers
are files, orders are functions and classes inside them, line items are imports,
calls and attribute uses, nations are layers and regions their tiers. Every row
of a table takes part, in a role that one of its own columns decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import cut_lineage


class Facts:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.root = spark, sf_dir
        self._edges: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def customers(self) -> DataFrame:
        layer = F.concat(F.lit("n"), F.col("c_nationkey"))
        leaf = F.concat(F.lit("c"), F.col("c_custkey"))
        return self.table("customer").select(
            "c_custkey", "c_nationkey", "c_acctbal",
            F.concat(F.lit("app/"), layer, F.lit("/"), leaf, F.lit(".py")).alias("filepath"),
            F.concat(F.lit("app."), layer, F.lit("."), leaf).alias("module"),
        )

    def orders(self) -> DataFrame:
        return self.table("orders").join(self.customers(), F.col("o_custkey") == F.col("c_custkey"))

    def blocks(self) -> DataFrame:
        """Complexity blocks: open and filled orders, one function each."""
        cc = complexity_of(F.col("o_totalprice"))
        return self.orders().where(F.col("o_orderstatus").isin("O", "F")).select(
            "filepath", F.concat(F.lit("f"), F.col("o_orderkey")).alias("name"),
            F.when(F.col("o_orderpriority") == "5-LOW", "function").otherwise("method").alias("type"),
            cc.alias("complexity"), complexity_rank(cc).alias("rank"), F.col("o_orderkey").alias("lineno"),
        )

    def cohesion_rows(self) -> DataFrame:
        """Class rows: pending orders. The priority digit is the score."""
        digit = F.substring("o_orderpriority", 1, 1).cast("int")
        return self.orders().where(F.col("o_orderstatus") == "P").select(
            "filepath", F.concat(F.lit("K"), F.col("o_orderkey")).alias("name"), F.col("o_orderkey").alias("lineno"),
            F.when(digit == 4, "interface").otherwise("concrete").alias("class_kind"),
            digit.cast("double").alias("cohesion_score"), F.lit(1.0).alias("cohesion_score_norm"),
            digit.cast("long").alias("methods_count"), (digit == 4).alias("excluded_from_aggregation"),
        )

    def mi_files(self) -> DataFrame:
        mi = F.floor((F.col("c_acctbal") + 1000.0) / 1.1).cast("double") / 100.0
        return self.customers().select("filepath", mi.alias("mi"), mi_rank(mi).alias("rank"))

    def layers(self) -> DataFrame:
        return self.table("nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("layer"), "n_nationkey", "n_regionkey")

    def prefixes(self) -> DataFrame:
        return self.layers().select("layer", F.concat(F.lit("app."), F.col("layer")).alias("prefix"), F.col("n_nationkey").alias("ord"))

    def tiers(self) -> DataFrame:
        return self.layers().select("layer", F.col("n_regionkey").alias("tier"))

    def interfaces(self) -> DataFrame:
        return self.tiers().where("tier = 2").select("layer")

    def exceptions(self) -> DataFrame:
        """Allowed pairs: each layer may depend on layer ``n0``."""
        return self.layers().select(F.col("layer").alias("source"), F.lit("n0").alias("target"))

    def import_rows(self) -> DataFrame:
        """Line items with the nation, region and key of both ends."""
        region = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("s_region"))
        home = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("c_region"))
        items = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
        return (
            items.join(self.table("supplier").join(region, "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("customer").join(home, "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        )

    def imports(self) -> DataFrame:
        """Module imports: low-priority orders import from a test folder, indebted suppliers are outside packages."""
        cust = F.concat(F.lit("n"), F.col("c_nationkey"), F.lit(".c"), F.col("c_custkey"))
        importer = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("app.tests."), cust)).otherwise(F.concat(F.lit("app."), cust))
        inside = F.concat(F.lit("app.n"), F.col("s_nationkey"), F.lit(".s"), F.col("s_suppkey"))
        outside = F.concat(F.lit("ext"), F.col("s_region"), F.lit(".pkg.s"), F.col("s_suppkey"))
        return self.import_rows().select(importer.alias("importer"), F.when(F.col("s_acctbal") < 0, outside).otherwise(inside).alias("imported"))

    def module_imports(self) -> DataFrame:
        """A module graph in which layers reach each other through library modules.

        Customers import parts or, rarely, suppliers; parts import adapters of suppliers; some
        adapters import their supplier; suppliers import outside packages.
        """
        cust = F.concat(F.lit("app.n"), F.col("c_nationkey"), F.lit(".c"), F.col("c_custkey"))
        supp = F.concat(F.lit("app.n"), F.col("s_nationkey"), F.lit(".s"), F.col("s_suppkey"))
        part_, adapter = F.concat(F.lit("lib.p"), F.col("l_partkey")), F.concat(F.lit("lib.q"), F.col("s_suppkey"))
        outside = F.concat(F.lit("ext"), F.col("s_region"))
        returned, line = F.col("l_returnflag"), F.col("l_linenumber")
        link = lambda a, b: F.struct(a.alias("importer"), b.alias("imported"))
        ends = (
            F.when((returned == "R") & (line == 7), link(cust, supp)).when(returned == "R", link(cust, part_)).when(returned == "A", link(part_, adapter))
            .when((line == 1) & (F.col("s_suppkey") % 3 == 0), link(adapter, supp)).otherwise(link(supp, outside))
        )
        return self.import_rows().select(ends.alias("e")).select("e.importer", "e.imported").distinct()

    def externals(self) -> DataFrame:
        name = F.concat(F.lit("ext"), F.col("r_regionkey"))
        return self.table("region").select(name.alias("layer"), name.alias("prefix"), F.col("r_regionkey").alias("ord"))

    def edges(self) -> DataFrame:
        """Layer edges: a nation imports from those it buys more from than it sells to."""
        if self._edges is not None:
            return self._edges
        pairs = self.import_rows().where(F.col("c_nationkey") != F.col("s_nationkey")).groupBy("c_nationkey", "s_nationkey").agg(
            F.count(F.lit(1)).alias("n")
        )
        # A few hundred pairs of nations: written once, so no rule repeats the joins behind them.
        pairs = cut_lineage(pairs.toDF("a", "b", "n"))
        back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("returned"))
        found = pairs.join(back, ["a", "b"], "left").where(F.col("n") > F.coalesce("returned", F.lit(0)))
        self._edges = cut_lineage(found.select(F.concat(F.lit("n"), "a").alias("source"), F.concat(F.lit("n"), "b").alias("target")))
        return self._edges

    def contract_rows(self) -> DataFrame:
        """Broken imports: returned items bought inside one region."""
        return self.import_rows().where((F.col("l_returnflag") == "R") & (F.col("c_region") == F.col("s_region"))).select(
            F.concat(F.lit("app.n"), F.col("c_nationkey"), F.lit(".c"), F.col("c_custkey")).alias("importer"),
            F.concat(F.lit("app.n"), F.col("s_nationkey"), F.lit(".s"), F.col("s_suppkey")).alias("imported"),
            F.col("o_orderpriority").alias("contract_name"), F.col("l_orderkey").alias("seq"),
        )

    def dead_names(self) -> DataFrame:
        """Qualified names of orders without items, in one to five parts by priority."""
        empty = self.orders().join(self.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti")
        key = F.col("o_orderkey").cast("string")
        digit = F.substring("o_orderpriority", 1, 1)
        name = (
            F.when(digit == "1", F.concat(F.lit("f"), key))
            .when(digit == "2", F.concat(F.lit("app.f"), key))
            .when(digit == "3", F.concat(F.col("module"), F.lit(".K"), key, F.lit(".run")))
            .otherwise(F.concat(F.col("module"), F.lit(".f"), key))
        )
        return empty.select(name.alias("name"))

    def calls(self) -> DataFrame:
        """Call edges with their copies: order to supplier."""
        return self.table("lineitem").select(
            "l_orderkey", F.concat(F.lit("o"), F.col("l_orderkey")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target")
        )

    def call_nodes(self) -> DataFrame:
        return self.table("orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("name")).union(
            self.table("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")))
        )

    def colliding_calls(self) -> DataFrame:
        """Orders that use one supplier more than once."""
        return self.calls().groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            F.col("source").alias("block")
        ).distinct()

    def call_lines(self) -> DataFrame:
        """Call-graph text: one file per order priority, one block per order, one line per item.

        Some headers are tool chatter or no valid name, some items repeat the block's own name.
        """
        head = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("WARNING: o"), F.col("o_orderkey"))).when(
            F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("o-"), F.col("o_orderkey"))
        ).otherwise(F.concat(F.lit("pkg.o"), F.col("o_orderkey")))
        heads = self.table("orders").select(F.substring("o_orderpriority", 3, 20).alias("file"), (F.col("o_orderkey") * 16).alias("pos"), head.alias("text"))
        target = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("pkg.o"), F.col("l_orderkey"))).otherwise(
            F.concat(F.lit("pkg.s"), F.col("l_suppkey"))
        )
        items = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.substring("o_orderpriority", 3, 20).alias("file"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("pos"),
            F.concat(F.lit("  [U] "), target).alias("text"),
        )
        return heads.unionByName(items).withColumn("slice", F.floor(F.col("pos") / 65536))

    def contract_lines(self) -> DataFrame:
        """Contract text: one file per order status, broken and kept contracts by priority, one import per item."""
        verdict = F.when(F.col("o_orderpriority") == "5-LOW", " KEPT").otherwise(" BROKEN")
        heads = self.table("orders").select(
            F.col("o_orderstatus").alias("file"), (F.col("o_orderkey") * 16).alias("pos"),
            F.concat(F.lit("\u001b[1mContract "), F.col("o_orderkey"), verdict, F.lit("\u001b[0m")).alias("text"),
        )
        tail = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" (l."), F.col("l_linenumber"), F.lit(")"))).otherwise("")
        mark = F.when(F.col("l_returnflag") == "R", "-   ").otherwise("")
        items = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_orderstatus").alias("file"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("pos"),
            F.concat(F.lit("    "), mark, F.lit("app.o"), F.col("l_orderkey"), F.lit(" -> app.s"), F.col("l_suppkey"), tail).alias("text"),
        )
        return heads.unionByName(items).withColumn("slice", F.floor(F.col("pos") / 65536))


def complexity_of(price: Column) -> Column:
    return F.floor(price / 25000.0) + 1


def complexity_rank(cc: Column) -> Column:
    return (
        F.when(cc <= 5, "A").when(cc <= 10, "B").when(cc <= 20, "C").when(cc <= 30, "D").when(cc <= 40, "E").otherwise("F")
    )


def mi_rank(mi: Column) -> Column:
    return F.when(mi > 19, "A").when(mi > 9, "B").otherwise("C")
