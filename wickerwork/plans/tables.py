"""The analytics tables, read off a folder of order, event and text tables.

A basket is an order (or all a customer bought), an item a part name, the leader the customer's segment, an entry an
order placed in the event of its day, a price the last event value of a user, type and day. ``CTES`` holds the same
bindings as SQL, so a query and its SQL start from the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.functions.numeric import half_even
from wickerwork.session import cut_lineage

#: The day after the last order: the day every look-back counts from.
TODAY = "2001-08-02"
LAST_EVENT_DAY = "2024-01-31"
#: Order lines that a task has about, once that takes more tasks than shuffles have.
LINES_A_TASK = 500_000


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._once: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that one plan reads many times: made and written once, read from there."""
        if name not in self._once:
            self._once[name] = cut_lineage(make(), name)
        return self._once[name]

    # ---- baskets ------------------------------------------------------------------------------------------
    @cached_property
    def line_tasks(self) -> int:
        """How many tasks order lines are dealt over: as many as shuffles have, more for a large table. Files know their rows."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.read("lineitem").count() // LINES_A_TASK))

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows as many as order lines, dealt by keys where shuffles have too few tasks; what is grouped by more keys stays there."""
        n = self.line_tasks
        return rows if n == int(self.spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(n, *keys)

    @cached_property
    def lines(self) -> DataFrame:
        """One row per order line, with its part's name and price and its order's leader."""
        part = self.read("part").select("p_partkey", F.col("p_name").alias("item"), "p_retailprice", "p_type", "p_brand", "p_size")
        sold = self.dealt(self.read("lineitem").withColumnRenamed("l_orderkey", "basket"), "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
        return self.dealt(sold, "basket").join(self.baskets.select("basket", "leader", "customer", "made"), "basket")

    @cached_property
    def baskets(self) -> DataFrame:
        customer = self.read("customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("leader"),
                                                F.col("c_nationkey").cast("long").alias("nation"), F.col("c_name").alias("customer_name"))
        orders = self.read("orders").select(
            F.col("o_orderkey").alias("basket"), F.col("o_custkey").alias("customer"),
            F.to_date("o_orderdate").alias("made"), F.substring("o_orderpriority", 1, 1).cast("long").alias("bracket"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
        return orders.join(customer, "customer")

    @cached_property
    def basket_items(self) -> DataFrame:
        """leader, basket, item, copies"""
        return self.lines.groupBy("leader", "basket", "item").agg(F.sum("l_quantity").cast("long").alias("copies"))

    @cached_property
    def customer_items(self) -> DataFrame:
        """The denser baskets: all a customer bought."""
        return self.lines.select("leader", F.col("customer").alias("basket"), "item").distinct()

    @cached_property
    def customer_baskets(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("basket"), F.col("c_mktsegment").alias("leader"),
                                            F.col("c_name").alias("name"))

    @cached_property
    def items(self) -> DataFrame:
        """One row per part name: cheapest price in cents, the type of its cheapest part as its kind."""
        part = self.read("part")
        return part.groupBy(F.col("p_name").alias("item")).agg(
            half_even(F.min("p_retailprice") * 100).cast("long").alias("cents"),
            F.min_by("p_type", F.struct("p_retailprice", "p_partkey")).alias("kind"),
            F.min_by("p_size", F.struct("p_retailprice", "p_partkey")).cast("long").alias("value"),
            F.min_by("p_brand", F.struct("p_retailprice", "p_partkey")).alias("brand"))

    @cached_property
    def item_tags(self) -> DataFrame:
        """Tags of an item: the words of its name, and the types its parts come in."""
        part = self.read("part").select(F.col("p_name").alias("item"), "p_type").distinct()
        words = part.select("item", F.explode(F.split("item", " ")).alias("tag"))
        kinds = part.select("item", F.lower("p_type").alias("tag"))
        return words.unionByName(kinds).distinct()

    # ---- outcomes -----------------------------------------------------------------------------------------
    @cached_property
    def entries(self) -> DataFrame:
        """event, entry, leader, player, date, size, top_cut, standing, games, wins, draws"""
        tally = self.dealt(self.read("lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey").groupBy(F.col("l_orderkey").alias("entry")).agg(
            F.count(F.lit(1)).alias("games"),
            F.sum((F.col("l_returnflag") == "R").cast("long")).alias("wins"),
            F.sum((F.col("l_returnflag") == "N").cast("long")).alias("draws"))
        day = W.partitionBy("date")
        placed = self.baskets.select(
            F.col("basket").alias("entry"), "leader", "nation", F.col("customer").alias("player"),
            F.col("customer_name").alias("player_name"), F.col("made").alias("date"), "total")
        size = F.count(F.lit(1)).over(day)
        return (placed.withColumn("size", size)
                .withColumn("standing", F.row_number().over(day.orderBy(F.desc("total"), "entry")).cast("long"))
                .withColumn("top_cut", F.when(F.col("size") >= 4, F.floor(F.col("size") / 2)).otherwise(F.lit(0)))
                .join(tally, "entry").drop("total"))

    @cached_property
    def entry_items(self) -> DataFrame:
        return self.lines.select(F.col("basket").alias("entry"), "item").distinct()

    # ---- prices -------------------------------------------------------------------------------------------
    @cached_property
    def observed(self) -> DataFrame:
        """variant, finish, day, cents: the last value of a user, type and day."""
        day = F.to_date("ts").alias("day")
        return (self.read("events").groupBy(F.col("user_id").alias("variant"), F.col("event_type").alias("finish"), day)
                .agg(half_even(F.max_by("value", F.struct("ts", "event_id")) * 100).cast("long").alias("cents")))

    @cached_property
    def shipped(self) -> DataFrame:
        """The longer price table: variant, item, set, finish, day, cents, the cheapest line of a part and day."""
        sold = self.read("lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("variant"), "l_shipdate", "l_extendedprice", "l_quantity")
        sold = self.dealt(sold, "basket").join(self.baskets.select("basket"), "basket")
        part = self.read("part").select(F.col("p_partkey").alias("variant"), F.col("p_name").alias("item"), F.col("p_brand").alias("set"))
        # lines are dealt by part last and stay there: series are joined to themselves, summed and named in the same tasks
        return (self.dealt(sold.drop("basket"), "variant").groupBy("variant", F.to_date("l_shipdate").alias("day"))
                .agg(half_even(F.min(F.col("l_extendedprice") / F.col("l_quantity")) * 100).cast("long").alias("cents"))
                .join(part, "variant").select("variant", "item", "set", "day", "cents"))

    # ---- text ---------------------------------------------------------------------------------------------
    @cached_property
    def basket_text(self) -> DataFrame:
        """One text per basket: the names of its items, in order, as a typed query would say them."""
        return (self.basket_items.groupBy(F.col("basket").alias("query"))
                .agg(F.array_join(F.array_sort(F.collect_set("item")), " ").alias("text")))


CTES: dict[str, tuple[list[str], str]] = {
    "bk": ([], """SELECT o_orderkey AS basket, o_custkey AS customer, CAST(o_orderdate AS DATE) AS made,
        CAST(substr(o_orderpriority,1,1) AS BIGINT) AS bracket, o_orderstatus AS status, o_totalprice AS total,
        c_mktsegment AS leader, CAST(c_nationkey AS BIGINT) AS nation, c_name AS customer_name
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "ln": (["bk"], """SELECT bk.basket, bk.leader, bk.customer, bk.made, p_name AS item, lineitem.*, part.*
        FROM lineitem JOIN bk ON l_orderkey = bk.basket JOIN part ON l_partkey = p_partkey"""),
    "bi": (["ln"], """SELECT leader, basket, item, CAST(sum(l_quantity) AS BIGINT) AS copies FROM ln GROUP BY ALL"""),
    "ci": (["ln"], """SELECT DISTINCT leader, customer AS basket, item FROM ln"""),
    "it": ([], """SELECT p_name AS item, CAST(round_even(min(p_retailprice)*100, 0) AS BIGINT) AS cents,
        arg_min(p_type, p_retailprice*1e6+p_partkey/1e6) AS kind,
        CAST(arg_min(p_size, p_retailprice*1e6+p_partkey/1e6) AS BIGINT) AS value,
        arg_min(p_brand, p_retailprice*1e6+p_partkey/1e6) AS brand FROM part GROUP BY p_name"""),
    "tg": ([], """SELECT DISTINCT p_name AS item, unnest(string_split(p_name, ' ')) AS tag FROM part
        UNION SELECT DISTINCT p_name, lower(p_type) FROM part"""),
    "pl": (["bi"], "SELECT leader, item, count(*) AS plays FROM bi GROUP BY ALL"),
    "sz": (["bk"], "SELECT leader, count(*) AS n FROM bk GROUP BY ALL"),
    "en": (["bk"], """SELECT e.*, CASE WHEN size >= 4 THEN size // 2 ELSE 0 END AS top_cut, games, wins, draws FROM (
        SELECT basket AS entry, leader, nation, customer AS player, customer_name AS player_name, made AS date,
        count(*) OVER (PARTITION BY made) AS size,
        row_number() OVER (PARTITION BY made ORDER BY total DESC, basket) AS standing FROM bk) e
        JOIN (SELECT l_orderkey, count(*) AS games, CAST(count(*) FILTER (l_returnflag='R') AS BIGINT) AS wins,
        CAST(count(*) FILTER (l_returnflag='N') AS BIGINT) AS draws FROM lineitem GROUP BY 1) t ON e.entry = t.l_orderkey"""),
    "ei": (["ln"], "SELECT DISTINCT basket AS entry, item FROM ln"),
    "ob": ([], """SELECT user_id AS variant, event_type AS finish, CAST(ts AS DATE) AS day,
        CAST(round_even(last(value ORDER BY ts, event_id)*100, 0) AS BIGINT) AS cents FROM events GROUP BY ALL"""),
    "sh": (["ln"], """SELECT l_partkey AS variant, item, p_brand AS set, CAST(l_shipdate AS DATE) AS day,
        CAST(round_even(min(l_extendedprice/l_quantity)*100, 0) AS BIGINT) AS cents FROM ln GROUP BY ALL"""),
    "bt": (["bi"], "SELECT basket AS query, string_agg(item, ' ' ORDER BY item) AS text FROM bi GROUP BY basket"),
}
