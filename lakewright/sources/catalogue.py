"""Objects that queries can name: tables, fields, lookups and child relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lookup:
    """A field that holds the id of one of several objects. With several, the
    type field tells which."""

    field: str
    targets: tuple[str, ...]
    type_field: str | None = None


@dataclass
class Entity:
    name: str
    load: Callable[[], DataFrame]
    id_fields: tuple[str, ...]
    lookups: dict[str, Lookup] = field(default_factory=dict)
    children: dict[str, tuple[str, str]] = field(default_factory=dict)  # relation -> (object, its lookup field)
    custom: frozenset[str] = frozenset()
    search: dict[str, tuple[str, ...]] = field(default_factory=dict)  # scope -> text fields
    deleted: str | None = None  # a flag whose rows only ALL ROWS shows
    scopes: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)


class Catalogue:
    """Case-insensitive names of objects; relationship names end in __r or not."""

    def __init__(self, entities: list[Entity]):
        self.entities = {e.name.lower(): e for e in entities}
        self._frames: dict[str, DataFrame] = {}

    def get(self, name: str) -> Entity | None:
        return self.entities.get(name.lower())

    def frame(self, e: Entity) -> DataFrame:
        if e.name not in self._frames:
            self._frames[e.name] = e.load()
        return self._frames[e.name]

    @staticmethod
    def field(columns: list[str], name: str) -> str | None:
        low = name.lower()
        return next((c for c in columns if c.lower() == low), None)

    @staticmethod
    def lookup(e: Entity, name: str) -> Lookup | None:
        """The lookup behind a relationship name: X__r, or X where XId is one."""
        low = name.lower()
        for k, v in e.lookups.items():
            if k.lower() == low or not low.endswith("__r") and v.field.lower() == low + "id":
                return v
        return None

    @staticmethod
    def child(e: Entity, name: str) -> tuple[str, str] | None:
        low = name.lower()
        return next((v for k, v in e.children.items() if k.lower() == low or k.lower() == low.removesuffix("__r")), None)


def star_schema(spark: SparkSession, sf_dir: str) -> Catalogue:
    """The catalogue over the test tables. Money is DECIMAL(18,2), so that sums
    do not depend on the order of rows."""

    def load(name: str, money: tuple[str, ...] = (), more: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            for c in money:
                df = df.withColumn(c, F.col(c).cast("decimal(18,2)"))
            return more(df)

        return run

    def activity(df: DataFrame) -> DataFrame:
        what = F.when(F.col("event_id") % 3 == 0, "Customer").when(F.col("event_id") % 3 == 1, "Supplier").otherwise("Part")
        df = df.withColumn("note", F.when(F.col("event_id") % 4 != 0, F.col("event_type")))
        return df.withColumn("what_type", what).withColumn("tags", F.concat_ws(";", F.col("event_type"), F.when(F.col("value") > 50, "high").otherwise("low")))

    n = {"Nation__r": Lookup("nationkey", ("Nation",))}
    return Catalogue([
        Entity("Region", load("region"), ("r_regionkey",), children={"Nations": ("Nation", "n_regionkey")}, search={"name": ("r_name",), "all": ("r_name",)}),
        Entity("Nation", load("nation"), ("n_nationkey",), {"Region__r": Lookup("n_regionkey", ("Region",))}, {"Customers": ("Customer", "c_nationkey"), "Suppliers": ("Supplier", "s_nationkey")}, search={"name": ("n_name",), "all": ("n_name",)}),
        Entity("Customer", load("customer", ("c_acctbal",)), ("c_custkey",), {"Nation__r": Lookup("c_nationkey", n["Nation__r"].targets)}, {"Orders": ("Orders", "o_custkey")}, frozenset({"c_mktsegment"}), {"name": ("c_name",), "all": ("c_name", "c_mktsegment")}),
        Entity("Supplier", load("supplier", ("s_acctbal",)), ("s_suppkey",), {"Nation__r": Lookup("s_nationkey", ("Nation",))}, {"Lineitems": ("Lineitem", "l_suppkey")}, search={"name": ("s_name",), "all": ("s_name",)}),
        Entity("Part", load("part", ("p_retailprice",)), ("p_partkey",), children={"Lineitems": ("Lineitem", "l_partkey")}, search={"name": ("p_name",), "all": ("p_name", "p_brand", "p_type")}),
        Entity("Orders", load("orders", ("o_totalprice",)), ("o_orderkey",), {"Customer__r": Lookup("o_custkey", ("Customer",))}, {"Lineitems": ("Lineitem", "l_orderkey")}),
        Entity("Lineitem", load("lineitem", ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), ("l_orderkey", "l_linenumber"), {"Orders__r": Lookup("l_orderkey", ("Orders",)), "Part__r": Lookup("l_partkey", ("Part",)), "Supplier__r": Lookup("l_suppkey", ("Supplier",))}),
        Entity("Event", load("events", ("value",), activity), ("event_id",), {"What": Lookup("user_id", ("Customer", "Supplier", "Part"), "what_type")}),
        Entity("Document", load("documents"), ("doc_id",), children={"Labels": ("Label", "doc_id")}, search={"name": ("source",), "all": ("text", "source")}),
        Entity("Label", load("labels"), ("doc_id",), {"Document__r": Lookup("doc_id", ("Document",))}),
        Entity("Page", load("pages"), ("page_id",), search={"name": ("url",), "all": ("url", "html")}),
        Entity("Conversation", load("conversations"), ("conv_id", "turn"), search={"all": ("text",), "name": ("role",)}),
        Entity("Benchmark", load("benchmark"), ("item_id",), search={"all": ("text",)}),
        Entity("Embedding", load("embeddings"), ("vec_id",)),
    ])
