"""Paged listings of a market as a Spark data source: a partition is one page of one slice.

A market gives the listings of a category newest first, PAGE to a page, MOST_OFFSET at most; it is a folder
of pages here, which `write_market` makes of a table. A slice asks one category with filters of its own. What
a query filters by is pushed into the requests: the category decides which pages are asked for at all, the
buying option and the price go along - the price with its bounds floored and ceiled to whole units, as
requests take them, so Spark filters by the exact bounds again.

A market may refuse a slice's filters. The partition then spends one more call and asks again without them;
its rows are `degraded` and the slice's own filters are left to the gate. The cut by end of auction is made
on this side in any case, so a refused end filter changes the calls and not the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Listings of a full page, and the last place that a market shows.
PAGE, MOST_OFFSET = 200, 10_000
LISTING = "item_id string, title string, price double, buying_option string, condition_id string, created_ms long, ends_ms long"
SCHEMA = f"slice string, category string, page int, pos int, {LISTING}, degraded boolean, lost_calls int"


def write_market(listings: DataFrame, path: str) -> None:
    """Pages of listings (category and the columns of LISTING) under path, a folder for each category and page.

    Newest first, then by id. A category's window is cut to MOST_OFFSET places before its rows meet.
    """
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.col("created_ms").desc_nulls_last(), "item_id"))
    shown = listings.withColumn("pos", place - 1).filter(F.col("pos") < MOST_OFFSET)
    paged = shown.withColumn("page", F.floor(F.col("pos") / PAGE).cast("int")).withColumn("folder", F.hex("category")).repartition("category", "page")
    paged.sortWithinPartitions("category", "page", "pos").write.partitionBy("folder", "page").parquet(f"{path}/pages")
    paged.groupBy("category").agg(F.count("*").cast("int").alias("shown")).coalesce(1).write.json(f"{path}/sizes")


class Refused(Exception):
    """The market does not take these filters."""


class Market:
    """Requests to a folder of pages. refuses: category -> names of filters that it does not take."""

    def __init__(self, path: str, refuses: dict[str, list[str]]):
        self.files, self.root = arrow_fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        self.refuses = refuses

    def sizes(self) -> dict[str, int]:
        """Listings that each category shows."""
        found = self.files.get_file_info(arrow_fs.FileSelector(f"{self.root}/sizes"))
        lines = [line for f in found if f.base_name.startswith("part-") for line in self.files.open_input_stream(f.path).read().decode().splitlines()]
        return {x["category"]: x["shown"] for x in map(json.loads, lines)}

    def page(self, category: str, page: int, filters: dict) -> pa.Table | None:
        """A page's listings that pass the filters; None where the category has no such page."""
        if named := {*filters} & {*self.refuses.get(category, ())}:
            raise Refused(f"{category}: {sorted(named)}")
        folder = f"{self.root}/pages/folder={category.encode().hex().upper()}/page={page}"
        if self.files.get_file_info(folder).type != arrow_fs.FileType.Directory:
            return None
        parts = [f.path for f in self.files.get_file_info(arrow_fs.FileSelector(folder)) if f.base_name.startswith("part-")]
        out = pa.concat_tables([pq.read_table(f, filesystem=self.files, partitioning=None) for f in sorted(parts)])
        for name, value in filters.items():
            if name == "price_from":
                out = out.filter(pc.greater_equal(out["price"], value))
            elif name == "price_to":
                out = out.filter(pc.less_equal(out["price"], value))
            elif name == "ends_before":
                out = out.filter(pc.less_equal(out["ends_ms"], value))
            else:
                out = out.filter(pc.equal(out[name], value))
        return out


class Page(InputPartition):
    def __init__(self, slice_: dict, page: int):
        super().__init__((slice_["slice"], page))
        self.slice, self.page = slice_, page


class PageReader(DataSourceReader):
    """One request for each planned page.

    Options: path of the market; slices, JSON list of {slice, category, price_from, price_to, condition_id,
    ends_after, ends_before} of which only the first two must be there; budget, pages of a slice at most;
    refuses, JSON object category -> names of filters that the market does not take.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.slices = json.loads(options["slices"])
        self.budget = int(options.get("budget", MOST_OFFSET // PAGE))
        self.refuses = json.loads(options.get("refuses", "{}"))
        self.categories: set[str] | None = None
        self.asked: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        """Take what requests can say; give back what Spark still has to check."""
        for f in filters:
            match f:
                case EqualTo(("category",), value):
                    self._only({value})
                case In(("category",), values):
                    self._only({*values})
                case EqualTo(("buying_option",), value) if "buying_option" not in self.asked:
                    self.asked["buying_option"] = value
                case GreaterThan(("price",), value) | GreaterThanOrEqual(("price",), value):
                    self.asked["price_from"] = max(math.floor(value), self.asked.get("price_from", -math.inf))
                    yield f
                case LessThan(("price",), value) | LessThanOrEqual(("price",), value):
                    self.asked["price_to"] = min(math.ceil(value), self.asked.get("price_to", math.inf))
                    yield f
                case _:
                    yield f

    def _only(self, categories: set) -> None:
        self.categories = categories if self.categories is None else self.categories & categories

    def partitions(self) -> list[Page]:
        """The pages up to the one that is not full, which ends a slice; one request even where there is nothing."""
        sizes, out = Market(self.path, {}).sizes(), []
        for s in self.slices:
            if self.categories is None or s["category"] in self.categories:
                pages = min(self.budget, sizes.get(s["category"], 0) // PAGE + 1, MOST_OFFSET // PAGE)
                out += [Page(s, k) for k in range(pages)]
        return out

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        s, market = partition.slice, Market(self.path, self.refuses)
        own = {}
        for name in ("price_from", "price_to", "condition_id", "ends_before"):
            if s.get(name) is not None:
                own[name] = math.floor(s[name]) if name == "price_from" else math.ceil(s[name]) if name == "price_to" else s[name]
        both = own | self.asked
        for name, pick in (("price_from", max), ("price_to", min)):
            if name in own and name in self.asked:
                both[name] = pick(own[name], self.asked[name])
        degraded = False
        try:
            rows = market.page(s["category"], partition.page, both)
        except Refused:
            degraded = True
            rows = market.page(s["category"], partition.page, {k: v for k, v in self.asked.items() if k not in self.refuses[s["category"]]})
            if rows is not None:  # what the query itself asked for was promised to Spark
                for name in {*self.asked} & {"buying_option"} & {*self.refuses[s["category"]]}:
                    rows = rows.filter(pc.equal(rows[name], self.asked[name]))
        if rows is None:
            return
        if s.get("ends_before") is not None:
            inside = pc.and_(pc.greater(rows["ends_ms"], s.get("ends_after", 0)), pc.less_equal(rows["ends_ms"], s["ends_before"]))
            rows = rows.filter(pc.fill_null(inside, False))
        n = rows.num_rows
        fixed = {"slice": (s["slice"], pa.string()), "category": (s["category"], pa.string()), "page": (partition.page, pa.int32()), "degraded": (degraded, pa.bool_()), "lost_calls": (int(degraded), pa.int32())}
        columns = []
        for name in (f.split()[0] for f in SCHEMA.split(", ")):
            columns.append(pa.array([fixed[name][0]] * n, fixed[name][1]) if name in fixed else rows[name].combine_chunks())
        yield from pa.table(columns, [f.split()[0] for f in SCHEMA.split(", ")]).to_batches()


class ListingPages(DataSource):
    """spark.read.format("listing_pages"); see PageReader for the options."""

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def read_pages(spark: SparkSession, path: str, slices: list[dict], budget: int | None = None, refuses: dict[str, list[str]] | None = None) -> DataFrame:
    """Listings of the slices (SCHEMA). Filters on category, buying_option and price go into the requests."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingPages)
    options = {"path": path, "slices": json.dumps(slices), "refuses": json.dumps(refuses or {})} | ({"budget": str(budget)} if budget else {})
    return spark.read.format("listing_pages").options(**options).load()


def ledger(spark: SparkSession, rows: DataFrame, path: str, slices: list[dict], budget: int | None = None) -> DataFrame:
    """(slice, calls, listings, degraded) of each slice, also of those without rows.

    A call is a planned page, and one more for each page with rows whose filters were refused.
    """
    planned = PageReader({"path": path, "slices": json.dumps(slices)} | ({"budget": str(budget)} if budget else {})).partitions()
    pages = spark.createDataFrame([(s["slice"], sum(p.slice["slice"] == s["slice"] for p in planned)) for s in slices], "slice string, pages long")
    by_page = rows.groupBy("slice", "page").agg(F.count("*").alias("n"), F.max("lost_calls").alias("lost"), F.max("degraded").alias("degraded"))
    seen = by_page.groupBy("slice").agg(F.sum("n").alias("listings"), F.sum("lost").alias("lost"), F.max("degraded").alias("degraded"))
    out = pages.join(seen, "slice", "left")
    return out.select("slice", (F.col("pages") + F.coalesce("lost", F.lit(0))).alias("calls"), F.coalesce("listings", F.lit(0)).cast("long").alias("listings"), F.coalesce("degraded", F.lit(False)).alias("degraded"))
