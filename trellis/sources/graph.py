"""A property graph held in DataFrames: one per vertex label (id first), one per edge definition (src, dst first)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .shared import discard, written

UNKNOWN = 10**15  # bytes; Catalyst takes tables of unknown size for larger ones
LARGE = 4 << 20  # bytes
SLICE = 2_000_000  # rows that a task sorts, of edges that are stored


@dataclass(frozen=True)
class Edges:
    """One edge definition. rows: __src, __dst and properties, or a function that gives them twice, stored by either end."""

    type: str
    src_label: str
    dst_label: str
    rows: DataFrame | Callable[[], tuple[DataFrame, DataFrame]]

    @property
    def df(self) -> DataFrame:
        return self.rows if isinstance(self.rows, DataFrame) else self.rows()[0]

    @property
    def large(self) -> bool:
        """Whether these are stored edges that rows had better not be shuffled to meet."""
        return not isinstance(self.rows, DataFrame) and LARGE <= size(self.df)

    @property
    def back(self) -> DataFrame:
        """The same rows, to be met by __dst."""
        return self.rows if isinstance(self.rows, DataFrame) else self.rows()[1]


def slices(spark: SparkSession, rows: int) -> int:
    """How many tasks rows are cut for, so that what a task sorts doesn't grow with the table."""
    return max(-(-rows // SLICE), min(spark.sparkContext.defaultParallelism, -(-rows // 100_000)), 1)


def stored(edges: DataFrame, distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges that are costly to derive, written once in the order of each end: a walk's step from a few vertices then reads
    the row groups that hold them, and not the tables that the edges were derived from. distinct: of edges without
    properties, one between two vertices; told in sorted order, so that no task holds more than it sorts."""
    e = written(edges, "edges")
    n = slices(e.sparkSession, e.count())
    src = e.repartitionByRange(n, "__src")
    if distinct:
        last = F.lag("__dst").over(Window.partitionBy("__src").orderBy("__dst"))
        src = src.withColumn("__last", last).filter("__last IS NULL OR __last <> __dst").drop("__last")
    else:
        src = src.sortWithinPartitions("__src")
    src = written(src, "edges-by")
    dst = written(src.repartitionByRange(n, "__dst").sortWithinPartitions("__dst"), "edges-by")
    discard(e)
    return src, dst


def size(df: DataFrame) -> int:
    """Catalyst's estimate in bytes, from the sizes of files; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def plain(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Properties in the four scalar types: whole numbers as bigint, others as double, dates as text."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f.name), f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif not isinstance(t, (T.LongType, T.DoubleType, T.StringType, T.BooleanType)) and f.name not in keep:
            continue
        out.append(c.alias(f.name))
    return df.select(*out)


@dataclass
class PropertyGraph:
    spark: SparkSession
    vertices: dict[str, DataFrame] = field(default_factory=dict)
    edges: list[Edges] = field(default_factory=list)
    indexes: dict[tuple[str, str], bool] = field(default_factory=dict)
    _cached: dict[tuple[str, str], DataFrame] = field(default_factory=dict)

    def add_vertices(self, label: str, df: DataFrame, key: str) -> PropertyGraph:
        """Rows become vertices of this label, beside those it has. The key column stays a property under its own name."""
        p = plain(df)
        cols = [F.col(key).cast("bigint").alias("__id"), *[F.col(c) for c in p.columns]]
        new, old = p.select(*cols), self.vertices.get(label)
        self.vertices[label] = new if old is None else old.unionByName(new, allowMissingColumns=True)
        return self

    def add_edges(self, type_: str, src_label: str, dst_label: str, df: DataFrame, src: str, dst: str, props: tuple[str, ...] = ()) -> PropertyGraph:
        p = plain(df.select(F.col(src).cast("bigint").alias("__src"), F.col(dst).cast("bigint").alias("__dst"), *props))
        self.edges.append(Edges(type_, src_label, dst_label, p))
        return self

    def add_stored_edges(self, type_: str, src_label: str, dst_label: str, rows: Callable[[], tuple[DataFrame, DataFrame]]) -> PropertyGraph:
        """Edges made by `stored`, when a query first asks for them."""
        self.edges.append(Edges(type_, src_label, dst_label, rows))
        return self

    def type_of(self, label: str, key: str) -> str | None:
        """int, float, string, bool; None for an unknown property."""
        df = self.vertices.get(label)
        return kind_of(df, key) if df is not None else None

    def edge_defs(self, type_: str | None) -> list[Edges]:
        return [e for e in self.edges if type_ is None or e.type == type_]

    # indexes

    def index(self, label: str, key: str, create: bool) -> str:
        """Create (or enable again) or disable an index: a copy sorted by the property, so that range scans skip row groups
        of the cached batches by their minima and maxima."""
        if label not in self.vertices or key not in self.vertices[label].columns:
            raise QueryError(f"no property {key} on {label}")
        if create:
            if (label, key) not in self._cached:
                self._cached[label, key] = self.vertices[label].sortWithinPartitions(key).persist()
            self.indexes[label, key] = True
            return f"index on :{label}({key}) built"
        if not self.indexes.get((label, key)):
            raise QueryError(f"no index on :{label}({key})")
        self.indexes[label, key] = False
        self._cached.pop((label, key)).unpersist()
        return f"index on :{label}({key}) dropped"

    def scan(self, label: str, keys: frozenset[str] = frozenset()) -> DataFrame:
        """The vertices of a label; from an enabled index when one of the filtered keys has one."""
        for k in sorted(keys):
            if self.indexes.get((label, k)):
                return self._cached[label, k]
        return self.vertices[label]

    # statistics

    def fan_out(self, type_: str | None, way: str, src_labels: frozenset[str], dst_labels: frozenset[str]) -> float:
        """About how many edges a vertex has, by the sizes of the tables; 1 where these aren't known."""
        edges, at = 0, set()
        for e in self.edge_defs(type_):
            for a, b in [(e.src_label, e.dst_label)] * (way != "in") + [(e.dst_label, e.src_label)] * (way != "out"):
                if a in src_labels and b in dst_labels:
                    edges += size(e.df.select("__src"))
                    at.add(a)
        vertices = sum(size(self.vertices[a].select("__id")) for a in at if a in self.vertices)
        return edges / vertices if 0 < edges < UNKNOWN and 0 < vertices < UNKNOWN else 1.0

    def degrees(self, label: str, type_: str | None = None, way: str = "out") -> DataFrame:
        """id, degree of every vertex of a label, 0 included. way: out, in or both."""
        parts = []
        for e in self.edge_defs(type_):
            if way in ("out", "both") and e.src_label == label:
                parts.append(e.df.select(F.col("__src").alias("id")))
            if way in ("in", "both") and e.dst_label == label:
                parts.append(e.df.select(F.col("__dst").alias("id")))
        v = self.vertices[label].select(F.col("__id").alias("id"))
        if not parts:
            return v.withColumn("degree", F.lit(0).cast("bigint"))
        u = parts[0]
        for p in parts[1:]:
            u = u.unionAll(p)
        return v.join(u.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def histogram(self, values: DataFrame, column: str, percents, exact: bool = False) -> list:
        """Values at the given percentiles of a column; by percentile_approx unless exact."""
        f = F.percentile(column, [p / 100 for p in percents]) if exact else F.percentile_approx(column, [p / 100 for p in percents])
        return list(values.agg(f.alias("p")).first()["p"] or [])

    def sample_ids(self, label: str, type_: str | None = None, low: int = 40, high: int = 60, n: int = 10, seed: int = 7) -> list[int]:
        """Ids of vertices whose degree lies between two percentiles: parameters for a throughput test."""
        d = self.degrees(label, type_, "both")
        ends = self.histogram(d, "degree", (low, high))
        if not ends:
            return []
        rows = d.filter(F.col("degree").between(ends[0], ends[1])).orderBy(F.xxhash64(F.lit(seed), "id")).limit(n).collect()
        return [r["id"] for r in rows]

    # checks

    def validate(self) -> list[str]:
        """Repeated vertex ids and edges without an end, as messages."""
        out = []
        for label, df in self.vertices.items():
            if df.groupBy("__id").count().filter("count > 1").limit(1).count():
                out.append(f"{label}: repeated ids")
        for e in self.edges:
            for end, label in (("__src", e.src_label), ("__dst", e.dst_label)):
                if e.df.join(self.vertices[label], e.df[end] == self.vertices[label]["__id"], "left_anti").limit(1).count():
                    out.append(f"{e.type}: {end[2:]} without a {label}")
        return out

    def partitioned(self, n: int) -> PropertyGraph:
        """The same graph with edges hash-partitioned by source and kept, so expands along them don't move them again."""
        es = [Edges(e.type, e.src_label, e.dst_label, e.df.repartition(n, "__src").persist()) for e in self.edges]
        return PropertyGraph(self.spark, dict(self.vertices), es)


def kind_of(df: DataFrame, key: str) -> str | None:
    if key not in df.columns or key.startswith("__"):
        return None
    t = df.schema[key].dataType
    return {T.LongType: "int", T.DoubleType: "float", T.StringType: "string", T.BooleanType: "bool"}[type(t)]
