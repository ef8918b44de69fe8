"""Where tables come from: files, SQL, the catalog; and the gate for SQL text from outside."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions import exprs as X

#: Rows that a preview of a table shows.
PREVIEW_ROWS, PARTITION_VALUES = 10000, 500
# Fixed value: the name of the folder of null partition values.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, types inferred, empty fields null."""
    return spark.read.csv(path, header=True, inferSchema=True, nullValue="", quote='"', escape='"', multiLine=True)


def read_object_csv(spark: SparkSession, uri: str) -> DataFrame:
    """A CSV object of a store; only ``s3://bucket/key`` is taken. Where the session has no file system for ``s3``, that of ``s3a`` reads it."""
    scheme, _, rest = uri.partition("://")
    bucket, _, key = rest.partition("/")
    if scheme != "s3" or not bucket or not key:
        raise ValueError(f"not an s3://bucket/key address: {uri}")
    return read_csv(spark, store_path(spark, uri))


def store_path(spark: SparkSession, uri: str) -> str:
    known = any(spark._jsc.hadoopConfiguration().get(k) for k in ("fs.s3.impl", "fs.AbstractFileSystem.s3.impl"))
    return uri if known else "s3a" + uri.removeprefix("s3")


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    """The result of a query. Text that is anything but one query is refused, by its parsed plan and not by its words."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise ValueError("an empty query")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    refused = [spark._jvm.java.lang.Class.forName(logical + n) for n in ("Command", "ParsedStatement")]
    todo = [plan]
    while todo:
        node = todo.pop()
        if any(c.isInstance(node) for c in refused):
            raise ValueError("only queries are allowed")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return spark.sql(text)


def data_sources(spark: SparkSession) -> list[str]:
    """Catalogs, the session's default among them."""
    return sorted({c.name for c in spark.catalog.listCatalogs()} | {spark.catalog.currentCatalog()})


def catalogs(spark: SparkSession, source: str) -> list[str]:
    return [source]


def databases(spark: SparkSession, catalog: str | None = None) -> list[str]:
    with _Catalog(spark, catalog):
        return [d.name for d in spark.catalog.listDatabases()]


def tables(spark: SparkSession, database: str, catalog: str | None = None) -> list[str]:
    with _Catalog(spark, catalog):
        return [t.name for t in spark.catalog.listTables(database)]


def partition_names(spark: SparkSession, table: str) -> list[dict[str, str]]:
    """Partitions of a table, as key to text, from the catalog, or where it keeps none from the names of folders; no data file is opened."""
    try:
        found = [r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    except AnalysisException:
        found = {p.rpartition("/")[0] for p in spark.table(table).inputFiles()}
    pairs = [[s.partition("=") for s in f.split("/") if "=" in s] for f in found]
    return [{unquote(k): unquote(v) for k, _, v in p} for p in pairs]


def partitions(spark: SparkSession, table: str) -> dict:
    """Partition keys and the first values of each, in order; empty for tables without partitions."""
    keys = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if not keys:
        return {"keys": [], "values": {}}
    schema, names = spark.table(table).schema, partition_names(spark, table)
    values = {}
    for k in keys:
        text = sorted({p[k] for p in names if k in p} - {NULL_PARTITION})
        typed = spark.createDataFrame([(t,) for t in text], "v string").select(F.col("v").cast(schema[k].dataType).alias("v"))
        rows = [r["v"] for r in typed.orderBy("v").limit(PARTITION_VALUES).collect()]
        values[k] = ([None] + rows if any(p.get(k) == NULL_PARTITION for p in names) else rows)[:PARTITION_VALUES]
    return {"keys": keys, "values": values}


class _Catalog:
    def __init__(self, spark: SparkSession, name: str | None):
        self.spark, self.name = spark, name

    def __enter__(self):
        self.before = self.spark.catalog.currentCatalog()
        if self.name:
            self.spark.catalog.setCurrentCatalog(self.name)

    def __exit__(self, *_):
        self.spark.catalog.setCurrentCatalog(self.before)


def partition_scan(df: DataFrame, filters: dict[str, list] | None = None, limit: int | None = PREVIEW_ROWS) -> DataFrame:
    """Rows whose columns have one of the wanted values, each cast to the column's type; ``limit`` rows for a preview."""
    for name, values in (filters or {}).items():
        if values:
            kind = df.schema[name].dataType
            df = df.where(X.col(name).isin([F.lit(v).cast(kind) for v in values]))
    return df if limit is None else df.limit(limit)


def literal(value, kind: str) -> str:
    """A value as SQL text: dates and timestamps typed, finite numbers bare, all else quoted."""
    text = str(value)
    k = kind.lower()
    if k == "date" or k.startswith("timestamp"):
        return f"{'DATE' if k == 'date' else 'TIMESTAMP'} {_quoted(text)}"
    if k.startswith(("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")):
        try:
            finite = float(text) not in (float("inf"), float("-inf")) and float(text) == float(text)
        except ValueError:
            finite = False
        return text.strip() if finite else f"CAST({_quoted(text)} AS {kind})"
    return _quoted(text)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def scan_sql(table: str, kinds: dict[str, str], filters: dict[str, list] | None = None, limit: int = PREVIEW_ROWS) -> dict:
    """The same scan as SQL text, with what it does and the filters that it applies."""
    used = {k: v for k, v in (filters or {}).items() if v}
    where = " AND ".join(f"{X.quote(k)} IN ({', '.join(literal(x, kinds.get(k, 'string')) for x in v)})" for k, v in used.items())
    name = ".".join(X.quote(p) for p in table.split("."))
    sql = f"SELECT * FROM {name}" + (f" WHERE {where}" if where else "") + f" LIMIT {limit}"
    text = f"Up to {limit} rows of {table}" + (f" where {', '.join(used)} have the chosen values" if used else "")
    return {"query": sql, "explanation": text, "partitionsApplied": used}
