"""Project metadata: a manifest's nodes, sources, edges and contracts, and a catalog's columns, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types as L

COLUMN = "struct<name:string,data_type:string,description:string>"
NODE = f"struct<unique_id:string,name:string,resource_type:string,original_file_path:string,path:string,database:string,schema:string,alias:string,config:struct<materialized:string,contract:struct<enforced:boolean>>,columns:map<string,{COLUMN}>,depends_on:struct<nodes:array<string>,macros:array<string>>,raw_code:string,checksum:struct<name:string,checksum:string>>"
SOURCE = f"struct<unique_id:string,name:string,source_name:string,database:string,schema:string,identifier:string,columns:map<string,{COLUMN}>>"
#: Keys are data, so the schema is given: inference would make a struct field of each.
MANIFEST = f"nodes map<string,{NODE}>, sources map<string,{SOURCE}>, parent_map map<string,array<string>>, child_map map<string,array<string>>"
CATALOG = "nodes map<string,struct<columns:map<string,struct<name:string,type:string,index:int>>>>, sources map<string,struct<columns:map<string,struct<name:string,type:string,index:int>>>>"


class Manifest:
    """A manifest file, or several (one row each)."""

    def __init__(self, spark: SparkSession, path: str):
        self.raw = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)

    def nodes(self) -> DataFrame:
        each = self.raw.select(F.explode("nodes").alias("unique_id", "n"))
        return each.select(
            "unique_id", "n.name", "n.resource_type", F.coalesce("n.original_file_path", "n.path").alias("path"), "n.database", "n.schema",
            F.coalesce("n.alias", "n.name").alias("alias"), "n.config.materialized", F.coalesce("n.config.contract.enforced", F.lit(False)).alias("contract"),
            "n.columns", F.coalesce("n.depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"), "n.raw_code", F.col("n.checksum.checksum").alias("checksum"),
        )

    def models(self) -> DataFrame:
        return self.nodes().filter("resource_type = 'model'")

    def sources(self) -> DataFrame:
        each = self.raw.select(F.explode("sources").alias("unique_id", "s"))
        return each.select("unique_id", "s.name", "s.source_name", "s.database", "s.schema", F.coalesce("s.identifier", "s.name").alias("identifier"), "s.columns")

    def get_node(self, unique_id: str) -> dict | None:
        """The node of that id, None if there is none."""
        found = self.nodes().filter(F.col("unique_id") == unique_id).first()
        return found.asDict(recursive=True) if found else None

    def get_source(self, unique_id: str) -> dict | None:
        found = self.sources().filter(F.col("unique_id") == unique_id).first()
        return found.asDict(recursive=True) if found else None

    def edges(self) -> DataFrame:
        from ..operators.lineage import edges_of_maps

        maps = [self.raw.select(F.explode(c).alias("node", "others")) for c in ("parent_map", "child_map")]
        return edges_of_maps(*maps, self.nodes())

    def contracts(self, parity: bool = False) -> DataFrame:
        """Typed columns of models with an enforced contract: rows of a diff's expected side."""
        enforced = self.models().filter("contract")
        typed = enforced.select(F.col("unique_id").alias("relation"), F.posexplode(F.map_values("columns")).alias("ordinal", "c")).filter("c.data_type is not null")
        return typed.select("relation", "ordinal", "c.name", L.normalise(F.col("c.data_type"), "contract", parity).alias("type"), F.lit(None).cast("boolean").alias("nullable"))

    def relations(self) -> DataFrame:
        """(key, unique_id): all names by which SQL may call a relation."""
        m, s = self.nodes().filter("resource_type in ('model', 'seed', 'snapshot')"), self.sources()
        dotted = lambda *c: F.when(F.col(c[0]).isNotNull() & F.col(c[1]).isNotNull(), F.concat_ws(".", *c))
        keys = m.select("unique_id", F.explode(F.array_compact(F.array("name", "alias", "unique_id", dotted("database", "schema", "name"), dotted("database", "schema", "alias")))).alias("key"))
        more = s.select("unique_id", F.explode(F.array_compact(F.array(F.concat_ws(".", "source_name", "name"), "unique_id", dotted("database", "schema", "name"), dotted("database", "schema", "identifier")))).alias("key"))
        return keys.unionByName(more).distinct()


def catalog_columns(spark: SparkSession, path: str, dialect: str = "contract") -> DataFrame:
    """Columns of a catalog file: the actual side of a diff, or types for new contracts."""
    raw = spark.read.schema(CATALOG).option("multiLine", True).json(path)
    both = raw.select(F.explode(F.map_concat(F.coalesce("nodes", F.map_from_arrays(F.array(), F.array()).cast(dict(raw.dtypes)["nodes"])), F.coalesce("sources", F.map_from_arrays(F.array(), F.array()).cast(dict(raw.dtypes)["sources"])))).alias("relation", "t"))
    each = both.select("relation", F.explode(F.map_values("t.columns")).alias("c"))
    return each.select("relation", F.col("c.index").alias("ordinal"), "c.name", L.normalise(F.col("c.type"), dialect).alias("type"), F.lit(None).cast("boolean").alias("nullable"))


def sql_files(spark: SparkSession, folder: str, pattern: str = "*.sql") -> DataFrame:
    """(path, sql) of all files below a folder, each one row."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("sql"))


def missing_files(models: DataFrame, files: DataFrame) -> DataFrame:
    """Diagnostics of models whose SQL file isn't there; paths match by their ends."""
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("path").alias("full"))
    known = models.withColumn("file", F.element_at(F.split("path", "/"), -1))
    hit = known.join(names, "file").filter(F.col("full").endswith(F.col("path"))).select("unique_id")
    lost = known.join(hit, "unique_id", "left_anti")
    return lost.select(F.col("unique_id").alias("relation"), F.lit("SQL_PARSE_ERROR").alias("code"), F.lit("error").alias("severity"), F.concat(F.lit("Cannot read SQL file '"), "path", F.lit("'")).alias("message"))
