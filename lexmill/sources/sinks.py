"""Where results go: versioned tables, shards of vectors, rows for a graph database."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_CURRENT"


class Versions:
    """Tables of a corpus under root/v=N; a pointer file, renamed into place last, names the version readers use.

    All files are reached through Hadoop's file systems, so a root may lie in any storage Spark reads.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        at = self._path(self.root)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        qualified = self.fs.makeQualified(at)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration())
        self._overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._qualified = qualified.toString()

    def _in(self, name: str):
        return self._path(f"{self._qualified}/{name}")

    def _move(self, old: str, new: str) -> None:
        self._files.rename(self._in(old), self._in(new), self._overwrite)

    def current(self) -> int | None:
        if not self.fs.exists(self._in(POINTER)):
            return None
        try:
            n = json.loads(self._text(POINTER))["version"]
            if not isinstance(n, int) or n < 0 or not self.fs.exists(self._in(f"v={n}")):
                raise ValueError("no such version")
            return n
        except (ValueError, KeyError, TypeError):
            # what cannot be understood is put aside, never overwritten
            self._move(POINTER, f"{POINTER}.corrupt-{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}")
            return None

    def _text(self, name: str) -> str:
        stream = self.fs.open(self._in(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        except Py4JJavaError as e:
            if "ChecksumException" in str(e.java_exception):
                raise ValueError("the file was changed") from e
            raise
        finally:
            stream.close()

    def _at(self, n: int) -> str:
        return f"{self._qualified}/v={n}"

    def write(self, **tables: DataFrame) -> int:
        n = (self.current() or 0) + 1
        while self.fs.exists(self._in(f"v={n}")):
            n += 1
        for name, df in tables.items():
            df.write.parquet(f"{self._at(n)}/{name}")
        new = f"{POINTER}.{uuid.uuid4().hex}"
        out = self.fs.create(self._in(new))
        out.write(bytearray(json.dumps({"version": n, "tables": sorted(tables), "written_at": time.time()}).encode("utf-8")))
        out.close()
        self._move(new, POINTER)
        return n

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        n = self.current() if version is None else version
        return None if n is None or not self.fs.exists(self._in(f"v={n}/{name}")) else self.spark.read.parquet(f"{self._at(n)}/{name}")


def write_shards(df: DataFrame, path: str, rows: int = 100_000, resume: bool = True) -> None:
    """Vectors and texts as files of at most `rows` rows; resuming appends."""
    df.write.mode("append" if resume else "overwrite").option("maxRecordsPerFile", rows).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, row, ...): a row is addressed by its file and its place in it."""
    meta = F.col("_metadata")
    return spark.read.parquet(path).select("*", meta["file_name"].alias("shard"), meta["row_index"].alias("row"))


#: where an edge was read, as properties of its relationship
PROVENANCE = ("sentence", "s_span", "o_span", "r_class", "pattern", "swapped")


def _merge(other: str, link: str) -> str:
    """A statement that merges an entity, another node and the relationship between them; every value is a parameter."""
    return f"MERGE (a:Entity {{name: $s}}) MERGE (b:{other}) MERGE (a)-[r:{link}]->(b)"


def cypher(edges: DataFrame, provenance: bool = False) -> DataFrame:
    """(id, query, s, o, r, src[, provenance]): the statement that merges an edge, and its parameters. The relation's
    words are a property, so relations that differ in any character stay apart."""
    query = _merge("Entity {name: $o}", "REL {type: $r, source: $src}")
    more = PROVENANCE if provenance else ()
    if more:
        query += " SET " + ", ".join(f"r.{k} = ${k}" for k in more)
    return edges.select("id", F.lit(query).alias("query"), "s", "o", "r", F.col("source").alias("src"), *more)


def literal_cypher(links: DataFrame) -> DataFrame:
    """(query, s, value, kind, src): the statement that links an entity with a literal. links (key, entity, kind, literal, source)."""
    query = _merge("Literal {value: $value, kind: $kind}", "HAS_LITERAL {source: $src}")
    return links.select(F.lit(query).alias("query"), F.col("entity").alias("s"), F.col("literal").alias("value"), "kind", F.col("source").alias("src"))


#: one entity of a name and one literal of a value and a kind
CONSTRAINTS = (
    "CREATE CONSTRAINT entity_name IF NOT EXISTS FOR (n:Entity) REQUIRE n.name IS UNIQUE",
    "CREATE CONSTRAINT literal_value_kind IF NOT EXISTS FOR (n:Literal) REQUIRE (n.value, n.kind) IS UNIQUE",
)


def literal_links(entities: DataFrame, literals: DataFrame) -> DataFrame:
    """(key, entity, kind, literal): every entity of a sentence with every literal of it. (key, entity) and (key, kind, literal)."""
    return entities.select("key", "entity").distinct().join(literals.select("key", "kind", "literal").distinct(), "key")


def send(rows: DataFrame, session_factory) -> None:
    """Runs (query, parameters) rows in one session a partition; the factory is given by the caller."""

    def run(part) -> None:
        with session_factory() as session:
            for r in part:
                d = r.asDict()
                session.run(d.pop("query"), **d)

    rows.foreachPartition(run)


def append_metrics(rows: DataFrame, path: str) -> None:
    """One line of JSON a row, added to what is there."""
    rows.write.mode("append").json(path)
