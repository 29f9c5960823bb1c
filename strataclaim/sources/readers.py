"""Readers: landed JSON, JSON lines, XML feeds, graph files, binary papers, paged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER = "title string, abstract string, full_text string, source string, url string, year int"
TRIPLE_LIST = "array<array<string>>"
PAIR_LISTS = "map<string,array<array<string>>>"
NESTED = "map<string,map<string,array<string>>>"
NESTED_SCALAR = "map<string,map<string,string>>"


def read_papers(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Landed JSON lines of papers; unreadable lines are left out, missing fields are null."""
    df = spark.read.schema(PAPER + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    df = df.where("title is not null or abstract is not null").drop("_broken")
    return df.withColumn("source", F.lit(source)) if source else df


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed: title, abstract, url, year."""
    df = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, summary string, published string").load(path)
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return df.select(clean("title").alias("title"), clean("summary").alias("abstract"), F.col("id").alias("url"), F.left("published", F.lit(4)).cast("int").alias("year"))


def inverted_to_text(index: str = "abstract_inverted_index", key: str = "id"):
    """A transformation from (key, map of word to positions as JSON) to (key, text).

    Of several words at one position the last in order of words counts.
    """

    def apply(df: DataFrame) -> DataFrame:
        words = df.select(key, F.explode(F.from_json(index, "map<string,array<int>>")).alias("w", "ps")).select(key, "w", F.explode("ps").alias("p"))
        at = words.groupBy(key, "p").agg(F.max("w").alias("w"))
        return at.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda s: s["w"]), " ").alias("text"))

    return apply


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges (source, relation, target) of a graph file in any of its layouts.

    Layouts: a list of triples; an object of lists of (relation, target) pairs; an object of objects
    of target lists; the same with single targets.
    """
    return graph_edges(spark.read.text(path, wholetext=True).select("value"), "value")


def graph_edges(df: DataFrame, col: str) -> DataFrame:
    """Edges of graphs held as JSON text, whichever layout each has."""
    j = F.col(col)
    is_list = j.rlike(r"^\s*\[")
    triples = df.where(is_list).select(F.explode(F.from_json(j, TRIPLE_LIST)).alias("t")).select(F.get("t", 0).alias("source"), F.get("t", 1).alias("relation"), F.get("t", 2).alias("target"))
    rest = df.where(~is_list)
    node = rest.select(F.explode(F.from_json(j, "map<string,string>")).alias("source", "v"))
    pairs = node.where(F.col("v").rlike(r"^\s*\[")).select("source", F.explode(F.from_json("v", TRIPLE_LIST)).alias("t")).select("source", F.get("t", 0).alias("relation"), F.get("t", 1).alias("target"))
    rel = node.where(~F.col("v").rlike(r"^\s*\[")).select("source", F.explode(F.from_json("v", "map<string,string>")).alias("relation", "x"))
    many = rel.where(F.col("x").rlike(r"^\s*\[")).select("source", "relation", F.explode(F.from_json("x", "array<string>")).alias("target"))
    one = rel.where(~F.col("x").rlike(r"^\s*\[")).select("source", "relation", F.col("x").alias("target"))
    edges = triples.unionByName(pairs).unionByName(many).unionByName(one)
    clean = edges.select(*(F.trim(c).alias(c) for c in ("source", "relation", "target")))
    return clean.where("source <> '' and relation <> '' and target <> ''").distinct()


def read_reports(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The newest report files of a folder."""
    df = spark.read.option("multiLine", True).json(path).select("*", F.col("_metadata.file_modification_time").alias("modified"))
    return df.orderBy(F.desc("modified")).limit(limit)


def read_binary(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """Binary papers with their texts, from a given extractor of bytes to text (none is built in)."""
    from pyspark.sql.types import StringType

    df = spark.read.format("binaryFile").load(path)
    if extract is None:
        return df.select("path", "length", F.lit(None).cast("string").alias("text"))
    fn = F.pandas_udf(lambda s: s.map(extract), StringType())
    return df.select("path", "length", fn("content").alias("text"))


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32) -> DataFrame:
    """A table over JDBC, in ranges of a numeric key where its bounds are known; filters are pushed down."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()
