"""Sources and sinks: JSON lines, JSON arrays, CSV, and writes that replace only what they bring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyframe.operators.merging import stratified_sample


def read_json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = True) -> DataFrame:
    """Rows of JSON lines; a missing path is an empty table, and malformed lines are skipped if tolerant, else fail."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_cases(spark: SparkSession, path: str, schema: str, group: str, key: str, groups: list[str] | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
    """Cases of a JSON array file: of some groups only, and at most ``limit`` of them in the proportions of the groups, in hash order."""
    cases = read_json_array(spark, path, schema)
    cases = cases if groups is None else cases.where(F.col(group).isin(groups))
    return cases if limit is None else stratified_sample(cases, group, key, limit, seed)


def read_split(spark: SparkSession, root: str, domain: str, split: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{domain}/{split}-*.parquet").withColumns({"domain": F.lit(domain), "split": F.lit(split)})


def read_domain(spark: SparkSession, root: str, domain: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """All splits of a domain, columns matched by name."""
    out = None
    for s in splits:
        part = read_split(spark, root, domain, s)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def union_families(families: dict[str, DataFrame]) -> DataFrame:
    """Metric tables of different columns in one, tagged by family."""
    out = None
    for name, df in families.items():
        part = df.withColumn("family", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def replace_sources(df: DataFrame, path: str, column: str = "rubric_source") -> None:
    """Writes a table partitioned by source so that only the sources brought along are replaced. Rows without a source are one
    partition and are replaced as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_checked(df: DataFrame, path: str, least_rows: int) -> None:
    """Refuses to overwrite a table by a smaller one."""
    n = df.count()
    if n < least_rows:
        raise ValueError(f"{n} rows would replace {least_rows}")
    df.write.mode("overwrite").parquet(path)


def done_keys(log: DataFrame, key: str = "uid", error: str = "error") -> DataFrame:
    """Keys already processed without an error."""
    return log.where(F.col(error).isNull()).select(key).distinct()


def to_do(work: DataFrame, log: DataFrame, key: str = "uid", error: str = "error") -> DataFrame:
    return work.join(done_keys(log, key, error), key, "left_anti")


def merged_shards(shards: list[DataFrame], key: str, filled: str, order: str) -> DataFrame:
    """One row per key of several shards: a filled one before an empty one, the latest of equal ones."""
    from tallyframe.operators.ranking import first_per_key

    out = None
    for s in shards:
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    empty = F.coalesce(F.length(F.col(filled)), F.lit(0)) == 0
    return first_per_key(out, [key], [empty.cast("int").alias("a"), (-F.col(order)).alias("b")])


def write_shards(df: DataFrame, path: str, key: str, n: int) -> None:
    """Rows in one folder per shard of their key's hash."""
    from tallyframe.operators.merging import hash_number

    df.withColumn("shard", hash_number(F.col(key).cast("string"), n)).repartition(n, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def carried_over(target: DataFrame, other: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The target and those wanted rows of another run whose key it lacks."""
    missing = other.join(wanted.select(key), key, "left_semi").join(target.select(key), key, "left_anti")
    return target.unionByName(missing, allowMissingColumns=True)


def as_json(df: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and everything else as one JSON text."""
    rest = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*rest)).alias("json"))


def case_ids(spark: SparkSession, spec: str) -> DataFrame:
    """Ids named by ``file.json:key``, a JSON list, a text file with one per line, or a comma list."""
    import json
    import os

    path, _, key = spec.partition(":")
    if path.endswith(".json") and os.path.exists(path):
        with open(path) as f:
            value = json.load(f)
        ids = value[key] if key else value
    elif os.path.exists(spec):
        with open(spec) as f:
            ids = f.read().split()
    else:
        ids = [x.strip() for x in spec.split(",") if x.strip()]
    return spark.createDataFrame([(str(i),) for i in dict.fromkeys(ids)], "case_id string")


def cache_stats(spark: SparkSession, path: str, stamp: str = "fetched_at") -> DataFrame:
    """(entries, bytes, oldest, newest) of a folder of JSON files, by the time stamp in each; a missing folder has none. Files without a readable stamp count
    as entries."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
        files.limit(0).count()
    except AnalysisException:
        files = spark.createDataFrame([], "content binary, length long")
    when = F.get_json_object(F.col("content").cast("string"), f"$.{stamp}").try_cast("double")
    return files.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.min(when).alias("oldest"), F.max(when).alias("newest"))
