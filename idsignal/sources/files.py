"""CSV extracts and warehouse tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from idsignal import schemas

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose header names the columns, in any order; a file with another header raises.

    Columns the file lacks are null, columns the schema lacks are dropped. Rows with fewer fields
    keep what they have. `_corrupt_record` holds the text of rows that cannot be read: those with
    more fields than the header, or with a value their column cannot hold.
    """
    names = spark.read.csv(path, header=True).columns
    kinds = {f.name: f.dataType for f in schema.fields}
    present = [T.StructField(n, kinds.get(n, T.StringType()), True) for n in names]
    rows = spark.read.csv(
        path, schema=T.StructType([*present, T.StructField(CORRUPT, T.StringType(), True)]), header=True,
        enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT,
    )
    wide = ", ".join(f"f{i} string" for i in range(len(names) + 1))
    again = rows.withColumn("_text", F.from_csv(F.col(CORRUPT), wide))
    unread = F.col(f"_text.f{len(names)}").isNotNull()
    for i, name in enumerate(names):
        unread = unread | (F.col(f"`{name}`").isNull() & F.col(f"_text.f{i}").isNotNull())
    fields = [F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return again.select(*fields, F.when(unread, F.col(CORRUPT)).alias(CORRUPT))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; a missing one raises."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int,
              partitions: int, **options) -> DataFrame:
    """A database table read in parallel over ranges of a numeric column."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high,
                 numPartitions=partitions, **options)
        .load()
    )


def read_reputation(spark: SparkSession, path: str) -> DataFrame:
    """Address reputation table (ip, abuse_confidence, country, asn)."""
    return read_table(spark, path, schemas.REPUTATION)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.lower() for name in df.columns])


def alert_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[F.col(f.name) for f in schemas.ALERTS.fields])
