"""Delimited text with all fields as strings: missing tokens, kinds of columns, coercion, derived annotations; result tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

#: What stands for a missing value, and for true and false, in any case.
MISSING = ("", "na", "n/a", "nan", "null", "?")
TRUE = ("true", "t", "yes", "y", "1")
FALSE = ("false", "f", "no", "n", "0")


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as strings; a header with a blank or repeated name is an error."""
    reader = spark.read.option("sep", separator).option("inferSchema", False)
    header = reader.option("header", False).csv(path).first()  # as written: with header=True Spark renames what repeats
    names = [(c or "").strip() for c in header or []]
    if len({n.lower() for n in names}) < len(names) or "" in names:
        raise ValueError("column names must be distinct and not blank")
    out = reader.option("header", True).option("enforceSchema", False).csv(path)
    return out.toDF(*names)


def token(value: Column, missing: tuple[str, ...] = MISSING) -> Column:
    """The trimmed field, null where it stands for a missing value."""
    trimmed = F.trim(value)
    return F.when(~F.lower(trimmed).isin(*missing), trimmed)


def decimal_comma(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit("."))


def to_boolean(value: Column) -> Column:
    low = F.lower(token(value))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def to_finite(value: Column) -> Column:
    """The number that a field spells, null where it spells none or not a finite one."""
    number = token(value).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def infer_kinds(df: DataFrame) -> DataFrame:
    """name, kind, n_observed, n_distinct of every string column, by one aggregation over the whole table.

    boolean: every observed field is a truth token; numeric: every one a finite number; categorical: anything else, or none observed.
    """
    fields = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), token(F.col(c)).alias("v")) for c in df.columns])).alias("f")).select("f.*")
    seen = fields.groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))  # combined before the shuffle; few values stay few rows
    v = F.col("v")
    out = seen.groupBy("name").agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("n"))), F.lit(0)).alias("n_observed"), F.count("v").alias("n_distinct"),
        F.bool_and(to_boolean(v).isNotNull() | v.isNull()).alias("b"), F.bool_and(to_finite(v).isNotNull() | v.isNull()).alias("f"),
    )
    kind = F.when(F.col("n_observed") == 0, "categorical").when(F.col("b"), "boolean").when(F.col("f"), "numeric").otherwise("categorical")
    return out.select("name", kind.alias("kind"), "n_observed", "n_distinct")


def identifier_faults(df: DataFrame, column: str) -> DataFrame:
    """One row: n_rows, n_missing, n_blank, n_repeated of a row identifier; it is usable where the last three are 0."""
    per = df.groupBy(F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    blank = F.trim("v") == ""
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    repeated = F.coalesce(F.sum(F.when(F.col("v").isNotNull() & ~blank, F.col("n") - 1)), F.lit(0))
    return per.agg(total(F.lit(True)).alias("n_rows"), total(F.col("v").isNull()).alias("n_missing"), total(blank).alias("n_blank"), repeated.alias("n_repeated"))


def derive(value: Column, rule: str, operand) -> Column:
    """A boolean annotation of a column: equal, not_equal, less_equal or in; null where the value is missing."""
    if rule == "in":
        return value.isin(*operand)
    return {"equal": value == operand, "not_equal": value != operand, "less_equal": value <= operand}[rule]


def mask_members(df: DataFrame, key: str, mask: str, element: str) -> DataFrame:
    """key, element (0-based): the positions at which a boolean array is true."""
    return df.select(key, F.posexplode(mask).alias(element, "__in")).filter("__in").drop("__in")


def index_members(df: DataFrame, key: str, indices: str, element: str) -> DataFrame:
    return df.select(key, F.explode(indices).alias(element)).distinct()


def write_results(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """The tables of a result under one folder, a subfolder each; in CSV, nested columns are JSON texts."""
    for name, df in tables.items():
        if form == "csv":
            nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
            df.withColumns({c: F.to_json(c) for c in nested}).write.option("header", True).csv(f"{path}/{name}")
        else:
            df.write.option("compression", "zstd").parquet(f"{path}/{name}")


def nested_results(results: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Results with their members as sorted arrays; one group holds the members of one result."""
    r = rows.groupBy("id").agg(F.array_sort(F.collect_set("row_index")).alias("rows"))
    c = columns.groupBy("id").agg(F.array_sort(F.collect_set("column_index")).alias("columns"))
    return results.join(r, "id", "left").join(c, "id", "left")


def usable_identifiers(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, usable, for each column: whether every row has a value of its own there, none missing or blank. One pass over the table."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    good = lambda c: (F.count_if(text(c) != "") == F.count(F.lit(1))) & (F.count_distinct(text(c)) == F.count(F.lit(1)))
    one = df.agg(*[F.coalesce(good(c), F.lit(False)).alias(c) for c in columns])
    return one.unpivot([], columns, "name", "usable")


def default_identifiers(df: DataFrame, key: str) -> DataFrame:
    """``df`` with identifier, the position of each row in order of ``key`` as text, from 0; positions come from counts of ranges, so no task numbers all rows."""
    spread = df.withColumn("__k", F.col(key)).repartitionByRange("__k").sortWithinPartitions("__k").withColumn("__part", F.spark_partition_id())
    spread = cut(spread.withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)), "positions")
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    out = spread.join(sizes.select("__part", before.alias("__before")), "__part")
    return out.withColumn("identifier", (F.col("__before") + F.col("__at")).cast("string")).select(*df.columns, "identifier")


def category_order(df: DataFrame, key: str, column: str) -> DataFrame:
    """value, code: the categories of a column in order of first appearance by ``key``; nulls are none."""
    first = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(key).alias("__first"))
    return first.select("value", (F.row_number().over(Window.orderBy("__first", "value")) - 1).cast("int").alias("code"))  # one row a category
