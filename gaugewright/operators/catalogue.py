"""Columns, code objects, jobs and security over catalogue snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import CHARACTER_TYPES, JSON_TYPES, LARGE_CHARACTER_LENGTH, LARGE_OBJECT_TYPES, STANDALONE
from ..functions.status import is_user_table
from .lists import DATABASE, TABLE
from .snapshots import on_current

COLUMN = [*TABLE, "column_name"]


def user_columns(columns: DataFrame) -> DataFrame:
    return columns.filter(is_user_table(columns))


# --- columns -----------------------------------------------------------------------------------------


@on_current
def data_dictionary(columns: DataFrame) -> DataFrame:
    """Columns with position, type, length, precision and scale, default, nullability and whether they are in the primary key."""
    rows = user_columns(columns)
    optional = {"num_precision": "int", "num_scale": "int", "default_value": "string", "key": "string"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in rows.columns})
    return rows.select(
        *COLUMN, "position", "data_type", "char_length", "num_precision", "num_scale", "default_value", "nullable", "extra",
        F.coalesce(F.upper("key") == "PRI", F.lit(False)).alias("in_primary_key"),
    )


def dictionary_of(df: DataFrame) -> DataFrame:
    """The data dictionary of a table at hand, from its schema."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean")


@on_current
def large_object_columns(columns: DataFrame) -> DataFrame:
    return user_columns(columns).filter(F.lower("data_type").isin(LARGE_OBJECT_TYPES)).select(*COLUMN, "data_type")


@on_current
def json_columns(columns: DataFrame) -> DataFrame:
    """JSON columns by type or by an IS JSON check."""
    by_type = F.lower("data_type").isin(JSON_TYPES)
    by_check = F.upper("check_expr").contains("IS JSON")
    return user_columns(columns).filter(by_type | by_check).select(*COLUMN, "data_type").distinct()


@on_current
def generated_columns(columns: DataFrame) -> DataFrame:
    return user_columns(columns).filter("generation_expr <> ''").select(*COLUMN, "generation_expr")


@on_current
def auto_increment_columns(columns: DataFrame) -> DataFrame:
    return user_columns(columns).filter(F.col("extra").contains("auto_increment")).select(*COLUMN, "data_type")


@on_current
def large_varchar_columns(columns: DataFrame) -> DataFrame:
    """Character columns of 255 and more, and text types."""
    long = F.lower("data_type").isin(CHARACTER_TYPES) & (F.col("char_length") >= LARGE_CHARACTER_LENGTH)
    text = F.lower("data_type").contains("text")
    return user_columns(columns).filter(long | text).select(*COLUMN, "data_type", "char_length")


@on_current
def collation_mix(tables: DataFrame) -> DataFrame:
    """Tables per schema and collation."""
    return (
        tables.filter(is_user_table(tables) & F.col("collation").isNotNull())
        .groupBy(*DATABASE, "schema_name", "collation")
        .agg(F.count(F.lit(1)).alias("table_count"))
    )


@on_current
def column_collations(columns: DataFrame) -> DataFrame:
    """Character set and collation of each column that has one."""
    charset = F.col("charset") if "charset" in columns.columns else F.lit(None).cast("string")
    return user_columns(columns).filter(F.col("collation").isNotNull()).select(*COLUMN, charset.alias("charset"), "collation")


@on_current
def documented_tables(tables: DataFrame) -> DataFrame:
    return tables.filter(is_user_table(tables) & (F.col("comment") != "")).select(*TABLE, "comment")


# --- code objects ------------------------------------------------------------------------------------

OBJECT = [*DATABASE, "schema_name", "object_name"]
ROUTINES = ["PROCEDURE", "FUNCTION", "PACKAGE"]


@on_current
def routines(objects: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Procedures, functions and packages that no extension owns."""
    wanted = F.col("object_type").isin(types or ROUTINES) & ~F.col("is_extension")
    return objects.filter(is_user_table(objects) & wanted).select(*OBJECT, "object_type")


@on_current
def views(objects: DataFrame) -> DataFrame:
    label = (
        F.when(F.col("object_type") == "MATERIALIZED VIEW", F.lit("Materialized View"))
        .when(F.col("object_type") == "VIEW", F.lit("View"))
    )
    return (
        objects.filter(is_user_table(objects))
        .select(*OBJECT, label.alias("view_type"))
        .filter("view_type IS NOT NULL")
    )


@on_current
def triggers(objects: DataFrame, tables: DataFrame) -> DataFrame:
    """Triggers on known tables."""
    found = objects.filter(F.col("object_type") == "TRIGGER").select(*OBJECT, "table_name")
    return found.join(tables.select(*TABLE).distinct(), TABLE, "left_semi")


@on_current
def scheduled_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.select(*DATABASE, "job_name", "enabled", "schedule", "owner")


@on_current(histories=("runs",))
def failed_job_runs(jobs: DataFrame, runs: DataFrame, n: int = 100) -> DataFrame:
    """The latest runs that did anything but succeed (status 1)."""
    keys = [*DATABASE, "job_name"]
    return (
        runs.filter(F.col("status") != 1)
        .join(jobs.select(*keys, "owner"), keys)
        .select(*keys, "owner", "run_ts", "status", "message")
        .orderBy(F.desc("run_ts"), *keys, "message")
        .limit(n)
    )


@on_current
def code_dependencies(objects: DataFrame, tables: DataFrame) -> DataFrame:
    """Routines and the tables their bodies mention as a whole word, ignoring case.

    Bodies are cut into words (letters and digits of any script, and underscores) once and joined to the
    first words of table names. Names that are not one word are then checked against the whole body.
    """
    code = objects.filter(
        is_user_table(objects) & F.col("object_type").isin("PROCEDURE", "FUNCTION") & ~F.col("is_extension")
    ).select(*OBJECT, "object_type", F.lower("body").alias("body"))
    words = code.select(
        *OBJECT, F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("word"),
    )
    targets = (
        tables.filter(is_user_table(tables))
        .select(
            *DATABASE,
            F.concat_ws(".", "schema_name", "table_name").alias("referenced_object"),
            F.lower("table_name").alias("name"),
            F.regexp_extract(F.lower("table_name"), r"(?U)(\w+)", 1).alias("word"),
        )
        .distinct()
    )
    mentioned = words.join(targets, [*DATABASE, "word"]).withColumn("whole", F.col("name") == F.col("word"))
    # bodies are fetched only for the objects that mention the first word of a longer name
    bodies = code.select(*[F.col(c).alias(f"__{c}") for c in OBJECT], "body")
    same = ~F.col("whole")
    for c in OBJECT:
        same = same & (F.col(c) == F.col(f"__{c}"))
    checked = mentioned.join(bodies, same, "left").filter(
        F.col("whole") | F.expr(r"body RLIKE concat(r'(?U)(?<!\w)\Q', name, r'\E(?!\w)')")
    )
    found = checked.select(*OBJECT, "referenced_object").distinct()
    return code.select(*OBJECT, "object_type").join(found, OBJECT, "left").withColumn(
        "referenced_object", F.coalesce("referenced_object", F.lit(STANDALONE))
    )


@on_current
def view_dependencies(deps: DataFrame) -> DataFrame:
    """Distinct edges recorded by the catalogue itself, per database where the fact says which; self references aside."""
    place = [c for c in DATABASE if c in deps.columns]
    return deps.filter("referencing <> referenced").select(*place, "referencing", "referenced").distinct()


@on_current
def object_counts(objects: DataFrame) -> DataFrame:
    """Objects per class."""
    return objects.groupBy(*DATABASE, "object_type").agg(F.count(F.lit(1)).alias("object_count"))


# --- security ----------------------------------------------------------------------------------------


@on_current
def accounts(principals: DataFrame) -> DataFrame:
    """Accounts with their flags and role."""
    return principals.select(
        *DATABASE, "name", "type", "is_disabled", F.coalesce("role", F.lit("none")).alias("role")
    ).distinct()


@on_current
def privileges(grants: DataFrame) -> DataFrame:
    """Who may do what on which object, and pass it on."""
    return grants.groupBy(*DATABASE, "grantee", "privilege", "object_name").agg(F.bool_or("grantable").alias("grantable"))


@on_current
def role_members(principals: DataFrame) -> DataFrame:
    """Role to member edges."""
    return principals.filter("role IS NOT NULL").select(*DATABASE, "role", F.col("name").alias("member")).distinct()
