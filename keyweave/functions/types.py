"""Spark types for the column types of nine SQL dialects.

Spark reads and writes TIME only where the session sets `spark.sql.timeType.enabled`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions.text import parse_type

# The type names each dialect knows, with the Spark type for their values.
DIALECT_TYPES: Mapping[str, Mapping[str, str]] = {
    "cubrid": {
        "SHORT": "SMALLINT",
        "SMALLINT": "SMALLINT",
        "INTEGER": "INT",
        "BIGINT": "BIGINT",
        "DECIMAL": "DECIMAL",
        "FLOAT": "FLOAT",
        "DOUBLE": "DOUBLE",
        "MONETARY": "DECIMAL(19,4)",
        "CHAR": "STRING",
        "VARCHAR": "STRING",
        "STRING": "STRING",
        "NCHAR": "STRING",
        "NCHAR VARYING": "STRING",
        "DATE": "DATE",
        "TIME": "TIME",
        "DATETIME": "TIMESTAMP_NTZ",
        "TIMESTAMP": "TIMESTAMP_NTZ",
        "SET": "ARRAY<STRING>",
        "MULTISET": "ARRAY<STRING>",
        "LIST": "ARRAY<STRING>",
        "BIT": "BINARY",
        "BIT VARYING": "BINARY",
    },
    "mssql": {
        "TINYINT": "SMALLINT",
        "SMALLINT": "SMALLINT",
        "INT": "INT",
        "BIGINT": "BIGINT",
        "MONEY": "DECIMAL(19,4)",
        "SMALLMONEY": "DECIMAL(10,4)",
        "REAL": "FLOAT",
        "FLOAT": "DOUBLE",
        "DECIMAL": "DECIMAL",
        "NUMERIC": "DECIMAL",
        "CHAR": "STRING",
        "VARCHAR": "STRING",
        "TEXT": "STRING",
        "XML": "STRING",
        "NCHAR": "STRING",
        "NVARCHAR": "STRING",
        "NTEXT": "STRING",
        "DATETIME": "TIMESTAMP_NTZ",
        "SMALLDATETIME": "TIMESTAMP_NTZ",
        "BINARY": "BINARY",
        "VARBINARY": "BINARY",
        "BIT": "BOOLEAN",
        "IMAGE": "BINARY",
        "TIMESTAMP": "BINARY",
        "SQL_VARIANT": "VARIANT",
        "UNIQUEIDENTIFIER": "STRING",
    },
    "mysql": {
        "INTEGER": "INT",
        "TINYINT": "SMALLINT",
        "SMALLINT": "SMALLINT",
        "MEDIUMINT": "INT",
        "INT": "INT",
        "BIGINT": "BIGINT",
        "DECIMAL": "DECIMAL",
        "FLOAT": "FLOAT",
        "DOUBLE": "DOUBLE",
        "CHAR": "STRING",
        "VARCHAR": "STRING",
        "MEDIUMTEXT": "STRING",
        "BINARY": "BINARY",
        "VARBINARY": "BINARY",
        "BLOB": "BINARY",
        "DATE": "DATE",
        "TIME": "TIME",
        "DATETIME": "TIMESTAMP_NTZ",
        "YEAR": "SMALLINT",
        "TIMESTAMP": "TIMESTAMP_NTZ",
        "ENUM": "STRING",
        "SET": "STRING",
        "BIT": "BOOLEAN",
    },
    "oracle": {
        "INTEGER": "INT",
        "NUMBER": "DECIMAL",
        "CHAR": "STRING",
        "VARCHAR2": "STRING",
        "CLOB": "STRING",
        "NCHAR": "STRING",
        "NVARCHAR2": "STRING",
        "NCLOB": "STRING",
        "DATE": "TIMESTAMP_NTZ",
        "TIMESTAMP": "TIMESTAMP_NTZ",
        "RAW": "BINARY",
        "BLOB": "BINARY",
        "DECIMAL": "DECIMAL",
        "FLOAT": "DOUBLE",
        "DOUBLE PRECISION": "DOUBLE",
    },
    "postgresql": {
        "INTEGER": "INT",
        "SMALLINT": "SMALLINT",
        "BIGINT": "BIGINT",
        "DECIMAL": "DECIMAL",
        "SERIAL": "INT",
        "BIGSERIAL": "BIGINT",
        "FLOAT": "FLOAT",
        "DOUBLE": "DOUBLE",
        "CHAR": "STRING",
        "VARCHAR": "STRING",
        "TEXT": "STRING",
        "BYTEA": "BINARY",
        "BOOLEAN": "BOOLEAN",
        "DATE": "DATE",
        "TIME": "TIME",
        "TIME WITH TIME ZONE": "TIME",
        "INTERVAL": "INTERVAL DAY TO SECOND",
        "TIMESTAMP": "TIMESTAMP_NTZ",
        "TIMESTAMP WITH TIME ZONE": "TIMESTAMP",
        "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP_NTZ",
        "XML": "STRING",
        "BIT": "BINARY",
        "VARBIT": "BINARY",
        "INET": "STRING",
        "CIDR": "STRING",
        "GEOMETRY": "BINARY",
        "JSON": "VARIANT",
        "JSONB": "VARIANT",
    },
    "sqlalchemy": {
        "SA.INTEGER": "INT",
        "SA.FLOAT": "DOUBLE",
        "SA.NUMERIC": "DECIMAL",
        "SA.STRING": "STRING",
        "SA.TEXT": "STRING",
        "SA.DATE": "DATE",
        "SA.TIME": "TIME",
        "SA.DATETIME": "TIMESTAMP_NTZ",
        "SA.TIMESTAMP": "TIMESTAMP_NTZ",
        "SA.INTERVAL": "INTERVAL DAY TO SECOND",
        "SA.BOOLEAN": "BOOLEAN",
        "SA.BINARY": "BINARY",
        "SA.PICKLETYPE": "BINARY",
    },
    "sqlite": {
        "TEXT": "STRING",
        "NUMERIC": "DECIMAL",
        "INTEGER": "BIGINT",
        "REAL": "DOUBLE",
        "NONE": "VARIANT",
    },
    "vfp9": {
        "INTEGER": "INT",
        "NUMERIC": "DECIMAL",
        "DOUBLE": "DOUBLE",
        "FLOAT": "DOUBLE",
        "LOGICAL": "BOOLEAN",
        "CHARACTER": "STRING",
        "VARCHAR": "STRING",
        "MEMO": "STRING",
        "DATE": "DATE",
        "DATETIME": "TIMESTAMP_NTZ",
        "CURRENCY": "DECIMAL(19,4)",
        "VARBINARY": "BINARY",
        "BLOB": "BINARY",
        "GENERAL": "BINARY",
    },
    "web2py": {
        "INTEGER": "INT",
        "DOUBLE": "DOUBLE",
        "STRING": "STRING",
        "TEXT": "STRING",
        "BLOB": "BINARY",
        "TIME": "TIME",
        "DATE": "DATE",
        "DATETIME": "TIMESTAMP_NTZ",
        "BOOLEAN": "BOOLEAN",
        "UPLOAD": "STRING",
        "PASSWORD": "STRING",
    },
}

# Other spellings of a dialect's names.
SYNONYMS: Mapping[str, Mapping[str, str]] = {
    "mysql": {
        "DEC": "DECIMAL",
        "TINYTEXT": "MEDIUMTEXT",
        "TEXT": "MEDIUMTEXT",
        "LONGTEXT": "MEDIUMTEXT",
        "JSON": "MEDIUMTEXT",
        "TINYBLOB": "BLOB",
        "MEDIUMBLOB": "BLOB",
        "LONGBLOB": "BLOB",
        "DOUBLE PRECISION": "DOUBLE",
    },
    "mssql": {"DEC": "DECIMAL"},
    "oracle": {"INT": "INTEGER", "DEC": "DECIMAL"},
    "postgresql": {
        "INT": "INTEGER",
        "NUMERIC": "DECIMAL",
        "SERIAL4": "SERIAL",
        "SERIAL8": "BIGSERIAL",
        "REAL": "FLOAT",
        "DOUBLE PRECISION": "DOUBLE",
        "CHARACTER VARYING": "VARCHAR",
        "BIT VARYING": "VARBIT",
    },
}

# The type a child column takes when its parent column generates its own keys.
FOREIGN_KEY_TYPES: Mapping[str, str] = {"SERIAL": "INTEGER", "BIGSERIAL": "BIGINT"}

UNSIZED_DECIMAL = "DECIMAL(38,18)"


# The next wider type holds the values of an unsigned one.
UNSIGNED: Mapping[str, str] = {"SMALLINT": "INT", "INT": "BIGINT", "BIGINT": "DECIMAL(20,0)"}


def base_type(dialect: str, name: str) -> str | None:
    """Spark type of an exact name, else of its synonym, else None. UNSIGNED widens; SIGNED and ZEROFILL say nothing more."""
    known = DIALECT_TYPES[dialect]
    words = name.upper().split()
    unsigned = "UNSIGNED" in words or "ZEROFILL" in words
    upper = " ".join(w for w in words if w not in ("UNSIGNED", "SIGNED", "ZEROFILL"))
    found = known.get(upper) or known.get(SYNONYMS.get(dialect, {}).get(upper, ""))
    if found and unsigned and upper not in ("TINYINT", "MEDIUMINT", "YEAR"):  # these fit unsigned as they are
        return UNSIGNED.get(found, found)
    return found


def spark_type(dialect: str, declared: str) -> str:
    """Spark type of one declared type such as `DECIMAL(12,2)`; an unknown one is a STRING."""
    return _found_type(dialect, declared) or "STRING"


def known_type(dialect: str, declared: str) -> str:
    """As `spark_type`, but an unknown type is an error."""
    found = _found_type(dialect, declared)
    if found is None:
        raise ValueError(f"{dialect} has no type {declared}")
    return found


def _found_type(dialect: str, declared: str) -> str | None:
    name, _, rest = declared.partition("(")
    size, _, suffix = rest.partition(")") if not name.strip().upper() in ("ENUM", "SET") else ("", "", "")
    size = size.replace(" ", "")
    found = base_type(dialect, f"{name} {suffix}")
    if found == "DECIMAL":
        return f"DECIMAL({size})" if size else UNSIZED_DECIMAL
    if found == "BOOLEAN" and name.strip().upper() == "BIT" and size not in ("", "1"):
        return "BINARY"
    return found


def type_table(spark: SparkSession, dialect: str) -> DataFrame:
    """(type_name, base) of one dialect, synonyms included: at most a few dozen rows."""
    names = {**DIALECT_TYPES[dialect], **{s: DIALECT_TYPES[dialect][n] for s, n in SYNONYMS.get(dialect, {}).items()}}
    unsigned = {f"{n} UNSIGNED": base_type(dialect, f"{n} UNSIGNED") for n, base in names.items() if base in UNSIGNED}
    return spark.createDataFrame(list({**names, **unsigned}.items()), "type_name string, base string")


def map_types(columns: DataFrame, dialect: str, declared: str = "data_type") -> DataFrame:
    """Add `spark_type` and `mapped` for the declared type of each row; the type table is a fixed small one."""
    parsed = columns.withColumn("_type", parse_type(F.col(declared)))
    known = F.broadcast(type_table(columns.sparkSession, dialect))
    joined = parsed.join(known, F.col("_type.name") == F.col("type_name"), "left")
    decimal = F.when(
        F.col("_type.size").isNotNull(), F.concat(F.lit("DECIMAL("), F.replace("_type.size", F.lit(" "), F.lit("")), F.lit(")"))
    ).otherwise(F.lit(UNSIZED_DECIMAL))
    several_bits = (F.col("type_name") == "BIT") & (F.col("base") == "BOOLEAN") & (F.coalesce("_type.size", F.lit("1")) != "1")
    found = F.when(several_bits, F.lit("BINARY")).when(F.col("base") == "DECIMAL", decimal).otherwise(F.coalesce("base", F.lit("STRING")))
    return joined.select(*columns.columns, found.alias("spark_type"), F.col("base").isNotNull().alias("mapped"))


def foreign_key_type(parent_type):
    """Expected declared type of a child column, given the parent's declared type."""
    parsed = parse_type(parent_type)
    name = F.coalesce(*[F.when(parsed["name"] == own, F.lit(child)) for own, child in FOREIGN_KEY_TYPES.items()], parsed["name"])
    return F.when(parsed["size"].isNull(), name).otherwise(F.concat(name, F.lit("("), parsed["size"], F.lit(")")))
