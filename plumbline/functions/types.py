"""Logical types: one normaliser for several dialects, display, and the two compatibility relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIND = "struct<kind:string,precision:int,scale:int,element:string>"

# Type names of each dialect by kind.
NAMES: dict[str, dict[str, list[str]]] = {
    "contract": {
        "INT": ["int", "integer", "bigint", "smallint", "tinyint", "int64", "int4", "int8"],
        "FLOAT": ["float", "double", "real", "float64", "float8"],
        "STRING": ["string", "varchar", "char", "text", "character varying", "character"],
        "BOOL": ["bool", "boolean"],
        "DATE": ["date"],
        "TIMESTAMP": ["timestamp", "datetime", "timestamp_ntz", "timestamp_ltz", "timestamp_tz"],
        "JSON": ["json", "jsonb", "variant", "object"],
    },
    "bigquery": {
        "BOOL": ["bool", "boolean"],
        "INT": ["int64", "integer", "int", "smallint", "tinyint", "byteint"],
        "FLOAT": ["float64", "float"],
        "DECIMAL": ["numeric", "bignumeric", "decimal"],
        "STRING": ["string", "bytes", "geography"],
        "DATE": ["date"],
        "TIMESTAMP": ["datetime", "timestamp", "time"],
        "JSON": ["json"],
        "ARRAY": ["array"],
        "STRUCT": ["struct", "record"],
    },
    "snowflake": {
        "BOOL": ["boolean"],
        "DECIMAL": ["number", "decimal", "numeric"],
        "INT": ["int", "integer", "bigint", "smallint", "tinyint", "byteint"],
        "FLOAT": ["float", "float4", "float8", "double", "double precision", "real"],
        "STRING": ["varchar", "string", "text", "char", "character", "nvarchar", "nchar", "binary", "varbinary", "geography", "geometry"],
        "DATE": ["date"],
        "TIMESTAMP": ["datetime", "timestamp", "timestamp_ntz", "timestamp_ltz", "timestamp_tz", "time"],
        "JSON": ["variant", "object"],
        "ARRAY": ["array"],
    },
    "postgres": {
        "BOOL": ["boolean", "bool"],
        "INT": ["smallint", "int2", "integer", "int", "int4", "bigint", "int8", "serial", "serial4", "bigserial", "serial8", "smallserial", "serial2", "oid", "regclass", "regproc", "regtype", "regnamespace"],
        "FLOAT": ["real", "float4", "double precision", "float8", "float"],
        "DECIMAL": ["numeric", "decimal", "money"],
        "STRING": [
            "character varying", "varchar", "character", "char", "bpchar", "text", "name", "citext", "bytea", "interval", "uuid", "xml",
            "point", "line", "lseg", "box", "path", "polygon", "circle", "inet", "cidr", "macaddr", "macaddr8", "bit", "bit varying", "varbit",
            "tsvector", "tsquery", "int4range", "int8range", "numrange", "tsrange", "tstzrange", "daterange", "pg_lsn", "pg_snapshot",
        ],
        "DATE": ["date"],
        "TIMESTAMP": ["timestamp without time zone", "timestamp", "timestamp with time zone", "timestamptz", "time without time zone", "time", "time with time zone", "timetz"],
        "JSON": ["json", "jsonb"],
        "ARRAY": ["array"],
    },
}
NAMES["redshift"] = NAMES["postgres"]
# Precision and scale of a decimal without parameters.
BARE = {"contract": (None, None), "bigquery": (38, 9), "snowflake": (38, 0), "postgres": (None, None), "redshift": (None, None)}


def struct(kind: Column, precision: Column | None = None, scale: Column | None = None, element: Column | None = None) -> Column:
    none = F.lit(None)
    parts = {"kind": kind, "precision": none if precision is None else precision, "scale": none if scale is None else scale, "element": none if element is None else element}
    return F.struct(*[v.cast("string" if k in ("kind", "element") else "int").alias(k) for k, v in parts.items()])


def _known(base: Column, dialect: str) -> Column:
    """The kind of a type's name, null for one that the dialect doesn't have."""
    pairs = [F.lit(x) for kind, names in NAMES[dialect].items() for n in names for x in (n, kind)]
    return F.create_map(*pairs)[base]


def _lookup(base: Column, dialect: str) -> Column:
    return F.coalesce(_known(base, dialect), F.lit("UNKNOWN"))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def normalise(raw: Column, dialect: str = "contract", parity: bool = False) -> Column:
    """A type's text as <kind, precision, scale, element>; null stays null.

    ``contract`` takes names exactly and leaves a decimal's missing scale open when ``parity`` is set; otherwise a
    name without its parameters, in any of the dialects, counts as well and the scale is 0.
    """
    low = F.lower(F.trim(raw)) if not (dialect == "contract" and parity) else F.lower(raw)
    inner = F.regexp_extract(low, r"\(([^)]*)\)", 1)
    parts = F.split(inner, ",")
    given = low.contains("(")
    precision = F.when(given, _number(F.get(parts, F.lit(0))))
    second = _number(F.get(parts, F.lit(1)))
    no_scale = F.size(parts) == 1
    if dialect == "contract":
        scale = F.when(given, second if parity else F.when(no_scale, F.lit(0)).otherwise(second))
        kind = _lookup(low, "contract")
        if not parity:
            base = F.trim(F.regexp_replace(F.regexp_replace(low, r"\(.*?\)", ""), r"\s+", " "))
            kind = F.coalesce(_known(low, "contract"), *[_known(base, d) for d in ("contract", "postgres", "snowflake", "bigquery")], F.lit("UNKNOWN"))
            element = F.regexp_extract(low, r"^array\s*<(.*)>$", 1)
            within = F.when(element != "", _lookup(F.trim(F.regexp_replace(element, r"\(.*?\)", "")), "contract")).otherwise("UNKNOWN")
        else:
            within = F.lit("UNKNOWN")
        is_decimal = low.startswith("decimal") | low.startswith("numeric") | (kind == "DECIMAL")
        return (
            F.when(raw.isNull(), F.lit(None))
            .when(is_decimal, struct(F.lit("DECIMAL"), precision, scale))
            .when(low.startswith("array"), struct(F.lit("ARRAY"), element=within))
            .when(low.startswith("struct") | low.startswith("record"), struct(F.lit("STRUCT")))
            .otherwise(struct(kind))
        )
    base = F.trim(F.regexp_extract(low, r"^([^(<]*)" if dialect == "bigquery" else r"^([^(]*)", 1))
    kind = _lookup(base, dialect)
    bare_p, bare_s = BARE[dialect]
    decimal = F.when(given, struct(F.lit("DECIMAL"), precision, F.when(no_scale, F.lit(0)).otherwise(second))).otherwise(struct(F.lit("DECIMAL"), F.lit(bare_p), F.lit(bare_s)))
    out = F.when(raw.isNull(), F.lit(None))
    if dialect == "snowflake":  # a scale of 0 makes an integer, a bare number doesn't
        out = out.when((kind == "DECIMAL") & given & (no_scale | (second == 0)), struct(F.lit("INT")))
    if dialect in ("postgres", "redshift"):
        listed = F.when(low.endswith("[]"), F.regexp_replace(low, r"\[\]$", "")).when(low.startswith("_"), F.regexp_replace(low, "^_", ""))
        out = out.when(base == "money", struct(F.lit("DECIMAL"), F.lit(19), F.lit(2)))
        inside = F.regexp_extract(listed, r"^([^(]*)", 1)
        out = out.when((kind == "UNKNOWN") & listed.isNotNull(), struct(F.lit("ARRAY"), element=_lookup(F.trim(inside), dialect)))
    if dialect == "bigquery":
        inside = F.regexp_extract(low, r"^array<(.*)>$", 1)
        out = out.when(kind == "ARRAY", struct(F.lit("ARRAY"), element=_lookup(F.trim(F.regexp_extract(inside, r"^([^(<]*)", 1)), dialect)))
    return out.when(kind == "DECIMAL", decimal).when(kind == "ARRAY", struct(kind, element=F.lit("UNKNOWN"))).otherwise(struct(kind))


def logical(kind: T.DataType) -> dict:
    """The logical type of a Spark type."""
    out = {"kind": "UNKNOWN", "precision": None, "scale": None, "element": None}
    if isinstance(kind, T.BooleanType):
        out["kind"] = "BOOL"
    elif isinstance(kind, T.DecimalType):
        out |= {"kind": "DECIMAL", "precision": kind.precision, "scale": kind.scale}
    elif isinstance(kind, T.IntegralType):
        out["kind"] = "INT"
    elif isinstance(kind, T.FractionalType):
        out["kind"] = "FLOAT"
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        out["kind"] = "STRING"
    elif isinstance(kind, T.DateType):
        out["kind"] = "DATE"
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out["kind"] = "TIMESTAMP"
    elif isinstance(kind, T.VariantType):
        out["kind"] = "JSON"
    elif isinstance(kind, T.StructType):
        out["kind"] = "STRUCT"
    elif isinstance(kind, T.ArrayType):
        out |= {"kind": "ARRAY", "element": logical(kind.elementType)["kind"]}
    return out


def display(t: Column) -> Column:
    """A type as it is shown: DECIMAL with what is known of its parameters, others by kind."""
    args = F.concat_ws(", ", t["precision"], F.when(t["precision"].isNotNull(), t["scale"]))
    return F.when((t["kind"] == "DECIMAL") & t["precision"].isNotNull(), F.concat(F.lit("DECIMAL("), args, F.lit(")"))).otherwise(t["kind"])


def compatible(a: Column, b: Column) -> Column:
    """Whether a contract's type takes the other: numbers mix except FLOAT and DECIMAL, and UNKNOWN takes all."""

    def kinds(x: Column, y: Column) -> Column:
        mixed = (x == "INT") & y.isin("FLOAT", "DECIMAL") | (y == "INT") & x.isin("FLOAT", "DECIMAL")
        return (x == y) | (x == "UNKNOWN") | (y == "UNKNOWN") | mixed

    arrays = (a["kind"] == "ARRAY") & (b["kind"] == "ARRAY")
    element = lambda t: F.coalesce(t["element"], F.lit("UNKNOWN"))
    return F.when(arrays, kinds(element(a), element(b))).otherwise(kinds(a["kind"], b["kind"]))


def same(a: Column, b: Column, parity: bool = False) -> Column:
    """Whether no drift lies between the types; ``parity``: arrays and structs never match, even themselves."""
    decimal = a["precision"].eqNullSafe(b["precision"]) & a["scale"].eqNullSafe(b["scale"])
    nested = F.lit(False) if parity else a["element"].eqNullSafe(b["element"])
    equal = F.when(a["kind"] != b["kind"], False).when(a["kind"] == "DECIMAL", decimal).when(a["kind"].isin("ARRAY", "STRUCT"), nested).otherwise(True)
    return F.when((a["kind"] == "UNKNOWN") | (b["kind"] == "UNKNOWN"), True).otherwise(equal)
