"""Sources of actual schemas: one interface, and errors with a kind."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from typing import Protocol

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import types as L

COLUMNS = f"relation string, ordinal int, name string, type {L.KIND}, nullable boolean"


class FetchError(Exception):
    """``kind``: connection, authentication, permission, not_found, query, unsupported or other."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def kind_of(error: Exception) -> str:
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    text = f"{condition or ''} {error}".lower()
    for kind, words in (("not_found", ("table_or_view_not_found", "path_not_found", "does not exist")), ("permission", ("permission", "access denied")), ("authentication", ("authentication", "password")), ("connection", ("connection", "refused", "timeout", "no suitable driver")), ("query", ("parse_syntax_error", "unresolved"))):
        if any(w in text for w in words):
            return kind
    return "other"


class Adapter(Protocol):
    name: str

    def fetch_schema(self, table: str) -> T.StructType: ...

    def test_connection(self) -> None: ...


class SparkAdapter:
    """Tables and views of the session's catalog."""

    name = "spark"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def fetch_schema(self, table: str) -> T.StructType:
        try:
            return self.spark.table(table).schema
        except AnalysisException as e:
            raise FetchError(kind_of(e), str(e)) from e

    def test_connection(self) -> None:
        self.spark.sql("SELECT 1").collect()


class ParquetAdapter(SparkAdapter):
    """Parquet tables of a folder; only footers are read."""

    name = "parquet"

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark)
        self.folder = folder

    def fetch_schema(self, table: str) -> T.StructType:
        try:
            return self.spark.read.parquet(f"{self.folder}/{table}.parquet").schema
        except AnalysisException as e:
            raise FetchError(kind_of(e), str(e)) from e


class JdbcAdapter(SparkAdapter):
    """A warehouse by JDBC: its INFORMATION_SCHEMA gives the columns as rows. Drivers are the user's to provide."""

    #: Dialects that fold unquoted names to upper case.
    UPPER = ("snowflake",)

    def __init__(self, spark: SparkSession, url: str, dialect: str, options: dict[str, str] | None = None):
        super().__init__(spark)
        self.url, self.name, self.options = url, dialect, options or {}

    def query(self, schema: str, table: str) -> str:
        if self.name in self.UPPER:
            schema, table = schema.upper(), table.upper()
        quoted = [x.replace("'", "''") for x in (schema, table)]
        return f"SELECT column_name, data_type, is_nullable, ordinal_position, numeric_precision, numeric_scale FROM information_schema.columns WHERE table_schema = '{quoted[0]}' AND table_name = '{quoted[1]}'"

    def fetch_rows(self, schema: str, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, query=self.query(schema, table), **self.options).load()

    def fetch_schema(self, table: str) -> T.StructType:
        try:
            return self.spark.read.format("jdbc").options(url=self.url, dbtable=table, **self.options).load().schema
        except Exception as e:  # drivers raise their own errors
            raise FetchError(kind_of(e), str(e)) from e

    def test_connection(self) -> None:
        try:
            self.spark.read.format("jdbc").options(url=self.url, query="SELECT 1 AS one", **self.options).load().collect()
        except Exception as e:
            raise FetchError(kind_of(e), str(e)) from e


def snowflake_options(account: str, user: str, *, password: str | None = None, key_pem: str | None = None, warehouse: str | None = None, role: str | None = None, database: str | None = None) -> tuple[str, dict[str, str]]:
    """JDBC url and options of a Snowflake connection, by password or by a private key's PEM text, but not both."""
    if not account or not user or bool(password) == bool(key_pem):
        raise FetchError("authentication", "an account, a user and either a password or a private key are needed")
    given = {"user": user, "password": password, "private_key_base64": key_pem and "".join(x for x in key_pem.splitlines() if "-----" not in x), "warehouse": warehouse, "role": role, "db": database}
    return f"jdbc:snowflake://{account}.snowflakecomputing.com/", {k: v for k, v in given.items() if v}


def bigquery_options(project: str, *, key_path: str | None = None, key_json: str | None = None) -> tuple[str, dict[str, str]]:
    """JDBC url and options of a BigQuery connection: a key file, a key's JSON text, or the machine's default account."""
    if not project or key_path and key_json:
        raise FetchError("authentication", "a project and at most one of a key's path and a key's text are needed")
    url = "jdbc:bigquery://https://www.googleapis.com/bigquery/v2:443;ProjectId=" + project
    if key_json:
        try:
            mail = json.loads(key_json)["client_email"]
        except (ValueError, KeyError, TypeError) as e:
            raise FetchError("authentication", "the key's text isn't a service account's JSON") from e
        return url, {"OAuthType": "0", "OAuthServiceAcctEmail": mail, "OAuthPvtKey": key_json}
    return url, {"OAuthType": "0", "OAuthPvtKeyPath": key_path} if key_path else {"OAuthType": "3"}


def postgres_options(host: str, database: str, user: str, password: str | None = None, port: int = 5432, ssl: bool = False) -> tuple[str, dict[str, str]]:
    """JDBC url and options of a Postgres or Redshift connection."""
    if not host or not database or not user:
        raise FetchError("authentication", "a host, a database and a user are needed")
    given = {"user": user, "password": password, "ssl": "true" if ssl else None, "sslmode": "verify-full" if ssl else None}
    return f"jdbc:postgresql://{host}:{port}/{database}", {k: v for k, v in given.items() if v}


class MockAdapter:
    """Given schemas and errors, for tests."""

    name = "mock"

    def __init__(self, schemas: dict[str, T.StructType] | None = None, errors: dict[str, FetchError] | None = None, down: bool = False, latency: float = 0.0):
        self.schemas, self.errors, self.down, self.latency = dict(schemas or {}), dict(errors or {}), down, latency

    def with_table(self, table: str, ddl: str) -> MockAdapter:
        return MockAdapter(self.schemas | {table: T.StructType.fromDDL(ddl)}, self.errors, self.down, self.latency)

    def fetch_schema(self, table: str) -> T.StructType:
        self.test_connection()
        time.sleep(self.latency)
        if table in self.errors:
            raise self.errors[table]
        if table not in self.schemas:
            raise FetchError("not_found", f"table {table} not found")
        return self.schemas[table]

    def test_connection(self) -> None:
        if self.down:
            raise FetchError("connection", "mock connection is down")


def columns_frame(spark: SparkSession, schemas: dict[str, T.StructType]) -> DataFrame:
    """Rows (relation, ordinal, name, type, nullable) of schemas by relation."""
    rows = [(r, i + 1, f.name, tuple(L.logical(f.dataType).values()), f.nullable) for r, s in schemas.items() for i, f in enumerate(s)]
    return spark.createDataFrame(rows, COLUMNS)


def fetch_all(spark: SparkSession, adapter: Adapter, tables: Iterable[str]) -> tuple[DataFrame, dict[str, FetchError]]:
    """Columns of all tables that can be read, and the errors of the others."""
    found, errors = {}, {}
    for t in tables:
        try:
            found[t] = adapter.fetch_schema(t)
        except FetchError as e:
            errors[t] = e
    return columns_frame(spark, found), errors
