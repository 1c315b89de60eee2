"""Sessions and database settings from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession


def get_session(app_name: str = "starloom", master: str | None = None, **more: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI semantics. SPARK_MASTER names the master where none is given."""
    builder = SparkSession.builder.appName(app_name)
    if master := master or os.environ.get("SPARK_MASTER"):
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | more
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Database:
    """Where a warehouse database is. Read from DB_HOST, DB_PORT, DB_NAME, DB_USER and DB_PASSWORD."""

    host: str
    port: int
    name: str
    user: str
    password: str
    driver: str = "org.postgresql.Driver"

    @classmethod
    def from_env(cls) -> Database:
        absent = [k for k in ("DB_HOST", "DB_NAME", "DB_USER", "DB_PASSWORD") if not os.environ.get(k)]
        if absent:
            raise KeyError(f"not set: {', '.join(absent)}")
        e = os.environ
        return cls(e["DB_HOST"], int(e.get("DB_PORT", "5432")), e["DB_NAME"], e["DB_USER"], e["DB_PASSWORD"])

    @property
    def url(self) -> str:
        return f"jdbc:postgresql://{self.host}:{self.port}/{self.name}"

    @property
    def properties(self) -> dict[str, str]:
        return {"user": self.user, "password": self.password, "driver": self.driver}
