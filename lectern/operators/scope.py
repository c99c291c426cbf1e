"""Whose rows: tenants and users, logins and keys, searches and listings inside a scope, guards of links and paths."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of fields that hold secrets, and addresses that are not public.
SECRET = "api.?key|authorization|token|secret|password"
PRIVATE = "^(?:0\\.|10\\.|127\\.|169\\.254\\.|192\\.168\\.|172\\.(?:1[6-9]|2\\d|3[01])\\.|192\\.0\\.[02]\\.|198\\.1[89]\\.|2(?:4\\d|5[0-5])\\.|\\[?::1\\]?$|\\[?f[cd]|\\[?fe80)"


def scoped(df: DataFrame, tenant: str, user: str) -> DataFrame:
    """Rows of one user; both filters reach the scan, and prune where a table is partitioned by them."""
    return df.where((F.col("tenant_id") == tenant) & (F.col("user_id") == user))


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal every value that is given; None and blanks set no condition."""
    for c, v in equal.items():
        if v not in (None, ""):
            df = df.where(F.col(c) == v)
    return df


def among(df: DataFrame, key: str, values: list | DataFrame) -> DataFrame:
    """Rows whose key is in a short list, or in a table of keys."""
    return df.join(values.select(key).distinct(), key, "left_semi") if isinstance(values, DataFrame) else df.where(F.col(key).isin(*values))


def contains_ignoring_case(text: Column, query: str) -> Column:
    """As a plain substring: wildcards in the query are characters like others."""
    return F.lower(F.coalesce(text, F.lit(""))).contains(query.lower())


def found_by(df: DataFrame, query: str, columns: list[str], order: list[Column], limit: int) -> DataFrame:
    """Rows with the query in one of the columns, all for a blank query; in order, ``limit`` at most."""
    hit = F.lit(query == "")
    for c in columns:
        hit = hit | contains_ignoring_case(F.col(c), query)
    return df.where(hit).orderBy(*order).limit(limit)


def listing(df: DataFrame, order: list[Column], limit: int, most: int = 200) -> DataFrame:
    """The first rows in an order, 1 to ``most`` of them."""
    return df.orderBy(*order).limit(max(1, min(limit, most)))


def logins(users: DataFrame, tenants: DataFrame) -> DataFrame:
    """Active users of active tenants."""
    t = tenants.where("status = 'active'").select("tenant_id", F.col("name").alias("tenant_name"))
    return users.where("status = 'active'").join(t, "tenant_id")


def login(users: DataFrame, tenants: DataFrame, attempts: DataFrame) -> DataFrame:
    """``attempts`` (attempt, username, password, tenant_id or null) with ``user_id`` where name, hash and tenant agree."""
    u = logins(users, tenants).select(F.col("tenant_id").alias("__t"), "user_id", F.col("username").alias("__u"), "password_hash")
    a = attempts.withColumn("__h", F.sha2("password", 256))
    same = (F.trim(a["username"]) == u["__u"]) & (a["tenant_id"].isNull() | (F.trim(a["tenant_id"]) == u["__t"])) & (a["__h"] == u["password_hash"])
    best = a.join(u, same).groupBy("attempt").agg(F.min_by("user_id", F.struct("__t", "user_id")).alias("user_id"))
    return attempts.join(best, "attempt", "left").drop("password")


def key_entries(settings: DataFrame, column: str) -> DataFrame:
    """(api_key, tenant_id, user_id, label) of lists of key:tenant:user; entries of another form are passed over."""
    d = settings.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), ",")).alias("x")).select(F.split(F.trim("x"), ":").alias("p")).where("size(p) = 3")
    return d.select(F.col("p")[0].alias("api_key"), F.col("p")[1].alias("tenant_id"), F.col("p")[2].alias("user_id"), F.concat(F.left(F.col("p")[0], F.lit(4)), F.lit("***")).alias("label"))


def users_of_keys(keys: DataFrame, *tables: DataFrame) -> DataFrame:
    """``keys`` (api_key) with tenant and user of the first table that knows them; null where none does."""
    d = keys
    for i, t in enumerate(tables):
        one = t.groupBy("api_key").agg(F.min(F.struct("tenant_id", "user_id")).alias(f"__{i}"))
        d = d.join(one, "api_key", "left")
    found = F.coalesce(*[F.col(f"__{i}") for i in range(len(tables))])
    return d.select(*keys.columns, found["tenant_id"].alias("tenant_id"), found["user_id"].alias("user_id"))


def has_role(roles: Column, role: str = "tenant_admin") -> Column:
    return F.coalesce(F.array_contains(roles, role), F.lit(False))


def is_public_url(url: Column) -> Column:
    """http or https to a host that is no local name and no private address. Names are not resolved."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(F.trim(url), F.lit("PROTOCOL")))
    local = host.isin("localhost", "localhost.localdomain") | host.endswith(".local") | host.rlike(PRIVATE)
    return F.coalesce(scheme.isin("http", "https") & (host != "") & ~local, F.lit(False))


def knowledge_url(url: Column) -> Column:
    """The page's address, blank where it is a download of a closed format."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(F.lower(u).contains(".caj"), "").otherwise(u)


def inside(path: Column, root: Column) -> Column:
    """Whether a path, once its . and .. are resolved, lies in a folder."""
    def resolved(p: Column) -> Column:
        parts = F.filter(F.split(p, "/+"), lambda x: ~x.isin("", "."))
        up = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))))
        return F.concat(F.lit("/"), F.array_join(up, "/"))

    at, top = resolved(path), resolved(root)
    return (at == top) | at.startswith(F.concat(F.when(top == "/", "").otherwise(top), F.lit("/")))


def full_text_available(source: Column, arxiv: Column, open_access: Column, pdf_url: Column) -> Column:
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    return (F.coalesce(source, F.lit("")) == "arxiv") | known(arxiv) | (F.coalesce(open_access, F.lit(False)) & known(pdf_url))


def _clean(value, secret):
    if isinstance(value, dict):
        return {k: "[REDACTED]" if secret.search(k) else _clean(v, secret) for k, v in value.items()}
    if isinstance(value, list):
        return [_clean(v, secret) for v in value[:100]]
    return value[:8000] if isinstance(value, str) else value


@F.pandas_udf(StringType())
def redacted(text: pd.Series) -> pd.Series:
    """JSON of any depth with secrets' values taken out, lists and strings cut; what is no JSON is null."""
    secret = re.compile(SECRET, re.IGNORECASE)

    def one(t):
        try:
            return json.dumps(_clean(json.loads(t), secret), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return text.map(one)


def redacted_map(fields: Column) -> Column:
    """A flat map of strings, by expressions alone."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).rlike(SECRET), "[REDACTED]").otherwise(F.left(v, F.lit(8000))))
