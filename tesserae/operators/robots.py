"""Robots permission of pages, and the outcome of fetches."""

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.rules import robots_state
from tesserae.functions.urls import canonical_origin, is_text


def with_permission(pages: DataFrame, rules: DataFrame, url: str, agent: str = "*") -> DataFrame:
    """pages with `allowed`. rules: origin, status, body. No robots file allows all; one that could not be read, or was never asked for, denies all."""

    @F.pandas_udf("boolean")
    def permits(bodies: pd.Series, urls: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}

        def one(body, u):
            if body is None:
                return False
            if body not in parsers:
                parsers[body] = RobotFileParser()
                parsers[body].parse(body.splitlines())
            return parsers[body].can_fetch(agent, u)

        return pd.Series([one(b, u) for b, u in zip(bodies, urls, strict=True)], dtype=bool)

    known = rules.select("origin", robots_state(F.col("status")).alias("_state"), F.col("body").alias("_body"))
    joined = pages.withColumn("origin", canonical_origin(F.col(url))).join(known, "origin", "left")
    state = F.coalesce("_state", F.lit("error"))
    body = F.when(state == "ok", F.coalesce("_body", F.lit(""))).when(state == "absent", F.lit(""))
    return joined.withColumn("allowed", permits(body, F.col(url))).drop("origin", "_state", "_body")


def fetched_text(status: Column, content_type: Column, size: Column, cap: int) -> Column:
    """Why a text fetch is not used, or `ok`: only status 200, text types, and no more than the cap."""
    return F.when(status.isin(301, 302, 303, 307, 308), "redirect").when(~(status == 200), "status").when(~is_text(content_type), "type").when(size > cap, "size").otherwise("ok")


def fetched_image(status: Column, content_type: Column, size: Column, cap: int = 8 * 1024 * 1024) -> Column:
    kind = F.coalesce(F.startswith(F.lower(content_type), F.lit("image/")), F.lit(False))
    return F.when(~(status == 200), "status").when(~kind, "type").when(size > cap, "size").otherwise("ok")


def all_public(addresses: DataFrame, host: str, address: str) -> DataFrame:
    """(host, public): whether every address that a host resolves to is public."""
    from tesserae.functions.urls import is_public

    return addresses.withColumn("_p", is_public(F.col(address))).groupBy(host).agg(F.bool_and("_p").alias("public"))


def after_redirect(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, outcome, body) of fetches that may follow one redirect, to the same host and public addresses only.

    first: key, url, outcome, location, body; second, fetched from the resolved location: key, outcome, body, public.
    """
    from tesserae.functions.urls import resolved, same_host

    target = resolved(F.col("url"), F.col("location"))
    asked = first.withColumn("_follow", (F.col("outcome") == "redirect") & F.coalesce(same_host(F.col("url"), target), F.lit(False)))
    met = asked.join(second.select(key, F.col("outcome").alias("_then"), F.col("body").alias("_body"), "public"), key, "left")
    follows = F.col("_follow") & F.coalesce("public", F.lit(False))
    outcome = F.when(follows, F.coalesce("_then", F.lit("error"))).when(F.col("_follow") & F.col("public").isNotNull(), "address").otherwise(F.col("outcome"))
    return met.select(key, outcome.alias("outcome"), F.when(follows, F.col("_body")).when(F.col("outcome") == "ok", F.col("body")).alias("body"))
