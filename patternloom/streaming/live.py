"""Live variants on Structured Streaming: counts by minute with a watermark, and clustering with kept state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import clp
from ..functions.timestamps import extract_timestamp, strip_timestamp
from ..operators.drain import DrainConfig, Leaf, TokenCountGroup, _Cluster


def parse_stream(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """raw, ts, stripped, logtype of a stream with a ``raw`` column."""
    rows = lines.withColumn("__m", extract_timestamp(F.col("raw"), default_year))
    rows = rows.withColumn("stripped", strip_timestamp(F.col("raw"), F.col("__m")))
    return rows.select("raw", F.col("__m.ts").alias("ts"), "stripped", clp.logtype(F.col("stripped")).alias("logtype"))


def minute_counts(parsed: DataFrame, late: str = "10 minutes") -> DataFrame:
    """minute (window start), logtype, n; lines later than ``late`` are left out."""
    kept = parsed.where("ts IS NOT NULL").withWatermark("ts", late)
    return kept.groupBy(F.window("ts", "1 minute"), "logtype").agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "logtype", "n")


def _load(state: str, config: DrainConfig) -> TokenCountGroup:
    group = TokenCountGroup(config)
    for first, founder, words in json.loads(state):
        cluster = _Cluster(founder, words)
        group.leaves.setdefault(first, Leaf()).add(cluster)
        group.recent[founder] = cluster
    return group


def _save(group: TokenCountGroup) -> str:
    names = {id(leaf): first for first, leaf in group.leaves.items()}
    return json.dumps([[names[id(c.leaf)], k, c.template] for k, c in group.recent.items()])


def live_templates(parsed: DataFrame, config: DrainConfig = DrainConfig()) -> DataFrame:
    """token_count, cluster, template, n, version for every cluster that a micro-batch touches (update mode).

    Clusters are numbered within their token count; a template may gain wildcards in later versions.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, counts, version = state.get if state.exists else ("[]", "{}", 0)
        group, sizes = _load(text, config), {int(k): v for k, v in json.loads(counts).items()}
        new, touched = max(sizes, default=0), {}
        for frame in frames:
            for words in frame["words"]:
                cluster = group.add(list(words), new + 1)
                new = max(new, cluster.founder)
                sizes[cluster.founder] = sizes.get(cluster.founder, 0) + 1
                touched[cluster.founder] = cluster
        state.update((_save(group), json.dumps(sizes), version + 1))
        rows = [(key[0], k, " ".join(c.template), sizes[k], version + 1) for k, c in touched.items()]
        yield pd.DataFrame(rows, columns=["token_count", "cluster", "template", "n", "version"])

    keyed = parsed.select(clp.tokens(F.col("logtype")).alias("words")).withColumn("token_count", F.size("words"))
    schema = "token_count int, cluster long, template string, n long, version int"
    return keyed.groupBy("token_count").applyInPandasWithState(step, schema, "clusters string, sizes string, version int", "update", GroupStateTimeout.NoTimeout)
