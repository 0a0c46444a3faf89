"""External taggers: which files to send, running one, and folding its answers together."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.scalars import version_at_least

#: Tags with this prefix are one choice of several: the parts vote.
CHOICE = "rating:"


@dataclass(frozen=True)
class Tagger:
    """A tagger's registration; frames of a video are between 1 and 16."""

    name: str
    version: str
    command: tuple[str, ...]
    api_version: int = 1
    kind: str = "cli"
    tag_prefix: str = ""
    max_edge: int = 512
    frames: int = 5

    def __post_init__(self):
        if self.api_version != 1 or self.kind != "cli":
            raise ValueError(f"{self.name}: only command-line taggers of API version 1 run")
        object.__setattr__(self, "frames", min(16, max(1, self.frames)))


def to_send(media: DataFrame, buckets: DataFrame, tagger: Tagger) -> DataFrame:
    """Paths without a bucket (path, plugin, version) of the tagger's version or a later one."""
    done = buckets.filter((F.col("plugin") == tagger.name) & version_at_least(F.col("version"), F.lit(tagger.version))).select("path")
    return media.select("path").join(done, "path", "left_anti")


def run(parts: DataFrame, tagger: Tagger) -> DataFrame:
    """Answers (path, part, tags, meta, error) for parts (path, part, file): one process a partition, a line of JSON each way.

    Answers may come in any order and are matched by file; a part without one has the error 'no result'.
    """
    command = list(tagger.command)

    def talked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            asked = "".join(json.dumps({"file": f}) + "\n" for f in pdf["file"])
            done = subprocess.run(command, input=asked, capture_output=True, text=True, check=False)
            got = {}
            for line in done.stdout.splitlines():
                try:
                    answer = json.loads(line)
                    got.setdefault(answer["file"], answer)
                except (ValueError, KeyError, TypeError):
                    continue
            found = [got.get(f, {"error": "no result"}) for f in pdf["file"]]
            yield pd.DataFrame({"path": pdf["path"], "part": pdf["part"], "tags": [a.get("tags") or [] for a in found], "meta": [json.dumps(a["meta"]) if a.get("meta") is not None else None for a in found], "error": [a.get("error") for a in found]})

    return parts.select("path", "part", "file").mapInPandas(talked, "path string, part bigint, tags array<string>, meta string, error string")


def merged(parts: DataFrame) -> DataFrame:
    """One answer for each item of parts (item, part, tags, meta, error).

    Tags are united in the order they were first seen; choices are voted on, the first seen
    wins a tie and stands last. Only if all parts failed does the item, with the first error.
    """
    failed = parts.groupBy("item").agg(
        F.min(F.when(F.col("error").isNull(), 0).otherwise(1)).alias("failed"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("part"))).alias("error"),
        F.min_by("meta", F.when(F.col("meta").isNotNull(), F.col("part"))).alias("meta"),
    )
    seen = parts.select("item", "part", F.posexplode("tags").alias("k", "tag")).groupBy("item", "tag").agg(F.min(F.struct("part", "k")).alias("first"), F.count("*").alias("votes"))
    choice = F.col("tag").startswith(CHOICE)
    best = Window.partitionBy("item", choice).orderBy(F.desc("votes"), "first")
    kept = seen.withColumn("rank", F.row_number().over(best)).filter(~choice | (F.col("rank") == 1))
    lists = kept.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct(choice.alias("c"), "first", "tag"))), lambda x: x["tag"]).alias("tags"))
    out = failed.join(lists, "item", "left")
    whole = F.col("failed") == 0
    return out.select("item", F.when(whole, F.coalesce("tags", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.when(whole, F.col("meta")).alias("meta"), F.when(~whole, F.col("error")).alias("error"))


def report(sent: DataFrame, skipped: int) -> DataFrame:
    """Counts of tagged, skipped and failed files of answers (item, error)."""
    return sent.agg(F.count_if(F.col("error").isNull()).alias("tagged"), F.lit(skipped).cast("bigint").alias("skipped"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def replaced_bucket(tags: DataFrame, answers: DataFrame, tagger: Tagger) -> DataFrame:
    """The tag rows after a run: a tagger's rows of an answered file are replaced as a whole."""
    space = f"plugin.{tagger.name}"
    ok = answers.filter("error is null")
    old = tags.join(ok.select(F.col("item").alias("path"), F.lit(space).alias("namespace")), ["path", "namespace"], "left_anti")
    fresh = ok.select(F.col("item").alias("path"), F.lit(space).alias("namespace"), F.explode("tags").alias("tag"))
    fresh = fresh.withColumn("tag", F.concat(F.lit(tagger.tag_prefix), F.col("tag"))).withColumn("position", F.lit(None).cast("int"))
    return old.select("path", "namespace", "tag", "position").unionByName(fresh)
