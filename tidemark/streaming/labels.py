"""Labels from outside: requests and answers as JSON files, read as a stream.

A request lists points with their context; whoever answers writes (group_id, id, label) files. The answers are a
Structured Streaming source, so each is processed once per checkpoint, and what they feed must allow for a batch that comes
twice. No network is involved.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolution import IncrementalResolution
from ..plans.scratch import materialize, new_path

ANSWERS = "group_id string, id string, label double, worker string"


@dataclass(frozen=True)
class RequestConfig:
    """How a group of points is asked: kind ``er`` (do two records match?) or ``sa`` (sentiment)."""

    task_type: str = "er"
    max_points_per_task: int = 5
    votes_per_point: int = 1
    options: dict = field(default_factory=dict)


def er_context(left: list[str], right: list[str]):
    """Context of a pair: the two records' fields."""
    return F.array(F.array(*[F.col(c).cast("string") for c in left]), F.array(*[F.col(c).cast("string") for c in right]))


def sa_context(text: str):
    """Context of a text."""
    return F.col(text).cast("string")


def requests(points: DataFrame, group_id: str, config: RequestConfig, fields: list[str] | None = None) -> DataFrame:
    """One JSON request per task of ``max_points_per_task`` points (id, context): a column ``value``.

    Tasks are dealt by a hash, so that nothing is numbered in one place; a task may hold fewer or more points.
    """
    n = max(1, -(-points.count() // config.max_points_per_task))
    task = F.pmod(F.xxhash64("id"), F.lit(n))
    head = json.dumps({"task_type": config.task_type, "task_batch_size": config.max_points_per_task, "num_assignments": config.votes_per_point, **config.options}, sort_keys=True)
    context = json.dumps({"fields": fields or []})
    body = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string").alias("key"), F.col("context").alias("value")))))
    grouped = points.groupBy(task.alias("task")).agg(body.alias("content"))
    made = F.concat(F.lit('{"configuration":' + head + f',"group_id":{json.dumps(group_id)},"group_context":' + context + ',"content":'), F.to_json("content"), F.lit("}"))
    return grouped.select(made.alias("value"))


def answer_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Answers as they arrive."""
    return spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def votes(answers: DataFrame, positive: float = 0.5) -> DataFrame:
    """(id, label): 1 if the mean of a point's votes, each worker's once, is above ``positive``."""
    once = answers.groupBy("id", "worker").agg(F.max("label").alias("label"))
    return once.groupBy("id").agg((F.avg("label") > positive).cast("double").alias("label"))


def pending(points: DataFrame, answers: DataFrame) -> DataFrame:
    """Points without an answer; none left means that the group is complete."""
    return points.join(answers.select("id"), "id", "left_anti")


def unknown(points: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers to points that nobody asked about."""
    return answers.join(points.select("id"), "id", "left_anti")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None):
    """Runs ``handle`` on every batch that is there, then stops."""
    path = checkpoint or new_path(stream.sparkSession, "stream")
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", path).trigger(availableNow=True).start()


@dataclass
class FileLabels:
    """Label source over answer files: waits for what is there, and labels the points asked for."""

    spark: SparkSession
    folder: str

    def label(self, points: DataFrame) -> DataFrame:
        got = votes(self.spark.read.schema(ANSWERS).json(self.folder))
        return points.select("id").join(got, "id")


@dataclass
class CrowdStrategy:
    """Asks for labels of all points, hears of answers batch by batch, and waits until every point has one."""

    spark: SparkSession
    outbox: str
    inbox: str
    config: RequestConfig = field(default_factory=RequestConfig)

    def send(self, points: DataFrame, group_id: str, fields: list[str] | None = None) -> int:
        """Writes the requests of points (id, context); how many there are."""
        made = materialize(requests(points, group_id, self.config, fields), "requests")
        made.write.mode("append").text(self.outbox)
        return made.count()

    def run(self, points: DataFrame, group_id: str, on_result: Callable[[DataFrame], None], checkpoint: str | None = None, timeout: float = 0.0, pause: float = 1.0, fields: list[str] | None = None) -> DataFrame:
        """Sends the points, hands every batch of their (id, label) to ``on_result``, and gives all of them back.

        Answers are looked for until all points have one or ``timeout`` seconds are over; then what is missing is an error.
        """
        self.send(points, group_id, fields)
        path, until = checkpoint or new_path(self.spark, "crowd"), time.monotonic() + timeout
        asked = points.select("id")

        def handle(batch: DataFrame, _: int) -> None:
            got = materialize(votes(batch.where(F.col("group_id") == group_id)).join(asked, "id", "left_semi"), "answers")
            if not got.isEmpty():
                on_result(got)

        while True:
            each_batch(answer_stream(self.spark, self.inbox), handle, path).awaitTermination()
            answers = self.spark.read.schema(ANSWERS).json(self.inbox).where(F.col("group_id") == group_id)
            left = pending(points, answers).count()
            if not left:
                return votes(answers).join(asked, "id", "left_semi")
            if time.monotonic() >= until:
                raise TimeoutError(f"{left} points of {group_id} have no answer")
            time.sleep(pause)


def stream_resolution(resolution: IncrementalResolution, pairs: DataFrame, stream: DataFrame, checkpoint: str | None = None):
    """Entity resolution that grows with the answers: each batch's matches become edges, and the sample is rewritten.

    ``pairs`` is (id, id_a, id_b). Edges form a set, so a batch that is processed again changes nothing.
    """

    def handle(batch: DataFrame, _: int) -> None:
        yes = votes(batch).filter("label > 0.5").select("id")
        edges = materialize(pairs.join(yes, "id", "left_semi").select("id_a", "id_b"), "matches")
        if not edges.isEmpty():
            resolution.add(edges)
            resolution.ws.snapshot()

    return each_batch(stream, handle, checkpoint)
