"""What a Gold run keeps for the next one: sums per batch and the latest snapshots, in versions.

The state is a list of segments, each with the sums and the latest snapshots of some batches. A run adds a
segment of its batch, so what it writes follows the batch and not history; readers merge the segments, the
newest snapshot of a key wins. When segments are many they are merged into larger ones, as often as their
number doubles, so a row is rewritten a few times in all.

A version is a manifest that names its segments. Segments are never changed, and the manifest is written
last and under a new number: a run that ends anywhere before leaves the version before it in force, and
what it wrote is removed by a later one. The manifest also names the keys that are not published yet, so
a run that ends between its commit and the Gold tables is made good by the next, whatever batch that has.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.keys import Batch, affected_keys, batch_slice, restrict_to
from tidemark.operators.reshape import conform
from tidemark.plans.snapshots import ENTITY, MEASURES, latest_rows
from tidemark.schemas import BATCH, SILVER_STATS
from tidemark.session import delete_folder, folder_size, glob_paths, stage, write_text

STATE_SUMS = T.StructType(
    [SILVER_STATS[c] for c in ("category_id", "views", "likes", "comment_count", *BATCH)]
)
STATE_LATEST = T.StructType([SILVER_STATS[c] for c in ("video_id", *MEASURES, *BATCH, "trending_date", "_source_file", "region")])
PENDING = T.StructType().add("region", "string").add("category_id", "integer").add("moved", "boolean")
#: Segments of one level that are merged into one of the next.
FAN = 16
#: The level of the segment that the state begins with; no other segment has it.
BASE = 99
PAIR = ["region", "category_id"]


def _batch_sums(stats: DataFrame) -> DataFrame:
    """Sums per batch and category."""
    sums = [F.sum(c).alias(c) for c in ("views", "likes", "comment_count")]
    return conform(stats.groupBy(*BATCH, "category_id").agg(*sums), STATE_SUMS)


def _is(batch: Batch) -> Column:
    same = (F.col(BATCH[0]) == F.lit(batch.date)) & (F.col(BATCH[1]) == F.lit(batch.hour))
    return F.coalesce(same, F.lit(False))


def _meets(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi- or anti-join in which NULL equals NULL."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") for c in on])
    condition = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    return left.join(renamed, condition, how)


class GoldState:
    """Stored below ``path``, which belongs to one writer at a time.

    A batch that is new, or comes late, costs a read of the batch, and reads of the state for the keys it
    meets. A batch that is loaded again first takes out what its earlier load left. Where that was a segment
    of its own it just goes; where it has been merged with others, facts of those batches are read for the
    videos whose latest snapshot it had held. Without stored state everything is derived from all facts
    once. Batches that reach the fact table around these runs are seen when they are run, or when the folder
    is dropped.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")

    def manifests(self) -> list[str]:
        return sorted(glob_paths(self.spark, f"{self.root}/manifests/v*.json"))

    def manifest(self, path: str | None = None) -> dict | None:
        """The version in force; None without state."""
        found = self.manifests()
        if not found:
            return None
        return json.loads(self.spark.read.text(path or found[-1], wholetext=True).first().value)

    def _commit(self, segments: list[dict], pending: list[str]) -> None:
        """Puts a new version in force; then removes what neither it nor the one before it names."""
        before = self.manifest()
        version = before["version"] + 1 if before else 1
        now = {"version": version, "segments": segments, "pending": pending}
        write_text(self.spark, f"{self.root}/manifests/v{version:012d}.json", json.dumps(now))
        used = {s["path"] for m in (before, now) if m for s in m["segments"]} | {p for m in (before, now) if m for p in m["pending"]}
        for kind in ("segments", "pending"):
            for folder in glob_paths(self.spark, f"{self.root}/{kind}/*"):
                if f"{kind}/{folder.rstrip('/').rsplit('/', 1)[1]}" not in used:
                    delete_folder(self.spark, folder)
        for old in self.manifests()[:-2]:
            delete_folder(self.spark, old)

    def _write(self, latest: DataFrame, sums: DataFrame, level: int) -> dict:
        path = f"segments/{uuid.uuid4().hex}"
        conform(latest, STATE_LATEST).write.parquet(f"{self.root}/{path}/latest")
        conform(sums, STATE_SUMS).write.parquet(f"{self.root}/{path}/sums")
        return {"path": path, "level": level, "bytes": folder_size(self.spark, f"{self.root}/{path}")}

    def _read(self, segments: list[dict], part: str) -> DataFrame:
        schema = STATE_SUMS if part == "sums" else STATE_LATEST
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}/{part}" for s in segments])

    def sums(self) -> DataFrame:
        return self._read(self.manifest()["segments"], "sums")

    def latest(self) -> DataFrame:
        """The newest snapshot of each key. Rows of the largest segment travel only where others hold the key."""
        segments = sorted(self.manifest()["segments"], key=lambda s: s["bytes"])
        if len(segments) < 2:
            return self._read(segments, "latest")
        large, others = self._read(segments[-1:], "latest"), self._read(segments[:-1], "latest")
        keys = others.select(*ENTITY).distinct()
        merged = latest_rows(_meets(large, keys, ENTITY, "left_semi").unionByName(others))
        return _meets(large, keys, ENTITY, "left_anti").unionByName(conform(merged, STATE_LATEST))

    def _of(self, segments: list[dict], keys: DataFrame) -> DataFrame:
        """The newest snapshots of some keys."""
        return latest_rows(_meets(self._read(segments, "latest"), keys, ENTITY, "left_semi"))

    def _without(self, segment: dict, batch: Batch, facts: DataFrame) -> dict:
        """A merged segment without a batch: keys that it had held go back to their snapshot before it."""
        latest, sums = self._read([segment], "latest"), self._read([segment], "sums")
        held = latest.filter(_is(batch)).select(*ENTITY)
        others = _meets(facts.filter(~_is(batch)), sums.filter(~_is(batch)).select(*BATCH).distinct(), list(BATCH), "left_semi")
        back = latest_rows(_meets(others, held, ENTITY, "left_semi"))
        rows = conform(latest.filter(~_is(batch)), STATE_LATEST).unionByName(conform(back, STATE_LATEST))
        return self._write(rows, sums.filter(~_is(batch)), segment["level"])

    def _compacted(self, segments: list[dict]) -> list[dict]:
        """Merges segments when there are many of one level, all of them when they outgrow the first."""
        base, rest = [s for s in segments if s["level"] == BASE], [s for s in segments if s["level"] != BASE]
        for level in sorted({s["level"] for s in rest}):
            same = [s for s in rest if s["level"] == level]
            if len(same) >= FAN:
                outgrown = sum(s["bytes"] for s in rest) >= sum(s["bytes"] for s in base)
                chosen = base + rest if outgrown else same
                rows = latest_rows(self._read(chosen, "latest"))
                merged = self._write(rows, self._read(chosen, "sums"), BASE if outgrown else level + 1)
                return self._compacted([s for s in segments if s not in chosen] + [merged])
        return segments

    def update(self, stats: DataFrame, batch: Batch, work: str) -> DataFrame:
        """Takes the batch in. Returns the keys to publish as (region, category_id, moved): those of the
        batch, of what an earlier load of it leaves or gives back (with NULL regions where only sums
        change), and of runs that ended before they were published; ``moved`` marks keys of snapshots that
        the batch replaced."""
        facts = conform(stats, SILVER_STATS)
        new, manifest = batch_slice(facts, batch), self.manifest()
        own = affected_keys(new, PAIR).withColumn("moved", F.lit(False))
        name = f"pending/{uuid.uuid4().hex}"
        if manifest is None:
            keys = stage(conform(own, PENDING), f"{self.root}/{name}")
            self._commit([self._write(latest_rows(facts), _batch_sums(facts), BASE)], [name])
            return keys
        segments = manifest["segments"]
        folder = F.regexp_extract(F.col("_metadata.file_path"), "(segments/[^/]+)/sums/", 1)
        again = self._read(segments, "sums").filter(_is(batch)).select(folder.alias("path")).distinct().collect()  # few segments
        holding = [s for s in segments if s["path"] in {r.path for r in again}]
        held = stage(self._read(holding, "latest").filter(_is(batch)).select(*ENTITY, "category_id"), f"{work}/held")
        gone = self._read(holding, "sums").filter(_is(batch)).select(F.lit(None).cast("string").alias("region"), "category_id")
        left = stage(held.select(*PAIR).unionByName(gone).distinct(), f"{work}/left")
        kept = [s for s in segments if s not in holding] + [self._without(s, batch, facts) for s in holding if s["level"] > 0]
        touched = new.select(*ENTITY).unionByName(held.select(*ENTITY)).distinct()
        moved = self._of(kept, touched).select(*PAIR).distinct()
        delta = [] if new.isEmpty() else [self._write(latest_rows(new), _batch_sums(new), 0)]
        after = kept + delta
        given_back = self._of(after, held.select(*ENTITY)).select(*PAIR)
        plain = left.unionByName(given_back).distinct().withColumn("moved", F.lit(False))
        keys = own.unionByName(plain).unionByName(moved.withColumn("moved", F.lit(True)))
        stage(conform(keys, PENDING), f"{self.root}/{name}")
        pending = [*manifest["pending"], name]
        self._commit(self._compacted(after), pending)
        return self.spark.read.schema(PENDING).parquet(*[f"{self.root}/{p}" for p in pending])

    def published(self) -> None:
        """Every key of the version in force has reached the Gold tables."""
        self._commit(self.manifest()["segments"], [])
