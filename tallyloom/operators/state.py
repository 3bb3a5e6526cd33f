"""Keyed state that outlives a job: logs to take back, checkpoints, rolling tails, pools.

State is tables in versions. A change writes a folder and commits it; until then nobody
reads it, and a change that names its batch is made once, however often a job that died
is started again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.versions import Versions

MOST_PARTS = 64


@dataclass(frozen=True)
class OperationLog:
    """Batches of operations, the last of which can be taken back.

    A commit holds its batch's folder and the number of the commit below it, so the
    log is a stack of any height and a commit is of constant size.
    """

    spark: SparkSession
    path: str

    def _at(self) -> Versions:
        return Versions(self.spark, self.path)

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Put a batch on top; False if the commit on top is of this batch already."""
        at = self._at()
        number = at.number()
        top = at.read(number)
        if top and top["change"] == f"append {batch}":
            return False
        folder = at.fresh()
        rows.write.parquet(folder)
        at.commit(folder, after=number, change=f"append {batch}", batch=batch, below=(top["at"] if top else 0), at=number + 1, schema=rows.schema.json())
        return True

    def last(self) -> DataFrame | None:
        """The batch on top."""
        held = self._at().read()
        return self._rows(held) if held and held["folder"] else None

    def _rows(self, held: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(_json(held["schema"]))).parquet(held["folder"])

    def pop(self, undo: str) -> DataFrame | None:
        """Take the batch on top back and return its rows; the same rows again for the same `undo`, None where the log is empty."""
        at = self._at()
        number = at.number()
        top = at.read(number)
        if top and top["change"] == f"pop {undo}":
            return self._rows(at.read(top["popped"]))
        if not top or not top["folder"]:
            return None
        below = at.read(top["below"]) if top["below"] else None
        facts = {"batch": below["batch"], "below": below["below"], "at": below["at"], "schema": below["schema"]} if below else {"batch": None, "below": 0, "at": 0, "schema": None}
        at.commit(below["folder"] if below else None, after=number, change=f"pop {undo}", popped=top["at"], **facts)
        return self._rows(top)

    def height(self) -> int:
        held, n = self._at().read(), 0
        while held and held["folder"]:
            n += 1
            held = self._at().read(held["below"]) if held["below"] else None
        return n


def _json(text: str) -> dict:
    import json

    return json.loads(text)


def replay(rows: DataFrame, group: str, step: str, source: str = "source", target: str = "target") -> DataFrame:
    """What undoes a batch: source and target exchanged, `place` from the last step of each group on."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(step))).cast("long")
    return rows.select(group, place.alias("place"), step, F.col(target).alias("source"), F.col(source).alias("target"))


@dataclass(frozen=True)
class Checkpoint:
    """Keys that are done, in parts; a part for each batch, put together when there are many."""

    spark: SparkSession
    path: str
    schema: str

    def _at(self) -> Versions:
        return Versions(self.spark, self.path)

    def load(self) -> DataFrame:
        held = self._at().read()
        parts = held["parts"] if held else []
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def save(self, keys: DataFrame, batch: str) -> bool:
        """Add a batch's keys; False if it was the last one saved."""
        at = self._at()
        number = at.number()
        held = at.read(number) or {"parts": [], "batch": None}
        if held["batch"] == batch:
            return False
        folder, parts = at.fresh(), held["parts"]
        if len(parts) >= MOST_PARTS:
            keys, parts = self.load().unionByName(keys).distinct(), []
        keys.write.parquet(folder)
        at.commit(folder, after=number, parts=[*parts, folder], batch=batch)
        return True

    def reset(self) -> None:
        at = self._at()
        at.commit(None, parts=[], batch=None)

    def pending(self, rows: DataFrame, key: str) -> DataFrame:
        """rows that are not done."""
        return rows.join(self.load().select(key).distinct(), key, "left_anti")


@dataclass(frozen=True)
class RollingTail:
    """The last n lines of each key, after any number of batches."""

    spark: SparkSession
    path: str
    n: int = 20

    def add(self, rows: DataFrame, key: str, order: list[str], line: str, batch: str) -> bool:
        """Take in a batch; False if it was the last one. Of a batch, no more than n lines of a key leave a task's sort; of the state, n lines a key are read."""
        at = Versions(self.spark, self.path)
        number = at.number()
        held = at.read(number)
        if held and held["batch"] == batch:
            return False
        new = rows.select(key, *order, line)
        every = self._read(held).unionByName(new) if held else new
        place = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
        folder = at.fresh()
        every.withColumn("_place", place).where(F.col("_place") <= self.n).drop("_place").write.parquet(folder)
        at.commit(folder, after=number, batch=batch, schema=new.schema.json())
        return True

    def _read(self, held: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(_json(held["schema"]))).parquet(held["folder"])

    def lines(self) -> DataFrame | None:
        held = Versions(self.spark, self.path).read()
        return self._read(held) if held else None


def rotating_picks(pool: DataFrame, term: str, k: int, rounds: int, seed: str = "") -> DataFrame:
    """round, term: k terms for each round that no round since the last reset has used.

    When fewer than k are left, the pool is reset and dealt in a new order, by a hash
    of seed, reset and term; a pool of less than k terms is given whole each time.
    """
    size = pool.select(term).distinct().agg(F.count("*").alias("_size"))
    turns = F.greatest(F.lit(1), F.expr(f"_size div {k}"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_reset").cast("string"), F.lit(":"), F.col(term)))
    # One row of the pool's size, and a row per round: both bounded.
    resets = size.select(F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"{rounds - 1} div greatest(1, _size div {k})"))).alias("_reset"), "_size")
    dealt = pool.select(term).distinct().crossJoin(F.broadcast(resets)).withColumn("_place", F.row_number().over(Window.partitionBy("_reset").orderBy(order, term)) - 1)
    return dealt.withColumn("round", (F.col("_reset") * turns + F.expr(f"_place div {k}")).cast("long")).where((F.expr(f"_place div {k}") < turns) & (F.col("round") < rounds)).select("round", term)


def line_rows(rows: DataFrame, key: str, order: str, text: Column) -> DataFrame:
    """key, order, line_no, line of every line of a text that isn't empty."""
    lines = rows.select(key, order, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.where("line <> ''").select(key, order, F.col("line_no").cast("long").alias("line_no"), "line")
