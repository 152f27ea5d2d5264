"""Streaming forms: sessions and tumbling windows with watermarks, and a keyed state machine with resets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.tables import stable_hash

#: Why a key's state was cleared: fixed codes.
FIRST, BACKWARDS, GAP = 1, 4, 5


def tumbling(stream: DataFrame, time: str, keys: list[str], length: str, late: str, value: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def stabilise(rows: pd.DataFrame, state: dict, up: float, down: float, gap_ns: int, ttl: int) -> tuple[pd.DataFrame, dict]:
    """One causal pass over a key's rows in order: hysteresis on value, resets, a life of ttl rows after the last ``on``.

    The state is (last_t, on, age); nothing looks ahead, so any cut into batches gives the same rows.
    """
    last_t, on, age = state.get("last_t"), state.get("on", False), state.get("age", 0)
    out = []
    for t, i, v in zip(rows["t"], rows["sample_index"], rows["value"]):
        reset = FIRST if last_t is None else BACKWARDS if t <= last_t else GAP if t - last_t > gap_ns else 0
        if reset:
            on, age = False, 0
        if v is not None and v == v:
            if v >= up:
                on, age = True, 0
            elif v < down:
                on = False
            else:
                age += 1
        else:
            age += 1
        if age > ttl:
            on = False
        last_t = t
        out.append((t, i, bool(on), int(age), int(reset)))
    return pd.DataFrame(out, columns=["t", "sample_index", "on", "age", "reset"]), {"last_t": last_t, "on": on, "age": age}


OUT = "recording_id long, t long, sample_index long, on boolean, age int, reset int"


def state_machine(df: DataFrame, up: float, down: float, gap_ns: int, ttl: int) -> DataFrame:
    """Batch form: a key's rows in (t, sample_index) order."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, _ = stabilise(rows.sort_values(["t", "sample_index"]), {}, up, down, gap_ns, ttl)
        out.insert(0, "recording_id", key[0])
        return out

    return df.select("recording_id", "t", "sample_index", "value").groupBy("recording_id").applyInPandas(run, OUT)


def state_machine_stream(stream: DataFrame, up: float, down: float, gap_ns: int, ttl: int) -> DataFrame:
    """Streaming form with the same state per key; rows of one batch are put in order first."""

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(("last_t", "on", "age"), state.get)) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values(["t", "sample_index"])
        out, held = stabilise(rows, held, up, down, gap_ns, ttl)
        state.update((int(held["last_t"]), bool(held["on"]), int(held["age"])))
        out.insert(0, "recording_id", key[0])
        yield out

    picked = stream.select("recording_id", "t", "sample_index", "value").groupBy("recording_id")
    return picked.applyInPandasWithState(run, OUT, "last_t long, on boolean, age int", "append", GroupStateTimeout.NoTimeout)


def advance(df: DataFrame, state: DataFrame | None, up: float, down: float, gap_ns: int, ttl: int) -> tuple[DataFrame, DataFrame]:
    """state_machine from saved states(recording_id, last_t, on, age) on: the rows, and the states after them.

    A key without new rows keeps its state; each key's rows go on from where its last batch ended.
    """
    rows = df.select("recording_id", "t", "sample_index", "value")
    if state is not None:
        rows = rows.join(state, "recording_id", "left")
    else:
        rows = rows.withColumns({"last_t": F.lit(None).cast("long"), "on": F.lit(False), "age": F.lit(0)})

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        held = {} if pd.isna(first["last_t"]) else {"last_t": int(first["last_t"]), "on": bool(first["on"]), "age": int(first["age"])}
        out, _ = stabilise(part.sort_values(["t", "sample_index"]), held, up, down, gap_ns, ttl)
        out.insert(0, "recording_id", key[0])
        return out

    out = rows.groupBy("recording_id").applyInPandas(run, OUT)
    last = F.max_by(F.struct(F.col("t").alias("last_t"), "on", "age"), F.struct("t", "sample_index"))
    after = out.groupBy("recording_id").agg(last.alias("s")).select("recording_id", "s.*")
    if state is not None:
        after = after.unionByName(state.join(after.select("recording_id"), "recording_id", "left_anti"))
    return out, after


def save_state(state: DataFrame, path: str, config: dict) -> None:
    """States with the fingerprint of the settings that made them."""
    state.withColumn("fingerprint", F.lit(stable_hash(config))).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """Saved states; an error where other settings made them."""
    saved = spark.read.parquet(path)
    made = [r["fingerprint"] for r in saved.select("fingerprint").distinct().limit(2).collect()]
    if made and made != [stable_hash(config)]:
        raise ValueError("the saved state was made with other settings")
    return saved.drop("fingerprint")


#: Operators by name, for callers that add their own.
PLUGINS: dict[str, Callable[..., DataFrame]] = {"state_machine": state_machine, "sessions": sessions, "tumbling": tumbling}


def register(name: str):
    """Add an operator under a name; a name can't be taken twice."""

    def keep(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in PLUGINS:
            raise ValueError(f"{name} is taken")
        PLUGINS[name] = operator
        return operator

    return keep


def apply(name: str, df: DataFrame, **options) -> DataFrame:
    if name not in PLUGINS:
        raise ValueError(f"no operator {name}; there are {', '.join(sorted(PLUGINS))}")
    return PLUGINS[name](df, **options)
