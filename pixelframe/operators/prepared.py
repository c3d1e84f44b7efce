"""Prepared sources: a bounded store of one-time tokens, and decoding by token, by a given probe, or directly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship

#: Sources that a store holds at once.
CAPACITY = 1024
_OUTPUT = "store string, seq long, kind string, token string, accepted boolean"


def takes(events: DataFrame, keys: list[str], token: str, order: list[str], kind: str) -> DataFrame:
    """``events`` with ``accepted``, as far as a store of any size decides it: a token is inserted while it isn't held, and taken or removed while it is.

    Events of one token alternate between held and not held, so an event counts if it isn't like the last one of its token.
    """
    inserting = F.col(kind) == "insert"
    before = F.lag(inserting).over(Window.partitionBy(*keys, token).orderBy(*order))
    return events.withColumn("accepted", inserting != F.coalesce(before, F.lit(False)))


def _store(name: str, frame: pd.DataFrame, held: set[str], capacity: int) -> pd.DataFrame:
    accepted = []
    for row in frame.itertuples():
        if row.kind == "insert":
            ok = len(held) < capacity and row.token not in held
            if ok:
                held.add(row.token)
        else:
            ok = row.token in held
            held.discard(row.token)
        accepted.append(ok)
    return pd.DataFrame({"store": name, "seq": frame["seq"], "kind": frame["kind"], "token": frame["token"], "accepted": accepted})


def store(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(store, seq, kind: insert, take or remove, token) with ``accepted``: at most ``capacity`` tokens are held, each is taken once.

    A store's events come in the order of seq; the state is its at most ``capacity`` tokens.
    """
    ship(events.sparkSession)
    rows = events.select("store", "seq", "kind", "token")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _store(frame["store"].iloc[0], frame.sort_values("seq", kind="stable"), set(), capacity)

    return rows.groupBy("store").applyInPandas(run, _OUTPUT)


def store_stream(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The stores of a streaming DataFrame; rows are handled in the order of seq within a micro-batch."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = set(state.get[0]) if state.exists else set()
        yield _store(key[0], pd.concat(list(frames), ignore_index=True).sort_values("seq", kind="stable"), held, capacity)
        state.update((sorted(held),))

    ship(events.sparkSession)
    return events.select("store", "seq", "kind", "token").groupBy("store").applyInPandasWithState(step, _OUTPUT, "held array<string>", "append", GroupStateTimeout.NoTimeout)


#: What a probe holds, in the order of its fields.
PROBE_FIELDS = ("format", "width", "height", "frame_count", "orientation", "metadata_byte_count", "attachment_count", "source_profile")


def same_probe(left: str, right: str, fields: tuple[str, ...] = PROBE_FIELDS) -> Column:
    """Whether two sides' probes agree in every field; nulls agree with nulls."""
    agree = F.lit(True)
    for f in fields:
        agree = agree & F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}"))
    return agree


def matched(requests: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """``requests`` (key, ``given``: the caller's probe) against fresh ``probes`` (key, probe columns, failure): the source's own failure, else probeMismatch, else null."""
    fresh = probes.select(key, F.struct(*PROBE_FIELDS).alias("_fresh"), F.col("failure").alias("_failure"))
    failure = F.when(F.col("_failure").isNotNull(), F.col("_failure")).when(~same_probe("given", "_fresh"), F.lit("probeMismatch"))
    return requests.join(fresh, key).select(*requests.columns, failure.alias("failure"))


def interpreted_colour(profile: Column, inspected: Column, image: Column) -> Column:
    """The colour space that a decoded image is read in: sRGB for untagged and sRGB sources; an embedded profile as the container scan found it, else as the image says; an unknown one the other way round."""
    return F.when(profile.isin("absent", "standardSRGB"), F.lit("sRGB")).when(profile == "embeddedICC", F.coalesce(inspected, image)).otherwise(F.coalesce(image, inspected))


def colour_step(interpreted: Column, interpreted_model: Column, image: Column, image_model: Column, policy: Column) -> Column:
    """What becomes of pixels: kept, retagged (same or unknown colour model: no pixel changes), or converted."""
    same = interpreted.isNull() | interpreted.eqNullSafe(image)
    tagged = F.coalesce(interpreted, image)
    wanted = (policy == "convertToSRGB") & ~tagged.eqNullSafe(F.lit("sRGB"))
    other_model = ~same & image_model.isNotNull() & (interpreted_model != image_model)
    return F.when(wanted | other_model, F.lit("convert")).when(same, F.lit("keep")).otherwise(F.lit("retag"))
