"""Photos of a place: hashes by what they show, and pairs within a moving window of time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators.graph import connected_components
from archivolt.operators.similarity import hamming
from archivolt.storage import materialize

# Fixed values of the pairing.
WINDOW_SECONDS = 120
MOST_DISTANCE = 2
#: Side of the gray samples, and of the block of low frequencies that the hash takes its 64 bits from.
SAMPLES, LOW = 32, 8


def _cosines(n: int, low: int) -> np.ndarray:
    """The first ``low`` rows of the orthonormal cosine transform of n values."""
    k, i = np.arange(low)[:, None], np.arange(n)[None, :]
    out = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def perceptual_hash(gray: Column) -> Column:
    """64 bits of a square gray image (an array of numbers): which of its low cosine coefficients exceed their median without
    the first. Null where there is no image or it is not square. Images of one size are one block of products."""

    @F.pandas_udf("long")
    def run(images: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(images), dtype=object)
        sizes = images.map(lambda x: 0 if x is None or np.isnan(np.asarray(x, dtype=np.float64)).any() else len(x))
        for size in sizes.unique():
            n = int(round(size**0.5))
            if size < LOW * LOW or n * n != size:
                continue
            own = np.flatnonzero(sizes == size)
            x = np.stack([np.asarray(images.iloc[i], dtype=np.float64) for i in own]).reshape(-1, n, n)
            c = _cosines(n, LOW)
            # Rounding keeps equal pictures equal whatever the order of sums.
            low = np.round(c @ x @ c.T, 6).reshape(len(own), -1)
            bits = low > np.median(low[:, 1:], axis=1)[:, None]
            bits[:, 0] = False
            packed = np.packbits(bits, axis=1).view(">u8").astype("<u8").view("<i8").ravel()
            for i, h in zip(own.tolist(), packed.tolist(), strict=True):
                out.iloc[i] = h
        return out

    return run(gray)


def photo_distance(first: Column, second: Column) -> Column:
    """0 for equal contents (structs with digest, hash), else the differing bits of their hashes; null where one has none."""
    return F.when(first["digest"] == second["digest"], F.lit(0)).otherwise(hamming(first["hash"], second["hash"]))


def quality_order(pixels: Column, explicit: Column, size: Column, identity: Column) -> Column:
    """Sorts the better photo first: pixels, then those that belong to an entry, then bytes, then the id."""
    return F.struct((-pixels).alias("pixels"), (~explicit).alias("explicit"), (-size).alias("size"), identity.alias("id"))


def pairs_in_window(loose: DataFrame, entries: DataFrame, held: DataFrame, seconds: int = WINDOW_SECONDS, most: int = MOST_DISTANCE) -> DataFrame:
    """Candidate pairs (loose_id, entry_id, photo_id, distance, gap) of loose photos with photos of entries at their place.

    ``loose`` has loose_id, place, at (seconds), photo; ``entries`` entry_id, place, at; ``held`` entry_id, photo_id, at,
    photo. Entry and photo are both within the window of the loose photo, and the photos at most ``most`` bits apart. Time
    is dealt to windows, and a hash to ``most`` + 1 bands of which one must be equal: the join is on place, window and
    band, so that photos of one place that look different do not meet. Equal contents meet in the same way.
    """
    bands, width = most + 1, -(-64 // (most + 1))

    def banded(photo: Column) -> Column:
        parts = [F.concat(F.lit(f"{i}:"), F.shiftrightunsigned(photo["hash"], i * width).bitwiseAND(F.lit((1 << min(width, 63)) - 1)).cast("string")) for i in range(bands)]
        return F.explode(F.array_compact(F.array(*parts, photo["digest"])))

    known = held.join(entries.select("entry_id", "place", F.col("at").alias("entry_at")), "entry_id")
    window = F.floor(F.col("at") / seconds)
    right = known.select("place", "entry_id", "entry_at", "photo_id", F.col("at").alias("photo_at"), F.col("photo").alias("other"), window.alias("window"), banded(F.col("photo")).alias("band"))
    left = loose.select("place", "loose_id", "at", "photo", F.explode(F.array(window - 1, window, window + 1)).alias("window"), banded(F.col("photo")).alias("band"))
    gap = F.abs(F.col("photo_at") - F.col("at"))
    distance = photo_distance(F.col("photo"), F.col("other"))
    near = left.join(right, ["place", "window", "band"]).filter((gap <= seconds) & (F.abs(F.col("entry_at") - F.col("at")) <= seconds))
    found = near.select("loose_id", "entry_id", "photo_id", distance.alias("distance"), gap.alias("gap")).filter(F.col("distance") <= most)
    return found.dropDuplicates(["loose_id", "entry_id", "photo_id"])


def merged_photos(pairs: DataFrame, loose: DataFrame, held: DataFrame) -> DataFrame:
    """(loose_id, entry_id, photo_id, distance, replaces): what became of loose photos that have a pair, in their own order.

    A loose photo (loose_id, place_in_order, quality) takes its first pair by (distance, gap, entry_id, photo_id) whose
    photo still stands. The worse of the two by quality is suppressed: if that is the photo of the entry, the loose one
    ``replaces`` it, and later ones no longer see it. Who comes later depends on who came before only among photos that
    pairs connect, so each such component is settled on its own; it spans photos of one place within minutes. A loose
    photo whose pairs are all gone gives a row with nulls.
    """
    nodes = pairs.select(F.xxhash64("loose_id", F.lit("loose")).alias("a"), F.xxhash64("entry_id", "photo_id", F.lit("held")).alias("b"), "*")
    nodes = materialize(nodes, "photo-pairs")
    parts = connected_components(nodes.select("a", "b"), "a", "b")
    own = loose.select("loose_id", "place_in_order", F.col("quality").alias("loose_quality"))
    other = held.select("entry_id", "photo_id", F.col("quality").alias("photo_quality"))
    better = (F.col("loose_quality") < F.col("photo_quality")).alias("better")
    listed = nodes.join(parts.withColumnRenamed("node", "a"), "a").join(own, "loose_id").join(other, ["entry_id", "photo_id"])
    fields = ["place_in_order", "loose_id", "distance", "gap", "entry_id", "photo_id"]
    parts = listed.groupBy("component").agg(F.array_sort(F.collect_list(F.struct(*fields, better))).alias("options"))
    kinds = dict(listed.dtypes)

    def settle(options: list[dict]) -> list[dict]:
        gone, out = set(), {}
        for o in options:
            if out.get(o["loose_id"]) is None:
                held = (o["entry_id"], o["photo_id"])
                out[o["loose_id"]] = None if held in gone else (*held, o["distance"], o["better"])
                if held not in gone and o["better"]:
                    gone.add(held)
        names = ("entry_id", "photo_id", "distance", "replaces")
        return [{"loose_id": loose_id, **dict(zip(names, taken or (None,) * 4, strict=True))} for loose_id, taken in out.items()]

    def run(batches):
        for batch in batches:
            at = batch.schema.field(0).type.value_type
            kind = pa.schema([("loose_id", at.field("loose_id").type), ("entry_id", at.field("entry_id").type), ("photo_id", at.field("photo_id").type), ("distance", pa.int32()), ("replaces", pa.bool_())])
            # A group of pandas for each component would cost many times what settling it does.
            yield pa.RecordBatch.from_pylist([row for options in batch.column(0) for row in settle(options.as_py())], kind)

    schema = f"loose_id {kinds['loose_id']}, entry_id {kinds['entry_id']}, photo_id {kinds['photo_id']}, distance int, replaces boolean"
    return parts.select("options").mapInArrow(run, schema)
