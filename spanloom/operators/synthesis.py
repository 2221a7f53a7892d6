"""Splits, augmentation and synthetic sequences. Randomness is a hash of ids and a seed: the same at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.intervals import half_even, uniform


def stratified_split(rows: DataFrame, share: float, seed: int, cls: str, key: str, holdout: Column | None = None) -> DataFrame:
    """Adds split: of each class the first share (rounded half to even) in hashed order is val, the rest fit; holdout rows are holdout.

    Keys are hashed in Spark, and ranked within a class and hash range of their own: a range's first place is the count of those
    before it, so a class of any size is many window partitions.
    """
    held = F.coalesce(holdout, F.lit(False)) if holdout is not None else F.lit(False)
    text = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    marked = rows.withColumns({"_h": text, "_held": held}).withColumn("_range", F.substring("_h", 1, 2))
    sizes = marked.filter("not _held").groupBy(cls, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(cls)
    sizes = sizes.withColumns({"_before": F.sum("_n").over(w.orderBy("_range")) - F.col("_n"), "_all": F.sum("_n").over(w)}).drop("_n")
    place = F.row_number().over(Window.partitionBy(cls, "_range", "_held").orderBy("_h", key)) + F.col("_before")
    placed = marked.join(sizes, [cls, "_range"], "left").withColumn("_place", place)
    split = F.when(F.col("_held"), "holdout").when(F.col("_place") <= half_even(F.col("_all") * share), "val").otherwise("fit")
    return placed.withColumn("split", split).drop("_h", "_held", "_range", "_before", "_all", "_place")


def clip_crop(clips: DataFrame, share: float, seed: int, n: str = "n", key: str = "video_id") -> DataFrame:
    """Adds st and en of ceil(share * n) neighbouring frames at a hashed place."""
    keep = F.ceil(F.col(n) * share).cast("bigint")
    start = F.floor(uniform(F.col(key), "crop", seed) * (F.col(n) - keep + 1)).cast("bigint")
    return clips.withColumns({"st": start, "en": start + keep})


def zero_frames(frames: DataFrame, share: float, seed: int, emb: str = "emb") -> DataFrame:
    """Sets the embedding of a hashed share of the frames to zeros; no frame goes."""
    hit = uniform(F.col("video_id"), F.col("i"), "zero", seed) < share
    return frames.withColumns({"zeroed": hit, emb: F.when(hit, F.transform(emb, lambda x: F.lit(0.0))).otherwise(F.col(emb))})


def synthetic_ids(spark: SparkSession, n: int) -> DataFrame:
    """number 0 .. n - 1."""
    return spark.range(n).withColumnRenamed("id", "number")


def tile_background(videos: DataFrame, donors: DataFrame, frames: int, slots: int, seed: int) -> DataFrame:
    """number, slot, donor, st, en: donors drawn with replacement, one after another, until `frames` frames are filled; the last is cut.

    donors: donor (0 .. m - 1), n. The table is small; a video draws `slots` times at most.
    """
    m = donors.agg(F.count("*").alias("m"))
    draws = videos.select("number", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<bigint>")).alias("slot")).crossJoin(F.broadcast(m))
    draws = draws.withColumn("donor", F.floor(uniform(F.col("number"), F.col("slot"), "tile", seed) * F.col("m")).cast("bigint")).join(donors, "donor")
    end = F.sum("n").over(Window.partitionBy("number").orderBy("slot"))
    return draws.withColumn("st", end - F.col("n")).withColumn("en", F.least(end, F.lit(frames))).filter(F.col("st") < frames).select("number", "slot", "donor", "st", "en")


def place_events(videos: DataFrame, frames: int | Column, length: int, gap: int, most: int, tries: int, seed: int, quiet: float = 0.2) -> DataFrame:
    """number, k, cls, st, en: up to `most` events a video at hashed places; of `tries` places for an event the first that keeps `gap`
    frames from those placed before; an event without one is left out. A share `quiet` of videos has none."""
    number = F.col("number")
    count = F.when(uniform(number, "quiet", seed) < quiet, 0).otherwise(1 + F.floor(uniform(number, "count", seed) * most)).cast("int")

    def step(taken: Column, k: Column) -> Column:
        at = lambda t: F.floor(uniform(number, k, t, "place", seed) * (F.col("_f") - length + 1)).cast("bigint")
        free = lambda s: F.forall(taken, lambda o: (s + length + gap <= o.st) | (s >= o.st + length + gap))
        found = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), at), free), F.lit(0))
        return F.when(found.isNotNull(), F.concat(taken, F.array(F.struct(k.cast("int").alias("k"), found.alias("st"))))).otherwise(taken)

    empty = F.array().cast("array<struct<k:int,st:bigint>>")
    placed = videos.withColumns({"_c": count, "_f": F.lit(frames)}).select("number", F.explode(F.aggregate(F.when(F.col("_c") > 0, F.sequence(F.lit(1), "_c")).otherwise(F.array().cast("array<int>")), empty, step)).alias("e"))
    cls = F.floor(uniform(number, F.col("e.k"), "class", seed) * 11).cast("bigint")
    return placed.select("number", F.col("e.k").alias("k"), cls.alias("cls"), F.col("e.st").alias("st"), (F.col("e.st") + length).alias("en"))


def regular_events(videos: DataFrame, frames: int | Column, length: int, most: int, seed: int) -> DataFrame:
    """number, k, st, en: events at a fixed pitch of frames // (count + 1), centred on it."""
    count = (1 + F.floor(uniform(F.col("number"), "count", seed) * most)).cast("int")
    rows = videos.withColumns({"_c": count, "_f": F.lit(frames)}).select("number", "_c", "_f", F.explode(F.sequence(F.lit(1), "_c")).alias("k"))
    centre = F.col("k") * F.floor(F.col("_f") / F.greatest(F.col("_c") + 1, F.lit(2)))
    start = F.floor(centre - F.lit(length) / 2).cast("bigint")
    return rows.select("number", "k", start.alias("st"), (start + length).alias("en"))


def overlay(frames: DataFrame, spans: DataFrame, donors: DataFrame, normal: int = 11) -> DataFrame:
    """frames (number, i, emb) with the embeddings of donors (cls, i, emb) inside spans (number, cls, st, en), a label
    (class or normal) and edge marks at each span's first and last frame."""
    a, b = frames.alias("f"), spans.alias("s")
    on = (F.col("f.number") == F.col("s.number")) & (F.col("f.i") >= F.col("s.st")) & (F.col("f.i") < F.col("s.en"))
    rows = a.join(b, on, "left").select("f.number", "f.i", "f.emb", "s.cls", "s.st", "s.en")
    found = rows.withColumn("_at", F.col("i") - F.col("st")).alias("r").join(donors.alias("d"), (F.col("r.cls") == F.col("d.cls")) & (F.col("r._at") == F.col("d.i")), "left")
    edge = F.coalesce((F.col("r.i") == F.col("r.st")) | (F.col("r.i") == F.col("r.en") - 1), F.lit(False)).cast("double")
    return found.select("r.number", "r.i", F.coalesce("d.emb", "r.emb").alias("emb"), F.coalesce("r.cls", F.lit(normal)).cast("bigint").alias("label"), edge.alias("edge"))


def donor_crops(events: DataFrame, donors: DataFrame, most: int, seed: int, same_share: float = 0.25, frames: str = "frames") -> DataFrame:
    """Gives each event (number, k, cls, st, and its video's frames) a donor of its class and a crop of it.

    donors: cls, donor and n, clips of a class with their frames. A donor is drawn by hash among its class's in the order of donor; of one longer than `most` frames, `most` neighbouring ones at a hashed place. Adds donor,
    left (the crop's first frame), en (the crop's length on, the video's end at most) and same_scene, true for a hashed share of the events, whose background stays as it is.
    Events of a class without donors go.
    """
    own = Window.partitionBy("cls")
    ranked = donors.select("cls", "donor", "n", (F.row_number().over(own.orderBy("donor")) - 1).alias("_at"), F.count("*").over(own).alias("_m"))
    sizes = ranked.filter("_at = 0").select("cls", "_m")
    u = lambda what: uniform(F.col("number"), F.col("k"), what, seed)
    drawn = events.join(sizes, "cls").withColumn("_at", F.floor(u("donor") * F.col("_m")).cast("int")).join(ranked.drop("_m"), ["cls", "_at"])
    length = F.least(F.col("n"), F.lit(most))
    left = F.floor(u("crop") * (F.col("n") - length + 1)).cast("bigint")
    return drawn.withColumns({"left": left, "en": F.least(F.col("st") + length, F.col(frames)).cast("bigint"), "same_scene": u("scene") < same_share}).drop("_at", "_m", "n")


def splice(frames: DataFrame, events: DataFrame, donor_frames: DataFrame, normal: int = 11) -> DataFrame:
    """frames (number, i, emb) with the crops of donors in place of what lies inside events, except where an event keeps its scene; a label (class or normal) and
    edge marks, which events have either way.

    events: of donor_crops; donor_frames: donor, i, emb. Joined by (donor, frame of the donor), so a donor's frame goes to the events that use it and no clip is held as a whole.
    """
    a, b = frames.alias("f"), events.alias("s")
    on = (F.col("f.number") == F.col("s.number")) & (F.col("f.i") >= F.col("s.st")) & (F.col("f.i") < F.col("s.en"))
    rows = a.join(b, on, "left").select("f.number", "f.i", "f.emb", "s.cls", "s.st", "s.en", F.when(~F.col("s.same_scene"), F.col("s.donor")).alias("_donor"), (F.col("s.left") + F.col("f.i") - F.col("s.st")).alias("_at"))
    own = donor_frames.select(F.col("donor").alias("_d"), F.col("i").alias("_i"), F.col("emb").alias("_emb"))
    found = rows.join(own, (F.col("_donor") == F.col("_d")) & (F.col("_at") == F.col("_i")), "left")
    edge = F.coalesce((F.col("i") == F.col("st")) | (F.col("i") == F.col("en") - 1), F.lit(False)).cast("double")
    return found.select("number", "i", F.coalesce("_emb", "emb").alias("emb"), F.coalesce("cls", F.lit(normal)).cast("bigint").alias("label"), edge.alias("edge"))
