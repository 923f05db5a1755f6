"""Checks of a submission of JSON lines against its contract, as one row for each issue.

A line is an object with `video_id`, `targetRatioWH` (two positive numbers; from the index where the line has none) and `predictions`, a list of
objects with `frame` and `bboxes` (origin x, y and width; the height follows from the ratio). What is unknown, as the size of a video, is not checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The codes of the contract.
CODES = (
    "invalid_json invalid_record missing_video_id unknown_video_id invalid_target_ratio ratio_mismatch missing_predictions invalid_prediction non_integer_frame negative_frame frame_out_of_range "
    "duplicate_frame non_ascending_order temporal_traceability_violation missing_bboxes invalid_bbox_shape non_integer_bbox invalid_bbox_value bbox_out_of_bounds ratio_height_violation missing_video_line"
).split()
OF_LINE = "invalid_json invalid_record missing_video_id unknown_video_id invalid_target_ratio ratio_mismatch missing_predictions missing_video_line".split()


def _kind(v: Column, kind: str) -> Column:
    """Whether a small value is an OBJECT or ARRAY of any content, or exactly STRING, BIGINT or VOID; false without a value."""
    schema = F.schema_of_variant(v)
    return F.coalesce(schema.startswith(f"{kind}<") if kind in ("OBJECT", "ARRAY") else schema == kind, F.lit(False))


def _at(column: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({column}, '{path}', '{kind}')")


def _ratio(column: str) -> Column:
    """Width and height of a ratio as decimals; null unless two positive numbers (as numbers or text)."""
    w, h = (_at(column, f"$[{k}]", "double").cast("decimal(30,12)") for k in (0, 1))
    two = _kind(F.col(column), "ARRAY") & _at(column, "$[2]", "variant").isNull() & (w > 0) & (h > 0)
    return F.when(two, F.struct(w.alias("w"), h.alias("h")))


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def _found(*tests: tuple[Column, str]) -> Column:
    """Codes whose test is true, as words of a text."""
    return F.concat_ws(" ", *[F.when(test, code) for test, code in tests])


def _keyed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """With a second column of the key: rows without a video have their line there and do not meet in one task."""
    spread = F.xxhash64("video_id")
    if "line" in df.columns:
        spread = F.when(F.col("video_id").isNull(), F.xxhash64("line")).otherwise(spread)
    return df.select("video_id", spread.alias("spread"), *columns)


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines with what they hold as variants; ``broken`` is the code of a line that is not looked at further."""
    # The first character tells the kind of valid JSON; the schema of a whole line would be put together from all of its predictions.
    v = lines.where("trim(text) <> ''").select("line", F.try_parse_json("text").alias("v"), F.expr(r"ltrim(' \t\n\r', text) like '{%'").alias("object"))
    v = v.select("line", "object", F.col("v").isNotNull().alias("valid"), *[_at("v", f"$.{c}", "variant").alias(a) for c, a in {"video_id": "id", "targetRatioWH": "ratio", "predictions": "predictions"}.items()])
    v = v.withColumn("video_id", F.when(F.col("object") & _kind(F.col("id"), "STRING"), F.nullif(_at("id", "$", "string"), F.lit(""))))
    broken = F.when(~F.col("valid"), "invalid_json").when(~F.col("object"), "invalid_record").when(F.col("video_id").isNull(), "missing_video_id")
    return v.select("line", "video_id", "ratio", "predictions", broken.alias("broken"))


def validate(lines: DataFrame, index: DataFrame | None = None, sizes: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Issues (line, video_id, place, code) of ``lines`` (line, text); ``place`` counts predictions from 0 and is null for issues of a line.

    ``index`` (video_id, ratio: two numbers) names the videos that must be there, ``sizes`` (video_id, width, height, frame_count) their extent,
    ``allowed`` (video_id, frame) the frames that may be used, of the videos it has. Blank lines are skipped; a video without a line has the line 0.
    Order and repeats of frames are those of a line; frames that are not valid by themselves have none.

    All lines, broken ones too, go through in one pass with an outer explode at its end: a filter on parsed values would be pushed down to the text
    and parse it again for each value that it names. What is known of a video meets its lines in one window, which also finds videos without a line.
    """
    none = lambda kind: F.lit(None).cast(kind)
    key, facts = ["video_id", "spread"], {"listed": "struct<w:decimal(30,12),h:decimal(30,12)>", "width": "long", "height": "long", "frame_count": "long", "bound": "boolean", "wanted": "boolean", "sent": "boolean"}
    v = _keyed(_parsed(lines), "line", "ratio", "predictions", "broken", F.lit(True).alias("sent"))
    if index is not None:
        listed = F.expr("struct(cast(ratio[0] as decimal(30,12)) as w, cast(ratio[1] as decimal(30,12)) as h)").alias("listed")
        v = v.unionByName(_keyed(index, listed, F.lit(True).alias("wanted")), True)
    if sizes is not None:
        v = v.unionByName(_keyed(sizes, *[_positive(c).cast("long").alias(c) for c in ("width", "height", "frame_count")]), True)
    if allowed is not None:
        v = v.unionByName(_keyed(allowed, F.lit(True).alias("bound")).distinct(), True)
    v = v.select("line", *key, "ratio", "predictions", "broken", *[F.col(c) if c in v.columns else none(k).alias(c) for c, k in facts.items()])
    if index is not None or sizes is not None or allowed is not None:
        video = Window.partitionBy(*key)
        known = {c: F.max(c).over(video) for c in facts if c not in ("wanted", "sent")}
        v = v.withColumns(known | {"seen": F.max(F.when(F.col("video_id").isNotNull(), F.col("sent"))).over(video)})
        gone = F.col("wanted") & F.col("seen").isNull()
        v = v.where(F.col("sent") | gone).withColumn("line", F.when(F.col("sent"), F.col("line")).otherwise(F.lit(0).cast("long"))).withColumn("broken", F.when(gone, "missing_video_line").otherwise(F.col("broken")))
    fine = F.col("broken").isNull()
    given = F.col("ratio").isNotNull() & ~_kind(F.col("ratio"), "VOID")
    good = F.when(F.col("listed.w") > 0, F.when(F.col("listed.h") > 0, F.col("listed")))
    v = v.withColumn("given", given).withColumn("own", _ratio("ratio")).withColumn("items", F.when(fine, _at("predictions", "$", "array<variant>")))
    of_line = _found(
        (fine & F.lit(index is not None) & F.col("listed").isNull(), "unknown_video_id"), (fine & F.col("given") & F.col("own").isNull(), "invalid_target_ratio"),
        (fine & F.col("own").isNotNull() & good.isNotNull() & ((F.col("own.w") != F.col("listed.w")) | (F.col("own.h") != F.col("listed.h"))), "ratio_mismatch"), (fine & F.col("items").isNull(), "missing_predictions"),
    )
    of_line = F.when(fine, of_line).otherwise(F.col("broken"))
    p = v.select("line", *key, of_line.alias("of_line"), F.when(F.col("given"), F.col("own")).otherwise(good).alias("used"), "width", "height", "frame_count", "bound", F.posexplode_outer("items").alias("place", "item"))

    # A line without predictions has one row without a place; the codes of a line go with its first row.
    p = p.select("*", *[_at("item", f"$.{c}", "variant").alias(c) for c in ("frame", "bboxes")])
    p = p.withColumn("fits", F.col("frame").isNotNull() | F.col("bboxes").isNotNull() | _kind(F.col("item"), "OBJECT"))
    box = [_at("bboxes", f"$[{k}]", "bigint").alias(c) for k, c in enumerate("xyw")]
    p = p.select("*", F.when(_kind(F.col("frame"), "BIGINT"), _at("frame", "$", "bigint")).alias("n"), F.schema_of_variant("bboxes").alias("kind"), *box, *[_at("bboxes", f"$[{k}]", "variant").isNotNull().alias(f"has{k}") for k in (2, 3)])
    p = p.withColumn("f", F.when((F.col("n") >= 0) & F.coalesce(F.col("n") < F.col("frame_count"), F.lit(True)), F.col("n")))
    here, there = F.col("place").isNotNull(), F.col("bboxes").isNotNull()
    three = there & F.col("kind").startswith("ARRAY<") & F.col("has2") & ~F.col("has3")
    ints = three & (F.col("kind") == "ARRAY<BIGINT>") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull()
    p = p.withColumn("three", three).withColumn("ints", ints).withColumn("sound", F.col("ints") & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") > 0))
    of_item = _found(
        (here & ~F.col("fits"), "invalid_prediction"), (F.col("fits") & F.col("n").isNull(), "non_integer_frame"), (F.col("n") < 0, "negative_frame"), (F.col("n") >= F.col("frame_count"), "frame_out_of_range"),
        (F.col("fits") & ~there, "missing_bboxes"), (there & ~F.col("three"), "invalid_bbox_shape"), (F.col("three") & ~F.col("ints"), "non_integer_bbox"), (F.col("ints") & ~F.col("sound"), "invalid_bbox_value"), (F.col("sound") & (F.col("x") + F.col("w") > F.col("width")), "bbox_out_of_bounds"),
        (F.col("sound") & (F.col("w") * F.col("used.h") > (F.col("height") - F.col("y")) * F.col("used.w")), "ratio_height_violation"),
    )
    p = p.select("line", *key, "place", "f", "bound", F.when(F.coalesce("place", F.lit(0)) == 0, F.col("of_line")).alias("of_line"), of_item.alias("of_item"))
    earlier = Window.partitionBy(*key, "line").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("before", F.last("f", ignorenulls=True).over(earlier)).withColumn("nth", F.row_number().over(Window.partitionBy(*key, "line", "f").orderBy("place")))
    if allowed is not None:
        p = p.join(_keyed(allowed, F.col("frame").cast("long").alias("f")).distinct().withColumn("may", F.lit(True)), [*key, "f"], "left")
    else:
        p = p.withColumn("may", none("boolean"))
    f = F.col("f")
    of_frame = _found((f.isNotNull() & (F.col("nth") > 1), "duplicate_frame"), (f < F.col("before"), "non_ascending_order"), (f.isNotNull() & F.col("bound") & F.col("may").isNull(), "temporal_traceability_violation"))
    codes = F.concat_ws(" ", F.nullif("of_line", F.lit("")), F.nullif("of_item", F.lit("")), F.nullif(of_frame, F.lit("")))
    out = p.select("line", "video_id", "place", F.explode_outer(F.split(codes, " ")).alias("code")).where("code <> ''")
    return out.select("line", "video_id", F.when(~F.col("code").isin(*OF_LINE), F.col("place")).alias("place"), "code")
