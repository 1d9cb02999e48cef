"""Label-side operators. Nothing on the selection side imports this module."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_right, cell_key, has_keyword, starts_with_any, surprisal
from ..scratch import written
from .aggregates import frame_frequency, gated_or, quantiles_higher
from .scoring import class_edges, with_cells

# Definitions of rare frames.
CAMERA_RARE = ("vehicle.motorcycle", "vehicle.bicycle", "vehicle.construction", "vehicle.trailer", "vehicle.emergency.ambulance", "vehicle.emergency.police", "animal", "movable_object.debris")
CAMERA_FLAGS = ("A_night", "A_rain", "B_rare_class", "C_crowd", "C_low_vis", "C_far")
LIDAR_FEW = ("child", "stroller", "wheelchair", "personal_mobility", "police_officer", "construction_worker", "emergency_vehicle", "animal", "pushable_pullable", "debris")
LIDAR_MEDIUM = ("motorcycle", "bicycle", "construction_vehicle", "trailer", "bus")
DISTANCE_BINS, POINT_BINS, TAU = (0.0, 20.0, 40.0, 1000.0), (0.0, 5.0, 20.0, 100000.0), 0.02
LIDAR_CLASSES = {
    "vehicle.car": "car", "vehicle.truck": "truck", "vehicle.bus.bendy": "bus", "vehicle.bus.rigid": "bus", "vehicle.trailer": "trailer", "vehicle.construction": "construction_vehicle",
    "vehicle.motorcycle": "motorcycle", "vehicle.bicycle": "bicycle", "vehicle.emergency.ambulance": "emergency_vehicle", "vehicle.emergency.police": "emergency_vehicle",
    "human.pedestrian.adult": "adult", "human.pedestrian.child": "child", "human.pedestrian.stroller": "stroller", "human.pedestrian.wheelchair": "wheelchair",
    "human.pedestrian.personal_mobility": "personal_mobility", "human.pedestrian.police_officer": "police_officer", "human.pedestrian.construction_worker": "construction_worker",
    "animal": "animal", "movable_object.barrier": "barrier", "movable_object.trafficcone": "traffic_cone", "movable_object.pushable_pullable": "pushable_pullable", "movable_object.debris": "debris",
}


def annotated(annotations: DataFrame, instances: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with their category name."""
    cat = categories.select(F.col("token").alias("category_token"), F.col("name").alias("category"))
    inst = instances.select(F.col("token").alias("instance_token"), "category_token").join(cat, "category_token", "left")
    return annotations.join(inst, "instance_token", "left")


def camera_flags(frames: DataFrame, boxes: DataFrame, crowd: int = 8, most_freq: float = 0.10) -> DataFrame:
    """Six flags a frame from scene text and boxes; a group counts toward is_rare only if it is rare enough in the pool."""
    per = boxes.groupBy("sample_token").agg(
        F.bool_or(starts_with_any(F.col("category"), CAMERA_RARE)).alias("B_rare_class"), (F.count_if(F.col("category").startswith("human.pedestrian.")) >= crowd).alias("C_crowd"),
        F.bool_or(F.col("visibility") == "1").alias("C_low_vis"), F.bool_or(F.col("num_lidar_pts").between(1, 5)).alias("C_far"),
    )
    met = frames.join(per, "sample_token", "left").withColumns({"A_night": has_keyword(F.col("scene_desc"), ["night"]), "A_rain": has_keyword(F.col("scene_desc"), ["rain"])})
    met = met.na.fill(False, list(CAMERA_FLAGS))
    return gated_or(met, CAMERA_FLAGS, most_freq).select("sample_token", "is_rare", *CAMERA_FLAGS)


def lidar_cells(boxes: DataFrame, kind: str = "cls", distance: str = "dist_m", points: str = "num_lidar_pts") -> DataFrame:
    return boxes.withColumn("cell", cell_key(F.col(kind), bin_right(F.col(distance), DISTANCE_BINS, clip=True), bin_right(F.col(points), POINT_BINS, clip=True)))


def cell_rarity(frames: DataFrame, boxes: DataFrame, tau: float = TAU, by: str = "split") -> DataFrame:
    """Rare cells of each frame (strictly rarer than tau in the split), flags of groups A, B, B' and C, and is_rare."""
    met = written(lidar_cells(boxes).select("sample_token", "cls", "num_lidar_pts", "dist_m", "visibility", "cell").join(frames.select("sample_token", by), "sample_token"), "boxes")  # read three times below
    freq = frame_frequency(met, "sample_token", "cell", [by], frames)
    rare = met.join(freq.filter(F.col("freq") < tau).select(by, "cell"), [by, "cell"], "left_semi").groupBy("sample_token").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    per = met.groupBy("sample_token").agg(
        F.bool_or(F.col("cls").isin(*LIDAR_FEW)).alias("B_few"), F.bool_or(F.col("cls").isin(*LIDAR_MEDIUM)).alias("Bp_medium"), F.count(F.lit(1)).alias("n_boxes"),
        F.bool_or(((F.col("num_lidar_pts") <= 5) & (F.col("dist_m") > 40.0)) | (F.col("visibility") == "1")).alias("C_sensor"),
    )
    out = frames.join(per, "sample_token", "left").join(rare, "sample_token", "left").withColumn("A_env", has_keyword(F.col("scene_desc"), ["rain", "night"]))
    out = out.na.fill(False, ["B_few", "Bp_medium", "C_sensor"]).na.fill(0, ["n_boxes"])
    cells = F.coalesce(F.col("cells"), F.array().cast("array<string>"))
    return out.select("sample_token", (F.size(cells) > 0).alias("is_rare"), "A_env", "B_few", "Bp_medium", "C_sensor", "n_boxes", F.array_join(cells, "|").alias("rare_cells"))


def behaviour_events(boxes: DataFrame, attributes: str = "attributes", context: str = "context", kind: str = "vru_group") -> DataFrame:
    """One row for each (instance, context, class and attribute)."""
    return boxes.select("instance_token", "sample_token", context, kind, F.explode(attributes).alias("attribute")).withColumn("event", F.concat_ws("|", F.col(context), F.col(kind), F.col("attribute")))


def _thresholds(df: DataFrame, values: Sequence[str], alpha: float) -> dict[str, Column]:
    """The 'higher' quantile of each value over the table, as literals: one aggregate, a row a value; null for an empty table."""
    found = {r["name"]: r["q0"] for r in quantiles_higher(df, [], values, [1 - alpha]).collect()}
    return {v: F.lit(found.get(v)).cast("double") for v in values}


def surprisal_labels(boxes: DataFrame, frames: DataFrame, v_split: str = "V", alpha: float = 0.10, kind: str = "vru_group") -> DataFrame:
    """Frame labels r1_class and r2_combo from surprisals fitted on V: classes by distinct instance, cells by frame share, thresholds by the 'higher' quantile over V frames; unseen classes and cells only raise ``unknown``."""
    frames = written(frames, "frames")
    seen = written(boxes.filter("num_lidar_pts >= 1").join(frames.select("sample_token", "split"), "sample_token"), "seen-boxes")  # read by every statistic
    v, v_frames = seen.filter(F.col("split") == v_split), frames.filter(F.col("split") == v_split)
    total = v.agg(F.count_distinct("instance_token").alias("__n"))
    classes = v.groupBy(kind).agg(F.count_distinct("instance_token").alias("n")).crossJoin(F.broadcast(total)).select(kind, (F.col("n") / F.col("__n")).alias("class_p"))
    edges = class_edges(v, kind, ["dist_m", "num_lidar_pts"])
    celled = written(with_cells(seen, edges, kind, "dist_m", "num_lidar_pts"), "celled-boxes")
    cells = frame_frequency(celled.filter(F.col("split") == v_split), "sample_token", "cell", frames=v_frames).select("cell", F.col("freq").alias("cell_p"))
    scored = celled.join(classes, kind, "left").join(cells, "cell", "left")
    known = lambda p: F.when(F.col(p).isNotNull(), surprisal(F.col(p)))
    worst = scored.groupBy("sample_token").agg(F.max(known("class_p")).alias("u1"), F.max(known("cell_p")).alias("u2"), F.bool_or(F.col("class_p").isNull() | F.col("cell_p").isNull()).alias("unknown"), F.count(F.lit(1)).alias("n_vru_visible"))
    base = written(frames.join(worst, "sample_token", "left").na.fill(0, ["u1", "u2", "n_vru_visible"]).na.fill(False, ["unknown"]), "frame-surprisals")
    ref = base.filter(F.col("split") == v_split)
    cut = _thresholds(ref, ["u1", "u2"], alpha)
    return base.select("sample_token", "split", (F.col("u1") > cut["u1"]).alias("r1_class"), (F.col("u2") > cut["u2"]).alias("r2_combo"), "unknown", "n_vru_visible", (F.col("u2") > cut["u2"]).alias("is_target"))


def conflict(speed: Column, x: Column, y: Column, v_min: float = 0.5, x_max: float = 20.0, y_abs: float = 4.0) -> Column:
    return F.coalesce((speed >= v_min) & (x > 0) & (x <= x_max) & (F.abs(y) <= y_abs), F.lit(False))


def hard(distance: Column, points: Column, far: float = 30.0, few: int = 10) -> Column:
    return (distance > far) | (points < few)


def relevant_objects(boxes: DataFrame, vru: Sequence[str], vehicles: Sequence[str], corridor: float = 2.0, most_distance: float = 40.0, least_points: int = 5, least_height: float = 20.0, least_share: float = 0.5) -> DataFrame:
    """Objects that matter for braking: VRU, or vehicles in the corridor; near, with enough points, tall enough and mostly inside the image.

    ``boxes`` has category, x, y (ego), corners (flat u, v of the unclipped projection), the clipped box and num_lidar_pts; the largest view of each object stays."""
    us, vs = (F.filter(F.transform(F.col("corners"), lambda c, i: F.when(i % 2 == k, c)), lambda c: c.isNotNull()) for k in (0, 1))
    finite = F.forall(F.col("corners"), lambda c: ~F.isnan(c) & (F.abs(c) < float("inf")))
    full = (F.array_max(us) - F.array_min(us)) * (F.array_max(vs) - F.array_min(vs))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    group = F.when(F.col("category").isin(*vru), F.lit("vru")).when(F.col("category").isin(*vehicles), F.lit("vehicle"))
    met = boxes.withColumns({"group": group, "dist_m": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2), "in_corridor": (F.col("x") > 0) & (F.abs(F.col("y")) <= corridor), "__area": area})
    met = met.withColumn("__full", F.when(finite, full).otherwise(F.raise_error(F.lit("corners are not finite"))))
    kept = met.filter((F.col("group") == "vru") | ((F.col("group") == "vehicle") & F.col("in_corridor"))).filter((F.col("dist_m") <= most_distance) & (F.col("num_lidar_pts") >= least_points) & (F.col("y2") - F.col("y1") >= least_height) & (F.col("__area") >= least_share * F.col("__full")))
    from .aggregates import first_by

    return first_by(kept, ["sample_token", "ann_token"], [F.col("__area").desc(), F.col("cam").asc()]).drop("__area", "__full")


VRU_CLASSES = {"vehicle.bicycle": "bicycle", "vehicle.motorcycle": "motorcycle"}


def load_boxes(annotations: DataFrame, egos: DataFrame, times: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """Road-user boxes in the ego frame: distance, x, y, speed along the instance's track, sorted attribute names.

    annotations: with category (``annotated``); egos: (sample_token, ego_q, ego_t); times: (sample_token, timestamp)."""
    from ..functions.geometry import yaw
    from .joins import adjacent_speed

    group = F.when(F.col("category").startswith("human.pedestrian."), F.lit("pedestrian")).otherwise(F.create_map(*[F.lit(x) for kv in VRU_CLASSES.items() for x in kv])[F.col("category")])
    met = annotations.withColumn("vru_group", group).filter("vru_group is not null").join(times, "sample_token").withColumns({"gx": F.col("translation")[0], "gy": F.col("translation")[1]})
    met = met.withColumn("speed_mps", adjacent_speed(met, "instance_token", "timestamp", "gx", "gy")).join(egos, "sample_token")
    dx, dy, a = F.col("gx") - F.col("ego_t")[0], F.col("gy") - F.col("ego_t")[1], yaw(F.col("ego_q"))
    met = met.withColumns({"dist_m": F.sqrt(dx * dx + dy * dy), "x": F.cos(a) * dx + F.sin(a) * dy, "y": F.cos(a) * dy - F.sin(a) * dx})
    if attributes is None:
        return met.withColumn("attributes", F.array().cast("array<string>"))
    names = met.select(F.col("token").alias("ann"), F.explode("attribute_tokens").alias("attribute_token")).join(attributes.select(F.col("token").alias("attribute_token"), "name"), "attribute_token").groupBy("ann").agg(F.array_sort(F.collect_list("name")).alias("attributes"))
    return met.join(names.withColumnRenamed("ann", "token"), "token", "left").withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))


def rhcio_labels(boxes: DataFrame, frames: DataFrame, v_split: str = "V", alpha: float = 0.10, min_pts: int = 1, v_min: float = 0.5, x_max: float = 20.0, y_abs: float = 4.0, far: float = 30.0, few: int = 10) -> tuple[DataFrame, DataFrame]:
    """Frame and instance tables of the surprisal definition, fitted on V.

    boxes: ``load_boxes``; frames: sample_token, scene_token, split, scene_desc. Classes by
    distinct instance, cells and behaviours as shares; thresholds are 'higher' quantiles over V
    frames, labels strictly above; what V has never seen only raises ``unknown``."""
    night, rain = has_keyword(F.col("scene_desc"), ["night"]), has_keyword(F.col("scene_desc"), ["rain"])
    f = frames.withColumns({"c_night": night, "c_rain": rain, "context": F.format_string("night=%d,rain=%d", night.cast("int"), rain.cast("int"))})
    seen = boxes.filter(F.col("num_lidar_pts") >= min_pts).join(f.select("sample_token", "split", "context"), "sample_token")
    v, v_frames = seen.filter(F.col("split") == v_split), f.filter(F.col("split") == v_split)
    total = v.select("category", "instance_token").distinct().agg(F.count(F.lit(1)).alias("__n"))
    classes = v.groupBy("category").agg(F.count_distinct("instance_token").alias("n")).crossJoin(F.broadcast(total)).select("category", (F.col("n") / F.col("__n")).alias("class_p"))
    celled = with_cells(seen, class_edges(v, "category", ["dist_m", "num_lidar_pts"]), "category", "dist_m", "num_lidar_pts")
    cells = frame_frequency(celled.filter(F.col("split") == v_split), "sample_token", "cell", frames=v_frames).select("cell", F.col("freq").alias("cell_p"))
    event = lambda d: d.withColumn("event", F.concat_ws("|", "context", "category", "attribute"))
    acts = event(seen.select("sample_token", "instance_token", "context", "split", "category", F.explode("attributes").alias("attribute")))
    shown = acts.filter(F.col("split") == v_split).groupBy("context", "event").agg(F.count_distinct("instance_token").alias("n"))
    behaviours = shown.join(v.groupBy("context").agg(F.count_distinct("instance_token").alias("nc")), "context").select("event", (F.col("n") / F.col("nc")).alias("event_p"))
    acted = acts.join(behaviours, "event", "left").groupBy("sample_token", "instance_token").agg(F.max(F.when(F.col("event_p").isNotNull(), surprisal(F.col("event_p")))).alias("u3"), F.bool_or(F.col("event_p").isNull()).alias("odd"))
    known = lambda p: F.when(F.col(p).isNotNull(), surprisal(F.col(p)))
    each = celled.join(classes, "category", "left").join(cells, "cell", "left").groupBy("sample_token", "instance_token").agg(
        F.max(known("class_p")).alias("u1"), F.max(known("cell_p")).alias("u2"), F.bool_or(F.col("class_p").isNull() | F.col("cell_p").isNull()).alias("new"), F.count(F.lit(1)).alias("n"),
        F.bool_or(conflict(F.col("speed_mps"), F.col("x"), F.col("y"), v_min, x_max, y_abs)).alias("moves"), F.bool_or(hard(F.col("dist_m"), F.col("num_lidar_pts"), far, few)).alias("hard"), F.first("category").alias("category"), F.first("vru_group").alias("vru_group"),
    ).join(acted, ["sample_token", "instance_token"], "left")
    per = each.groupBy("sample_token").agg(*[F.max(u).alias(u) for u in ("u1", "u2", "u3")], F.bool_or(F.col("new") | F.coalesce("odd", F.lit(False))).alias("unknown"), F.bool_or("moves").alias("i_conflict"), F.bool_or("hard").alias("h_hard"), F.sum("n").alias("n_vru_visible"))
    base = f.join(per, "sample_token", "left").na.fill(0, ["u1", "u2", "u3", "n_vru_visible"]).na.fill(False, ["unknown", "i_conflict", "h_hard"])
    ref = base.filter(F.col("split") == v_split)
    cut = _thresholds(ref, ["u1", "u2", "u3"], alpha)
    marked = each.withColumns({f"r{k}": F.coalesce(F.col(f"u{k}") > cut[f"u{k}"], F.lit(False)) for k in (1, 2, 3)})
    targets = marked.filter("r2").groupBy("sample_token").agg(F.array_join(F.array_sort(F.collect_set("instance_token")), "|").alias("target_instances"))
    frame = base.join(targets, "sample_token", "left").select(
        "sample_token", "scene_token", "split", (F.col("u1") > cut["u1"]).alias("r1_class"), (F.col("u2") > cut["u2"]).alias("r2_combo"), (F.col("u3") > cut["u3"]).alias("r3_behavior"), "i_conflict", "h_hard", "c_night", "c_rain", "unknown",
        (F.col("u2") > cut["u2"]).alias("is_target"), F.coalesce("target_instances", F.lit("")).alias("target_instances"), F.col("n_vru_visible").cast("int").alias("n_vru_visible"),
    )
    axes = F.array_compact(F.array(F.when(F.bool_or("moves"), F.lit("i_conflict")), *[F.when(F.bool_or(f"r{k}"), F.lit(n)) for k, n in ((1, "r1_class"), (2, "r2_combo"), (3, "r3_behavior"))]))
    instance = marked.groupBy("instance_token").agg(F.max("category").alias("category"), F.max("vru_group").alias("vru_group"), F.array_join(axes, "|").alias("axes"), F.count_distinct("sample_token").cast("int").alias("n_frames_visible"), F.array_join(F.array_sort(F.collect_set("sample_token")), "|").alias("frames"))
    return frame, instance
