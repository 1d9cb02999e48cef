"""Declared table contracts and their validation in one aggregate pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "1.2"
# The camera order.
CAMERAS = ("CAM_FRONT", "CAM_FRONT_LEFT", "CAM_FRONT_RIGHT", "CAM_BACK", "CAM_BACK_LEFT", "CAM_BACK_RIGHT")


class ContractError(ValueError):
    """A table or an input breaks its contract."""


@dataclass(frozen=True)
class Contract:
    """Columns as DDL, key columns, and the columns whose nulls (or NaN) are allowed besides strings and lists."""

    ddl: str
    key: tuple[str, ...]
    nullable: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


# Names, types and order of the columns of every table.
CONTRACTS: dict[str, Contract] = {
    "features_cache": Contract("sample_token string, cam string, scene_token string, split string, frame_idx int, img_path string, emb_row int, nov_knn float, det_n short, det_n_conf short, det_ent float, det_tmp float, unc float, qry_max float, qry_best string, q_bright float, q_blur float, q_ok boolean", ("sample_token", "cam")),
    "frame_scores": Contract("sample_token string, scene_token string, split string, frame_idx int, best_cam string, S_hybrid float, S_nov float, S_unc float, S_qry float, r_nov float, r_unc float, r_qry float, qry_best string, q_ok boolean, emb_row_best int, frame_emb_row int, n_cams short, det_n_conf_best short", ("sample_token",)),
    "selected": Contract("method string, seed int, rank int, sample_token string, scene_token string, best_cam string, S float, max_sim float, mmr_util float, reason string, budget_B int, split string", ("method", "seed", "sample_token")),
    "gt_rare": Contract("sample_token string, is_rare boolean, A_night boolean, A_rain boolean, B_rare_class boolean, C_crowd boolean, C_low_vis boolean, C_far boolean", ("sample_token",)),
    "frames": Contract("sample_token string, cam string, sd_token string, scene_token string, scene_name string, scene_desc string, split string, frame_idx int, timestamp long, img_path string", ("sample_token", "cam")),
    "cam_poses": Contract("sample_token string, cam string, translation array<double>, rotation array<double>, intrinsic array<double>", ("sample_token", "cam")),
    "gt_boxes_2d": Contract("sample_token string, cam string, ann_token string, category string, x1 float, y1 float, x2 float, y2 float, corners array<double>, depth float, visibility string, num_lidar_pts int", ("sample_token", "cam", "ann_token")),
    "boxes_3d": Contract("sample_token string, ann_token string, category string, corners array<double>", ("sample_token", "ann_token")),
    "lidar_index": Contract("sample_token string, scene_token string, scene_name string, split string, frame_idx int, timestamp long, lidar_path string, ego_x float, ego_y float, ego_yaw float", ("sample_token",)),
    "lidar_filter": Contract("sample_token string, n_points int, keep boolean, reason string", ("sample_token",)),
    "gt_rare_lidar": Contract("sample_token string, is_rare boolean, A_env boolean, B_few boolean, Bp_medium boolean, C_sensor boolean, n_boxes int, rare_cells string", ("sample_token",)),
    "t1_signals": Contract("sample_token string, ent float, inc float, n_det int, nov float", ("sample_token",)),
    "lidar_scores": Contract("sample_token string, scene_token string, split string, frame_idx int, keep boolean, rar float, nov float, unc float, r_rar float, r_nov float, r_unc float, s float", ("sample_token",)),
    "lidar_selected": Contract("method string, seed int, rank int, sample_token string, scene_token string, s float, max_sim float, mmr_util float, reason string, budget_B int", ("method", "seed", "sample_token")),
    "quality_cv": Contract("sample_token string, cam string, img_ok boolean, luma_mean float, v_mean float, v_p5 float, v_p95 float, sat_frac float, blob_max_frac float, blob_count short, tile_range float, veil float, noise_sigma float, lap_var_raw float, lap_var_dn float, sharp_ratio float", ("sample_token", "cam")),
    "context_frame": Contract("sample_token string, cam string, sun_elev_deg float, p_illum string, p_glare string, p_lens string, p_weather string, tag_illum string, tag_glare string, tag_lens string, tag_weather string, margin_illum float, margin_glare float, margin_lens float, margin_weather float, cv_flags string, review boolean, review_reasons string, context_version string", ("sample_token", "cam"), ("sun_elev_deg",)),
    "gt_rhcio_frame": Contract("sample_token string, scene_token string, split string, r1_class boolean, r2_combo boolean, r3_behavior boolean, i_conflict boolean, h_hard boolean, c_night boolean, c_rain boolean, unknown boolean, is_target boolean, target_instances string, n_vru_visible int", ("sample_token",)),
    "gt_rhcio_instance": Contract("instance_token string, category string, vru_group string, axes string, n_frames_visible int, frames string", ("instance_token",)),
    "rare_objects": Contract("sample_token string, object_id string, source string, cls_pred string, cx float, cy float, cz float, l float, w float, h float, yaw float, pts int, dist_m float, track_id string, speed_mps float, score_shape float, score_slice float, score_vru float, score_unc float, r_sem float, concept_top string, concept_score float, s_obj float, missed_by_model boolean, reasons string", ("sample_token", "object_id"), ("speed_mps", "r_sem", "concept_score")),
    "rare_frames": Contract("sample_token string, scene_token string, gate string, gate_fail string, ood_flag boolean, s_objects float, crowd int, weather_pred string, s_frame float, pred_tags string, evidence string, rank int, selected boolean, explore boolean", ("sample_token",), ("rank",)),
    "rare_obj_cam": Contract("sample_token string, object_id string, cam string, x1 float, y1 float, x2 float, y2 float, visible_frac float", ("sample_token", "object_id")),
    "lidar_calib": Contract("sample_token string, R array<double>, t array<double>", ("sample_token",)),
    "bench_split": Contract("scene_token string, scene_name string, bench_split string, engine_split string, n_frames int", ("scene_token",)),
    "media_manifest": Contract("sample_token string, cam string, img_path string, sha256 string, w short, h short", ("sample_token", "cam")),
    "judge_det": Contract("judge string, sample_token string, cam string, coco_label short, group string, score float, x1 float, y1 float, x2 float, y2 float", ()),
    "aeb_objects": Contract("sample_token string, cam string, ann_token string, instance_token string, scene_token string, category string, group string, x1 float, y1 float, x2 float, y2 float, dist_m float, in_corridor boolean, num_lidar_pts int", ("sample_token", "ann_token")),
    "judge_struggle": Contract("judge string, sample_token string, ann_token string, instance_token string, scene_token string, group string, best_iou float, best_score float, struggle boolean, unc float", ("judge", "sample_token", "ann_token")),
}

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def missing_number(column: str, kind: T.DataType) -> Column:
    c = F.col(column)
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def profile(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, duplicate keys, and null counts of the numeric columns that must have values."""
    contract = CONTRACTS[name]
    if lost := [f.name for f in contract.schema if f.name not in df.columns]:
        raise ContractError(f"{name}: columns missing: {', '.join(lost)}")
    checks = [F.count(F.lit(1)).alias("rows")]
    numbers = [f for f in contract.schema if isinstance(f.dataType, _NUMBERS) and f.name not in contract.nullable]
    checks += [F.count_if(missing_number(f.name, df.schema[f.name].dataType)).alias(f"null_{f.name}") for f in numbers]
    if "cam" in contract.schema.names:
        checks.append(F.count_if(~F.col("cam").isin(*CAMERAS)).alias("bad_cam"))
    return df.agg(*checks)


def duplicate_keys(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def validate(df: DataFrame, name: str) -> DataFrame:
    """``df`` cast to its contract, columns in contract order and no others; raises ContractError."""
    contract = CONTRACTS[name]
    row = profile(df, name).first().asDict()
    broken = [f"{k}: {v}" for k, v in row.items() if k != "rows" and v]
    if contract.key and not duplicate_keys(df, contract.key).isEmpty():
        broken.append(f"duplicate keys on {', '.join(contract.key)}")
    if broken:
        raise ContractError(f"{name}: {'; '.join(broken)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.schema])
