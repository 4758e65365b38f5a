"""The engine's tables, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

BOX = "ymin double, xmin double, ymax double, xmax double"

TABLES = {
    "frames": "video_id string, frame_idx int, shot_idx int, path string, fps double",
    "vectors": "video_id string, frame_idx int, model string, vec array<float>",
    "video_metadata": "video_id string, author string, title string, publish_date date, keywords array<string>, keywords_text string",
    "objects": f"detection_id bigint, video_id string, frame_idx int, label string, score double, {BOX}, source string, suppressed boolean",
    "region_vectors": "detection_id bigint, vec array<float>",
    "ocr_text": f"video_id string, frame_start int, frame_end int, text_raw string, text_norm string, {BOX}, score double, source string",
    "asr_text": "video_id string, frame_idx_start int, frame_idx_end int, start double, end double, text_raw string, text_norm string",
    "spatial_edges": "video_id string, frame_idx int, subj_detection_id bigint, subj_label string, obj_detection_id bigint, obj_label string, relation string",
    "semantic_edges": "video_id string, frame_idx int, subj_id bigint, obj_id bigint, relation string, conf double, inferred boolean, evidence string, spatial_checked boolean",
    "label_types": "label string, categories array<string>",
    "label_dict": "term_norm string, label string, priority int",
    "relation_registry": "name string, subject_categories array<string>, object_categories array<string>, gate_type string, category string",
}

PLAN = (
    "entities array<struct<term:string,min_count:int>>, secondary_entities array<struct<term:string>>, "
    "attributes array<struct<entity_term:string,attribute_text:string>>, audio_mentions array<struct<term:string>>, clip_text string"
)


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def checked(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the table's columns in order and type; a missing column is an error that names it."""
    wanted = schema(table)
    missing = [f.name for f in wanted.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in wanted.fields])
