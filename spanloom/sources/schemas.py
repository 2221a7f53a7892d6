"""Schemas at the edges. They are stated, never inferred."""

from __future__ import annotations

VIDEOS = "video_id string, filename string"
GROUND_TRUTH = "video_id string, level int, is_anomaly string, class_name string, start_time_sec double, end_time_sec double"
FRAMES = "video_id string, frame_idx int, ts double, emb array<float>"
EVENT = "struct<class_name: string, start_time_sec: double, end_time_sec: double, score: double, explanation: string>"
RUNTIME = "struct<total_time_ms: double, call_count: bigint, average_time_ms: double, call_times_ms: array<double>>"
METADATA = f"struct<frames_processed: bigint, chunks_processed: bigint, end_to_end_internal_time_ms: double, model_runtimes: array<{RUNTIME}>>"
PREDICTION = f"video_id string, events array<{EVENT}>, runtime_metadata {METADATA}"
MANIFEST_ENTRY = "struct<video_id: string, level: int, filename: string, duration_sec: double>"
