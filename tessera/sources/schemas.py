"""Schemas of the engine's relations, as DDL."""

TRACKS = "piece_id string, side string, track_idx int, name string, program int, is_drum boolean"
NOTES = f"{TRACKS}, pitch int, velocity int, t0 double, t1 double"
META = "piece_id string, side string, end_time double, tempo double, ts_numerator int"
BARS = "piece_id string, side string, bar_idx int, t double"
SEGMENTS = "piece_id string, seg_idx int, s0 double, s1 double, label string"
TICKS = "run string, tick int, is_hit boolean, backup_level double"
LIKELIHOOD = "run string, file string, avg_nll double, total_nll double, total_tokens bigint, error string"
