"""Replication metrics and change-data analytics on Spark."""

from lagscope.functions.scalars import flag_equals, id_origin, json_of, key_path
from lagscope.functions.text import (
    camel_to_words, contains_any, drop_comments, equals_any_ci, escape_key, field_literal, group1_all, is_backup_name,
    left_bytes, letters_digits, replace_group1, search_blocks, server_list, snake, split_address, split_trim,
)
from lagscope.functions.times import compact_time, duration_ms, epoch_ns, ns_to_s, parse_time, time_or
from lagscope.operators.changes import (
    apply_changes, change_stats, drop_looped, group_transactions, latest_changes, rows_of, transaction_rows, transaction_summary,
)
from lagscope.operators.copying import fan_out_copy
from lagscope.operators.filters import after_id, between, newer_than, time_range, user_schemas, user_tables
from lagscope.operators.gauges import (
    collect_gauges, heartbeat, missing_heartbeats, state_gauges, to_gauge_json, to_gauge_records,
)
from lagscope.operators.gtid import (
    contains_intervals, executed_intervals, gtid_intervals, gtid_text, intersect_intervals, merge_intervals, subtract_intervals, union_intervals,
)
from lagscope.operators.health import cluster_status, health_report, replication_errors
from lagscope.operators.history import as_of, deleted_rows, validity_intervals
from lagscope.operators.naming import smallest_free_suffix, unused
from lagscope.operators.ordered import ditto, head, number_by_position, number_rows, preview
from lagscope.operators.partials import RollupSpec, choose_interval, merge_partials, partials
from lagscope.operators.points import PointSpec, dedupe_points, project, split_rejects, stat_specs, to_line_protocol
from lagscope.operators.reconcile import reconcile_counts, reconcile_ranges, reconcile_rows, unlike_ranges
from lagscope.operators.rings import channels_in_rings
from lagscope.operators.rollups import (
    bucket, bucket_agg, bucket_max, bucket_sum, change_totals, duplicate_identity, exceptions_per_minute, fill_gaps, flatten_kv,
    has_exception, identity_members, last_value_by, next_watermark, null_mode, order_by_time, row_count,
)
from lagscope.operators.silence import silences
from lagscope.plans.named import NamedQueries, check_query
from lagscope.session import get_session, shared_folder
from lagscope.sources.changes import decode_changes, of_kind, read_changes
from lagscope.sources.nodes import read_nodes
from lagscope.sources.pages import extract_html_table, page_points
from lagscope.sources.polled import DbTable, ParquetTable, read_polled, saved_positions
from lagscope.sources.stats import (
    gen_rows, list_schemas, list_tables, read_node_status, read_stat, read_table, read_texts, read_variables,
)
from lagscope.streaming.changes import (
    closed_transactions, compact_table, current_table, finished_transactions, handle_changes, open_transactions, stream_table, stream_transactions,
)
from lagscope.streaming.collector import (
    Source, capture_changes, collect_once, collected_points, latest_state, run_collect, stream_points,
)
from lagscope.streaming.positions import WatermarkTable
from lagscope.streaming.rollups import fold_rollup, kept_rollup, panel, stream_rollup
from lagscope.streaming.silence import stream_silences, watch_hosts

__all__ = [name for name in dir() if not name.startswith("_")]
