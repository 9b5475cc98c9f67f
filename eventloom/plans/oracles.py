"""SQL for the queries, for another engine to check them by: standard SQL with DuckDB's time and list functions."""

ORACLES: dict[str, str] = {
    "record_assembly": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
per_source AS (SELECT trigger_number, source_id, count(*) AS came, sum(size_bytes) AS size_bytes FROM fragments GROUP BY ALL),
records AS (SELECT r.trigger_number, max(r.run_number) AS run_number, count(*) AS requested, count(p.came) AS received, coalesce(sum(p.size_bytes), 0)::BIGINT AS record_bytes,
  count(*) - count(p.came) AS missing, CASE WHEN count(p.came) = count(*) THEN 'complete' WHEN count(p.came) = 0 THEN 'empty' ELSE 'incomplete' END AS status
  FROM requests r LEFT JOIN per_source p USING (trigger_number, source_id) GROUP BY r.trigger_number)
SELECT trigger_number, run_number, requested, received, missing, record_bytes, status FROM records
""",
    "incomplete_records": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
per_source AS (SELECT trigger_number, source_id, count(*) AS came, sum(size_bytes) AS size_bytes FROM fragments GROUP BY ALL),
records AS (SELECT r.trigger_number, max(r.run_number) AS run_number, count(*) AS requested, count(p.came) AS received, coalesce(sum(p.size_bytes), 0)::BIGINT AS record_bytes,
  count(*) - count(p.came) AS missing, CASE WHEN count(p.came) = count(*) THEN 'complete' WHEN count(p.came) = 0 THEN 'empty' ELSE 'incomplete' END AS status
  FROM requests r LEFT JOIN per_source p USING (trigger_number, source_id) GROUP BY r.trigger_number)
SELECT trigger_number, requested, received, missing FROM records WHERE missing > 0
""",
    "unexpected_fragments": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem)
SELECT trigger_number, source_id, part, supplier, size_bytes FROM fragments f WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.trigger_number = f.trigger_number AND r.source_id = f.source_id)
""",
    "lost_fragments_by_run": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
per_source AS (SELECT trigger_number, source_id, count(*) AS came, sum(size_bytes) AS size_bytes FROM fragments GROUP BY ALL),
records AS (SELECT r.trigger_number, max(r.run_number) AS run_number, count(*) AS requested, count(p.came) AS received, coalesce(sum(p.size_bytes), 0)::BIGINT AS record_bytes,
  count(*) - count(p.came) AS missing, CASE WHEN count(p.came) = count(*) THEN 'complete' WHEN count(p.came) = 0 THEN 'empty' ELSE 'incomplete' END AS status
  FROM requests r LEFT JOIN per_source p USING (trigger_number, source_id) GROUP BY r.trigger_number)
SELECT run_number, status, count(*) AS n_records, sum(missing)::BIGINT AS lost_fragments FROM records GROUP BY ALL
""",
    "count_mode_assembly": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
asked AS (SELECT trigger_number, count(*) AS requested FROM requests GROUP BY ALL),
placed AS (SELECT trigger_number, row_number() OVER (PARTITION BY trigger_number ORDER BY arrival, part, supplier, source_id) AS nth FROM fragments SEMI JOIN requests USING (trigger_number, source_id)),
counted AS (SELECT trigger_number, requested, count(*) FILTER (nth <= requested) AS received, count(*) FILTER (nth > requested) AS late FROM asked LEFT JOIN placed USING (trigger_number) GROUP BY ALL)
SELECT *, CASE WHEN received = requested THEN 'complete' WHEN received = 0 THEN 'empty' ELSE 'incomplete' END AS status FROM counted
""",
    "fragment_routing": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
last AS (SELECT r.trigger_number, r.source_id, CASE WHEN d.trigger_type & 1 = 1 THEN 'trb-urgent' ELSE 'trb-' || (d.customer % 3) END AS destination, 1 AS n FROM requests r JOIN decisions d USING (trigger_number)),
nth AS (SELECT *, row_number() OVER (PARTITION BY trigger_number, source_id ORDER BY arrival, part, supplier) AS n FROM fragments)
SELECT trigger_number, source_id, destination, size_bytes, CASE WHEN destination IS NULL THEN 'unknown_destination' WHEN size_bytes IS NULL THEN 'unanswered' ELSE 'sent' END AS outcome FROM last FULL JOIN nth USING (trigger_number, source_id, n)
""",
    "monitor_samples": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
wanted AS (SELECT n_nationkey::BIGINT AS request_id, 1::BIGINT << (n_nationkey % 5)::INT AS trigger_type, 788918400000000 + n_nationkey * 86400000000 AS since FROM nation),
met AS (SELECT w.request_id, w.trigger_type, d.trigger_timestamp, d.trigger_number, row_number() OVER (PARTITION BY w.request_id ORDER BY d.trigger_timestamp, d.trigger_number) AS n
  FROM wanted w LEFT JOIN decisions d ON d.trigger_type = w.trigger_type AND d.trigger_timestamp >= w.since)
SELECT request_id, trigger_type, trigger_timestamp, trigger_number FROM met WHERE n = 1
""",
    "source_geo": """
WITH RECURSIVE fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem)
SELECT source_id, CASE WHEN source_id BETWEEN 1 AND 50 THEN 3 END AS detector_id, CASE WHEN source_id BETWEEN 1 AND 50 THEN source_id // 10 END AS crate_id, CASE WHEN source_id BETWEEN 1 AND 50 THEN source_id % 10 END AS slot_id, CASE WHEN source_id BETWEEN 1 AND 50 THEN source_id % 4 END AS stream_id, count(*) AS n_fragments, sum(size_bytes)::BIGINT AS bytes FROM fragments GROUP BY ALL
""",
    "decision_extent": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
extents AS (SELECT trigger_number, min(window_begin) AS extent_begin, max(window_end) AS extent_end, max(window_end) - min(window_begin) AS width FROM requests GROUP BY trigger_number)
SELECT * FROM extents
""",
    "slice_windows": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
extents AS (SELECT trigger_number, min(window_begin) AS extent_begin, max(window_end) AS extent_end, max(window_end) - min(window_begin) AS width FROM requests GROUP BY trigger_number),
cuts AS (SELECT *, CASE WHEN width > 0 THEN (width - 1) // 250 ELSE 0 END AS max_sequence_number FROM extents),
numbered AS (SELECT *, unnest(generate_series(0::BIGINT, max_sequence_number)) AS sequence_number FROM cuts),
slices AS (SELECT trigger_number, sequence_number, max_sequence_number, extent_begin + sequence_number * 250 AS slice_begin, least(extent_begin + sequence_number * 250 + 250, extent_end) AS slice_end FROM numbered)
SELECT * FROM slices
""",
    "data_requests": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
extents AS (SELECT trigger_number, min(window_begin) AS extent_begin, max(window_end) AS extent_end, max(window_end) - min(window_begin) AS width FROM requests GROUP BY trigger_number),
cuts AS (SELECT *, CASE WHEN width > 0 THEN (width - 1) // 250 ELSE 0 END AS max_sequence_number FROM extents),
numbered AS (SELECT *, unnest(generate_series(0::BIGINT, max_sequence_number)) AS sequence_number FROM cuts),
slices AS (SELECT trigger_number, sequence_number, max_sequence_number, extent_begin + sequence_number * 250 AS slice_begin, least(extent_begin + sequence_number * 250 + 250, extent_end) AS slice_end FROM numbered),
asked AS (SELECT s.trigger_number, s.sequence_number, r.source_id, greatest(s.slice_begin, r.window_begin) AS window_begin, least(s.slice_end, r.window_end) AS window_end
  FROM slices s JOIN requests r ON s.trigger_number = r.trigger_number AND r.window_begin <= s.slice_end AND r.window_end >= s.slice_begin)
SELECT * FROM asked
""",
    "trigger_type_counts": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
typed AS (SELECT d.*, b AS type FROM decisions d CROSS JOIN generate_series(0, 63) g(b) WHERE (trigger_type >> b) & 1 = 1)
SELECT run_number, type::INT AS type, count(*) AS received, count(*) FILTER (trigger_number IN (SELECT trigger_number FROM fragments)) AS completed FROM typed GROUP BY run_number, type
""",
    "run_filter": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders)
SELECT r AS run_number, count(*) FILTER (run_number = r) AS kept, count(*) FILTER (run_number <> r) AS dropped FROM decisions CROSS JOIN (VALUES (1995::BIGINT), (1997::BIGINT)) v(r) GROUP BY r
""",
    "duplicate_decisions": """
WITH RECURSIVE fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
n AS (SELECT source_id, row_number() OVER (PARTITION BY trigger_number, source_id ORDER BY arrival, part, supplier) AS n FROM fragments)
SELECT source_id, count(*) FILTER (n = 1) AS accepted, count(*) FILTER (n > 1) AS duplicated FROM n GROUP BY source_id
""",
    "invalid_requests": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions))
SELECT trigger_number, source_id FROM requests WHERE source_id > 5
""",
    "request_routes": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions))
SELECT CASE WHEN source_id <= 5 THEN 'readout-' || source_id END AS destination, count(*) AS n_requests FROM requests GROUP BY ALL
""",
    "tp_timeslices": """
WITH RECURSIVE primitives AS (SELECT event_id AS seqno, year(ts) AS run_number, user_id AS origin, epoch_us(ts) AS time_start, CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'payload' END AS type FROM events),
sets AS (SELECT min(seqno) AS seqno, run_number, origin, time_start // 5400000000 AS packet, min(time_start) AS start_time, max(time_start) AS end_time, list_sort(list(time_start)) AS objects
  FROM primitives WHERE type <> 'heartbeat' GROUP BY run_number, origin, time_start // 5400000000),
spread AS (SELECT *, unnest(generate_series(start_time // 3600000000, end_time // 3600000000)) AS slice_index FROM sets),
edges AS (SELECT *, (start_time <= slice_index * 3600000000 OR end_time >= (slice_index + 1) * 3600000000) AS edge FROM spread),
inside AS (SELECT seqno, run_number, origin, slice_index, edge, start_time, end_time,
  CASE WHEN edge THEN list_filter(objects, lambda t: t >= slice_index * 3600000000 AND t < (slice_index + 1) * 3600000000) ELSE objects END AS objects FROM edges),
sliced AS (SELECT seqno, run_number, origin, slice_index, objects, CASE WHEN edge THEN objects[1] ELSE start_time END AS start_time, CASE WHEN edge THEN objects[-1] ELSE end_time END AS end_time
  FROM inside WHERE len(objects) > 0),
in_slices AS (SELECT * FROM sliced QUALIFY row_number() OVER (PARTITION BY slice_index, origin, start_time ORDER BY seqno) = 1)
SELECT slice_index, count(*) AS n_sets, sum(len(objects))::BIGINT AS n_tps, count(DISTINCT origin) AS n_origins FROM in_slices GROUP BY slice_index
""",
    "tp_bundles": """
WITH RECURSIVE primitives AS (SELECT event_id AS seqno, year(ts) AS run_number, user_id AS origin, epoch_us(ts) AS time_start, CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'payload' END AS type FROM events),
sets AS (SELECT min(seqno) AS seqno, run_number, origin, time_start // 5400000000 AS packet, min(time_start) AS start_time, max(time_start) AS end_time, list_sort(list(time_start)) AS objects
  FROM primitives WHERE type <> 'heartbeat' GROUP BY run_number, origin, time_start // 5400000000),
spread AS (SELECT *, unnest(generate_series(start_time // 3600000000, end_time // 3600000000)) AS slice_index FROM sets),
edges AS (SELECT *, (start_time <= slice_index * 3600000000 OR end_time >= (slice_index + 1) * 3600000000) AS edge FROM spread),
inside AS (SELECT seqno, run_number, origin, slice_index, edge, start_time, end_time,
  CASE WHEN edge THEN list_filter(objects, lambda t: t >= slice_index * 3600000000 AND t < (slice_index + 1) * 3600000000) ELSE objects END AS objects FROM edges),
sliced AS (SELECT seqno, run_number, origin, slice_index, objects, CASE WHEN edge THEN objects[1] ELSE start_time END AS start_time, CASE WHEN edge THEN objects[-1] ELSE end_time END AS end_time
  FROM inside WHERE len(objects) > 0),
in_slices AS (SELECT * FROM sliced QUALIFY row_number() OVER (PARTITION BY slice_index, origin, start_time ORDER BY seqno) = 1)
SELECT slice_index, origin, count(*) AS n_sets, sum(len(objects))::BIGINT AS n_tps, arg_min(objects[1], start_time) AS first_time, arg_max(objects[-1], start_time) AS last_time FROM in_slices GROUP BY slice_index, origin
""",
    "tp_edge_replication": """
WITH RECURSIVE primitives AS (SELECT event_id AS seqno, year(ts) AS run_number, user_id AS origin, epoch_us(ts) AS time_start, CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'payload' END AS type FROM events),
sets AS (SELECT min(seqno) AS seqno, run_number, origin, time_start // 5400000000 AS packet, min(time_start) AS start_time, max(time_start) AS end_time, list_sort(list(time_start)) AS objects
  FROM primitives WHERE type <> 'heartbeat' GROUP BY run_number, origin, time_start // 5400000000),
spread AS (SELECT *, unnest(generate_series(start_time // 3600000000, end_time // 3600000000)) AS slice_index FROM sets),
edges AS (SELECT *, (start_time <= slice_index * 3600000000 OR end_time >= (slice_index + 1) * 3600000000) AS edge FROM spread),
inside AS (SELECT seqno, run_number, origin, slice_index, edge, start_time, end_time,
  CASE WHEN edge THEN list_filter(objects, lambda t: t >= slice_index * 3600000000 AND t < (slice_index + 1) * 3600000000) ELSE objects END AS objects FROM edges),
sliced AS (SELECT seqno, run_number, origin, slice_index, objects, CASE WHEN edge THEN objects[1] ELSE start_time END AS start_time, CASE WHEN edge THEN objects[-1] ELSE end_time END AS end_time
  FROM inside WHERE len(objects) > 0),
in_slices AS (SELECT * FROM sliced QUALIFY row_number() OVER (PARTITION BY slice_index, origin, start_time ORDER BY seqno) = 1)
SELECT n_slices, count(*) AS n_sets, sum(n_tps)::BIGINT AS n_tps FROM (SELECT seqno, count(*) AS n_slices, sum(len(objects)) AS n_tps FROM sliced GROUP BY seqno) GROUP BY n_slices
""",
    "slice_numbers": """
WITH RECURSIVE primitives AS (SELECT event_id AS seqno, year(ts) AS run_number, user_id AS origin, epoch_us(ts) AS time_start, CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'payload' END AS type FROM events),
sets AS (SELECT min(seqno) AS seqno, run_number, origin, time_start // 5400000000 AS packet, min(time_start) AS start_time, max(time_start) AS end_time, list_sort(list(time_start)) AS objects
  FROM primitives WHERE type <> 'heartbeat' GROUP BY run_number, origin, time_start // 5400000000),
spread AS (SELECT *, unnest(generate_series(start_time // 3600000000, end_time // 3600000000)) AS slice_index FROM sets),
edges AS (SELECT *, (start_time <= slice_index * 3600000000 OR end_time >= (slice_index + 1) * 3600000000) AS edge FROM spread),
inside AS (SELECT seqno, run_number, origin, slice_index, edge, start_time, end_time,
  CASE WHEN edge THEN list_filter(objects, lambda t: t >= slice_index * 3600000000 AND t < (slice_index + 1) * 3600000000) ELSE objects END AS objects FROM edges),
sliced AS (SELECT seqno, run_number, origin, slice_index, objects, CASE WHEN edge THEN objects[1] ELSE start_time END AS start_time, CASE WHEN edge THEN objects[-1] ELSE end_time END AS end_time
  FROM inside WHERE len(objects) > 0),
in_slices AS (SELECT * FROM sliced QUALIFY row_number() OVER (PARTITION BY slice_index, origin, start_time ORDER BY seqno) = 1)
SELECT DISTINCT run_number, slice_index, slice_index - min(slice_index) OVER (PARTITION BY run_number) + 1 AS slice_number FROM in_slices
""",
    "heartbeat_counts": """
WITH RECURSIVE primitives AS (SELECT event_id AS seqno, year(ts) AS run_number, user_id AS origin, epoch_us(ts) AS time_start, CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'payload' END AS type FROM events)
SELECT run_number, type, count(*) AS n FROM primitives GROUP BY ALL
""",
    "tps_per_slice": """
WITH RECURSIVE primitives AS (SELECT event_id AS seqno, year(ts) AS run_number, user_id AS origin, epoch_us(ts) AS time_start, CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'payload' END AS type FROM events),
sets AS (SELECT min(seqno) AS seqno, run_number, origin, time_start // 5400000000 AS packet, min(time_start) AS start_time, max(time_start) AS end_time, list_sort(list(time_start)) AS objects
  FROM primitives WHERE type <> 'heartbeat' GROUP BY run_number, origin, time_start // 5400000000),
spread AS (SELECT *, unnest(generate_series(start_time // 3600000000, end_time // 3600000000)) AS slice_index FROM sets),
edges AS (SELECT *, (start_time <= slice_index * 3600000000 OR end_time >= (slice_index + 1) * 3600000000) AS edge FROM spread),
inside AS (SELECT seqno, run_number, origin, slice_index, edge, start_time, end_time,
  CASE WHEN edge THEN list_filter(objects, lambda t: t >= slice_index * 3600000000 AND t < (slice_index + 1) * 3600000000) ELSE objects END AS objects FROM edges),
sliced AS (SELECT seqno, run_number, origin, slice_index, objects, CASE WHEN edge THEN objects[1] ELSE start_time END AS start_time, CASE WHEN edge THEN objects[-1] ELSE end_time END AS end_time
  FROM inside WHERE len(objects) > 0),
in_slices AS (SELECT * FROM sliced QUALIFY row_number() OVER (PARTITION BY slice_index, origin, start_time ORDER BY seqno) = 1)
SELECT run_number, slice_index, sum(len(objects))::BIGINT AS n_tps FROM in_slices GROUP BY ALL
""",
    "tardy_slices": """
WITH RECURSIVE fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
placed AS (SELECT *, arrival // 2592000000000 AS slice_index FROM fragments),
late AS (SELECT source_id, slice_index, (max(slice_index) OVER (PARTITION BY source_id ORDER BY trigger_number, part, supplier ROWS UNBOUNDED PRECEDING) - slice_index) * 2592000.0 AS t FROM placed)
SELECT source_id, slice_index, count(*) AS n_tardy, max(t)::DOUBLE AS largest_tardiness FROM late WHERE t > 0 GROUP BY ALL
""",
    "stream_rates": """
WITH RECURSIVE primitives AS (SELECT event_id AS seqno, year(ts) AS run_number, user_id AS origin, epoch_us(ts) AS time_start, CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'payload' END AS type FROM events),
r AS (SELECT run_number, type, count(*) AS n, arg_min(time_start, seqno) AS first_time, arg_max(time_start, seqno) AS last_time FROM primitives GROUP BY ALL)
SELECT *, CASE WHEN last_time > first_time THEN n / ((last_time - first_time) / 1e6) END AS per_second FROM r
""",
    "prescale": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
n AS (SELECT trigger_number, run_number, row_number() OVER (PARTITION BY run_number ORDER BY trigger_timestamp, trigger_number) AS nth FROM decisions)
SELECT *, nth % 10 = 1 AS is_stored FROM n
""",
    "sequence_completion": """
WITH RECURSIVE fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
written AS (SELECT DISTINCT trigger_number, source_id, trigger_number % 4 AS max_sequence_number FROM fragments), seqs AS (SELECT trigger_number, count(*) AS n_written, max(max_sequence_number) AS max_sequence_number FROM written GROUP BY trigger_number)
SELECT *, n_written > max_sequence_number AS has_token FROM seqs
""",
    "completion_tokens": """
WITH RECURSIVE fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
written AS (SELECT DISTINCT trigger_number, source_id, trigger_number % 4 AS max_sequence_number FROM fragments), seqs AS (SELECT trigger_number, count(*) AS n_written, max(max_sequence_number) AS max_sequence_number FROM written GROUP BY trigger_number)
SELECT trigger_number, 'app-' || (trigger_number % 10) AS decision_destination FROM seqs WHERE n_written > max_sequence_number
""",
    "file_per_event": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders)
SELECT trigger_number, run_number, trigger_timestamp, row_number() OVER (PARTITION BY run_number ORDER BY trigger_timestamp, trigger_number) - 1 AS file_index FROM decisions
""",
    "file_rollover": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
per_source AS (SELECT trigger_number, source_id, count(*) AS came, sum(size_bytes) AS size_bytes FROM fragments GROUP BY ALL),
records AS (SELECT r.trigger_number, max(r.run_number) AS run_number, count(*) AS requested, count(p.came) AS received, coalesce(sum(p.size_bytes), 0)::BIGINT AS record_bytes,
  count(*) - count(p.came) AS missing, CASE WHEN count(p.came) = count(*) THEN 'complete' WHEN count(p.came) = 0 THEN 'empty' ELSE 'incomplete' END AS status
  FROM requests r LEFT JOIN per_source p USING (trigger_number, source_id) GROUP BY r.trigger_number),
ordered AS (SELECT trigger_number, run_number, record_bytes, row_number() OVER (PARTITION BY run_number ORDER BY trigger_timestamp, trigger_number) AS n FROM records JOIN (SELECT trigger_number, trigger_timestamp FROM decisions) USING (trigger_number)),
filled AS (SELECT trigger_number, run_number, record_bytes, n, 0::BIGINT AS file_index, record_bytes AS held FROM ordered WHERE n = 1
  UNION ALL SELECT o.trigger_number, o.run_number, o.record_bytes, o.n, f.file_index + CASE WHEN f.held > 0 AND f.held + o.record_bytes > 1000000 THEN 1 ELSE 0 END,
    CASE WHEN f.held > 0 AND f.held + o.record_bytes > 1000000 THEN o.record_bytes ELSE f.held + o.record_bytes END
  FROM filled f JOIN ordered o ON o.run_number = f.run_number AND o.n = f.n + 1)
SELECT trigger_number, run_number, record_bytes, file_index FROM filled
""",
    "file_sizes": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
per_source AS (SELECT trigger_number, source_id, count(*) AS came, sum(size_bytes) AS size_bytes FROM fragments GROUP BY ALL),
records AS (SELECT r.trigger_number, max(r.run_number) AS run_number, count(*) AS requested, count(p.came) AS received, coalesce(sum(p.size_bytes), 0)::BIGINT AS record_bytes,
  count(*) - count(p.came) AS missing, CASE WHEN count(p.came) = count(*) THEN 'complete' WHEN count(p.came) = 0 THEN 'empty' ELSE 'incomplete' END AS status
  FROM requests r LEFT JOIN per_source p USING (trigger_number, source_id) GROUP BY r.trigger_number),
ordered AS (SELECT trigger_number, run_number, record_bytes, row_number() OVER (PARTITION BY run_number ORDER BY trigger_timestamp, trigger_number) AS n FROM records JOIN (SELECT trigger_number, trigger_timestamp FROM decisions) USING (trigger_number)),
filled AS (SELECT trigger_number, run_number, record_bytes, n, 0::BIGINT AS file_index, record_bytes AS held FROM ordered WHERE n = 1
  UNION ALL SELECT o.trigger_number, o.run_number, o.record_bytes, o.n, f.file_index + CASE WHEN f.held > 0 AND f.held + o.record_bytes > 1000000 THEN 1 ELSE 0 END,
    CASE WHEN f.held > 0 AND f.held + o.record_bytes > 1000000 THEN o.record_bytes ELSE f.held + o.record_bytes END
  FROM filled f JOIN ordered o ON o.run_number = f.run_number AND o.n = f.n + 1)
SELECT run_number, file_index, count(*) AS n_records, sum(record_bytes)::BIGINT AS file_bytes FROM filled GROUP BY ALL
""",
    "file_names": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders)
SELECT trigger_number, format('/data/test_raw_run{:06d}_{:04d}_writer_0.parquet', run_number, trigger_number) AS file_name, format('TriggerRecord{:05d}.{:04d}/RawData/Source_0x{:08x}', trigger_number, 0, trigger_type) AS record_path FROM decisions
""",
    "retry_schedule": """
SELECT n_nationkey::BIGINT AS attempt, least(1.0 * power(2.0, n_nationkey), 1000.0)::DOUBLE AS wait_ms FROM nation
""",
    "round_robin": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
apps AS (SELECT s_name AS connection_name, row_number() OVER (ORDER BY s_name) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT s_name FROM supplier)),
n AS (SELECT trigger_number, run_number, row_number() OVER (PARTITION BY run_number ORDER BY trigger_timestamp, trigger_number) AS nth FROM decisions)
SELECT trigger_number, run_number, nth, connection_name FROM n JOIN apps ON nth % m = k
""",
    "inflight_occupancy": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
completions AS (SELECT d.*, 'app-' || (customer % 10) AS app, (1 + trigger_number % 10) * 86400000000 AS latency_us, trigger_timestamp + (1 + trigger_number % 10) * 86400000000 AS completed
  FROM decisions d WHERE trigger_number IN (SELECT trigger_number FROM fragments)),
changes AS (SELECT 'app-' || (customer % 10) AS app, trigger_timestamp AS time, 1::BIGINT AS delta, trigger_number FROM decisions
  UNION ALL SELECT app, completed, -1, trigger_number FROM completions),
occupied AS (SELECT *, sum(delta) OVER (PARTITION BY app ORDER BY time, delta, trigger_number ROWS UNBOUNDED PRECEDING)::BIGINT AS slots FROM changes)
SELECT * FROM occupied
""",
    "busy_transitions": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
completions AS (SELECT d.*, 'app-' || (customer % 10) AS app, (1 + trigger_number % 10) * 86400000000 AS latency_us, trigger_timestamp + (1 + trigger_number % 10) * 86400000000 AS completed
  FROM decisions d WHERE trigger_number IN (SELECT trigger_number FROM fragments)),
changes AS (SELECT 'app-' || (customer % 10) AS app, trigger_timestamp AS time, 1::BIGINT AS delta, trigger_number FROM decisions
  UNION ALL SELECT app, completed, -1, trigger_number FROM completions),
occupied AS (SELECT *, sum(delta) OVER (PARTITION BY app ORDER BY time, delta, trigger_number ROWS UNBOUNDED PRECEDING)::BIGINT AS slots FROM changes)
SELECT app, time, trigger_number, slots, slots >= 3 AS busy FROM occupied WHERE (slots >= 3) <> (slots - delta >= 3)
""",
    "latency_stats": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
completions AS (SELECT d.*, 'app-' || (customer % 10) AS app, (1 + trigger_number % 10) * 86400000000 AS latency_us, trigger_timestamp + (1 + trigger_number % 10) * 86400000000 AS completed
  FROM decisions d WHERE trigger_number IN (SELECT trigger_number FROM fragments)),
newest AS (SELECT app, latency_us FROM completions QUALIFY row_number() OVER (PARTITION BY app ORDER BY completed DESC, trigger_number DESC) <= 1000), recent AS (SELECT app, (sum(latency_us) // count(*))::BIGINT AS average_latency_us FROM newest GROUP BY app), whole AS (SELECT app, count(*) AS n, min(latency_us) AS min_latency_us, max(latency_us) AS max_latency_us FROM completions GROUP BY app)
SELECT app, n, min_latency_us, max_latency_us, average_latency_us FROM whole JOIN recent USING (app)
""",
    "capacity_rate": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
completions AS (SELECT d.*, 'app-' || (customer % 10) AS app, (1 + trigger_number % 10) * 86400000000 AS latency_us, trigger_timestamp + (1 + trigger_number % 10) * 86400000000 AS completed
  FROM decisions d WHERE trigger_number IN (SELECT trigger_number FROM fragments)),
newest AS (SELECT app, latency_us FROM completions QUALIFY row_number() OVER (PARTITION BY app ORDER BY completed DESC, trigger_number DESC) <= 1000), recent AS (SELECT app, (sum(latency_us) // count(*))::BIGINT AS average_latency_us FROM newest GROUP BY app), whole AS (SELECT app, count(*) AS n, min(latency_us) AS min_latency_us, max(latency_us) AS max_latency_us FROM completions GROUP BY app)
SELECT app, min_latency_us, max_latency_us, CASE WHEN min_latency_us + max_latency_us > 0 THEN 1.5::DOUBLE / (0.5e-6::DOUBLE * (min_latency_us + max_latency_us)) END AS capacity_rate FROM whole
""",
    "remnants": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem)
SELECT trigger_number, run_number, 'app-' || (customer % 10) AS app FROM decisions WHERE trigger_number NOT IN (SELECT trigger_number FROM fragments)
""",
    "lag_inhibit": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
completions AS (SELECT d.*, 'app-' || (customer % 10) AS app, (1 + trigger_number % 10) * 86400000000 AS latency_us, trigger_timestamp + (1 + trigger_number % 10) * 86400000000 AS completed
  FROM decisions d WHERE trigger_number IN (SELECT trigger_number FROM fragments)),
marks AS (SELECT 'app-' || (customer % 10) AS app, trigger_timestamp AS time, 0 AS kind, trigger_number AS started, NULL::BIGINT AS ended, trigger_number FROM decisions UNION ALL SELECT app, completed, 1, NULL, trigger_number, trigger_number FROM completions),
run AS (SELECT *, coalesce(max(started) OVER w, 0) - coalesce(max(ended) OVER w, 0) AS lag FROM marks WINDOW w AS (PARTITION BY app ORDER BY time, kind, trigger_number ROWS UNBOUNDED PRECEDING))
SELECT app, time, kind, trigger_number, lag, lag >= 100 AS busy FROM run
""",
    "trb_info": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
per_source AS (SELECT trigger_number, source_id, count(*) AS came, sum(size_bytes) AS size_bytes FROM fragments GROUP BY ALL),
records AS (SELECT r.trigger_number, max(r.run_number) AS run_number, count(*) AS requested, count(p.came) AS received, coalesce(sum(p.size_bytes), 0)::BIGINT AS record_bytes,
  count(*) - count(p.came) AS missing, CASE WHEN count(p.came) = count(*) THEN 'complete' WHEN count(p.came) = 0 THEN 'empty' ELSE 'incomplete' END AS status
  FROM requests r LEFT JOIN per_source p USING (trigger_number, source_id) GROUP BY r.trigger_number),
extents AS (SELECT trigger_number, min(window_begin) AS extent_begin, max(window_end) AS extent_end, max(window_end) - min(window_begin) AS width FROM requests GROUP BY trigger_number),
cuts AS (SELECT *, CASE WHEN width > 0 THEN (width - 1) // 250 ELSE 0 END AS max_sequence_number FROM extents),
numbered AS (SELECT *, unnest(generate_series(0::BIGINT, max_sequence_number)) AS sequence_number FROM cuts),
slices AS (SELECT trigger_number, sequence_number, max_sequence_number, extent_begin + sequence_number * 250 AS slice_begin, least(extent_begin + sequence_number * 250 + 250, extent_end) AS slice_end FROM numbered),
asked AS (SELECT s.trigger_number, s.sequence_number, r.source_id, greatest(s.slice_begin, r.window_begin) AS window_begin, least(s.slice_end, r.window_end) AS window_end
  FROM slices s JOIN requests r ON s.trigger_number = r.trigger_number AND r.window_begin <= s.slice_end AND r.window_end >= s.slice_begin),
a AS (SELECT run_number, count(*) AS received_trigger_decisions, sum(width)::BIGINT AS trigger_decision_width, sum(received)::BIGINT AS fragments_in_the_book, sum(missing)::BIGINT AS pending_fragments FROM records JOIN extents USING (trigger_number) GROUP BY run_number),
b AS (SELECT run_number, count(*) AS generated_trigger_records FROM slices JOIN decisions USING (trigger_number) GROUP BY run_number),
c AS (SELECT run_number, count(*) AS generated_data_requests, sum(window_end - window_begin)::BIGINT AS data_request_width FROM asked JOIN decisions USING (trigger_number) GROUP BY run_number)
SELECT * FROM a LEFT JOIN b USING (run_number) LEFT JOIN c USING (run_number)
""",
    "trb_errors": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
per_source AS (SELECT trigger_number, source_id, count(*) AS came, sum(size_bytes) AS size_bytes FROM fragments GROUP BY ALL),
records AS (SELECT r.trigger_number, max(r.run_number) AS run_number, count(*) AS requested, count(p.came) AS received, coalesce(sum(p.size_bytes), 0)::BIGINT AS record_bytes,
  count(*) - count(p.came) AS missing, CASE WHEN count(p.came) = count(*) THEN 'complete' WHEN count(p.came) = 0 THEN 'empty' ELSE 'incomplete' END AS status
  FROM requests r LEFT JOIN per_source p USING (trigger_number, source_id) GROUP BY r.trigger_number),
lost AS (SELECT run_number, sum(missing)::BIGINT AS lost_fragments, count(*) FILTER (missing > 0) AS abandoned_trigger_records FROM records GROUP BY run_number),
odd AS (SELECT d.run_number, count(*) AS unexpected_fragments FROM fragments f JOIN decisions d USING (trigger_number) WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.trigger_number = f.trigger_number AND r.source_id = f.source_id) GROUP BY d.run_number),
bad AS (SELECT run_number, count(*) AS invalid_requests FROM requests WHERE source_id > 5 GROUP BY run_number)
SELECT run_number, lost_fragments, abandoned_trigger_records, coalesce(unexpected_fragments, 0) AS unexpected_fragments, coalesce(invalid_requests, 0) AS invalid_requests FROM lost LEFT JOIN odd USING (run_number) LEFT JOIN bad USING (run_number)
""",
    "dfo_info": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
completions AS (SELECT d.*, 'app-' || (customer % 10) AS app, (1 + trigger_number % 10) * 86400000000 AS latency_us, trigger_timestamp + (1 + trigger_number % 10) * 86400000000 AS completed
  FROM decisions d WHERE trigger_number IN (SELECT trigger_number FROM fragments))
SELECT run_number, count(*) AS decisions_received, count(*) AS decisions_sent, count(*) FILTER (trigger_number IN (SELECT trigger_number FROM completions)) AS tokens_received FROM decisions GROUP BY run_number
""",
    "application_info": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
open AS (SELECT 'app-' || (customer % 10) AS app, 946684800000000 - trigger_timestamp AS since FROM decisions WHERE trigger_number NOT IN (SELECT trigger_number FROM fragments))
SELECT app, count(*) AS outstanding_decisions, sum(since)::BIGINT AS total_time_since_assignment, min(since) AS min_time_since_assignment, max(since) AS max_time_since_assignment FROM open GROUP BY app
""",
    "complete_info": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
completions AS (SELECT d.*, 'app-' || (customer % 10) AS app, (1 + trigger_number % 10) * 86400000000 AS latency_us, trigger_timestamp + (1 + trigger_number % 10) * 86400000000 AS completed
  FROM decisions d WHERE trigger_number IN (SELECT trigger_number FROM fragments))
SELECT trigger_number, run_number, trigger_type, latency_us AS completion_time FROM completions
""",
    "writer_info": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
per_source AS (SELECT trigger_number, source_id, count(*) AS came, sum(size_bytes) AS size_bytes FROM fragments GROUP BY ALL),
records AS (SELECT r.trigger_number, max(r.run_number) AS run_number, count(*) AS requested, count(p.came) AS received, coalesce(sum(p.size_bytes), 0)::BIGINT AS record_bytes,
  count(*) - count(p.came) AS missing, CASE WHEN count(p.came) = count(*) THEN 'complete' WHEN count(p.came) = 0 THEN 'empty' ELSE 'incomplete' END AS status
  FROM requests r LEFT JOIN per_source p USING (trigger_number, source_id) GROUP BY r.trigger_number),
n AS (SELECT r.run_number, record_bytes, row_number() OVER (PARTITION BY r.run_number ORDER BY trigger_timestamp, trigger_number) AS nth FROM records r JOIN (SELECT trigger_number, trigger_timestamp FROM decisions) USING (trigger_number))
SELECT run_number, count(*) AS records_received, count(*) FILTER (nth % 10 = 1) AS records_written, coalesce(sum(record_bytes) FILTER (nth % 10 = 1), 0)::BIGINT AS bytes_output FROM n GROUP BY run_number
""",
    "store_info": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
per_source AS (SELECT trigger_number, source_id, count(*) AS came, sum(size_bytes) AS size_bytes FROM fragments GROUP BY ALL),
records AS (SELECT r.trigger_number, max(r.run_number) AS run_number, count(*) AS requested, count(p.came) AS received, coalesce(sum(p.size_bytes), 0)::BIGINT AS record_bytes,
  count(*) - count(p.came) AS missing, CASE WHEN count(p.came) = count(*) THEN 'complete' WHEN count(p.came) = 0 THEN 'empty' ELSE 'incomplete' END AS status
  FROM requests r LEFT JOIN per_source p USING (trigger_number, source_id) GROUP BY r.trigger_number),
ordered AS (SELECT trigger_number, run_number, record_bytes, row_number() OVER (PARTITION BY run_number ORDER BY trigger_timestamp, trigger_number) AS n FROM records JOIN (SELECT trigger_number, trigger_timestamp FROM decisions) USING (trigger_number)),
filled AS (SELECT trigger_number, run_number, record_bytes, n, 0::BIGINT AS file_index, record_bytes AS held FROM ordered WHERE n = 1
  UNION ALL SELECT o.trigger_number, o.run_number, o.record_bytes, o.n, f.file_index + CASE WHEN f.held > 0 AND f.held + o.record_bytes > 1000000 THEN 1 ELSE 0 END,
    CASE WHEN f.held > 0 AND f.held + o.record_bytes > 1000000 THEN o.record_bytes ELSE f.held + o.record_bytes END
  FROM filled f JOIN ordered o ON o.run_number = f.run_number AND o.n = f.n + 1)
SELECT run_number, sum(n)::BIGINT AS new_written_object, sum(b)::BIGINT AS new_bytes_output, max(file_index) AS written_files, arg_max(b, file_index) AS bytes_in_file
FROM (SELECT run_number, file_index, count(*) AS n, sum(record_bytes)::BIGINT AS b FROM filled GROUP BY ALL) GROUP BY run_number
""",
    "tp_writer_info": """
WITH RECURSIVE primitives AS (SELECT event_id AS seqno, year(ts) AS run_number, user_id AS origin, epoch_us(ts) AS time_start, CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'payload' END AS type FROM events),
sets AS (SELECT min(seqno) AS seqno, run_number, origin, time_start // 5400000000 AS packet, min(time_start) AS start_time, max(time_start) AS end_time, list_sort(list(time_start)) AS objects
  FROM primitives WHERE type <> 'heartbeat' GROUP BY run_number, origin, time_start // 5400000000),
spread AS (SELECT *, unnest(generate_series(start_time // 3600000000, end_time // 3600000000)) AS slice_index FROM sets),
edges AS (SELECT *, (start_time <= slice_index * 3600000000 OR end_time >= (slice_index + 1) * 3600000000) AS edge FROM spread),
inside AS (SELECT seqno, run_number, origin, slice_index, edge, start_time, end_time,
  CASE WHEN edge THEN list_filter(objects, lambda t: t >= slice_index * 3600000000 AND t < (slice_index + 1) * 3600000000) ELSE objects END AS objects FROM edges),
sliced AS (SELECT seqno, run_number, origin, slice_index, objects, CASE WHEN edge THEN objects[1] ELSE start_time END AS start_time, CASE WHEN edge THEN objects[-1] ELSE end_time END AS end_time
  FROM inside WHERE len(objects) > 0),
in_slices AS (SELECT * FROM sliced QUALIFY row_number() OVER (PARTITION BY slice_index, origin, start_time ORDER BY seqno) = 1),
a AS (SELECT run_number, count(*) FILTER (type = 'heartbeat') AS heartbeats_received, count(*) FILTER (type <> 'heartbeat') AS tps_received FROM primitives GROUP BY run_number),
b AS (SELECT run_number, count(DISTINCT slice_index) AS timeslices_written, sum(len(objects))::BIGINT AS tps_written FROM in_slices GROUP BY run_number)
SELECT * FROM a LEFT JOIN b USING (run_number)
""",
    "scrape_deltas": """
WITH RECURSIVE primitives AS (SELECT event_id AS seqno, year(ts) AS run_number, user_id AS origin, epoch_us(ts) AS time_start, CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'payload' END AS type FROM events)
SELECT run_number, time_start // 86400000000 AS scrape, count(*) AS tps_received FROM primitives WHERE type <> 'heartbeat' GROUP BY ALL
""",
    "fragment_checks": """
WITH RECURSIVE fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem)
SELECT source_id, count(*) AS n_fragments, count(*) FILTER (size_bytes < source_id * 500 OR size_bytes > 45000) AS n_outside, count(*) FILTER (size_bytes < source_id * 500 OR size_bytes > 45000) = 0 AS passed FROM fragments WHERE source_id BETWEEN 1 AND 7 GROUP BY source_id
""",
    "event_count_check": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
e AS (SELECT count(*) // 7 AS expected FROM decisions)
SELECT run_number, count(*) AS n_events, any_value(expected) AS expected, abs(count(*) - any_value(expected)) <= ceil(any_value(expected) * 0.1) AS passed FROM decisions, e GROUP BY run_number
""",
    "log_run_counts": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders)
SELECT run_number, count(*) AS n_sent FROM decisions GROUP BY run_number
""",
    "fake_fragments": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions))
SELECT trigger_number, source_id, (window_end - window_begin + 31) // 32 AS n_frames, 72 + (window_end - window_begin + 31) // 32 * 7200 AS size_bytes FROM requests
""",
    "stream_assembly": """
WITH RECURSIVE decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders),
requests AS (SELECT trigger_number, run_number, source_id, trigger_timestamp - 10 * source_id AS window_begin, trigger_timestamp + 100 * source_id AS window_end
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions)),
fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem),
per_source AS (SELECT trigger_number, source_id, count(*) AS came, sum(size_bytes) AS size_bytes FROM fragments GROUP BY ALL),
records AS (SELECT r.trigger_number, max(r.run_number) AS run_number, count(*) AS requested, count(p.came) AS received, coalesce(sum(p.size_bytes), 0)::BIGINT AS record_bytes,
  count(*) - count(p.came) AS missing, CASE WHEN count(p.came) = count(*) THEN 'complete' WHEN count(p.came) = 0 THEN 'empty' ELSE 'incomplete' END AS status
  FROM requests r LEFT JOIN per_source p USING (trigger_number, source_id) GROUP BY r.trigger_number)
SELECT trigger_number, requested, received, missing, status FROM records
""",
    "stream_slices": """
WITH RECURSIVE primitives AS (SELECT event_id AS seqno, year(ts) AS run_number, user_id AS origin, epoch_us(ts) AS time_start, CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'payload' END AS type FROM events)
SELECT time_start // 3600000000 AS slice_index, origin, count(*) AS n_tps, min(time_start) AS first_time, max(time_start) AS last_time FROM primitives WHERE type <> 'heartbeat' GROUP BY ALL
""",
}

_DECISIONS = """decisions AS (SELECT o_orderkey AS trigger_number, year(o_orderdate) AS run_number, epoch_us(o_orderdate) AS trigger_timestamp,
  ((1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) | CASE WHEN o_orderstatus = 'F' THEN 32 ELSE 0 END) AS trigger_type, o_custkey AS customer FROM orders)"""
_FRAGMENTS = """fragments AS (SELECT l_orderkey AS trigger_number, l_linenumber::BIGINT AS source_id, trunc(l_quantity * 1000)::BIGINT AS size_bytes, epoch_us(l_shipdate) AS arrival,
  l_partkey AS part, l_suppkey AS supplier FROM lineitem)"""
_COMPLETIONS = """completions AS (SELECT d.*, 'app-' || (customer % 10) AS app, (1 + trigger_number % 10) * 86400000000 AS latency_us, trigger_timestamp + (1 + trigger_number % 10) * 86400000000 AS completed
  FROM decisions d WHERE trigger_number IN (SELECT trigger_number FROM fragments))"""
_RUN_KEYED = f"""WITH {_DECISIONS}, {_FRAGMENTS},
keyed AS (SELECT trigger_number % 3 AS run_number, trigger_number // 3 AS trigger_number, trigger_timestamp FROM decisions),
requests AS (SELECT run_number, trigger_number, source_id, trigger_timestamp - 10 * source_id AS wb, trigger_timestamp + 100 * source_id AS we
  FROM (SELECT *, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM keyed)),
extents AS (SELECT run_number, trigger_number, min(wb) AS b, max(we) AS e FROM requests GROUP BY ALL),
slices AS (SELECT *, b + s * 250 AS sb, least(b + s * 250 + 250, e) AS se FROM (SELECT *, unnest(generate_series(0::BIGINT, (e - b - 1) // 250)) AS s FROM extents)),
asked AS (SELECT r.run_number, r.trigger_number, s AS sequence_number, source_id FROM slices z JOIN requests r ON r.run_number = z.run_number AND r.trigger_number = z.trigger_number AND wb <= se AND we >= sb),
came AS (SELECT trigger_number % 3 AS run_number, trigger_number // 3 AS trigger_number, part % 4 AS sequence_number, source_id, size_bytes, arrival, part, supplier FROM fragments)"""
_TIMED = f"""WITH {_DECISIONS}, {_FRAGMENTS},
requests AS (SELECT trigger_number, trigger_timestamp AS created, unnest(generate_series(1::BIGINT, 1 + trigger_number % 7)) AS source_id FROM decisions),
firsts AS (SELECT trigger_number, source_id, min(arrival) AS first FROM fragments GROUP BY ALL),
each AS (SELECT trigger_number, created, count(*) AS requested, count(*) FILTER (first - created <= 5184000000000) AS received, max(first) FILTER (first - created <= 5184000000000) AS last
  FROM requests LEFT JOIN firsts USING (trigger_number, source_id) GROUP BY ALL),
ends AS (SELECT *, CASE WHEN received = requested THEN greatest(last, created) ELSE created + 5184000000000 END AS ended FROM each),
lates AS (SELECT trigger_number, count(*) AS late FROM fragments SEMI JOIN requests USING (trigger_number, source_id) JOIN ends USING (trigger_number) WHERE arrival > ended GROUP BY ALL),
timed AS (SELECT trigger_number, requested, received, requested - received AS missing, ended, received <> requested AS timed_out, coalesce(late, 0) AS late,
  CASE WHEN received = requested THEN 'complete' WHEN received = 0 THEN 'empty' ELSE 'incomplete' END AS status FROM ends LEFT JOIN lates USING (trigger_number))"""
_ORDERED_MARKS = f"""WITH {_DECISIONS}, {_FRAGMENTS}, {_COMPLETIONS},
marks AS (SELECT 'app-' || (customer % 10) AS app, trigger_timestamp AS time, 0 AS kind, trigger_number AS started, NULL::BIGINT AS ended, trigger_number FROM decisions
  UNION ALL SELECT app, completed, 1, NULL, trigger_number, trigger_number FROM completions),
run AS (SELECT *, coalesce(max(started) OVER w, 0) - coalesce(max(ended) OVER w, 0) AS lag FROM marks WINDOW w AS (PARTITION BY app ORDER BY time, kind, trigger_number ROWS UNBOUNDED PRECEDING)),
turned AS (SELECT *, lag >= 100 AS busy, coalesce(lag(lag >= 100) OVER (PARTITION BY app ORDER BY time, kind, trigger_number), false) AS before FROM run)"""
_QUIET = """WITH rows AS (SELECT year(ts) AS run_number, epoch_us(ts) AS t FROM events WHERE event_type <> 'signup'),
sliced AS (SELECT *, t // 3600000000 AS slice_index FROM rows),
marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY run_number, slice_index ORDER BY t) > 600000000 THEN 1 ELSE 0 END AS opens FROM sliced),
parts AS (SELECT *, sum(opens) OVER (PARTITION BY run_number, slice_index ORDER BY t)::BIGINT AS closing FROM marked),
quiet AS (SELECT run_number, slice_index, closing, count(*) AS n, min(t) AS first_time, max(t) AS last_time FROM parts GROUP BY ALL)"""

ORACLES |= {
    "sliced_assembly": _RUN_KEYED
    + """,
per_source AS (SELECT run_number, trigger_number, sequence_number, source_id, sum(size_bytes) AS size_bytes FROM came GROUP BY ALL)
SELECT run_number, trigger_number, sequence_number, count(*) AS requested, count(size_bytes) AS received, coalesce(sum(size_bytes), 0)::BIGINT AS record_bytes, count(*) - count(size_bytes) AS missing,
  CASE WHEN count(size_bytes) = count(*) THEN 'complete' WHEN count(size_bytes) = 0 THEN 'empty' ELSE 'incomplete' END AS status
FROM asked LEFT JOIN per_source USING (run_number, trigger_number, sequence_number, source_id) GROUP BY ALL
""",
    "record_fragments": _RUN_KEYED
    + """,
counted AS (SELECT run_number, trigger_number, sequence_number, count(*) AS requested FROM asked GROUP BY ALL),
placed AS (SELECT run_number, trigger_number, sequence_number, source_id, size_bytes, row_number() OVER (PARTITION BY run_number, trigger_number, sequence_number ORDER BY arrival, part, supplier, source_id) AS nth
  FROM came SEMI JOIN asked USING (run_number, trigger_number, sequence_number, source_id)),
listed AS (SELECT run_number, trigger_number, sequence_number, requested, count(nth) FILTER (nth <= requested) AS received, coalesce(string_agg(source_id || ':' || size_bytes, ',' ORDER BY nth) FILTER (nth <= requested), '') AS fragments
  FROM counted LEFT JOIN placed USING (run_number, trigger_number, sequence_number) GROUP BY ALL)
SELECT *, requested - received AS missing, CASE WHEN received = requested THEN 'complete' WHEN received = 0 THEN 'empty' ELSE 'incomplete' END AS status FROM listed
""",
    "timed_records": _TIMED + " SELECT * FROM timed",
    "stream_timeouts": _TIMED + " SELECT trigger_number, requested, received, missing, timed_out, late, status FROM timed",
    "unexpected_decisions": f"""WITH {_DECISIONS}
SELECT r AS run_number, count(*) FILTER (run_number = r) AS received, count(*) FILTER (run_number <> r) AS unexpected_trigger_decisions FROM decisions CROSS JOIN (VALUES (1995::BIGINT), (1997::BIGINT)) v(r) GROUP BY r
""",
    "tardy_sets": """WITH rows AS (SELECT ascii(l_returnflag)::BIGINT AS run_number, epoch_us(l_shipdate) // 2592000000000 AS slice_index, l_orderkey * 1000000 AS arrival FROM lineitem),
each AS (SELECT DISTINCT run_number, slice_index, arrival FROM rows),
nexts AS (SELECT *, lead(arrival) OVER (PARTITION BY run_number, slice_index ORDER BY arrival) AS nxt FROM each),
ticks AS (SELECT DISTINCT run_number, arrival AS t FROM rows),
ready AS (SELECT n.run_number, t.t, n.nxt FROM nexts n ASOF JOIN ticks t ON n.run_number = t.run_number AND n.arrival + 20000000 <= t.t),
emitted AS (SELECT run_number, min(t) AS emitted FROM ready WHERE nxt IS NULL OR t < nxt GROUP BY run_number),
firsts AS (SELECT run_number, emitted, min(slice_index) AS first_index FROM each JOIN emitted USING (run_number) WHERE arrival <= emitted GROUP BY ALL),
marked AS (SELECT run_number, slice_index, coalesce(arrival > emitted AND slice_index < first_index, false) AS tardy FROM rows LEFT JOIN firsts USING (run_number))
SELECT run_number, slice_index, count(*) FILTER (tardy) AS dropped, count(*) FILTER (NOT tardy) AS kept FROM marked GROUP BY ALL
""",
    "quiet_slices": _QUIET + " SELECT * FROM quiet",
    "stream_quiet_slices": _QUIET + " SELECT run_number, slice_index, n, first_time, last_time FROM quiet",
    "prescale_of_run": f"""WITH {_DECISIONS},
n AS (SELECT run_number <> 1995 AS is_foreign, row_number() OVER (ORDER BY trigger_timestamp, trigger_number) AS nth FROM decisions)
SELECT is_foreign, NOT is_foreign AND nth % 7 = 1 AS is_stored, count(*) AS n, max(nth) AS last_nth FROM n GROUP BY ALL
""",
    "event_files": """WITH RECURSIVE came AS (SELECT l_orderkey % 3 AS run_number, l_orderkey // 3 AS trigger_number, trunc(l_quantity * 1000)::BIGINT AS size_bytes,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
filled AS (SELECT run_number, trigger_number, size_bytes, n, 0::BIGINT AS own, size_bytes AS held FROM came WHERE n = 1
  UNION ALL SELECT c.run_number, c.trigger_number, c.size_bytes, c.n, f.own + CASE WHEN f.held > 0 AND f.held + c.size_bytes > 60000 THEN 1 ELSE 0 END,
    CASE WHEN f.held > 0 AND f.held + c.size_bytes > 60000 THEN c.size_bytes ELSE f.held + c.size_bytes END
  FROM filled f JOIN came c ON c.run_number = f.run_number AND c.trigger_number = f.trigger_number AND c.n = f.n + 1),
files AS (SELECT run_number, trigger_number, own, count(*) AS n, sum(size_bytes)::BIGINT AS file_bytes FROM filled GROUP BY ALL)
SELECT run_number, row_number() OVER (PARTITION BY run_number ORDER BY trigger_number, own) - 1 AS file_index, trigger_number, n, file_bytes FROM files
""",
    "recent_latency": f"""WITH {_DECISIONS}, {_FRAGMENTS}, {_COMPLETIONS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY completed DESC, trigger_number DESC) AS n FROM completions)
SELECT app, count(*) AS n, sum(latency_us) FILTER (n <= 1000 AND completed >= 883612800000000) // nullif(count(*) FILTER (n <= 1000 AND completed >= 883612800000000), 0) AS average_latency_us FROM ranked GROUP BY app
""",
    "pool_state": f"""WITH {_DECISIONS}, {_FRAGMENTS}, {_COMPLETIONS},
changes AS (SELECT 'app-' || (customer % 10) AS app, trigger_timestamp AS time, 1 AS delta FROM decisions UNION ALL SELECT app, completed, -1 FROM completions),
pool AS (SELECT app, coalesce(sum(delta) FILTER (time <= 788918400000000), 0) AS s FROM changes GROUP BY app)
SELECT sum(s)::BIGINT AS used_slots, bool_and(s >= 3) AS all_busy, bool_and(s = 0) AS is_empty FROM pool
""",
    "inhibit_edges": _ORDERED_MARKS + " SELECT app, time, kind, trigger_number, lag, busy FROM turned WHERE busy <> before",
    "trb_counters": _TIMED
    + """,
reached AS (SELECT trigger_number, run_number, CASE WHEN customer % 11 = 0 THEN run_number + 1 ELSE run_number END AS builder_run FROM decisions JOIN (SELECT l_orderkey AS trigger_number FROM lineitem WHERE l_returnflag = 'R') USING (trigger_number)),
odd AS (SELECT builder_run, count(*) FILTER (run_number <> builder_run) AS unexpected_trigger_decisions, count(*) FILTER (run_number = builder_run) - count(DISTINCT trigger_number) FILTER (run_number = builder_run) AS duplicated_trigger_ids FROM reached GROUP BY ALL),
slow AS (SELECT run_number AS builder_run, count(*) FILTER (timed_out) AS timed_out_trigger_records, sum(late)::BIGINT AS late_fragments FROM timed JOIN decisions USING (trigger_number) GROUP BY ALL),
wanted AS (SELECT n_nationkey AS k, EXISTS (SELECT 1 FROM decisions WHERE trigger_type = 1::BIGINT << (n_nationkey % 5)::INT AND trigger_timestamp >= 788918400000000 + n_nationkey * 86400000000) AS found FROM nation),
asked AS (SELECT 1995 AS builder_run, count(*) AS received_trmon_requests, count(*) FILTER (found AND k % 3 <> 0) AS sent_trmon FROM wanted)
SELECT d.run_number, coalesce(unexpected_trigger_decisions, 0) AS unexpected_trigger_decisions, coalesce(duplicated_trigger_ids, 0) AS duplicated_trigger_ids, coalesce(timed_out_trigger_records, 0) AS timed_out_trigger_records,
  coalesce(late_fragments, 0) AS late_fragments, coalesce(received_trmon_requests, 0) AS received_trmon_requests, coalesce(sent_trmon, 0) AS sent_trmon
FROM (SELECT DISTINCT run_number FROM decisions) d LEFT JOIN odd ON odd.builder_run = d.run_number LEFT JOIN slow ON slow.builder_run = d.run_number LEFT JOIN asked ON asked.builder_run = d.run_number
""",
    "record_check": ORACLES["record_assembly"].rstrip().rsplit("SELECT trigger_number, run_number, requested", 1)[0]
    + "SELECT run_number, count(*) AS n_records, count(*) FILTER (received <> requested) AS n_wrong, count(*) FILTER (received <> requested) = 0 AS passed FROM records GROUP BY run_number",
    "file_count_check": ORACLES["store_info"].split("SELECT run_number, sum(n)")[0] + "SELECT run_number, count(DISTINCT file_index) AS n_files, 40::BIGINT AS expected, count(DISTINCT file_index) = 40 AS passed FROM filled GROUP BY run_number",
}
