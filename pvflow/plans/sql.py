"""SQL fragments for the checks: the sample tables seen as the engine's inputs."""

START_US = 1704067200000000
STOP_US = 1706659200000000

DENSE = """pv AS (SELECT 'ev:' || event_type AS pv_name, epoch_us(ts) AS ts_us, event_id AS seq, value FROM events)"""

SPARSE = """pv AS (SELECT 'user:' || user_id AS pv_name,
  CASE event_type WHEN 'error' THEN 'Fail' WHEN 'signup' THEN 'Disconnec' ELSE 'Data' END AS event_type,
  event_type AS source, epoch_us(ts) AS ts_us, event_id AS seq, value FROM events)"""


def definitions(prefix: str) -> str:
    return f"""def AS (SELECT CAST(r_regionkey AS BIGINT) AS def_id, '{prefix} ' || r_name AS snapshot_name,
  lower(regexp_replace('{prefix} ' || r_name, '[^A-Za-z0-9-]', '_', 'g')) AS queue_name,
  CAST(r_regionkey + 1 AS BIGINT) * 86400000 AS w_ms,
  CASE r_regionkey WHEN 0 THEN 0 WHEN 1 THEN 3600000 ELSE 259200000 END AS push_ms,
  {START_US} AS start_us, {STOP_US} AS stop_us FROM region)"""


DENSE_MEMBERS = """mem AS (SELECT def.*, unnest(['ev:click','ev:error','ev:none','ev:purchase','ev:signup','ev:view']) AS pv_name FROM def)"""

SPARSE_MEMBERS = """mem AS (SELECT def.*, 'user:' || c_custkey AS pv_name FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN def ON def_id = n_regionkey)"""

ROUTED = """routed AS (SELECT mem.*, pv.ts_us, pv.seq, pv.value,
  CAST((pv.ts_us - start_us) // (w_ms * 1000) + 1 AS BIGINT) AS iter_index
  FROM pv JOIN mem USING (pv_name) WHERE pv.ts_us >= start_us AND pv.ts_us < stop_us)"""

DENSE_SNAP = (DENSE, definitions("Snap"), DENSE_MEMBERS, ROUTED)
SPARSE_DATA = """pv AS (SELECT 'user:' || user_id AS pv_name, epoch_us(ts) AS ts_us, event_id AS seq, value
  FROM events WHERE event_type NOT IN ('error', 'signup'))"""
SPARSE_SNAP = (SPARSE_DATA, definitions("Site"), SPARSE_MEMBERS, ROUTED)

ITERS = """iters AS (SELECT queue_name, snapshot_name, start_us, stop_us, w_ms, i AS iter_index,
  least(start_us + i * w_ms * 1000, stop_us) AS to_us
  FROM def, LATERAL (SELECT unnest(range(1, CAST(ceil((stop_us - start_us) / (w_ms * 1000)) AS BIGINT) + 1)) AS i))"""

LAST = """last AS (SELECT * FROM routed QUALIFY row_number() OVER (PARTITION BY queue_name, pv_name, iter_index ORDER BY ts_us DESC, seq DESC) = 1)"""

GRID = """grid AS (SELECT iters.*, mem.pv_name, last.seq AS own_seq,
  last_value(last.ts_us IGNORE NULLS) OVER w AS ts_us, last_value(last.seq IGNORE NULLS) OVER w AS seq,
  last_value(last.value IGNORE NULLS) OVER w AS value
  FROM iters JOIN mem USING (queue_name) LEFT JOIN last
    ON last.queue_name = iters.queue_name AND last.pv_name = mem.pv_name AND last.iter_index = iters.iter_index
  WINDOW w AS (PARTITION BY iters.queue_name, mem.pv_name ORDER BY iters.iter_index ROWS UNBOUNDED PRECEDING))"""

TRIGGERS = f"""trg AS (SELECT queue_name, w_ms, epoch_us(ts) AS trigger_us, event_id AS trigger_seq,
  CAST(row_number() OVER (PARTITION BY queue_name ORDER BY ts, event_id) AS BIGINT) AS iter_index
  FROM events JOIN def ON def_id = event_id % 5 WHERE event_type = 'error'
  UNION ALL
  SELECT queue_name, any_value(w_ms), any_value(stop_us), NULL, count(event_id) + 1
  FROM def LEFT JOIN events ON def_id = event_id % 5 AND event_type = 'error' GROUP BY queue_name)"""

ASSIGNED = """assigned AS (SELECT routed.* EXCLUDE (iter_index), trg.iter_index, trg.trigger_us
  FROM routed ASOF JOIN trg ON routed.queue_name = trg.queue_name AND routed.ts_us <= trg.trigger_us)"""

SUBS = """sub AS (SELECT c_custkey AS id, 'user:' || (c_custkey % 150) AS pv_name, c_mktsegment AS channel_destination,
  CAST(1 + 2 * (c_nationkey % 2) AS INTEGER) AS event_serialization, c_custkey % 3 = 0 AS processed,
  1704067200000000 + (c_custkey * 1009 % 2592000) * 1000000 AS ts_us FROM customer)"""

CONSUMERS = """member AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' ELSE 'HOUSEHOLD' END AS topic,
  'group-' || s_nationkey AS group_name, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS member_id FROM supplier)"""


def mp_int(e: str) -> str:
    """Hexadecimal MsgPack of a whole number from -32 up."""
    return f"""(CASE WHEN {e} < 0 THEN to_hex(256 + {e}) WHEN {e} < 128 THEN lpad(to_hex({e}), 2, '0') WHEN {e} < 256 THEN 'CC' || to_hex({e})
  WHEN {e} < 65536 THEN 'CD' || lpad(to_hex({e}), 4, '0') WHEN {e} < 4294967296 THEN 'CE' || lpad(to_hex({e}), 8, '0')
  ELSE 'CF' || lpad(to_hex({e}), 16, '0') END)"""


def mp_text(e: str) -> str:
    return f"""(CASE WHEN strlen({e}) < 32 THEN to_hex(160 + strlen({e})) ELSE 'D9' || lpad(to_hex(strlen({e})), 2, '0') END || hex({e}))"""


def mp_double(e: str) -> str:
    return f"'CB' || hex(CAST(CAST(CAST({e} AS DOUBLE) AS BIT) AS BLOB))"


def mp_map(**entries: str) -> str:
    """A map of up to 15 entries, whose values are hexadecimal already."""
    return f"'8{len(entries):X}' || " + " || ".join(f"'{0xA0 + len(k):X}{k.encode().hex().upper()}' || {v}" for k, v in entries.items())
