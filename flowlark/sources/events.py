"""Connections from the driver's ``events`` table, for queries with an SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DAY_US = 86_400_000_000

#: One select list for both engines; {us} and {k} are the parts that differ.
_SELECT = """
select *,
  case when category = 'normal' then 'normal'
       when category = 'dos' then case flow_id % 3 when 0 then 'neptune' when 1 then 'smurf' else 'apache2' end
       when category = 'probe' then case flow_id % 2 when 0 then 'satan' else 'mscan' end
       when category = 'r2l' then 'guess_passwd' else 'rootkit' end as label
from (
  select *,
    case when day % 10 = 0 then 's0' when day % 10 = 5 then 'rej' when k < 5 then 'rstr' else 'sf' end as flag,
    case when day % 10 = 0 then 'dos' when day % 10 = 5 then 'probe' when k % 7 = 1 and flow_id % 5 = 0 then 'r2l'
         when k % 7 = 2 and flow_id % 9 = 0 then 'u2r' else 'normal' end as category
  from (
    select event_id as flow_id, {us} as start_us, cast(floor({us} / 86400000000.0) as bigint) as day,
      concat('u', cast(user_id as varchar(20))) as src, concat('h', cast(user_id % 3 as varchar(20))) as dst,
      event_type as service, {k} as k, cast(event_id % 5 as int) as dport,
      case event_id % 3 when 0 then 'tcp' when 1 then 'udp' else 'icmp' end as protocol_type,
      value * 100.0 as src_bytes, value * {k} as dst_bytes, cast({k} as double) as duration,
      case when event_id % 97 = 0 then 1.0 else 0.0 end as land, case when event_id % 89 = 0 then 1.0 else 0.0 end as wrong_fragment,
      cast(case when event_id % 13 = 0 then event_id % 4 else 0 end as double) as num_failed_logins,
      case when event_id % 11 = 0 then 1.0 else 0.0 end as is_guest_login, cast({k} % 4 as double) as hot,
      case when event_id % 211 = 0 then 1.0 else 0.0 end as root_shell, case when event_id % 307 = 0 then 1.0 else 0.0 end as su_attempted,
      case when event_id % 53 = 0 then 1.0 else 0.0 end as num_root, case when event_id % 31 = 0 then 1.0 else 0.0 end as num_file_creations
    from {events}
  ) a
) b
"""


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One connection for each event; see _SELECT."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us, k = "unix_micros(cast(ts as timestamp))", "cast(get_json_object(props, '$.k') as int)"
    return spark.sql(_SELECT.format(us=us, k=k, events="{events}"), events=events)


def oracle(name: str = "conn") -> str:
    """The same as a common table expression for DuckDB."""
    us, k = "epoch_us(ts)", "cast(json_extract_string(props, '$.k') as int)"
    return f"{name} as materialized ({_SELECT.format(us=us, k=k, events='events')})"
