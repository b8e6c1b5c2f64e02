"""Queries over the driver's tables with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlark import fixed
from flowlark.functions import columns as C
from flowlark.operators import binning, features, flows, forests, fusion, histogram, metrics, rules
from flowlark.operators.history import _dealt, with_history
from flowlark.operators.order import with_sequence
from flowlark.plans import report
from flowlark.plans.detector import Detector
from flowlark.session import table
from flowlark.sources import events as E
from flowlark.sources import records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one. The SQL may use conn, hist, hit and fused."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = _with_tables(sql)
        return f

    return register


# ---- tables: the same in both engines ----------------------------------------------------------------------------


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.connections(spark, sf_dir)


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections with a day's window and the last 100."""
    return with_history(with_sequence(conn(spark, sf_dir), "start_us", "flow_id"), E.DAY_US, 100)


def hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_hits(hist(spark, sf_dir))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule hits of single connections fused with stand-ins for the two models, which SQL can compute; see detected()."""
    rows = rules.with_hits(conn(spark, sf_dir))
    rows = rows.withColumns(
        {
            "attack_prob": F.expr("((flow_id * 37) % 100) / 100.0D"),
            "novelty": F.expr("((flow_id * 7919) % 1000) / 1000.0D"),
            "supervised_category": F.expr("case flow_id % 5 when 0 then 'normal' when 1 then 'dos' when 2 then 'probe' when 3 then 'r2l' else 'u2r' end"),
        }
    )
    rows = rows.withColumns({"supervised_alert": F.col("attack_prob") >= 0.9, "anomaly_alert": F.col("novelty") >= 0.99})
    return fusion.fuse(rows)


def detected(rows: DataFrame, **parameters) -> tuple[Detector, DataFrame]:
    """The detector fitted to ``rows`` (connections with history and category) and their verdicts."""
    det = Detector.fit(rows, **parameters)
    return det, det.predict(rows)


_STATE = {"n": "1", "e": "case when flag in ('s0','s1','s2','s3') then 1 else 0 end", "r": "case when flag in ('rej','rsto','rstr') then 1 else 0 end"}


def _hist_sql() -> str:
    out = []
    for p, keys in (("h", "dst"), ("s", "service"), ("hs", "dst, service")):
        for k, v in _STATE.items():
            out.append(
                f"cast(sum({v}) over (partition by {keys} order by start_us range between {E.DAY_US} preceding and current row)"
                f" - sum({v}) over (partition by {keys}, start_us order by seq rows between current row and unbounded following) as bigint) as {p}_{k}"
            )
    for p, keys in (("d", "dst"), ("ds", "dst, service"), ("dp", "dst, dport")):
        for k, v in _STATE.items():
            out.append(f"cast(coalesce(sum({v}) over (partition by {keys} order by seq range between 100 preceding and 1 preceding), 0) as bigint) as {p}_{k}")
    counts = "select *, " + ", ".join(out) + " from (select *, row_number() over (order by start_us, flow_id) - 1 as seq from conn)"
    rate = lambda a, b, name: f"case when {b} > 0 then cast({a} as double) / {b} else 0.0 end as {name}"
    less = lambda a, b, name: f"case when {b} > 0 then 1.0 - cast({a} as double) / {b} else 0.0 end as {name}"
    made = [
        'cast(h_n as double) as "count"', "cast(s_n as double) as srv_count", rate("h_e", "h_n", "serror_rate"), rate("s_e", "s_n", "srv_serror_rate"), rate("h_r", "h_n", "rerror_rate"),
        rate("s_r", "s_n", "srv_rerror_rate"), rate("hs_n", "h_n", "same_srv_rate"), less("hs_n", "h_n", "diff_srv_rate"), less("hs_n", "s_n", "srv_diff_host_rate"),
        "cast(d_n as double) as dst_host_count", "cast(ds_n as double) as dst_host_srv_count", rate("ds_n", "d_n", "dst_host_same_srv_rate"), less("ds_n", "d_n", "dst_host_diff_srv_rate"),
        rate("dp_n", "d_n", "dst_host_same_src_port_rate"), "0.0 as dst_host_srv_diff_host_rate", rate("d_e", "d_n", "dst_host_serror_rate"), rate("ds_e", "ds_n", "dst_host_srv_serror_rate"),
        rate("d_r", "d_n", "dst_host_rerror_rate"), rate("ds_r", "ds_n", "dst_host_srv_rerror_rate"),
    ]
    return f"hist as materialized (select *, {', '.join(made)} from ({counts}))"


_SQL_RULES = {
    "R01": "flag in ('s0','s1','s2','s3') and greatest(serror_rate, srv_serror_rate) >= 0.85 and \"count\" >= 100",
    "R02": "protocol_type = 'icmp' and src_bytes >= 800 and \"count\" >= 200",
    "R03": "service = 'http' and \"count\" >= 60 and same_srv_rate >= 0.90 and src_bytes >= 1500",
    "R04": "wrong_fragment >= 1",
    "R05": "land >= 1",
    "R06": "diff_srv_rate >= 0.55 and dst_host_count >= 30 and dst_host_same_srv_rate <= 0.35",
    "R07": "greatest(rerror_rate, srv_rerror_rate) >= 0.60 and \"count\" >= 3",
    "R08": "srv_diff_host_rate >= 0.70 and dst_host_srv_diff_host_rate >= 0.40",
    "R09": "num_failed_logins >= 2",
    "R10": "is_guest_login >= 1 and (hot >= 2 or num_file_creations >= 1)",
    "R11": "root_shell >= 1 or su_attempted >= 1",
    "R12": "num_root >= 1 and num_file_creations >= 1",
}
_LOCAL = ("R04", "R05", "R09", "R10", "R11", "R12")
_ORDER = ("R01", "R02", "R11", "R03", "R04", "R05", "R06", "R08", "R09", "R12", "R07", "R10")
_SEVERITY = {r: s for s, rs in (("critical", "R01 R02 R11"), ("high", "R03 R04 R05 R06 R08 R09 R12"), ("medium", "R07 R10")) for r in rs.split()}
_CATEGORY = {r: c for c, rs in (("dos", "R01 R02 R03 R04 R05"), ("probe", "R06 R07 R08"), ("r2l", "R09 R10"), ("u2r", "R11 R12")) for r in rs.split()}


def _hits_sql(name: str, source: str, only: tuple[str, ...] = _ORDER) -> str:
    tests = ", ".join(f"({_SQL_RULES[r]}) as f_{r}" for r in only)
    order = [r for r in _ORDER if r in only]
    first = lambda value, default: "case " + " ".join(f"when f_{r} then {value(r)}" for r in order) + f" else {default} end"
    text = " || ".join(f"case when f_{r} then '{r},' else '' end" for r in order)
    return (
        f"{name} as materialized (select *, rtrim({text}, ',') as hit_list, {first(lambda r: repr(_SEVERITY[r]), repr('none'))} as rule_severity, "
        f"{first(lambda r: repr(_CATEGORY[r]), repr('normal'))} as rule_category, "
        f"{first(lambda r: f'{fixed.RULE_SCORE[_SEVERITY[r]]}::double', '0.0::double')} as rule_score from (select *, {tests} from {source}))"
    )


_ABOVE = "least(greatest((novelty - 0.99::double) / (1 - 0.99::double), 0.0), 1.0)"


def _fusion_sql(source: str, name: str) -> str:
    """Rows of ``source`` with rule_score, rule_category, the models' verdicts and above, fused."""
    return f"""
{name}_joined as materialized (
  select *, (rule_score > 0)::int + supervised_alert::int + anomaly_alert::int as n_layers,
    1.0::double - (1.0::double - rule_score) * (1.0::double - 0.9::double * case when supervised_alert then attack_prob else 0.0 end)
      * (1.0::double - 0.6::double * case when anomaly_alert then above else 0.0 end) as raw
  from {source}),
{name}_scored as materialized (
  select *, raw * case when n_layers <> 1 then 1.0::double when rule_score > 0 then 0.62::double when supervised_alert then 0.55::double else 0.45::double end as fused_score,
    n_layers > 0 as is_alert,
    rtrim(case when rule_score > 0 then 'signature, ' else '' end || case when supervised_alert then 'supervised, ' else '' end || case when anomaly_alert then 'anomaly' else '' end, ', ') as layer_list
  from {name}_joined),
{name} as materialized (
  select *, case when not is_alert then 'info' when fused_score >= 0.85 then 'critical' when fused_score >= 0.65 then 'high' when fused_score >= 0.45 then 'medium' else 'low' end as severity,
    case when rule_score > 0 then rule_category when supervised_alert then supervised_category when anomaly_alert then 'unknown' else 'normal' end as category_out
  from {name}_scored)"""


_FUSED_SQL = f"""
{_hits_sql("local_hit", "conn", _LOCAL)},
parts as materialized (
  select *, attack_prob >= 0.9 as supervised_alert, novelty >= 0.99 as anomaly_alert, {_ABOVE} as above
  from (select *, ((flow_id * 37) % 100) / 100.0::double as attack_prob, ((flow_id * 7919) % 1000) / 1000.0::double as novelty,
    case flow_id % 5 when 0 then 'normal' when 1 then 'dos' when 2 then 'probe' when 3 then 'r2l' else 'u2r' end as supervised_category from local_hit)),
{_fusion_sql("parts", "fused")}"""



def _with_tables(sql: str) -> str:
    need = []
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    if words & {"conn", "hist", "hit", "fused"}:
        need.append(E.oracle())
    if words & {"hist", "hit"}:
        need.append(_hist_sql())
    if "hit" in words:
        need.append(_hits_sql("hit", "hist"))
    if "fused" in words:
        need.append(_FUSED_SQL)
    body = sql.strip()
    if not need:
        return body
    if body.lower().startswith("with recursive "):
        return "with recursive " + ", ".join(need) + ", " + body[15:]
    if body.lower().startswith("with "):
        return "with " + ", ".join(need) + ", " + body[5:]
    return "with " + ", ".join(need) + " " + body


# ---- projection and cleaning -------------------------------------------------------------------------------------


@query("select flow_id, start_us, src, dst, service, flag, protocol_type, dport, src_bytes, dst_bytes, duration, category, label from conn")
def q_conn_view(spark, sf_dir):
    return conn(spark, sf_dir).select("flow_id", "start_us", "src", "dst", "service", "flag", "protocol_type", "dport", "src_bytes", "dst_bytes", "duration", "category", "label")


@query(
    """select flow_id, round(ln(1 + src_bytes), 6) as log_src_bytes, src_bytes / (src_bytes + dst_bytes + 1.0) as byte_ratio, (src_bytes + dst_bytes) / (duration + 1.0) as bytes_per_second,
    num_failed_logins + 2.0 * root_shell + 2.0 * su_attempted + hot / 5.0 + is_guest_login as auth_pressure,
    case when flag in ('s0','s1','s2','s3') then 1.0 else 0.0 end as flag_serror, case when flag in ('rej','rsto','rstr','rstos0','oth') then 1.0 else 0.0 end as flag_rerror,
    case when protocol_type = 'tcp' then 1.0 else 0.0 end as proto_tcp from conn"""
)
def q_derived(spark, sf_dir):
    df = conn(spark, sf_dir)
    d = C.derived(df)
    names = ("byte_ratio", "bytes_per_second", "auth_pressure", "flag_serror", "flag_rerror", "proto_tcp")
    return df.select("flow_id", F.round(d["log_src_bytes"], 6).alias("log_src_bytes"), *(d[n].alias(n) for n in names))


_DIRTY = "case flow_id % 6 when 0 then 'abc' when 1 then 'nan' when 2 then 'inf' when 3 then '-5' when 4 then cast(cast(floor(src_bytes) as bigint) as varchar(30)) else null end"


@query(f"""select flow_id, case when v is null or isnan(v) then 0.0 else v end as num, case when v is null or isnan(v) or isinf(v) or v < 0 then 0.0 else v end as phys
    from (select flow_id, try_cast({_DIRTY} as double) as v from conn)""")
def q_nonneg_clean(spark, sf_dir):
    df = conn(spark, sf_dir).select("flow_id", F.expr(_DIRTY).alias("v"))
    return df.select("flow_id", C.number(df, "v").alias("num"), C.physical(C.number(df, "v")).alias("phys"))


_RAW_LABEL = "case flow_id % 7 when 0 then ' Neptune. ' when 1 then 'BENIGN' when 2 then 'xterm..' when 3 then 'satan' when 4 then 'guess_passwd.' when 5 then 'strange' else 'normal.' end"


@query(f"""select flow_id, l as label, case when l in ('normal','benign') then 'normal' when l = 'neptune' then 'dos' when l = 'xterm' then 'u2r' when l = 'satan' then 'probe'
    when l = 'guess_passwd' then 'r2l' else 'unknown' end as category, case when l in ('normal','benign') then 0 else 1 end as is_attack
    from (select flow_id, lower(rtrim(trim({_RAW_LABEL}), '.')) as l from conn)""")
def q_label_category(spark, sf_dir):
    raw = F.expr(_RAW_LABEL)
    df = conn(spark, sf_dir).select("flow_id", C.clean_label(raw).alias("label"), C.category_of(raw).alias("category"))
    return df.withColumn("is_attack", C.is_attack(F.col("category")))


@query("select service, count(*) as n, count(*)::double / (select count(*) from conn) as share from conn group by service")
def q_service_freq(spark, sf_dir):
    return features.service_shares(conn(spark, sf_dir))


@query("""with v as (select w, row_number() over (order by w) - 1 as code from (select distinct lower(service) as w from conn where flow_id % 2 = 0 and service <> 'signup'))
    select flow_id, coalesce(code, (select count(*) from v))::double as service_code from conn left join v on w = lower(service)""")
def q_ordinal_unseen(spark, sf_dir):
    df = conn(spark, sf_dir)
    train = df.filter("flow_id % 2 = 0 and service <> 'signup'")
    words = sorted(r[0] for r in train.select(C.words(train, "service")).distinct().limit(features.MOST_VALUES).collect())
    return df.select("flow_id", features.ordinal(C.words(df, "service"), words).alias("service_code"))


@query("""select 'src_bytes' as feature, round(avg(src_bytes), 6) as mean, round(stddev_pop(src_bytes), 6) as std from conn union all
    select 'dst_bytes', round(avg(dst_bytes), 6), round(stddev_pop(dst_bytes), 6) from conn union all select 'duration', round(avg(duration), 6), round(stddev_pop(duration), 6) from conn""")
def q_scaler_stats(spark, sf_dir):
    df = conn(spark, sf_dir)
    names = ("src_bytes", "dst_bytes", "duration")
    one = df.agg(*(f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.round(f"m_{c}", 6).alias("mean"), F.round(f"s_{c}", 6).alias("std")) for c in names))
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query("""select flow_id, 'h' || (flow_id % 3) as dst_host, case when protocol_type = 'icmp' then case flow_id % 4 when 0 then 'eco_i' when 1 then 'ecr_i' when 2 then 'urp_i' else 'other' end
    when p = 53 then case when protocol_type = 'udp' then 'domain_u' else 'domain' end when p = 80 then 'http' when p = 22 then 'ssh' else 'private' end as net_service
    from (select *, case flow_id % 5 when 0 then 53 when 1 then 80 when 2 then 22 else 9999 end as p from conn)""")
def q_port_service(spark, sf_dir):
    df = conn(spark, sf_dir).withColumn("p", F.expr("case flow_id % 5 when 0 then 53 when 1 then 80 when 2 then 22 else 9999 end"))
    types = F.expr("case flow_id % 4 when 0 then array(8, 3) when 1 then array(0) when 2 then array(3) else array(11) end")
    return df.select("flow_id", F.concat(F.lit("h"), (F.col("flow_id") % 3).cast("string")).alias("dst_host"), C.service_of(F.col("protocol_type"), F.col("p"), types).alias("net_service"))


@query("""select flow_id, case when protocol_type <> 'tcp' then 'SF' when not (r & 2 <> 0 and r & 16 <> 0) then case when r & 4 <> 0 then 'REJ' when o & 2 <> 0 then 'S0' else 'OTH' end
    when o & 1 <> 0 and r & 1 <> 0 then 'SF' when o & 4 <> 0 then 'RSTO' when r & 4 <> 0 then 'RSTR' when o & 1 <> 0 then 'S2' when r & 1 <> 0 then 'S3' else 'S1' end as state
    from (select *, cast((flow_id * 7) % 32 as int) as o, cast((flow_id * 11) % 32 as int) as r from conn)""")
def q_flag_state(spark, sf_dir):
    df = conn(spark, sf_dir)
    o, r = F.expr("cast((flow_id * 7) % 32 as int)"), F.expr("cast((flow_id * 11) % 32 as int)")
    return df.select("flow_id", C.state_of(F.col("protocol_type"), o, r).alias("state"))


@query("select flow_id, case when src_bytes = floor(src_bytes) then printf('%.0f', src_bytes) else 'part' end as shown from conn")
def q_value_format(spark, sf_dir):
    df = conn(spark, sf_dir)
    return df.select("flow_id", F.when(F.col("src_bytes") == F.floor("src_bytes"), C.shown(F.col("src_bytes"))).otherwise("part").alias("shown"))


@query("select flow_id, case when flow_id % 2 = 0 then printf('%.0f', floor(src_bytes)) else printf('%.3f', src_bytes / 7.0 + 0.00013) end as shown from conn")
def q_value_fractions(spark, sf_dir):
    """Whole numbers without decimals, others with three."""
    x = F.when(F.col("flow_id") % 2 == 0, F.floor("src_bytes").cast("double")).otherwise(F.col("src_bytes") / 7.0 + 0.00013)
    return conn(spark, sf_dir).select("flow_id", C.shown(x).alias("shown"))


@query("""with f as (select service, count(*)::double / (select count(*) from hist) as share from hist group by service)
    select flow_id, round(ln(1 + src_bytes), 6) as log_src_bytes, round(ln(1 + dst_bytes), 6) as log_dst_bytes, src_bytes / (src_bytes + dst_bytes + 1.0) as byte_ratio, (src_bytes + dst_bytes) / (duration + 1.0) as bytes_per_second,
    "count" / (duration + 1.0) as conn_per_second, greatest(serror_rate, srv_serror_rate) + greatest(rerror_rate, srv_rerror_rate) as error_pressure, diff_srv_rate * dst_host_diff_srv_rate as service_entropy_proxy,
    num_failed_logins + 2.0 * root_shell + 2.0 * su_attempted + hot / 5.0 + is_guest_login as auth_pressure, share as service_freq,
    case when flag in ('s0','s1','s2','s3') then 1.0 else 0.0 end as flag_serror, case when flag in ('rej','rsto','rstr','rstos0','oth') then 1.0 else 0.0 end as flag_rerror,
    case when protocol_type = 'tcp' then 1.0 else 0.0 end as proto_tcp, case when protocol_type = 'udp' then 1.0 else 0.0 end as proto_udp, case when protocol_type = 'icmp' then 1.0 else 0.0 end as proto_icmp
    from hist join f using (service)""")
def q_derived_all(spark, sf_dir):
    """All fourteen derived features of connections with history."""
    df = hist(spark, sf_dir)
    # without history, and of any number of services: as a table its size is known, so that it is broadcast if it is small
    shares = table(features.service_shares(conn(spark, sf_dir)).select(F.col("service").alias("_service"), "share"))
    df = df.join(shares, C.words(df, "service") == F.col("_service"))  # each row's service is one of them
    d = C.derived(df, F.col("share"))
    return df.select("flow_id", *((F.round(c, 6) if k.startswith("log_") else c).alias(k) for k, c in d.items()))


@query("""with v as (select w, row_number() over (order by w) - 1 as code from (select distinct lower(service) as w from conn where flow_id % 2 = 0 and service <> 'signup')), n as (select count(*) as n from v)
    select flow_id, coalesce(v.w, '<unseen>') as back, flow_id % (n + 2) as code from conn, n left join v on v.code = flow_id % (n + 2)""")
def q_ordinal_inverse(spark, sf_dir):
    """The words of codes, of which some stand for none."""
    df = conn(spark, sf_dir)
    words = features.vocabulary_of(df.filter("flow_id % 2 = 0 and service <> 'signup'"), "service")
    code = F.col("flow_id") % (len(words) + 2)
    return df.select("flow_id", features.word_of(code, words).alias("back"), code.alias("code"))


@query("""with v as (select category, row_number() over (order by category) - 1 as code from (select distinct category from conn where flow_id % 3 > 0 and category <> 'u2r'))
    select flow_id, coalesce(code, (select count(*) from v))::double as label_code from conn left join v using (category)""")
def q_label_codes(spark, sf_dir):
    """The target as numbers, with one number for a class that training had not."""
    df = conn(spark, sf_dir)
    classes = features.vocabulary_of(df.filter("flow_id % 3 > 0 and category <> 'u2r'"), "category")
    return df.select("flow_id", features.ordinal(F.col("category"), classes).alias("label_code"))


#: raw features that the events give; the others are 0
_CONN = "duration src_bytes dst_bytes land wrong_fragment hot num_failed_logins root_shell su_attempted num_root num_file_creations is_guest_login".split()


def _matrix_sql() -> str:
    """matrix: flow_id and the 55 features in their order."""
    past = [c for c in fixed.NUMERIC if c in fixed.COLUMNS[fixed.COLUMNS.index("count") : fixed.COLUMNS.index("label")]]
    raw = [f'"{c}"::double as "{c}"' if c in (*_CONN, *past) else f'0.0::double as "{c}"' for c in fixed.NUMERIC]
    made = """ln(1 + src_bytes) as log_src_bytes, ln(1 + dst_bytes) as log_dst_bytes, src_bytes / (src_bytes + dst_bytes + 1.0) as byte_ratio, (src_bytes + dst_bytes) / (duration + 1.0) as bytes_per_second,
      "count" / (duration + 1.0) as conn_per_second, greatest(serror_rate, srv_serror_rate) + greatest(rerror_rate, srv_rerror_rate) as error_pressure, diff_srv_rate * dst_host_diff_srv_rate as service_entropy_proxy,
      num_failed_logins + 2.0 * root_shell + 2.0 * su_attempted + hot / 5.0 + is_guest_login as auth_pressure, s.share as service_freq, (flag in ('s0','s1','s2','s3'))::int::double as flag_serror,
      (flag in ('rej','rsto','rstr','rstos0','oth'))::int::double as flag_rerror, (protocol_type = 'tcp')::int::double as proto_tcp, (protocol_type = 'udp')::int::double as proto_udp, (protocol_type = 'icmp')::int::double as proto_icmp,
      p.code::double as protocol_type_code, s.code::double as service_code, f.code::double as flag_code"""
    codes = lambda c: f"(select lower({c}) as w, row_number() over (order by lower({c})) - 1 as code, sum(count(*)) over (partition by lower({c}))::double / (select count(*) from hist) as share from hist group by lower({c}))"
    joins = f"join {codes('protocol_type')} p on p.w = protocol_type join {codes('service')} s on s.w = service join {codes('flag')} f on f.w = flag"
    return f"matrix as materialized (select flow_id, {', '.join(raw)}, {made} from hist {joins})"


def _matrix(spark, sf_dir) -> DataFrame:
    rows = table(hist(spark, sf_dir))
    return features.FeatureSpace.fit(rows).transform(rows, "flow_id")


@query(f"with {_matrix_sql()} select flow_id, {', '.join(f'round({c}, 6) as {c}' if c.startswith('log_') else f'"{c}"' for c in fixed.FEATURES)} from matrix, (select 1 from hist limit 1)")
def q_matrix(spark, sf_dir):
    """The 55 features of every connection, in their order, as the models see them."""
    return _matrix(spark, sf_dir).select("flow_id", *(F.round(c, 6).alias(c) if c.startswith("log_") else c for c in fixed.FEATURES))


# groups by feature in the SQL, to be compared with the lookup's rule
_GROUPS_SQL = "groups(g, members) as (values " + ", ".join(f"('{g}', {m})" for g, m in fixed.FEATURE_GROUPS.items()) + ")"


@query(f"""with {_matrix_sql()}, {_GROUPS_SQL}, long as (unpivot (select columns(* exclude flow_id) from matrix) on columns(*) into name feature value v),
    per as (select feature, count(*) filter (v <> 0) as n_present, round(avg(v), 6) as mean, round(max(v), 6) as largest from long group by feature)
    select feature, coalesce((select g from groups where list_contains(members, per.feature)), (select g from groups where list_contains(members, regexp_replace(per.feature, '_code$', ''))),
      case when list_contains({fixed.DERIVED}, feature) then 'derived' else 'other' end) as feature_group, n_present, mean, largest from per, (select 1 from hist limit 1)""")
def q_feature_groups(spark, sf_dir):
    """Group of each of the 55 features, in how many connections it is other than 0, its mean and its largest value, in one aggregation."""
    rows = _matrix(spark, sf_dir)
    sums = lambda c: F.struct(F.lit(c).alias("feature"), F.lit(fixed.group_of(c)).alias("feature_group"), F.count_if(F.col(c) != 0).alias("n_present"), F.round(F.avg(c), 6).alias("mean"), F.round(F.max(c), 6).alias("largest"))
    return rows.agg(F.array(*map(sums, fixed.FEATURES)).alias("all")).select(F.explode("all").alias("r")).select("r.*")


# ---- windows -----------------------------------------------------------------------------------------------------


@query('select flow_id, seq, "count", srv_count from hist')
def q_window_count(spark, sf_dir):
    return hist(spark, sf_dir).select("flow_id", "seq", "count", "srv_count")


@query("select flow_id, serror_rate, srv_serror_rate, rerror_rate, srv_rerror_rate, same_srv_rate, diff_srv_rate, srv_diff_host_rate from hist")
def q_window_rates(spark, sf_dir):
    return hist(spark, sf_dir).select("flow_id", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate")


_HISTORY = (
    "dst_host_count dst_host_srv_count dst_host_same_srv_rate dst_host_diff_srv_rate dst_host_same_src_port_rate dst_host_serror_rate dst_host_srv_serror_rate "
    "dst_host_rerror_rate dst_host_srv_rerror_rate"
).split()


@query(f"select flow_id, {', '.join(_HISTORY)} from hist")
def q_history_rates(spark, sf_dir):
    return hist(spark, sf_dir).select("flow_id", *_HISTORY)


_PRIOR_SQL = """select flow_id, count(*) over (partition by dst order by start_us range between 3600000000 preceding and current row)
    - count(*) over (partition by dst, start_us order by flow_id rows between current row and unbounded following) as prior from conn"""


@query(_PRIOR_SQL)
def q_range_join(spark, sf_dir):
    """The window range join (J2) of every connection."""
    return prior_counts(conn(spark, sf_dir))


def prior_counts(df, window_us=3_600_000_000, spans=16):
    """flow_id and prior: how many connections of the same dst started at most ``window_us`` before, those of the same
    start being earlier if their flow_id is lower; one row for each row of ``df``. Pairs are never built. Without a dst
    or a start nothing is prior."""
    keyed = F.col("dst").isNotNull() & F.col("start_us").isNotNull()
    rows = _dealt(df.filter(keyed).select("flow_id", "dst", "start_us"), "start_us", window_us, spans)
    upto = Window.partitionBy("_span", "dst").orderBy("start_us").rangeBetween(-window_us, 0)
    ties = Window.partitionBy("_span", "dst", "start_us").orderBy("flow_id").rangeBetween(0, Window.unboundedFollowing)
    counted = rows.withColumn("prior", F.count("*").over(upto) - F.count("*").over(ties)).filter("_own").select("flow_id", "prior")
    return counted.union(df.filter(~keyed).select("flow_id", F.lit(0).cast("long").alias("prior")))


@query(_PRIOR_SQL)
def q_range_join_all(spark, sf_dir):
    """The same as q_range_join, under the name it had first."""
    return prior_counts(conn(spark, sf_dir))


@query("""with gaps as (select *, case when start_us - lag(start_us) over (partition by src order by start_us, flow_id) <= 7200000000 then 0 else 1 end as fresh from conn),
    parts as (select *, sum(fresh) over (partition by src order by start_us, flow_id rows unbounded preceding) as part from gaps)
    select src, cast(part as bigint) as part, min(start_us) as first_us, max(start_us) as last_us, count(*) as n, round(sum(src_bytes), 3) as bytes from parts group by src, part""")
def q_sessionize(spark, sf_dir):
    """Runs of a source's connections with at most two hours between them."""
    return flows.sessions(conn(spark, sf_dir), 7_200_000_000)


_FLOW_SQL = """with p as (select flow_id as pkt_idx, cast(start_us / 1000000.0 as double) as ts, 'u' || (flow_id % 40) as a, 'v' || (flow_id % 3) as b, flow_id % 2 as back,
      cast(k as int) as length, cast(flow_id % 64 as int) as flags from conn),
    q as (select *, case when ts - lag(ts) over (partition by a, b order by ts, pkt_idx) <= 14400 then 0 else 1 end as fresh from p),
    r as (select *, sum(fresh) over (partition by a, b order by ts, pkt_idx rows unbounded preceding) as part from q),
    f as (select a, b, part, min(ts) as start, max(ts) as "end", arg_min(back, pkt_idx) as first_back, count(*) as n from r group by a, b, part)
    select case when first_back = 0 then f.a else f.b end as src, case when first_back = 0 then f.b else f.a end as dst, start, "end",
      cast(sum(case when r.back = first_back then length else 0 end) as bigint) as src_bytes, cast(sum(case when r.back = first_back then 0 else length end) as bigint) as dst_bytes,
      sum(case when r.back = first_back then 1 else 0 end)::bigint as src_pkts, sum(case when r.back = first_back then 0 else 1 end)::bigint as dst_pkts,
      bit_or(case when r.back = first_back then flags else 0 end) as orig_flags, bit_or(case when r.back = first_back then 0 else flags end) as resp_flags
    from r join f on r.a = f.a and r.b = f.b and r.part = f.part group by f.a, f.b, f.part, first_back, start, "end\""""


@query(_FLOW_SQL)
def q_flow_assembly(spark, sf_dir):
    """Two-sided flows of packets, cut at silences of over four hours."""
    from flowlark.operators.flows import assemble

    df = conn(spark, sf_dir)
    u, v, back = F.expr("concat('u', cast(flow_id % 40 as string))"), F.expr("concat('v', cast(flow_id % 3 as string))"), F.expr("flow_id % 2 = 1")
    packets = df.select(
        F.col("flow_id").alias("pkt_idx"), (F.col("start_us") / 1e6).alias("ts"), F.when(back, v).otherwise(u).alias("src"), F.when(back, u).otherwise(v).alias("dst"), F.lit("tcp").alias("proto"),
        F.lit(1).alias("sport"), F.lit(1).alias("dport"), F.col("k").alias("length"), F.expr("cast(flow_id % 64 as int)").alias("flags"), F.lit(-1).alias("icmp_type"), F.lit(0).alias("frag_bad"),
    )
    return assemble(packets, timeout=14_400.0).select("src", "dst", "start", "end", "src_bytes", "dst_bytes", "src_pkts", "dst_pkts", "orig_flags", "resp_flags")


# ---- rules -------------------------------------------------------------------------------------------------------


@query("select flow_id, hit_list from hit where hit_list <> ''")
def q_rule_hits(spark, sf_dir):
    return hit(spark, sf_dir).filter(F.size("hits") > 0).select("flow_id", F.concat_ws(",", "hits").alias("hit_list"))


@query("select flow_id, rule_severity, rule_category, rule_score from hit")
def q_rule_headline(spark, sf_dir):
    return hit(spark, sf_dir).select("flow_id", "rule_severity", "rule_category", "rule_score")


@query("select rule_severity, count(*) as n from hit group by rule_severity")
def q_severity_counts(spark, sf_dir):
    return hit(spark, sf_dir).groupBy("rule_severity").agg(F.count("*").alias("n"))


@query(
    " union all ".join(
        f"select '{r}' as rule_id, count(*) filter (where f_{r}) as fired, count(*) filter (where f_{r} and category <> 'normal') as on_attack, count(*) filter (where f_{r} and category = 'normal') as on_benign,"
        f" case when count(*) filter (where f_{r}) > 0 then count(*) filter (where f_{r} and category <> 'normal')::double / count(*) filter (where f_{r}) end as precision from hit"
        for r in _SQL_RULES
    )
)
def q_rule_coverage(spark, sf_dir):
    return rules.coverage(hist(spark, sf_dir)).select("rule_id", "fired", "on_attack", "on_benign", "precision")


@query("select rule_id, count(*) as n from (select unnest(string_split(hit_list, ',')) as rule_id from hit where hit_list <> '' and category = 'dos') group by rule_id")
def q_rule_breakdown(spark, sf_dir):
    return rules.breakdown(hit(spark, sf_dir).filter("category = 'dos'"))


@query("select flow_id, 'R09' as rule_id, cast(num_failed_logins as int)::varchar as seen from conn where num_failed_logins >= 2")
def q_rule_explain(spark, sf_dir):
    rows = rules.with_hits(conn(spark, sf_dir))
    told = rows.select("flow_id", F.explode(rules.explanations(rows)).alias("r")).filter("r.rule_id = 'R09'")
    return told.select("flow_id", "r.rule_id", F.element_at("r.observed", "num_failed_logins").alias("seen"))


# ---- fusion ------------------------------------------------------------------------------------------------------


@query("select flow_id, round(fused_score, 9) as fused_score, layer_list, is_alert from fused")
def q_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("flow_id", F.round("fused_score", 9).alias("fused_score"), F.concat_ws(", ", "layers").alias("layer_list"), "is_alert")


@query("select flow_id, severity, category_out from fused")
def q_severity(spark, sf_dir):
    return fused(spark, sf_dir).select("flow_id", "severity", "category_out")


_FIGURES = """concat_ws('; ', case when rule_score > 0 then 'by rule ' || replace(hit_list, ',', ', ') end,
    case when supervised_alert then 'at an attack probability of ' || cast(floor(attack_prob * 100) as int) || ' %' end,
    case when anomaly_alert then 'more unusual than ' || cast(floor(novelty * 1000) as int) || ' in 1000 benign connections' end)"""


@query(f"""select flow_id, case when n_layers = 0 then 'nothing raised by any layer' when n_layers >= 2 then 'raised by ' || replace(layer_list, ', ', ' and ') || ': ' || {_FIGURES}
    when layer_list = 'signature' then 'a rule alone, ' || {_FIGURES} || '; neither model is raised, so the score is lowered'
    when layer_list = 'supervised' then 'the forest alone, ' || {_FIGURES} || '; no rule and no anomaly, so the score is lowered'
    else 'an anomaly alone, ' || {_FIGURES} || '; this says least of the three, so the score is lowered most' end as corroboration from fused""")
def q_corroboration(spark, sf_dir):
    return fused(spark, sf_dir).select("flow_id", "corroboration")


@query("select flow_id, severity from fused where severity in ('medium', 'high', 'critical') and category_out = 'r2l'")
def q_alert_filter(spark, sf_dir):
    return fusion.at_least(fused(spark, sf_dir), "medium").filter("category_out = 'r2l'").select("flow_id", "severity")


@query("select flow_id, round(fused_score, 9) as fused_score from (select * from fused where is_alert order by round(fused_score, 9) desc, flow_id limit 25)")
def q_alert_queue(spark, sf_dir):
    rows = fused(spark, sf_dir).withColumn("fused_score", F.round("fused_score", 9))
    return fusion.queue(rows).limit(25).select("flow_id", "fused_score")


# ---- aggregations ------------------------------------------------------------------------------------------------


@query("select category, count(*) as flows, count(*)::double / (select count(*) from conn) as share from conn group by category")
def q_category_counts(spark, sf_dir):
    return records.category_counts(conn(spark, sf_dir))


@query("select category, label, count(*) as flows from conn group by category, label")
def q_family_counts(spark, sf_dir):
    return records.family_counts(conn(spark, sf_dir))


@query("select distinct label from conn where category <> 'normal' and label not in (select label from conn where label not in ('apache2', 'mscan'))")
def q_novel_families(spark, sf_dir):
    df = conn(spark, sf_dir)
    return records.novel_families(df.filter("label not in ('apache2', 'mscan')"), df)


def _binary_sql(verdicts: dict[str, str], source: str, extra: str = "") -> str:
    cells = " union all ".join(
        f"select '{n}' as config, count(*) filter (where t and ({v})) as tp, count(*) filter (where not t and ({v})) as fp, count(*) filter (where t and not ({v})) as fn,"
        f" count(*) filter (where not t and not ({v})) as tn from (select *, category <> 'normal' as t from {source})"
        for n, v in verdicts.items()
    )
    share = lambda a, b: f"case when {b} > 0 then ({a})::double / ({b}) else 0.0 end"
    return (
        f"select config, tp, fp, fn, tn, {share('tp', 'tp + fp')} as precision, {share('tp', 'tp + fn')} as recall, {share('2 * tp', '2 * tp + fp + fn')} as f1,"
        f" {share('fp', 'fp + tn')} as fpr, {share('fn', 'fn + tp')} as fnr, {share('tp + tn', 'tp + fp + fn + tn')} as accuracy, tp + fn as support_positive, tn + fp as support_negative from ({cells})"
    )


@query(
    _binary_sql(
        {
            "signature_only": "rule_score > 0", "supervised_only": "supervised_alert", "anomaly_only": "anomaly_alert", "hybrid": "is_alert",
            "signature_or_supervised": "rule_score > 0 or supervised_alert", "signature_or_anomaly": "rule_score > 0 or anomaly_alert",
        },
        "fused",
    )
)
def q_ablation(spark, sf_dir):
    return metrics.ablation(fused(spark, sf_dir), F.col("category") != "normal")


_CLASSES = "(select unnest(['normal','dos','probe','r2l','u2r']) as c)"


@query(f"select t.c as truth, p.c as predicted, (select count(*) from fused where category = t.c and supervised_category = p.c) as n from {_CLASSES} t, {_CLASSES} p")
def q_confusion(spark, sf_dir):
    return metrics.confusion(fused(spark, sf_dir), "category", "supervised_category")


@query(f"""select class, case when tp + fp > 0 then tp::double / (tp + fp) else 0.0 end as precision, case when support > 0 then tp::double / support else 0.0 end as recall,
    case when 2 * tp + fp + support - tp > 0 then (2 * tp)::double / (2 * tp + fp + support - tp) else 0.0 end as f1, support, tp as detected
    from (select c as class, (select count(*) from fused where category = c and supervised_category = c) as tp, (select count(*) from fused where category <> c and supervised_category = c) as fp,
    (select count(*) from fused where category = c) as support from {_CLASSES})""")
def q_per_class(spark, sf_dir):
    return metrics.per_class(metrics.confusion(fused(spark, sf_dir), "category", "supervised_category"))


@query("""select label as family, min(category) as category, count(*) as support, avg(is_alert::int) as hybrid_recall, avg((rule_score > 0)::int) as signature_recall, avg(supervised_alert::int) as supervised_recall,
    avg(anomaly_alert::int) as anomaly_recall, label not in ('apache2','mscan') as in_training from fused where category <> 'normal' group by label""")
def q_family_recall(spark, sf_dir):
    return metrics.family_recall(fused(spark, sf_dir))


@query("""select severity, alerts, hits::double / alerts as precision, alerts::double / sum(alerts) over () as share_of_queue
    from (select severity, count(*) as alerts, count(*) filter (where category <> 'normal') as hits from fused where is_alert group by severity)""")
def q_severity_table(spark, sf_dir):
    return metrics.severity_table(fused(spark, sf_dir))


@query("""select k, tp as true_positives, tp::double / k as precision from (select k, (select count(*) from r where rank <= k and category <> 'normal') as tp
    from (select unnest([50, 100, 250, 500, 1000, 2000, 5000]) as k) where k <= (select count(*) from r))""".replace("select k, tp", "with r as (select category, row_number() over (order by round(fused_score, 9) desc, flow_id) as rank from fused where is_alert) select k, tp", 1))
def q_precision_at_k(spark, sf_dir):
    return metrics.precision_at_k(fused(spark, sf_dir).withColumn("fused_score", F.round("fused_score", 9)))


_CURVE = """with c as (select attack_prob as threshold, count(*) filter (where category <> 'normal') as p, count(*) filter (where category = 'normal') as q from fused group by attack_prob),
    r as (select *, cast(sum(p) over (order by threshold desc) as bigint) as tp, cast(sum(q) over (order by threshold desc) as bigint) as fp, sum(p) over () as all_p, sum(q) over () as all_q from c)"""


@query(_CURVE + " select threshold, tp, fp, tp::double / all_p::double as tpr, fp::double / all_q::double as fpr from r")
def q_roc_points(spark, sf_dir):
    return metrics.curve(fused(spark, sf_dir), F.col("category") != "normal", "attack_prob").select("threshold", "tp", "fp", "tpr", "fpr")


@query(_CURVE + " select threshold, tp::double / (tp + fp) as precision, tp::double / all_p::double as recall from r")
def q_pr_points(spark, sf_dir):
    return metrics.curve(fused(spark, sf_dir), F.col("category") != "normal", "attack_prob").select("threshold", "precision", F.col("tpr").alias("recall"))


@query(_CURVE + " select round((sum(q * ((tp - p) + p / 2.0)) / (sum(p)::double * sum(q)::double))::double, 9) as auc from r")
def q_auc(spark, sf_dir):
    return metrics.auc(fused(spark, sf_dir), F.col("category") != "normal", "attack_prob").select(F.round("auc", 9).alias("auc"))


@query("select round(quantile_cont(src_bytes, 0.99), 6) as threshold from conn where category = 'normal'")
def q_percentile_threshold(spark, sf_dir):
    (value,) = binning.quantiles(conn(spark, sf_dir).filter("category = 'normal'"), [F.col("src_bytes")], [0.99])[0]
    return spark.createDataFrame([(round(value, 6),)], "threshold double")


@query("""select flow_id, (select count(*) from conn b where b.category = 'normal' and b.duration <= a.duration)::double / (select count(*) from conn where category = 'normal') as novelty
    from conn a where category <> 'normal'""")
def q_novelty(spark, sf_dir):
    df = conn(spark, sf_dir).select("flow_id", "category", F.col("duration").alias("score"))
    return binning.novelty(df.filter("category <> 'normal'"), df.filter("category = 'normal'")).select("flow_id", "novelty")


@query("select round(avg(src_bytes), 6) as mean, round(stddev_pop(src_bytes), 6) as sd, count(*) as n from conn where category = 'normal'")
def q_benign_stats(spark, sf_dir):
    return conn(spark, sf_dir).filter("category = 'normal'").agg(F.round(F.avg("src_bytes"), 6).alias("mean"), F.round(F.stddev_pop("src_bytes"), 6).alias("sd"), F.count("*").alias("n"))


_EDGES = f"select distinct round(unnest(quantile_cont(src_bytes, {[i / 64 for i in range(1, 64)]})), 6) as edge from conn"


@query(_EDGES)
def q_bin_edges(spark, sf_dir):
    edges = binning.bin_edges(conn(spark, sf_dir), "src_bytes")
    return spark.createDataFrame([(e,) for e in edges], "edge double").select(F.round("edge", 6).alias("edge")).distinct()


@query("select flow_id, (select count(*) from (select unnest([0.0, 2.0, 5.0, 7.0]) as e) where e < duration) as bin from conn")
def q_bin_codes(spark, sf_dir):
    return conn(spark, sf_dir).select("flow_id", binning.bin_of(F.col("duration"), [0.0, 2.0, 5.0, 7.0]).cast("long").alias("bin"))


@query("""with c as (select k as bin, category as class, count(*)::double as w from conn group by k, category), b as (select distinct bin from c), k as (select class, sum(w) as a from c group by class),
    g as (select b.bin, k.class, a, sum(coalesce(w, 0)) over (partition by k.class order by b.bin) as l from b cross join k left join c on c.bin = b.bin and c.class = k.class),
    p as (select bin, sum(l) as left_n, sum(a - l) as right_n, sum(l * l) as l2, sum((a - l) * (a - l)) as r2, sum(a * a) as a2, sum(a) as n from g group by bin)
    select bin, left_n, right_n, round((1 - a2 / (n * n)) - (left_n * (1 - l2 / (left_n * left_n)) + right_n * (1 - r2 / (right_n * right_n))) / n, 9) as gain from p where right_n > 0""")
def q_gini_split(spark, sf_dir):
    return binning.gini_splits(conn(spark, sf_dir), "k", "category").withColumn("gain", F.round("gain", 9))


@query("""select count(*) as alerts, count(distinct hit_list || '|' || service || '|' || flag) as signatures from fused where is_alert and category = 'dos'""")
def q_distinct_signatures(spark, sf_dir):
    rows = fused(spark, sf_dir).filter("is_alert and category = 'dos'")
    return rows.agg(F.count("*").alias("alerts"), F.countDistinct(F.struct(F.concat_ws(",", "hits"), "service", "flag")).alias("signatures"))


@query("""select src, count(*) as flows, count(*) filter (where is_alert) as alerts, avg(is_alert::int) as alert_rate,
    case max(case when is_alert then case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end end) when 4 then 'critical' when 3 then 'high' when 2 then 'medium' when 1 then 'low' else 'none' end as top_severity
    from fused group by src""")
def q_by_source(spark, sf_dir):
    return report.by_source(fused(spark, sf_dir), "src")


@query("""with o as (select *, row_number() over (order by round(fused_score, 9) desc, flow_id) as place, row_number() over (partition by severity order by md5('0|' || flow_id), flow_id) as turn,
      row_number() over (partition by category = 'normal' order by round(fused_score, 9) desc, flow_id) as wrong from fused where is_alert)
    select flow_id, severity, round(fused_score, 9) as fused_score from o where place <= 200 or (turn <= 40) or (category = 'normal' and wrong <= 60)""")
def q_queue_sample(spark, sf_dir):
    return queue_sample(fused(spark, sf_dir).withColumn("fused_score", F.round("fused_score", 9))).select("flow_id", "severity", "fused_score")


def queue_sample(rows: DataFrame, top: int = 200, each: int = 40, wrong: int = 60, seed: int = 0, row_id: str = "flow_id") -> DataFrame:
    """The head of the queue, some alerts of every severity (by hash) and the surest false positives, each row once.

    Three top-k selections, so the queue is never in one task.
    """
    alerts = rows.filter("is_alert")
    best = [F.desc("fused_score"), F.asc(row_id)]
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))
    parts = [alerts.orderBy(*best).limit(top), alerts.filter("category = 'normal'").orderBy(*best).limit(wrong)]
    parts += [alerts.filter(F.col("severity") == s).orderBy(turn, row_id).limit(each) for s in fixed.SEVERITY_ORDER[1:]]
    ids = parts[0].select(row_id)
    for p in parts[1:]:
        ids = ids.union(p.select(row_id))
    return alerts.join(F.broadcast(ids.distinct()), row_id, "left_semi").orderBy(*best)  # at most top + wrong + 4 * each ids


@query("""with h as (select flow_id, category, row_number() over (partition by category order by substr(md5('7|' || flow_id), 1, 13), flow_id) as place, count(*) over (partition by category) as n from conn)
    select flow_id, category, place <= round(n * 0.3) as is_test from h""")
def q_stratified_split(spark, sf_dir):
    return records.stratified_split(conn(spark, sf_dir), 0.3, 7).select("flow_id", "category", "is_test")


@query("select category, layer, count(*) as n from (select category, unnest(string_split(layer_list, ', ')) as layer from fused where is_alert and category <> 'x') group by category, layer")
def q_layer_counts(spark, sf_dir):
    return fused(spark, sf_dir).filter("is_alert").select("category", F.explode("layers").alias("layer")).groupBy("category", "layer").agg(F.count("*").alias("n"))


@query("""select flow_id, round(novelty, 3) as novelty from (select * from fused where category <> 'normal' and not is_alert order by novelty desc, flow_id limit 3)""")
def q_near_misses(spark, sf_dir):
    missed = fused(spark, sf_dir).filter("category <> 'normal' and not is_alert")
    return missed.orderBy(F.desc("novelty"), "flow_id").limit(3).select("flow_id", F.round("novelty", 3).alias("novelty"))


@query("select flow_id from fused where contains(lower(concat_ws(' ', src, dst, service, flag, severity, category_out)), 'h2 err')")
def q_search(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", "src", "dst", "service", "flag", "severity", "category_out"))
    return fused(spark, sf_dir).filter(text.contains("h2 err")).select("flow_id")


# ---- the evaluation report and scenarios ---------------------------------------------------------------------------


@query(f"""select avg(case when 2 * tp + fp + fn > 0 then (2 * tp)::double / (2 * tp + fp + fn) else 0.0 end) as macro_f1, sum(tp)::double / sum(support) as accuracy
    from (select *, support - tp as fn from (select c, (select count(*) from fused where category = c and supervised_category = c) as tp, (select count(*) from fused where category <> c and supervised_category = c) as fp,
    (select count(*) from fused where category = c) as support from {_CLASSES}))""")
def q_macro_f1(spark, sf_dir):
    return metrics.macro(metrics.per_class(metrics.confusion(fused(spark, sf_dir), "category", "supervised_category")))


_SLICE = """count(*) as connections, count(*) filter (where category <> 'normal') as attacks, count(*) filter (where is_alert) as alerts,
    case when count(*) filter (where category <> 'normal') > 0 then (count(*) filter (where category <> 'normal' and is_alert))::double / count(*) filter (where category <> 'normal') else 0.0 end as recall,
    case when count(*) filter (where is_alert) > 0 then (count(*) filter (where category <> 'normal' and is_alert))::double / count(*) filter (where is_alert) else 0.0 end as precision,
    case when count(*) filter (where category = 'normal') > 0 then (count(*) filter (where category = 'normal' and is_alert))::double / count(*) filter (where category = 'normal') else 0.0 end as fpr"""


@query(f"select category as slice, {_SLICE} from fused group by category")
def q_slice_scores(spark, sf_dir):
    """The scores of the scenarios' slices, one for each category."""
    return metrics.slice_scores(fused(spark, sf_dir), F.col("category"))


@query("""select 'layer' as kind, l as name, (select count(*) from fused where is_alert and category = 'normal' and contains(layer_list, l)) as n from (select unnest(['signature', 'supervised', 'anomaly']) as l)
    union all select 'severity', severity, count(*) from fused where is_alert and category = 'normal' group by severity
    union all select 'rule', r, count(*) from (select unnest(string_split(hit_list, ',')) as r from fused where is_alert and category = 'normal' and hit_list <> '') group by r""")
def q_false_positives(spark, sf_dir):
    """False positives by layer, severity and rule (scenario of benign traffic)."""
    return metrics.breakdown(fused(spark, sf_dir).filter("is_alert and category = 'normal'"))


@query("""select 'rows' as kind, 'all' as name, count(*) as n from fused union all select 'alerts', 'all', count(*) from fused where is_alert
    union all select 'severity', severity, count(*) from fused where is_alert group by severity
    union all select 'layer', l, (select count(*) from fused where is_alert and contains(layer_list, l)) from (select unnest(['signature', 'supervised', 'anomaly']) as l)
    union all select 'rule', r, count(*) from (select unnest(string_split(hit_list, ',')) as r from fused where is_alert and hit_list <> '') group by r""")
def q_alert_summary(spark, sf_dir):
    rows = fused(spark, sf_dir)
    totals = rows.agg(F.count("*").alias("rows"), F.count_if("is_alert").alias("alerts"))
    totals = totals.select(F.explode(F.create_map(F.lit("rows"), "rows", F.lit("alerts"), "alerts")).alias("kind", "n")).select("kind", F.lit("all").alias("name"), "n")
    return totals.union(metrics.breakdown(rows.filter("is_alert")))


_GAP = "(label not in ('apache2', 'mscan'))"


@query(f"""select avg(is_alert::int) filter (where {_GAP}) as seen_recall, avg(is_alert::int) filter (where not {_GAP}) as unseen_recall,
    avg(is_alert::int) filter (where {_GAP}) - avg(is_alert::int) filter (where not {_GAP}) as gap,
    (select label from (select label, avg(is_alert::int) as r, count(*) as n from fused where category <> 'normal' and not {_GAP} group by label order by r, n desc, label limit 1)) as worst_family
    from fused where category <> 'normal'""")
def q_seen_unseen(spark, sf_dir):
    """Recall on families that training had and on those that it had not, and the worst of the latter."""
    return metrics.seen_unseen(fused(spark, sf_dir), ("apache2", "mscan"))


@query("""select label as family, avg(is_alert::int) - avg(supervised_alert::int) as gain from fused where category in ('r2l', 'u2r') group by label order by gain desc, family limit 3""")
def q_hybrid_gain(spark, sf_dir):
    """What the hybrid finds beyond the forest, in the families of the rare categories; the three largest."""
    return metrics.gain(fused(spark, sf_dir).filter("category in ('r2l', 'u2r')"), 3)


@query("""with r as (select category, unnest(string_split(hit_list, ',')) as rule from fused where hit_list <> ''),
    t as (select rule, count(*) as n from r where category = 'probe' group by rule order by n desc, rule limit 3)
    select rule, n as on_category, (select count(*) from r where r.rule = t.rule and category = 'normal') as on_benign from t""")
def q_rule_overlap(spark, sf_dir):
    """The rules that fire most on reconnaissance, and how often the same fire on benign rows."""
    return report.rule_overlap(fused(spark, sf_dir))


@query("""with f as (select category, label, avg((hit_list <> '')::int) as s, avg(supervised_alert::int) as m, avg(anomaly_alert::int) as a from fused where category in ('r2l', 'u2r') group by all)
    select category, count(*) as families, count(*) filter (where s > greatest(m, a)) as rules_strongest from f group by category""")
def q_rules_strongest(spark, sf_dir):
    """In how many families of the rare categories the rules recall more than either model."""
    return report.rules_strongest(fused(spark, sf_dir))


@query("""select count(*) filter (where category = 'dos') as alerts, count(distinct case when category = 'dos' then hit_list || '|' || service || '|' || flag end) as signatures, count(*) as all_alerts,
    (count(*) filter (where category = 'dos'))::double / count(*) as share_of_all_alerts from fused where is_alert""")
def q_queue_share(spark, sf_dir):
    """How much of the queue a category of attacks fills, and how few kinds of alerts that is."""
    return report.signatures(fused(spark, sf_dir))


@query("""select flow_id from fused where is_alert and contains(lower(concat_ws(' ', src, dst, service, flag, category_out, category, replace(hit_list, ',', ' '), replace(layer_list, ', ', ' '), supervised_category)), 'r09 signature supervised')""")
def q_search_all(spark, sf_dir):
    """Search over every field that an alert shows."""
    return report.search(fused(spark, sf_dir), "R09 Signature Supervised").select("flow_id")


@query("select src, r as rule, count(*) as n from (select src, unnest(string_split(hit_list, ',')) as r from fused where is_alert and hit_list <> '') group by src, r")
def q_source_rules(spark, sf_dir):
    """How often each rule fired on the alerts of each source."""
    return fused(spark, sf_dir).filter("is_alert").select("src", F.explode("hits").alias("rule")).groupBy("src", "rule").agg(F.count("*").alias("n"))


_EXAMPLES = " union all ".join(
    f"select '{kind}' as kind, flow_id, round(fused_score, 9) as fused_score, severity from (select * from fused where is_alert and category {sign} 'normal' order by round(fused_score, 9) desc, flow_id limit 3)"
    for kind, sign in (("true_positive", "<>"), ("false_positive", "="))
)


@query(_EXAMPLES)
def q_examples(spark, sf_dir):
    """The surest right and the surest wrong alerts."""
    rows = fused(spark, sf_dir).withColumn("fused_score", F.round("fused_score", 9))
    best = lambda kind, which: fusion.queue(rows.filter(which)).limit(3).select(F.lit(kind).alias("kind"), "flow_id", "fused_score", "severity")
    return best("true_positive", "category <> 'normal'").union(best("false_positive", "category = 'normal'"))


@query("""select label as family, count(*) as support, avg(is_alert::int) as recall from fused where category = 'dos' group by label having count(*) >= 10 and avg(is_alert::int) < 0.9 order by recall, family limit 3""")
def q_weak_families(spark, sf_dir):
    """The least recalled families of the flood category, of those with ten connections or more."""
    per = fused(spark, sf_dir).filter("category = 'dos'").groupBy(F.col("label").alias("family")).agg(F.count("*").alias("support"), F.avg(F.col("is_alert").cast("int")).alias("recall"))
    return per.filter("support >= 10 and recall < 0.9").orderBy("recall", "family").limit(3)


@query("""select flow_id, severity, layer_list, fused_score from (select flow_id, severity, layer_list, n_layers, round(fused_score, 9) as fused_score, category from fused where is_alert)
    where severity in ('medium', 'high') and n_layers = 1 and category <> 'normal'""")
def q_queue_filters(spark, sf_dir):
    """The queue by severity, number of layers and whether the alert is right."""
    rows = fused(spark, sf_dir).filter("is_alert and severity in ('medium', 'high') and size(layers) = 1 and category <> 'normal'")
    return rows.select("flow_id", "severity", F.concat_ws(", ", "layers").alias("layer_list"), F.round("fused_score", 9).alias("fused_score"))


# ---- all twelve rules on crafted traffic ---------------------------------------------------------------------------

# events seen so that the flood and sweep rules, which the plain mapping cannot reach, have rows on both sides
_RICH = {
    "src_bytes": "case when k >= 50 then 1800.0 else 700.0 end",
    "service": "case when service = 'click' then 'http' else service end",
    "count": "case when flow_id % 3 = 0 then 220.0 else 55.0 + k end",
    "same_srv_rate": "case when flow_id % 2 = 0 then 0.95 else 0.85 end",
    "srv_diff_host_rate": "case when flow_id % 7 = 0 then 0.75 else 0.65 end",
    "dst_host_srv_diff_host_rate": "case when flow_id % 5 = 0 then 0.40 else 0.39 end",
}
_RICH_SQL = "rich as materialized (select * replace (" + ", ".join(f"{v} as \"{c}\"" for c, v in _RICH.items()) + ") from hist), " + _hits_sql("rich_hit", "rich")


@query(f"with {_RICH_SQL} select flow_id, hit_list, rule_severity, rule_category from rich_hit where hit_list <> ''")
def q_all_rules(spark, sf_dir):
    """Hits of all twelve rules, R02, R03 and R08 among them."""
    rows = hist(spark, sf_dir)
    rows = rules.with_hits(rows.withColumns({c: F.expr(v.replace("0.0 ", "0.0D ")) for c, v in _RICH.items()}))
    return rows.filter(F.size("hits") > 0).select("flow_id", F.concat_ws(",", "hits").alias("hit_list"), "rule_severity", "rule_category")


# ---- models from literal node tables, walked in SQL by recursion ---------------------------------------------------

#: features of the literal models
_INPUTS = ("duration", "src_bytes", "dst_bytes", "hot")
#: tree, node, feature (-1 for a leaf), threshold, left, right, size
_ISOLATION = (
    (0, 0, 0, 4.0, 1, 2, 64), (0, 1, 1, 900.0, 3, 4, 30), (0, 2, -1, 0.0, -1, -1, 34), (0, 3, -1, 0.0, -1, -1, 12), (0, 4, -1, 0.0, -1, -1, 18),
    (1, 0, 1, 2500.0, 1, 2, 64), (1, 1, 2, 1500.0, 3, 4, 50), (1, 2, -1, 0.0, -1, -1, 14), (1, 3, 0, 2.0, 5, 6, 40), (1, 4, -1, 0.0, -1, -1, 10), (1, 5, -1, 0.0, -1, -1, 2), (1, 6, -1, 0.0, -1, -1, 38),
    (2, 0, 2, 3000.0, 1, 2, 64), (2, 1, 3, 3.0, 3, 4, 60), (2, 2, -1, 0.0, -1, -1, 4), (2, 3, -1, 0.0, -1, -1, 59), (2, 4, -1, 0.0, -1, -1, 1),
)
_KINDS = ("normal", "dos", "probe")
#: the same, with the class distribution of the node
_FOREST = (
    (0, 0, 1, 1200.0, 1, 2, 100, (0.5, 0.3, 0.2)), (0, 1, 0, 3.0, 3, 4, 60, (0.7, 0.1, 0.2)), (0, 2, -1, 0.0, -1, -1, 40, (0.2, 0.6, 0.2)), (0, 3, -1, 0.0, -1, -1, 20, (0.4, 0.2, 0.4)), (0, 4, -1, 0.0, -1, -1, 40, (0.85, 0.05, 0.1)),
    (1, 0, 2, 800.0, 1, 2, 100, (0.5, 0.25, 0.25)), (1, 1, -1, 0.0, -1, -1, 70, (0.6, 0.1, 0.3)), (1, 2, 3, 1.0, 3, 4, 30, (0.25, 0.6, 0.15)), (1, 3, -1, 0.0, -1, -1, 10, (0.1, 0.8, 0.1)), (1, 4, -1, 0.0, -1, -1, 20, (0.325, 0.5, 0.175)),
)
_ROW = "[duration, src_bytes, dst_bytes, hot]"


def _nodes_sql(nodes, tag: str = "") -> str:
    cells = lambda n: ", ".join(f"{v}::double" if isinstance(v, float) else str(v) for v in n[:7]) + "".join(f", {p}::double" for p in (n[7] if len(n) > 7 else ()))
    extra = "".join(f", p{i}" for i in range(len(nodes[0][7]))) if len(nodes[0]) > 7 else ""
    return f"nodes{tag}(tree, node, feature, threshold, lft, rgt, size{extra}) as (values {', '.join(f'({cells(n)})' for n in nodes)})"


def _walk_sql(nodes, less: str, row: str = _ROW, source: str = "conn", tag: str = "") -> str:
    """walk: flow_id, tree, node, depth for every node on every row's way."""
    return f"""{_nodes_sql(nodes, tag)}, x{tag} as materialized (select flow_id, {row} as v from {source}),
    walk{tag}(flow_id, tree, node, depth) as (select flow_id, tree, 0, 0 from x{tag}, (select distinct tree from nodes{tag})
      union all select w.flow_id, w.tree, case when x.v[n.feature + 1] {less} n.threshold then n.lft else n.rgt end, w.depth + 1
      from walk{tag} w join nodes{tag} n on n.tree = w.tree and n.node = w.node join x{tag} x on x.flow_id = w.flow_id where n.feature >= 0)"""


def literal_nodes(spark: SparkSession, nodes, classes: bool) -> DataFrame:
    return spark.createDataFrame([(*n[:7], *([list(n[7])] if classes else [])) for n in nodes], forests.NODES + (", value array<double>" if classes else ""))


def _inputs(spark, sf_dir) -> DataFrame:
    return conn(spark, sf_dir).select("flow_id", F.array(*(F.col(c).cast("double") for c in _INPUTS)).alias("x"))


_USUAL = "case when {n} <= 1 then 1e-9 when {n} = 2 then 1.0 else 2.0 * (ln({n} - 1) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n} end"


@query(f"""with recursive {_walk_sql(_ISOLATION, '<')} select flow_id, round(pow(2.0::double, -avg(depth + {_USUAL.format(n='size::double')}) / {_USUAL.format(n='64.0::double')}), 9) as score
    from walk join nodes using (tree, node) where feature < 0 group by flow_id""")
def q_iforest_score(spark, sf_dir):
    """Isolation scores of all connections from a literal node table."""
    score = forests.isolation_score(literal_nodes(spark, _ISOLATION, False), 64)
    return _inputs(spark, sf_dir).select("flow_id", F.round(score("x"), 9).alias("score"))


@query(f"""with recursive {_walk_sql(_ISOLATION, '<')}, s as (select w.flow_id, n.feature, sum((1.0::double - c.size::double / n.size) / (w.depth + 1)) as part
      from walk w join nodes n on n.tree = w.tree and n.node = w.node join walk u on u.flow_id = w.flow_id and u.tree = w.tree and u.depth = w.depth + 1 join nodes c on c.tree = u.tree and c.node = u.node group by all)
    select flow_id, feature, round(part / sum(part) over (partition by flow_id), 9) as weight from s""")
def q_iforest_attribution(spark, sf_dir):
    """How much each feature isolated a connection, by literal trees; features that played no part have no row."""
    weights = forests.isolation_weights(literal_nodes(spark, _ISOLATION, False))
    each = _inputs(spark, sf_dir).select("flow_id", F.posexplode(weights("x")).alias("feature", "weight"))
    return each.filter("weight > 0").select("flow_id", F.col("feature").cast("long").alias("feature"), F.round("weight", 9).alias("weight"))


@query(f"""with recursive {_walk_sql(_FOREST, '<=')} select flow_id, round(avg(p0), 9) as normal, round(avg(p1), 9) as dos, round(avg(p2), 9) as probe
    from walk join nodes using (tree, node) where feature < 0 group by flow_id""")
def q_forest_proba(spark, sf_dir):
    """Class probabilities of all connections from a literal forest."""
    proba = forests.node_probabilities(literal_nodes(spark, _FOREST, True))
    rows = _inputs(spark, sf_dir).select("flow_id", proba("x").alias("p"))
    return rows.select("flow_id", *(F.round(F.get("p", F.lit(i)), 9).alias(c) for i, c in enumerate(_KINDS)))


@query(f"""with recursive {_walk_sql(_FOREST, '<=')} select w.flow_id, n.feature, round(sum(c.p1 - n.p1) / 2, 9) as dos, round(sum(c.p0 - n.p0) / 2, 9) as normal
    from walk w join nodes n on n.tree = w.tree and n.node = w.node join walk u on u.flow_id = w.flow_id and u.tree = w.tree and u.depth = w.depth + 1 join nodes c on c.tree = u.tree and c.node = u.node group by all""")
def q_forest_contributions(spark, sf_dir):
    """Contributions of the features on a connection's ways to two classes; the rest of the features have none."""
    k = len(_KINDS)
    share = forests.contributions(literal_nodes(spark, _FOREST, True), k)
    rows = _inputs(spark, sf_dir).select("flow_id", share("x").alias("c"))
    at = lambda i, j: F.get("c", F.lit(i * k + j))
    cells = F.array(*(F.struct(F.lit(i).cast("long").alias("feature"), F.round(at(i, 1), 9).alias("dos"), F.round(at(i, 0), 9).alias("normal"), sum((F.abs(at(i, j)) for j in range(k)), F.lit(0.0)).alias("any")) for i in range(len(_INPUTS))))
    return rows.select("flow_id", F.explode(cells).alias("r")).select("flow_id", "r.*").filter("any > 0").drop("any")


_BAG_SEED = 11


def _bag_sql(trees: int) -> str:
    """bag: flow_id, tree, w of every row and tree; ids below 2 ** 32."""
    keys = ", ".join(f"({t}, {histogram.tree_key(t, _BAG_SEED)}::ubigint)" for t in range(trees))
    draw = " + ".join(f"(h >= {p})::int" for p in histogram.POISSON)
    step = lambda name, of, more: f"{name} as materialized (select flow_id, tree, {more} as h from {of})"
    h = "h"
    stages, last = [], "b0"
    stages.append(f"b0 as materialized (select flow_id, tree, xor(flow_id::ubigint, key) as h from conn, (values {keys}) k(tree, key))")
    for i in range(2):  # the second is for the upper half of the id, which is 0
        for j, (shift, factor) in enumerate(((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None))):
            stir = f"xor({h}, {h} >> {shift})"
            name = f"b{i}{j}"
            stages.append(step(name, last, f"({stir} * {factor}::ubigint) % 4294967296::ubigint" if factor else stir))
            last = name
    return ", ".join(stages) + f", bag as (select flow_id, tree, {draw} as w from {last})"


@query(f"""with recursive {_walk_sql(_FOREST, '<=')}, {_bag_sql(2)},
    v as (select w.flow_id, sum(p0) as p0, sum(p1) as p1, sum(p2) as p2 from walk w join nodes n on n.tree = w.tree and n.node = w.node join bag b on b.flow_id = w.flow_id and b.tree = w.tree
      where n.feature < 0 and b.w = 0 group by w.flow_id),
    k as (select flow_id, case category when 'normal' then 0 when 'dos' then 1 when 'probe' then 2 else 3 end as label from conn),
    r as (select label, p0 is not null as voted, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as best from k left join v on v.flow_id = k.flow_id)
    select label, count(*) as n_rows, count(*) filter (voted) as n_voted, count(*) filter (voted and best = label) as n_right,
      count(*) filter (voted and best = label)::double / nullif(count(*) filter (voted), 0) as accuracy from r group by label""")
def q_oob_accuracy(spark, sf_dir):
    """By class, how many connections the trees of a literal forest get right that did not see them, with hashed bags of all rows."""
    rows = conn(spark, sf_dir).select("flow_id", "category", F.array(*(F.col(c).cast("double") for c in _INPUTS)).alias("x"))
    place = F.array_position(F.lit(list(_KINDS)), F.col("category"))
    label = F.when(place > 0, place - 1).otherwise(len(_KINDS)).cast("long")
    votes = histogram.oob_votes(literal_nodes(spark, _FOREST, True), _BAG_SEED)
    voted = rows.select(label.alias("label"), votes("flow_id", "x").alias("v"))
    right = (F.array_position("v", F.array_max("v")) - 1) == F.col("label")
    out = voted.groupBy("label").agg(F.count("*").alias("n_rows"), F.count("v").alias("n_voted"), F.sum(F.coalesce(right, F.lit(False)).cast("long")).alias("n_right"))
    return out.withColumn("accuracy", F.try_divide(F.col("n_right").cast("double"), F.col("n_voted")))


# ---- the whole detector around literal trees, repeated in SQL -------------------------------------------------------

#: features of the literal detector; its isolation trees see them scaled
_SEEN = ("duration", "src_bytes", "dst_bytes", "hot", "count", "serror_rate", "diff_srv_rate")
_VOTERS = (
    (0, 0, 1, 1210.7, 1, 2, 100, (0.53, 0.29, 0.18)), (0, 1, 5, 0.1137, 3, 4, 60, (0.71, 0.12, 0.17)), (0, 2, 4, 41.5, 5, 6, 40, (0.23, 0.58, 0.19)), (0, 3, -1, 0.0, -1, -1, 20, (0.83, 0.06, 0.11)),
    (0, 4, -1, 0.0, -1, -1, 40, (0.37, 0.42, 0.21)), (0, 5, -1, 0.0, -1, -1, 25, (0.44, 0.33, 0.23)), (0, 6, -1, 0.0, -1, -1, 15, (0.07, 0.82, 0.11)),
    (1, 0, 0, 3.5, 1, 2, 100, (0.47, 0.22, 0.31)), (1, 1, 3, 1.5, 3, 4, 55, (0.61, 0.14, 0.25)), (1, 2, 6, 0.6613, 5, 6, 45, (0.27, 0.24, 0.49)), (1, 3, -1, 0.0, -1, -1, 30, (0.73, 0.09, 0.18)),
    (1, 4, -1, 0.0, -1, -1, 25, (0.41, 0.26, 0.33)), (1, 5, -1, 0.0, -1, -1, 25, (0.39, 0.28, 0.33)), (1, 6, -1, 0.0, -1, -1, 20, (0.11, 0.13, 0.76)),
    (2, 0, 2, 2205.3, 1, 2, 100, (0.51, 0.27, 0.22)), (2, 1, -1, 0.0, -1, -1, 64, (0.67, 0.16, 0.17)), (2, 2, 4, 77.5, 3, 4, 36, (0.26, 0.43, 0.31)), (2, 3, -1, 0.0, -1, -1, 21, (0.34, 0.31, 0.35)), (2, 4, -1, 0.0, -1, -1, 15, (0.15, 0.59, 0.26)),
)
_APART = (
    (0, 0, 0, 0.7531, 1, 2, 64), (0, 1, 1, -0.2113, 3, 4, 43), (0, 2, 2, 1.4177, 5, 6, 21), (0, 3, -1, 0.0, -1, -1, 19), (0, 4, -1, 0.0, -1, -1, 24), (0, 5, -1, 0.0, -1, -1, 20), (0, 6, -1, 0.0, -1, -1, 1),
    (1, 0, 1, 1.3391, 1, 2, 64), (1, 1, 6, -0.1973, 3, 4, 57), (1, 2, 4, 0.3179, 5, 6, 7), (1, 3, -1, 0.0, -1, -1, 26), (1, 4, -1, 0.0, -1, -1, 31), (1, 5, -1, 0.0, -1, -1, 5), (1, 6, -1, 0.0, -1, -1, 2),
    (2, 0, 3, 0.2719, 1, 2, 64), (2, 1, 2, 2.1337, 3, 4, 39), (2, 2, 5, 1.1713, 5, 6, 25), (2, 3, -1, 0.0, -1, -1, 38), (2, 4, -1, 0.0, -1, -1, 1), (2, 5, -1, 0.0, -1, -1, 22), (2, 6, -1, 0.0, -1, -1, 3),
)
_SAMPLE = 64


def literal_detector(rows: DataFrame) -> Detector:
    """A detector of the literal trees, with feature space, threshold and benign statistics from ``rows``."""
    place = {i: fixed.FEATURES.index(c) for i, c in enumerate(_SEEN)}
    moved = lambda nodes: tuple((n[0], n[1], place.get(n[2], -1), *n[3:]) for n in nodes)
    spark = rows.sparkSession
    space = features.FeatureSpace.fit(rows)
    return Detector.around(rows, space, list(_KINDS), literal_nodes(spark, moved(_VOTERS), True), literal_nodes(spark, moved(_APART), False), _SAMPLE)


_QUOTED = [f'"{c}"' for c in _SEEN]
_SCALE_SQL = "scale as materialized (select " + ", ".join(f"avg({c}) as m{i}, case when stddev_pop({c}) < 1e-12 then 1.0 else stddev_pop({c}) end as d{i}" for i, c in enumerate(_QUOTED)) + " from hist)"
_RAW_ROW = "[" + ", ".join(_QUOTED) + "]"
_SCALED_ROW = "[" + ", ".join(f"({c} - m{i}) / d{i}" for i, c in enumerate(_QUOTED)) + "]"
_JUDGED_SQL = f"""{_SCALE_SQL}, {_walk_sql(_VOTERS, "<=", _RAW_ROW, "hist", "_f")}, {_walk_sql(_APART, "<", _SCALED_ROW, "hist, scale", "_i")},
    proba as materialized (select flow_id, avg(p0) as p0, avg(p1) as p1, avg(p2) as p2 from walk_f join nodes_f using (tree, node) where feature < 0 group by flow_id),
    far as materialized (select *, round(exact, 11) as score from (select flow_id, pow(2.0::double, -avg(depth + {_USUAL.format(n="size::double")}) / {_USUAL.format(n="64.0::double")}) as exact
      from walk_i join nodes_i using (tree, node) where feature < 0 group by flow_id)),
    benign as materialized (select score, sum(count(*)) over (order by score) as upto, sum(count(*)) over () as many from far join hist using (flow_id) where category = 'normal' group by score),
    line as materialized (select quantile_cont(score, 0.99) as threshold from far join hist using (flow_id) where category = 'normal'),
    judged as materialized (select h.*, 1.0::double - p0 as attack_prob, round(1.0::double - p0, 9) >= 0.5 as supervised_alert, score, exact,
        case when p0 >= p1 and p0 >= p2 then 'normal' when p1 >= p2 then 'dos' else 'probe' end as supervised_category, score >= round(threshold, 11) as anomaly_alert,
        coalesce((select max(upto)::double / max(many) from benign b where b.score <= far.score), 0.0) as novelty
      from hit h join proba using (flow_id) join far using (flow_id), line),
    above as materialized (select *, {_ABOVE} as above from judged), {_fusion_sql("above", "verdict")}"""


@query(f"""with recursive {_JUDGED_SQL} select flow_id, round(attack_prob, 9) as attack_prob, supervised_category, supervised_alert, round(exact, 9) as score, anomaly_alert, round(novelty, 9) as novelty,
    rule_score, round(fused_score, 9) as fused_score, layer_list, severity, category_out from verdict""")
def q_verdicts(spark, sf_dir):
    """All three layers and their fusion for all connections, by a detector of literal trees: nothing in it is a stand-in."""
    rows = table(hist(spark, sf_dir))
    out = literal_detector(rows).predict(rows)
    short = lambda c: F.round(c, 9).alias(c)
    return out.select("flow_id", short("attack_prob"), "supervised_category", "supervised_alert", short("score"), "anomaly_alert", short("novelty"), "rule_score", short("fused_score"), F.concat_ws(", ", "layers").alias("layer_list"), "severity", "category_out")


_NAMED = "case feature " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(_SEEN)) + " end"
_STEPS = "walk{t} w join nodes{t} n on n.tree = w.tree and n.node = w.node join walk{t} u on u.flow_id = w.flow_id and u.tree = w.tree and u.depth = w.depth + 1 join nodes{t} c on c.tree = u.tree and c.node = u.node"


@query(f"""with recursive {_JUDGED_SQL}, told as (select flow_id, supervised_category as k from verdict where n_layers >= 2),
    s as (select w.flow_id, n.feature, sum(c.p0 - n.p0) / 3 as c0, sum(c.p1 - n.p1) / 3 as c1, sum(c.p2 - n.p2) / 3 as c2 from {_STEPS.format(t="_f")} group by all),
    i as (select w.flow_id, n.feature, sum((1.0::double - c.size::double / n.size) / (w.depth + 1)) as part from {_STEPS.format(t="_i")} group by all),
    stat as (select {", ".join(f"avg({c}) as b{i}, stddev_pop({c}) as e{i}" for i, c in enumerate(_QUOTED))} from hist where category = 'normal'),
    told_all as (select 'supervised' as layer, flow_id, feature, round(case k when 'normal' then c0 when 'dos' then c1 else c2 end, 9) as amount from s join told using (flow_id)
      union all select 'anomaly', flow_id, feature, round(part / sum(part) over (partition by flow_id), 9) from i join told using (flow_id)),
    ranked as (select *, row_number() over (partition by flow_id, layer order by abs(amount) desc, feature) as place from told_all where amount <> 0)
    select r.layer, flow_id, {_NAMED} as feature, amount, r.place, round(x.v[feature + 1], 6) as observed,
      case when layer = 'anomaly' then round((x.v[feature + 1] - [{", ".join(f"b{i}" for i in range(len(_SEEN)))}][feature + 1]) / [{", ".join(f"e{i}" for i in range(len(_SEEN)))}][feature + 1], 6) end as z
    from ranked r join x_f x using (flow_id), stat where r.place <= 3""")
def q_top_features(spark, sf_dir):
    """The three features that moved the forest most and the three that set the connection apart, for alerts of two layers or more."""
    rows = table(hist(spark, sf_dir))
    det = literal_detector(rows)
    # dealt anew, as verdicts come in the order of their scores; and explained once for both layers
    told = det.explain(det.predict(rows).filter("size(layers) >= 2").repartition("flow_id"), top=3)
    most = lambda layer, amount, z: F.transform(f"{layer}.features", lambda f, i: F.struct(
        F.lit(layer).alias("layer"), f["feature"].alias("feature"), F.round(f[amount], 9).alias("amount"), (i + 1).cast("long").alias("place"), F.round(f["observed"], 6).alias("observed"), z(f).alias("z")))
    both = F.concat(most("supervised", "contribution", lambda f: F.lit(None).cast("double")), most("anomaly", "weight", lambda f: F.round(f["z"], 6)))
    return told.select("flow_id", F.explode(both).alias("r")).select("r.layer", "flow_id", "r.feature", "r.amount", "r.place", "r.observed", "r.z").filter("amount <> 0")


@query(f"""with recursive {_walk_sql(_VOTERS, "<=", _RAW_ROW, "hist", "_f")},
    k as (select flow_id, category as k from hist where category in ('normal', 'dos', 'probe')), c as (select tree, node, k, count(*)::double as n from walk_f join k using (flow_id) group by all),
    g as (select tree, node, sum(n) - sum(n * n) / sum(n) as g from c group by all),
    d as (select a.feature, greatest(g.g - coalesce(l.g, 0) - coalesce(r.g, 0), 0) as gain from nodes_f a join g on g.tree = a.tree and g.node = a.node
      left join g l on l.tree = a.tree and l.node = a.lft left join g r on r.tree = a.tree and r.node = a.rgt where a.feature >= 0)
    select {_NAMED} as feature, round(sum(gain) / (select sum(gain) from d), 9) as importance from d group by feature""")
def q_importances_on(spark, sf_dir):
    """How much each feature of a literal forest is worth on the connections of its classes, by the impurity its splits take away."""
    rows = hist(spark, sf_dir)
    vector = F.array(*(F.col(c).cast("double") for c in _SEEN))
    label = F.array_position(F.lit(list(_KINDS)), F.col("category")) - 1
    found = forests.importances_on(literal_nodes(spark, _VOTERS, True), rows, vector, label, len(_KINDS))
    return found.select(F.get(F.lit(list(_SEEN)), F.col("feature")).alias("feature"), F.round("importance", 9).alias("importance"))


# ---- the detector: no SQL, as its models are fitted ---------------------------------------------------------------


_VERDICT = "flow_id attack_prob supervised_category score novelty rule_score rule_category is_alert fused_score severity category_out".split()


@query()
def q_detect(spark, sf_dir):
    """Every connection's verdict by models fitted to the whole table with production parameters."""
    return detected(table(hist(spark, sf_dir)))[1].select(*_VERDICT)


@query()
def q_evaluated(spark, sf_dir):
    """Section, name and figures of the report on models that are fitted to one part of the table and judged on the other."""
    rows = table(records.stratified_split(table(hist(spark, sf_dir)), 0.3, 7))  # both parts are read several times
    train, test = (rows.filter(F.col("is_test") == t).drop("is_test") for t in (False, True))
    det = Detector.fit(train)
    verdicts, times = report.staged(det, test)
    novel = report.novel_labels(train, test)
    long = lambda df, section, name: df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.to_json(F.struct(*(c for c in df.columns if c != name))).alias("figures"))
    parts = [long(df, k, df.columns[0]) for k, df in (report.evaluation(det, verdicts, novel) | report.scenarios(det, verdicts, novel)).items() if "example" not in k and "near" not in k]
    return reduce(DataFrame.union, parts)


@query()
def q_detect_oob(spark, sf_dir):
    """Accuracy of the forest that is fitted to the whole table, each row judged by the trees that did not see it."""
    return Detector.oob(table(hist(spark, sf_dir)))


@query()
def q_detect_explained(spark, sf_dir):
    """The explained record of every alert of q_detect."""
    det, rows = detected(table(hist(spark, sf_dir)))
    return det.explain(rows.filter("is_alert"))
