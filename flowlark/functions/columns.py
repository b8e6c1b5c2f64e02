"""Column expressions: cleaning, lookups, derived features, connection states, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark import fixed


def lookup(values: dict) -> Column:
    """A small constant map; use as lookup(m)[key], null for other keys."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def found(values: dict, key: Column, default: str) -> Column:
    return F.coalesce(F.element_at(lookup(values), key), F.lit(default))


def number(df: DataFrame, name: str) -> Column:
    """The column as double: text that is no number, NaN and null are 0, and so is a column that is missing."""
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.nanvl(F.col(name).try_cast("double"), F.lit(0.0)), F.lit(0.0))


def words(df: DataFrame, name: str, missing: str = "unknown") -> Column:
    """The column as trimmed lower-case text; null is 'nan', a missing column ``missing``."""
    if name not in df.columns:
        return F.lit(missing)
    return F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit("nan"))))


def finite(c: Column) -> Column:
    """0 for NaN and infinities."""
    bad = F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull()
    return F.when(bad, F.lit(0.0)).otherwise(c)


def physical(c: Column) -> Column:
    """A quantity that can't be negative or infinite."""
    return F.greatest(finite(c), F.lit(0.0))


def clean_label(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\.+$", ""))


def category_of(label: Column) -> Column:
    """Attack category of a raw label; 'unknown' for labels that are not mapped."""
    return found(fixed.CATEGORY_OF, clean_label(label), "unknown")


def is_attack(category: Column) -> Column:
    return (category != "normal").cast("int")


def service_of(proto: Column, port: Column, icmp_types: Column) -> Column:
    """Service of a flow from its port, or its ICMP types (echo request, echo reply, unreachable, in this order)."""
    icmp = (
        F.when(F.array_contains(icmp_types, 8), "eco_i")
        .when(F.array_contains(icmp_types, 0), "ecr_i")
        .when(F.array_contains(icmp_types, 3), "urp_i")
        .otherwise("other")
    )
    by_port = found(fixed.SERVICE_OF_PORT, port, "private")
    return F.when(proto == "icmp", icmp).when((proto == "udp") & (by_port == "domain"), "domain_u").otherwise(by_port)


def state_of(proto: Column, orig: Column, resp: Column) -> Column:
    """Connection state from the flag bits that originator and responder have sent."""
    has = lambda side, bit: side.bitwiseAND(F.lit(bit)) != 0
    answered = has(resp, fixed.SYN) & has(resp, fixed.ACK)
    return (
        F.when(proto != "tcp", "SF")
        .when(~answered & has(resp, fixed.RST), "REJ")
        .when(~answered & has(orig, fixed.SYN), "S0")
        .when(~answered, "OTH")
        .when(has(orig, fixed.FIN) & has(resp, fixed.FIN), "SF")
        .when(has(orig, fixed.RST), "RSTO")
        .when(has(resp, fixed.RST), "RSTR")
        .when(has(orig, fixed.FIN), "S2")
        .when(has(resp, fixed.FIN), "S3")
        .otherwise("S1")
    )


def shown(c: Column) -> Column:
    """A number for people: no decimals if whole, else three."""
    whole = (F.abs(c - F.round(c)) < 1e-9) & (F.abs(c) < 1e15)
    return F.when(whole, F.format_string("%.0f", c)).otherwise(F.format_string("%.3f", c))


def derived(df: DataFrame, service_freq: Column | None = None) -> dict[str, Column]:
    """The 14 derived features of a connection frame, by name."""
    n = lambda name: number(df, name)
    src, dst, dur, cnt = (physical(n(c)) for c in ("src_bytes", "dst_bytes", "duration", "count"))
    proto, flag = words(df, "protocol_type"), words(df, "flag")
    yes = lambda c: c.cast("double")
    return {
        "log_src_bytes": F.log1p(src),
        "log_dst_bytes": F.log1p(dst),
        "byte_ratio": src / (src + dst + 1.0),
        "bytes_per_second": (src + dst) / (dur + 1.0),
        "conn_per_second": cnt / (dur + 1.0),
        "error_pressure": F.greatest(n("serror_rate"), n("srv_serror_rate")) + F.greatest(n("rerror_rate"), n("srv_rerror_rate")),
        "service_entropy_proxy": n("diff_srv_rate") * n("dst_host_diff_srv_rate"),
        "auth_pressure": n("num_failed_logins") + 2.0 * n("root_shell") + 2.0 * n("su_attempted") + n("hot") / 5.0 + n("is_guest_login"),
        "service_freq": F.lit(0.0) if service_freq is None else service_freq,
        "flag_serror": yes(flag.isin(fixed.HALF_OPEN)),
        "flag_rerror": yes(flag.isin(fixed.REJECTED_WIDE)),
        "proto_tcp": yes(proto == "tcp"),
        "proto_udp": yes(proto == "udp"),
        "proto_icmp": yes(proto == "icmp"),
    }
