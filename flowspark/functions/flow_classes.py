"""Categorical reading of a flow: rates, duration, shape, flags and rule signatures.

Each ``*_class`` function returns a short code; the matching ``*_text`` function adds the
wording and the formatted number.  All are plain expressions and stay inside codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.functions.text import fill, fixed, format_rate, format_time, lookup

FLAG_CODES = tuple(D.FLAG_PATTERN_TEXT)


def _rate_class(rate: Column, sustained: Column, limits: tuple[float, float, float, float]) -> Column:
    top, high, mid, low = limits
    return (
        F.when(rate.isNull() | F.isnan(rate) | (rate <= 0), "ZERO")
        .when(rate > top, F.when(sustained, "FLOOD").otherwise("INDETERMINADA"))
        .when(rate > high, F.when(sustained, "ALTA").otherwise("BURST"))
        .when(rate > mid, "MODERADA")
        .when(rate > low, "BAIXA")
        .otherwise("QUASE ZERO")
    )


def _sustained(volume: Column | None, least: float, duration: Column | None) -> Column:
    """Volume and duration guards; an absent value counts as satisfied."""
    enough = F.lit(True) if volume is None else F.coalesce(volume >= least, F.lit(True))
    long_enough = F.lit(True) if duration is None else F.coalesce(duration >= 0.1, F.lit(True))
    return enough & long_enough


def packet_rate_class(rate: Column, total_pkts: Column | None = None, duration: Column | None = None) -> Column:
    return _rate_class(rate, _sustained(total_pkts, 20, duration), (1000, 100, 10, 0.1))


def byte_rate_class(rate: Column, total_bytes: Column | None = None, duration: Column | None = None) -> Column:
    return _rate_class(rate, _sustained(total_bytes, 10_000, duration), (10_000_000, 1_000_000, 10_000, 100))


def worded(code: Column, wording: dict[str, str], value: Column) -> Column:
    branches = None
    for name, template in wording.items():
        text = fill(template, value) if "{}" in template else F.lit(template)
        branches = F.when(code == name, text) if branches is None else branches.when(code == name, text)
    return branches


def packet_rate_text(code: Column, rate: Column) -> Column:
    return worded(code, D.PACKET_RATE_TEXT, format_rate(rate))


def byte_rate_text(code: Column, rate: Column) -> Column:
    return worded(code, D.BYTE_RATE_TEXT, format_rate(rate))


def duration_class(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), "INSTANTÂNEA")
        .when(seconds < 0.001, "INSTANT")
        .when(seconds < 1, "SHORT")
        .when(seconds < 60, "MEDIUM")
        .when(seconds < 600, "LONG")
        .otherwise("VERY LONG")
    )


def duration_text(code: Column, seconds: Column) -> Column:
    return worded(code, D.DURATION_TEXT, format_time(seconds))


def byte_ratio(fwd_bytes: Column, bwd_bytes: Column) -> Column:
    return fwd_bytes / F.greatest(bwd_bytes, F.lit(1.0))


def flow_shape(fwd_pkts: Column, bwd_pkts: Column, fwd_bytes: Column, bwd_bytes: Column) -> Column:
    ratio = byte_ratio(fwd_bytes, bwd_bytes)
    return (
        F.when((fwd_pkts == 0) & (bwd_pkts == 0), "VAZIO")
        .when(bwd_pkts == 0, "UNIDIRECIONAL")
        .when(fwd_pkts == 0, "REVERSO ANÔMALO")
        .when((fwd_bytes == 0) & (bwd_bytes == 0), "HANDSHAKE-ONLY")
        .when(bwd_bytes == 0, "QUERY")
        .when(fwd_bytes == 0, "ANSWER")
        .when(ratio > 100, "EXFILTRAÇÃO")
        .when(ratio > 10, "UPLOAD")
        .when(ratio < 0.01, "DOWNLOAD")
        .when(ratio < 0.1, "DOWNLOAD-HEAVY")
        .otherwise("SIMÉTRICO")
    )


def ratio_text(code: Column, ratio: Column) -> Column:
    """The ratio as the wording of a shape shows it."""
    return (
        F.when(code.isin("EXFILTRAÇÃO", "UPLOAD"), fixed(ratio, 0))
        .when(code.isin("DOWNLOAD", "DOWNLOAD-HEAVY"), fixed(F.try_divide(F.lit(1.0), ratio), 0))
        .otherwise(fixed(ratio, 2))
    )


def shape_text(code: Column, ratio: Column) -> Column:
    return worded(code, D.SHAPE_TEXT, ratio_text(code, ratio))


def present(texts: Iterable[Column]) -> Column:
    """Array of the distinct texts that are not null.  Unlike ``array_compact`` this has no lambda
    and keeps the projection inside whole-stage codegen."""
    return F.array_except(F.array(*texts), F.array(F.lit(None).cast("string")))


def flag_patterns(syn: Column, ack: Column, fin: Column, rst: Column, psh: Column, urg: Column) -> Column:
    """Codes of all matching flag patterns, in fixed order."""
    tests = (
        (syn > 0) & (ack == 0) & (fin == 0),
        (ack > 0) & (syn == 0) & (fin == 0) & (psh == 0) & (urg == 0),
        (fin == 1) & (syn == 0),
        (rst > 0) & (syn > 0),
        (urg > 0) & (psh > 0) & (fin > 0),
        (syn > 0) & (ack > 0) & (psh > 0),
    )
    return present(F.when(test, code) for code, test in zip(FLAG_CODES, tests))


def signatures(
    source: Column, pkt_rate: Column, byte_rate: Column, duration: Column, shape: Column,
    fwd_pkts: Column, bwd_pkts: Column, fwd_bytes: Column,
    syn: Column, ack: Column, psh: Column,
    service: Column, state: Column, proto_known: Column,
) -> Column:
    """Codes of all rule signatures a flow matches, in fixed order."""
    cic = source == D.CIC
    unsw = source == D.UNSW
    sustained = (duration >= 0.1) & (fwd_pkts + bwd_pkts >= 20)
    unanswered_syn = cic & (syn > 0) & (ack == 0) & (bwd_pkts == 0)
    dialog = shape.isin("SIMÉTRICO", "DOWNLOAD", "DOWNLOAD-HEAVY")
    tests = {
        "flood": (pkt_rate > 1000) & sustained,
        "syn_flood": unanswered_syn & (syn >= 5),
        "syn_scan": unanswered_syn & (syn < 5),
        "slow_recon": (duration > 60) & (fwd_pkts <= 5) & (bwd_pkts == 0),
        "brute_force": cic & (duration > 0.1) & (duration < 10) & (fwd_pkts > 5) & (bwd_pkts > 0) & (psh > 0),
        "exfiltration": (fwd_bytes > 100_000) & sustained & (fwd_pkts > bwd_pkts * 2) & (byte_rate > 100_000),
        "c2_beacon": (duration > 300) & (pkt_rate > 0) & (pkt_rate < 10) & dialog,
        "likely_benign": (pkt_rate > 1) & (pkt_rate < 100) & (duration > 0.5) & (duration < 300) & dialog,
        "rejected_scan": unsw & (state == 5) & (bwd_pkts == 0),
        "request_probe": unsw & (state == 4),
        "unknown_protocol": unsw & (service == 0) & ~proto_known & (duration < 0.001),
        "ftp_probe": unsw & (service == 2) & (bwd_pkts == 0),
    }
    return present(F.when(test, code) for code, test in tests.items())


def protocol_name(number_col: Column) -> Column:
    code = number_col.try_cast("double").try_cast("int")
    unnamed = F.concat(F.lit("protocolo "), code.cast("string"))
    return F.when(code.isNull(), "desconhecido").otherwise(F.coalesce(lookup(D.PROTOCOL_NAMES, code), unnamed))


def service_hint(service: Column) -> Column:
    return lookup(D.SERVICE_HINTS, service, "outro")


def state_hint(state: Column) -> Column:
    return lookup(D.STATE_HINTS, state, "desconhecido")


def state_meaning(state: Column) -> Column:
    return lookup(D.STATE_MEANINGS, state, "")


def size_note(low: Column, high: Column, mean: Column, std: Column) -> Column:
    return (
        F.when((high <= 60) & (mean <= 60), "small")
        .when(low == high, "uniform")
        .when(std > mean, "variable")
        .otherwise("")
    )


def window_note(fwd_window: Column) -> Column:
    return F.when(fwd_window < 1024, "small").when(fwd_window > 60000, "large").otherwise("")


def ttl_note(source_ttl: Column, target_ttl: Column) -> Column:
    return (
        F.when((target_ttl == 0) & (source_ttl > 0), "dropped")
        .when(source_ttl.isin(254, 255), "high")
        .when(source_ttl == 64, "linux")
        .when(source_ttl == 128, "windows")
        .otherwise("")
    )


def flag_text(counts: dict[str, Column]) -> Column:
    """``NAME=n`` for every flag seen."""
    shown = [F.when(n > 0, F.concat(F.lit(f"{flag}="), n.cast("string"))) for flag, n in counts.items()]
    joined = F.concat_ws(", ", *shown)
    return F.when(joined == "", "(nenhuma)").otherwise(joined)
