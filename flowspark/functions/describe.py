"""Flow descriptions: one text per flow, built from the categorical classes.

Work is split over a few projections so that a rate or class is computed once and then
only referenced; nothing here leaves the JVM or moves a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark import domains as D
from flowspark.functions import flow_classes as C
from flowspark.functions.text import format_bytes, format_rate, format_time, format_value, integer, lookup, number

FLOAT_TYPES = (T.DoubleType, T.FloatType, T.DecimalType)
# Known columns that are measured rather than counted; all others are read as whole numbers.
FRACTIONS = {
    "Flow Duration", "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Min Packet Length", "Max Packet Length",
    "Packet Length Mean", "Packet Length Std", "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "dur", "sbytes", "dbytes", "Sload", "Dload", "smeansz", "dmeansz",
}


def ensure_columns(df: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    """Add absent columns as nulls, so that later expressions read them as 0.

    Names are compared as the resolver does: other spellings of a name count as present.
    """
    present = {c.lower() for c in df.columns}
    absent = {n: F.lit(None).cast("double") for n in names if n.lower() not in present}
    return df.withColumns(absent) if absent else df


def cic_duration(raw: Column, unit: str = "auto") -> Column:
    """Seconds from the raw duration, a number.

    ``auto`` keeps the published rule: only values above 1000 are microseconds.  ``us``
    always reads microseconds.
    """
    if unit == "us":
        return raw / 1e6
    return F.when(raw > 1000, raw / 1e6).otherwise(raw)


def _value(column: str) -> Column:
    return F.col(f"values.`{column}`")


def flow_measures(df: DataFrame, unit: str = "auto") -> DataFrame:
    """Add ``values``, all known columns as plain numbers, and ``flow``, the same measures for both datasets."""
    df = ensure_columns(df, D.CIC_FLOW_COLUMNS + D.UNSW_FLOW_COLUMNS)
    cic = F.col("dataset_source") == D.CIC
    values = [
        (number if c in FRACTIONS else integer)(F.col(f"`{c}`")).alias(c)
        for c in D.CIC_FLOW_COLUMNS + D.UNSW_FLOW_COLUMNS if c not in ("Protocol", "proto")]

    def pick(cic_name: str, unsw_name: str) -> Column:
        return F.when(cic, _value(cic_name)).otherwise(_value(unsw_name))

    base = F.struct(
        F.when(cic, cic_duration(_value("Flow Duration"), unit)).otherwise(_value("dur")).alias("duration"),
        pick("Total Fwd Packets", "Spkts").alias("fwd_pkts"),
        pick("Total Backward Packets", "Dpkts").alias("bwd_pkts"),
        pick("Total Length of Fwd Packets", "sbytes").alias("fwd_bytes"),
        pick("Total Length of Bwd Packets", "dbytes").alias("bwd_bytes"),
        C.protocol_name(F.when(cic, F.col("Protocol").cast("string")).otherwise(F.col("proto").cast("string"))).alias("proto"),
    )
    total_pkts = F.col("_b.fwd_pkts") + F.col("_b.bwd_pkts")
    total_bytes = F.col("_b.fwd_bytes") + F.col("_b.bwd_bytes")
    dur = F.col("_b.duration")
    measured = F.struct(
        F.col("_b.*"),
        total_pkts.alias("total_pkts"),
        total_bytes.alias("total_bytes"),
        F.when(dur > 0, total_pkts / dur).otherwise(0.0).alias("pkt_rate"),
        F.when(dur > 0, total_bytes / dur).otherwise(0.0).alias("byte_rate"),
        C.byte_ratio(F.col("_b.fwd_bytes"), F.col("_b.bwd_bytes")).alias("ratio"),
        C.duration_class(dur).alias("duration_class"),
        C.flow_shape(*[F.col(f"_b.{c}") for c in ("fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes")]).alias("shape"),
    )
    return df.withColumn("values", F.struct(*values)).withColumn("_b", base).withColumn("flow", measured).drop("_b")


def flow_classes(df: DataFrame) -> DataFrame:
    """Add a ``classes`` struct (codes) to a frame from ``flow_measures``."""
    f = {n: F.col(f"flow.{n}") for n in (
        "duration", "fwd_pkts", "bwd_pkts", "fwd_bytes", "total_pkts", "total_bytes",
        "pkt_rate", "byte_rate", "shape", "proto")}
    flags = {flag: _value(column) for flag, column in D.FLAG_COLUMNS}
    cic = F.col("dataset_source") == D.CIC
    patterns = C.flag_patterns(*[flags[n] for n in ("SYN", "ACK", "FIN", "RST", "PSH", "URG")])
    return df.withColumn("classes", F.struct(
        C.packet_rate_class(f["pkt_rate"], f["total_pkts"], f["duration"]).alias("packet_rate"),
        C.byte_rate_class(f["byte_rate"], f["total_bytes"], f["duration"]).alias("byte_rate"),
        F.col("flow.duration_class").alias("duration"),
        f["shape"].alias("shape"),
        F.when(cic, patterns).otherwise(F.array().cast("array<string>")).alias("flag_patterns"),
        C.signatures(
            F.col("dataset_source"), f["pkt_rate"], f["byte_rate"], f["duration"], f["shape"],
            f["fwd_pkts"], f["bwd_pkts"], f["fwd_bytes"], flags["SYN"], flags["ACK"], flags["PSH"],
            _value("service"), _value("state"), ~f["proto"].startswith("protocolo"),
        ).alias("signatures"),
    ))


def _shown() -> Column:
    """Every formatted number of the common lines, once."""
    return F.struct(
        format_time(F.col("flow.duration")).alias("duration"), format_rate(F.col("flow.pkt_rate")).alias("pkt_rate"),
        format_rate(F.col("flow.byte_rate")).alias("byte_rate"), C.ratio_text(F.col("flow.shape"), F.col("flow.ratio")).alias("ratio"),
        format_bytes(F.col("flow.fwd_bytes")).alias("fwd_bytes"), format_bytes(F.col("flow.bwd_bytes")).alias("bwd_bytes"),
    )


def _joined_texts(codes: Column, wording: dict[str, str], separator: str, lead: str = "") -> Column:
    return F.concat_ws(separator, *[F.when(F.array_contains(codes, code), lead + text) for code, text in wording.items()])


def _common_lines() -> list[Column]:
    return [
        F.concat(F.lit("DURAÇÃO: "), C.worded(F.col("classes.duration"), D.DURATION_TEXT, F.col("shown.duration"))),
        F.concat(F.lit("TAXA DE PACOTES: "), C.worded(F.col("classes.packet_rate"), D.PACKET_RATE_TEXT, F.col("shown.pkt_rate"))),
        F.concat(F.lit("TAXA DE BYTES: "), C.worded(F.col("classes.byte_rate"), D.BYTE_RATE_TEXT, F.col("shown.byte_rate"))),
        F.concat(F.lit("FORMA DO FLUXO: "), C.worded(F.col("classes.shape"), D.SHAPE_TEXT, F.col("shown.ratio"))),
    ]


def _volume_line(forward: str, backward: str) -> Column:
    return F.concat(
        F.lit("VOLUME: "), F.col("flow.fwd_pkts").cast("string"), F.lit(f" pkts {forward} ("), F.col("shown.fwd_bytes"), F.lit(") | "),
        F.col("flow.bwd_pkts").cast("string"), F.lit(f" pkts {backward} ("), F.col("shown.bwd_bytes"), F.lit(")"),
    )


def _signature_block() -> Column:
    codes = F.col("classes.signatures")
    lines = F.concat(F.lit("ASSINATURAS DETECTADAS:\n"), _joined_texts(codes, D.SIGNATURE_TEXT, "\n", "  "))
    return F.when(F.size(codes) > 0, lines)


def _whole(value: Column) -> Column:
    return value.try_cast("bigint").cast("string")


def _cic_text() -> Column:
    low, high, mean, std = [_value(n) for n in (
        "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std")]
    size_line = F.concat(
        F.lit("TAMANHO PKT: min="), _whole(low), F.lit(", max="), _whole(high), F.lit(", média="), _whole(mean), F.lit(" bytes"),
        lookup(D.SIZE_NOTES, C.size_note(low, high, mean, std), ""),
    )
    flags = {flag: _value(column) for flag, column in D.FLAG_COLUMNS}
    patterns = F.col("classes.flag_patterns")
    fwd_win, bwd_win = _value("Init_Win_bytes_forward"), _value("Init_Win_bytes_backward")
    window_line = F.concat(
        F.lit("JANELA TCP: fwd="), _whole(fwd_win),
        F.when(bwd_win > 0, F.concat(F.lit(", bwd="), _whole(bwd_win))).otherwise(""),
        lookup(D.WINDOW_NOTES, C.window_note(fwd_win), ""),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("=== FLUXO "), F.col("flow.proto"), F.lit(f" ({D.CIC}) ===")),
        *_common_lines(),
        _volume_line("fwd", "bwd"),
        F.when(high > 0, size_line),
        F.concat(F.lit("FLAGS TCP: "), C.flag_text(flags)),
        F.when(F.size(patterns) > 0, F.concat(F.lit("PADRÃO DE FLAGS: "), _joined_texts(patterns, D.FLAG_PATTERN_TEXT, "; "))),
        F.when(fwd_win > 0, window_line),
        _signature_block(),
    )


def _unsw_text() -> Column:
    service, state, s_load, d_load, s_mean, d_mean, s_ttl, d_ttl, repeats, http, logins, commands = [_value(c) for c in (
        "service", "state", "Sload", "Dload", "smeansz", "dmeansz", "sttl", "dttl", "ct_state_ttl", "ct_flw_http_mthd",
        "is_ftp_login", "ct_ftp_cmd")]
    return F.concat_ws(
        "\n",
        F.concat(F.lit("=== FLUXO "), F.col("flow.proto"), F.lit(f" ({D.UNSW}) ===")),
        F.concat(F.lit("SERVIÇO: "), C.service_hint(service), F.lit(" | ESTADO: "), C.state_hint(state),
                 F.lit(" ("), C.state_meaning(state), F.lit(")")),
        *_common_lines(),
        _volume_line("src→dst", "dst→src"),
        F.when((s_load > 0) | (d_load > 0),
               F.concat(F.lit("BPS: src="), format_rate(s_load), F.lit(", dst="), format_rate(d_load))),
        F.when((s_mean != 0) | (d_mean != 0),
               F.concat(F.lit("TAMANHO MÉDIO PKT: src="), _whole(s_mean),
                        F.lit("B, dst="), _whole(d_mean), F.lit("B"))),
        F.when((s_ttl > 0) | (d_ttl > 0),
               F.concat(F.lit("TTL: src="), s_ttl.cast("string"), F.lit(", dst="), d_ttl.cast("string"),
                        lookup(D.TTL_NOTES, C.ttl_note(s_ttl, d_ttl), ""))),
        F.when(repeats > 0,
               F.concat(F.lit("CONEXÕES PRÉVIAS no mesmo state/TTL: "), repeats.cast("string"),
                        F.when(repeats >= 5, D.REPEAT_NOTE).otherwise(""))),
        F.when(_value("is_sm_ips_ports") == 1, D.LAND_ANOMALY),
        F.when(http > 0, F.concat(F.lit("MÉTODOS HTTP no fluxo: "), http.cast("string"))),
        F.when((logins > 0) | (commands > 0),
               F.concat(F.lit("COMANDOS FTP: "), commands.cast("string"), F.lit(" (login="), logins.cast("string"), F.lit(")"))),
        _signature_block(),
    )


def generic_text(df: DataFrame, columns: list[str] | None = None, most: int = 15) -> Column:
    """``name=value`` for the first ``most`` columns that are neither null nor zero."""
    items = []
    for field in df.schema.fields:
        if field.name in D.META_COLS or (columns is not None and field.name not in columns):
            continue
        col = F.col(f"`{field.name}`")
        is_float = isinstance(field.dataType, FLOAT_TYPES)
        shown = col.isNotNull()
        if isinstance(field.dataType, T.NumericType):
            shown = shown & (col != 0)
            if is_float:
                shown = shown & ~F.isnan(col.cast("double"))
        items.append(F.when(shown, F.concat(F.lit(f"{field.name}="), format_value(col, is_float))))
    kept = F.slice(F.array_compact(F.array(*items)), 1, most)
    return F.concat(F.lit(D.GENERIC_LEAD + ": "), F.array_join(kept, ", "), F.lit("."))


def describe(df: DataFrame, output: str = "description", unit: str = "auto", keep_measures: bool = False,
             generic_columns: list[str] | None = None) -> DataFrame:
    """Add the description of every flow, by dataset.  ``generic_columns`` limits what the text
    of flows from other datasets lists."""
    original = df.columns
    generic = generic_text(df, generic_columns)
    if "dataset_source" not in original:
        return df.withColumn(output, generic)
    staged = flow_classes(flow_measures(df, unit))
    text = (
        F.when(F.col("dataset_source") == D.CIC, _cic_text())
        .when(F.col("dataset_source") == D.UNSW, _unsw_text())
        .otherwise(generic)
    )
    staged = staged.withColumn("shown", _shown()).withColumn(output, text)
    extra = ["flow", "classes"] if keep_measures else []
    return staged.select(*[F.col(f"`{c}`") for c in original], *extra, output)
