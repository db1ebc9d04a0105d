import pytest
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.functions import text as X
from flowspark.functions.describe import describe


def texts(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r["description"] for r in describe(df).collect()]


CIC_SCHEMA = ("dataset_source string, Protocol int, `Flow Duration` double, `Total Fwd Packets` int, `Total Backward Packets` int, "
              "`Total Length of Fwd Packets` double, `Min Packet Length` int, `Max Packet Length` int, `Packet Length Mean` double, "
              "`SYN Flag Count` int, `FIN Flag Count` int, `ACK Flag Count` int, `ECE Flag Count` int, Init_Win_bytes_forward int")


def test_cic_text(spark):
    row = (D.CIC, 6, 1_500_000.0, 7, 3, 1024.0, 64, 512, 200.0, 1, 1, 5, 0, 65535)
    text, other = texts(spark, [row, (D.CIC, 1, *row[2:12], 2, 0)], CIC_SCHEMA)
    lines = text.split("\n")
    assert lines[0] == "=== FLUXO TCP (CIC-IDS2017) ==="
    assert lines[1] == "DURAÇÃO: MEDIUM (1.50s — sessão típica de aplicação)"
    assert lines[2].startswith("TAXA DE PACOTES: BAIXA (6.7 pkt/s")
    assert lines[3].startswith("TAXA DE BYTES: BAIXA (682.7 B/s")
    assert lines[4].startswith("FORMA DO FLUXO: QUERY")
    assert lines[5] == "VOLUME: 7 pkts fwd (1.0KB) | 3 pkts bwd (0 B)"
    assert lines[6] == "TAMANHO PKT: min=64, max=512, média=200 bytes"
    assert lines[7] == "FLAGS TCP: SYN=1, FIN=1, ACK=5"
    assert lines[8] == "JANELA TCP: fwd=65535 — janela ampla (TCP scaling — host moderno)"
    assert "ECE" not in text and "ICMP" in other and "ECE=2" in other and "JANELA" not in other


def test_unsw_text(spark):
    schema = ("dataset_source string, proto int, service int, state int, dur double, sbytes int, dbytes int, Spkts int, "
              "Sload double, Dload double, smeansz int, sttl int, dttl int")
    text = texts(spark, [(D.UNSW, 6, 4, 1, 0.5, 2048, 512, 8, 32768.0, 8192.0, 256, 64, 128)], schema)[0]
    lines = text.split("\n")
    assert lines[1] == "SERVIÇO: HTTP | ESTADO: FIN (encerrado) (conexão fechou normalmente)"
    assert lines[2].startswith("DURAÇÃO: SHORT (500.0ms")
    assert lines[3].startswith("TAXA DE PACOTES: MODERADA (16.0")
    assert lines[4].startswith("TAXA DE BYTES: BAIXA (5.1K")
    assert lines[5].startswith("FORMA DO FLUXO: UNIDIRECIONAL")
    assert "BPS: src=32.8K, dst=8.2K" in lines
    assert "TAMANHO MÉDIO PKT: src=256B, dst=0B" in lines
    assert "TTL: src=64, dst=128 — TTL típico Linux" in lines


def test_generic_text(spark):
    text = texts(spark, [(1.5, 100, 0, None, "Benign")], "col_a double, col_b int, zero int, gap string, label string")[0]
    assert text == "Registro de tráfego de rede com características: col_a=1.500, col_b=100."


def test_generic_text_stops_at_fifteen(spark):
    text = texts(spark, [tuple(range(1, 21))], ", ".join(f"c{i:02d} int" for i in range(20)))[0]
    assert "c14=15." in text and "c15" not in text


@pytest.mark.parametrize("value,expected", [
    (None, "0s"), (0.0, "0s"), (0.0000005, "0μs"), (0.0005, "500μs"), (0.25, "250.0ms"), (59.999, "60.00s"), (90.0, "1.5min"), (7200.0, "2.0h")])
def test_time(spark, value, expected):
    assert spark.range(1).select(X.format_time(F.lit(value).cast("double"))).first()[0] == expected


@pytest.mark.parametrize("value,expected", [
    (0.0, "0 B"), (512.0, "512B"), (1024.0, "1.0KB"), (1.5 * 1024**2, "1.5MB"), (3 * 1024**3, "3.00GB")])
def test_bytes(spark, value, expected):
    assert spark.range(1).select(X.format_bytes(F.lit(float(value)))).first()[0] == expected


def test_fixed_rounds_like_printf(spark):
    values = [0.05, 0.15, 0.25, 0.35, 2.5, 1.005, 2.675, 123456.45, 999.95, 0.5, 1.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(X.fixed(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_counts_and_rates(spark):
    row = spark.range(1).select(
        X.format_count(F.lit(1234567)), X.format_count(F.lit(None).cast("int")), X.format_rate(F.lit(1500.0)),
        X.format_rate(F.lit(2.5e6)), X.format_rate(F.lit(3e9)), X.format_rate(F.lit(-1.0))).first()
    assert tuple(row) == ("1.234.567", "0", "1.5K", "2.5M", "3.00G", "0")


def test_no_row_leaves_the_jvm_or_moves(spark):
    df = describe(spark.createDataFrame([(D.CIC, 1.0)], "dataset_source string, `Flow Duration` double"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
