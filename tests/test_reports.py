"""Whole evaluations, counted by hand."""

from docgrid.operators import evaluate, registers
from pyspark.sql import functions as F


def test_package_report(spark):
    pins = "device string, package string, pin string, name string"
    ours = spark.createDataFrame([("a", "Q", "1", "PA0"), ("a", "Q", "2", "PA1"), ("b", "Q", "1", "VREF"), ("b", "Q", "2", "X"), ("b", "Q", "3", "Y"), ("c", "B", "1", "Z"), ("d", "B", "1", "Z")], pins)
    theirs = spark.createDataFrame([("a", "1", "PA0-WKUP"), ("a", "2", "PA1"), ("a", "49", "VSS"), ("b", "1", "VDDA"), ("b", "2", "W"), ("d", "1", None)], "device string, pin string, name string")
    pads = spark.createDataFrame([("Q", "49")], "package string, pin string")
    pairs = spark.createDataFrame([("VDDA", "VREF")], "a string, b string")
    r = evaluate.package_report(ours, theirs, pads, pairs, spark.createDataFrame([("b",)], "device string")).first()
    # a is right (one name within the other, a pad of its package); b has two faults that were looked into; c is missing; d has one.
    assert (r.total_devices, r.correct_devices, r.validated_devices, r.wrong_devices, r.missing_devices) == (4, 1, 2, 2, 1)
    assert (r.total_pins, r.correct_pins, r.wrong_pins, r.validated_pins, r.correct_pins_pct) == (7, 4, 3, 6, 57.143)
    none = evaluate.package_report(ours.limit(0), theirs, pads, pairs, ours.limit(0)).first()
    assert none.total_devices == 0 and none.total_pins == 0 and none.correct_pins_pct is None


def test_interrupt_report(spark):
    rows = "device string, position int, name string"
    ours = spark.createDataFrame([("a", 1, "TIM1"), ("a", 2, "RTC_ALARM"), ("b", 1, "X"), ("b", 2, "Y"), ("c", 1, "X"), ("h7@m4", 1, "X"), ("wb5", 1, "X")], rows)
    theirs = spark.createDataFrame([("a", 1, "TIM1_UP"), ("a", 2, "EXTI17_RTCALARM"), ("b", 1, "Z")], rows)
    pairs = spark.createDataFrame([("EXTI17_RTCALARM", "RTC_ALARM")], "a string, b string")
    r = evaluate.interrupt_report(ours, theirs, pairs, ["wb"]).first()
    assert (r.total_devices, r.missing_devices, r.correct_devices, r.wrong_devices) == (3, 1, 1, 1)
    assert (r.total_vectors, r.missing_vectors, r.wrong_vectors, r.correct_vectors, r.correct_vectors_pct) == (4, 1, 1, 2, 50.0)


def test_linked_types_by_keys(spark):
    instances = spark.createDataFrame([("TIM1", []), ("UART4", ["9"]), ("UART5", []), ("BKP", []), ("ADC12", ["7", "8"]), ("NONE", None), ("", [])], "name string, sections array<string>")
    types = spark.createDataFrame([("TIM1", "1"), ("TIM", "1"), ("USART", "9"), ("RTC", "3"), ("ADC", "4"), ("ADC", "2"), ("DAC", "8")], "type string, section string")
    found = {(r.name, r.type, r.section, r.level) for r in registers.linked_types(instances, types).collect()}
    assert found == {("TIM1", "TIM1", "1", 0), ("UART4", "USART", "9", 2), ("UART5", "USART", "9", 3), ("BKP", "RTC", "3", 4), ("ADC12", "ADC", "2", 1)}
    assert "NestedLoop" not in registers.linked_types(instances, types)._jdf.queryExecution().executedPlan().toString()


def test_names_of_single_registers(spark):
    r = spark.range(1).select(
        registers.single_register(F.lit("OTG_HS_GCR"), F.lit("OTG")).alias("a"), registers.single_register(F.lit("TIM1_CR1"), F.lit("TIM1")).alias("b"), registers.single_register(F.lit("ADC_SR"), F.lit("ZDC")).alias("c"),
        registers.single_register(F.lit("AFIO_MAPRconnectivitylinedevices"), F.lit("AFIO")).alias("d"), registers.single_register(F.lit("COMP1_CSR"), F.lit("")).alias("e"), registers.chapter_filters(F.lit("x"), F.lit("TIM")).alias("f"),
    ).first()
    assert [tuple(x) for x in (r.a, r.b, r.c, r.d, r.e)] == [("GCR", "OTG_HS", None), ("CR1", None, None), ("SR", "ADC$", None), ("MAPR", None, "STM32F10[57]"), ("COMP1_CSR", None, None)] and r.f == {}
