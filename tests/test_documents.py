"""Validation rules, fixes and quality analysis on hand-made documents."""

from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.operators import quality, rules
from cargoledger.plans import reports

GOOD = {
    "numero_bl": "BL-1",
    "exportador": "Acme",
    "consignatario": "Importadora",
    "valor_flete": "100",
    "bultos": "5",
    "kilos": "12,5",
    "numero_contenedor": "ABCD1234567",
    "incoterm": "FOB",
    "valor_factura": "1.234,56",
    "valor_fob": "1000",
    "valor_cif": "1150",
    "moneda": "USD",
}
SCHEMA = (
    "doc_id long, metodo_procesamiento string, tipo_documento string, errores array<string>, "
    "conversion_fob_cif boolean, " + ", ".join(f"{f} string" for f in rules.FIELDS)
)


def docs(spark, *changes, **common):
    rows = []
    for i, change in enumerate(changes):
        row = {"doc_id": i, "metodo_procesamiento": "texto_extraido", "tipo_documento": "BL", "errores": None,
               "conversion_fob_cif": False, **GOOD, **common, **change}
        rows.append(tuple(row[k.split()[0]] for k in SCHEMA.split(", ")))
    return spark.createDataFrame(rows, SCHEMA)


def errors(df):
    rows = quality.error_list(df).orderBy("doc_id", "seq").collect()
    return [(r["doc_id"], r["severity"], r["field"], r["message"]) for r in rows]


def messages(spark, field, *values):
    rows = rules.field_results(docs(spark, *[{field: v} for v in values])).where(F.col("field") == field)
    return [(r["valid"], r["value"], r["messages"]) for r in rows.orderBy("doc_id").collect()]


def test_good_document_is_valid(spark):
    row = rules.document_summary(docs(spark, {})).first()
    assert (row["valid"], row["valid_fields"], row["invalid_fields"], row["completion_rate"]) == (True, 12, 0, 100.0)
    assert row["error_messages"] == []


def test_missing_markers(spark):
    needed = [(False, "No detectado", ["Campo obligatorio: Número de BL"])]
    assert messages(spark, "numero_bl", None, "", "  ", "No detectado", "None", " null ") == needed * 6
    assert messages(spark, "moneda", None, "null") == [(True, "No detectado", [])] * 2


def test_text_rules(spark):
    wrong = ["Formato inválido: Formato: Letras mayúsculas, números y guiones"]
    assert messages(spark, "numero_bl", " BL-9 ", "bl-9") == [(True, "BL-9", []), (False, "bl-9", wrong)]
    assert messages(spark, "exportador", "X") == [(False, "X", ["Mínimo 2 caracteres"])]
    box = ["Formato inválido: Formato: 4 letras + 7 números (ej: ABCD1234567)"]
    assert messages(spark, "numero_contenedor", "ABCD-123456-7") == [(False, "ABCD-123456-7", box)]


def test_number_and_option_rules(spark):
    assert messages(spark, "bultos", "5", "12,5", "0") == [
        (True, "5", []), (False, "0", ["Valor mínimo: 1"]), (False, "0", ["Valor mínimo: 1"])]
    assert messages(spark, "kilos", "0.05", "abc") == [
        (False, "0.05", ["Valor mínimo: 0.1"]), (False, "0.0", ["Valor mínimo: 0.1"])]
    assert messages(spark, "valor_fob", "-3", "x") == [(False, "-3.0", ["Valor mínimo: 0"]), (True, "0.0", [])]
    options = "Debe seleccionar una opción válida: FOB, CIF, EXW, CFR, DAP, DDP"
    assert messages(spark, "incoterm", "fob", " CIF ") == [(False, "fob", [options]), (True, " CIF ", [])]


def test_rules_are_data(spark):
    own = [("nota", "Nota", "text", True, {"min_length": 3, "pattern": "^[a-z]+$"}, "minúsculas")]
    df = spark.createDataFrame([(1, "A"), (2, "abc"), (3, None)], "doc_id long, nota string")
    got = [(r["valid"], r["messages"]) for r in rules.field_results(df, own).orderBy("doc_id").collect()]
    assert got == [(False, ["Mínimo 3 caracteres", "Formato inválido: minúsculas"]), (True, []),
                   (False, ["Campo obligatorio: Nota"])]


def test_validation_report_and_common_errors(spark):
    df = docs(spark, {}, {"moneda": "XXX", "exportador": "X"}, {"moneda": None, "exportador": "Y"})
    report = {r["field"]: r for r in rules.validation_report(df).collect()}
    assert (report["moneda"]["total"], report["moneda"]["valid"], report["moneda"]["detected"]) == (3, 2, 2)
    assert report["moneda"]["valid_documents"] == 1
    top = rules.common_errors(df).first()
    assert (top["message"], top["n"]) == ("Exportador: Mínimo 2 caracteres", 2)


def test_auto_fix(spark):
    df = docs(
        spark,
        {"numero_bl": " bl-7 ", "numero_contenedor": "abcd 123456-7", "incoterm": " fob ", "valor_fob": "1.000,00"},
        {"numero_contenedor": "AB1", "incoterm": "zzz", "valor_flete": "n/a", "valor_cif": "5"},
    )
    a, b = rules.auto_fix(df).orderBy("doc_id").collect()
    assert (a["numero_bl"], a["numero_contenedor"], a["incoterm"], a["valor_fob"]) == (
        "BL-7", "ABCD1234567", "FOB", "1000.0")
    assert (a["valor_cif"], a["conversion_fob_cif"]) == ("1150.00", True)
    assert (b["numero_contenedor"], b["incoterm"], b["valor_flete"], b["valor_cif"], b["conversion_fob_cif"]) == (
        "AB1", "zzz", "n/a", "5.0", False)


def test_overlay_edits(spark):
    df = docs(spark, {"incoterm": "CIF"}, {"incoterm": "FOB"})
    edits = docs(spark, {"incoterm": "FOB", "valor_fob": "200", "moneda": None}).select("doc_id", *rules.FIELDS)
    a, b = rules.overlay_edits(df, edits).orderBy("doc_id").collect()
    assert (a["edited"], a["incoterm"], a["moneda"], a["valor_cif"]) == (True, "FOB", None, "230.00")
    assert (b["edited"], b["valor_cif"], b["conversion_fob_cif"]) == (False, "1150", False)


def test_ocr_errors(spark):
    df = docs(
        spark,
        {"metodo_procesamiento": "fallback", "errores": ["Texto ILEGIBLE", "otro", "baja calidad"]},
        {"numero_bl": None, "exportador": "No detectado"},
    )
    listed = errors(df)
    assert [e[3] for e in listed if e[0] == 0] == [
        "Documento requiere conversión a imagen para procesamiento OCR",
        "Problema de calidad en OCR: Texto ILEGIBLE",
        "Problema de calidad en OCR: baja calidad",
    ]
    assert [e[3] for e in listed if e[0] == 1] == [
        "Múltiples campos críticos no detectados: numero_bl, exportador",
        "Número de BL: Campo obligatorio: Número de BL",
        "Exportador: Campo obligatorio: Exportador",
        "Campos críticos faltantes: Número de BL, Exportador",
    ]


def test_structure_errors(spark):
    empty = {f: None for f in rules.FIELDS}
    df = docs(spark, {"tipo_documento": "PDF_SIN_TEXTO"}, {"valor_fob": None}, {"valor_fob": ""}, empty)
    wanted = quality.error_list(df, ["document_structure"]).orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["severity"]) for r in wanted] == [(0, "high"), (1, "medium"), (3, "critical")]


def test_completeness_errors(spark):
    empty = {f: "No detectado" for f in rules.FIELDS}
    some = {"valor_flete": None, "bultos": "", "kilos": "No detectado"}
    df = docs(spark, some, empty)
    listed = quality.error_list(df, ["data_completeness"]).orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["message"]) for r in listed] == [
        (0, "Múltiples campos importantes faltantes: Valor del Flete, Bultos, Kilos"),
        (1, "Campos críticos faltantes: Número de BL, Exportador, Consignatario"),
        (1, "Múltiples campos importantes faltantes: Valor del Flete, Bultos, Kilos, INCOTERM"),
        (1, "Completitud de datos muy baja: 0.0%"),
    ]


def test_calculation_errors(spark):
    df = docs(
        spark,
        {"valor_fob": "100", "valor_cif": "$1,00"},
        {"valor_fob": "100", "valor_cif": "160"},
        {"valor_fob": "-1", "valor_cif": "10"},
        {"valor_fob": None},
        {"valor_flete": "x", "kilos": "-2"},
        conversion_fob_cif=True, valor_factura="1", kilos="1",
    )
    listed = quality.error_list(df, ["calculation_errors"]).orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["field"], r["severity"]) for r in listed] == [
        (0, "valor_cif", "medium"),
        (1, "conversion_fob_cif", "low"),
        (2, "valor_fob", "medium"),
        (3, "conversion_fob_cif", "medium"),
        (4, "valor_flete", "low"),
        (4, "kilos", "medium"),
    ]
    assert "1.60" in listed[1]["message"]


def test_quality_metrics_agree_with_the_error_list(spark):
    df = docs(spark, {}, {"moneda": "XXX"}, {"numero_bl": None, "exportador": None}, {"tipo_documento": None})
    metrics = quality.quality_metrics(df)
    row = metrics.first()
    listed = quality.error_list(df)
    assert row["total_documents"] == 4 and row["documents_with_errors"] == 3
    assert row["total_errors"] == listed.count()
    by_category = {r["category"]: r["n"] for r in quality.category_counts(metrics).collect()}
    by_severity = {r["severity"]: r["n"] for r in quality.severity_counts(metrics).collect()}
    assert sum(by_category.values()) == sum(by_severity.values()) == row["total_errors"]
    assert by_category["calculation_errors"] == 0
    assert row["error_rate"] == 75.0 and row["success_rate"] == 25.0
    assert row["average_completeness"] == round(46 / 48 * 100, 2)
    counts = {r["doc_id"]: r["n_errors"] for r in quality.errors_by_document(df).collect()}
    assert counts == {r["doc_id"]: r["count"] for r in listed.groupBy("doc_id").count().collect()}


def test_no_documents(spark):
    metrics = quality.quality_metrics(docs(spark, {}).where("false"))
    row = metrics.first()
    assert (row["total_documents"], row["total_errors"], row["error_rate"]) == (0, 0, None)
    assert quality.detection_rates(metrics).count() == 0
    advice = quality.recommendations(metrics).collect()
    assert [a["category"] for a in advice] == ["data_completeness"]
    assert advice[0]["description"] == "Completitud promedio: 0.0%"
    assert [r["value"] for r in reports.quality_overview(metrics).orderBy("pos").collect()] == [0.0] * 5


def test_recommendations_and_labels(spark):
    empty = {f: None for f in rules.FIELDS}
    metrics = quality.quality_metrics(docs(spark, empty, empty, {}))
    advice = quality.recommendations(metrics).collect()
    assert [a["priority"] for a in advice] == ["critical", "high", "medium", "medium"]
    assert advice[1]["description"] == "2 errores relacionados con extracción de texto"
    assert advice[0]["description"] == "Más del 50% de los documentos tienen errores"
    assert {r["label"] for r in quality.detection_rates(metrics).collect()} == {"Necesita Mejora"}
    lines = [r["line"] for r in reports.recommendation_lines(metrics).orderBy("rec_no", "line_no").collect()]
    assert lines[:2] == ["1. Alta tasa de errores detectada", "Prioridad: CRITICAL"]
    assert len(lines) == 4 * 7


def test_unknown_priority_comes_last(spark):
    df = spark.createDataFrame([(0, "x"), (1, "low"), (2, "critical"), (3, "low")], "at int, priority string")
    assert [r["at"] for r in quality.by_priority(df, "at").collect()] == [2, 1, 3, 0]


def test_processing_statistics(spark):
    df = docs(spark, {"moneda": "No detectado"}, {"metodo_procesamiento": None, "incoterm": "CIF"})
    got = {(r["metric"], r["value"]): (r["n"], r["name"]) for r in quality.processing_statistics(df).collect()}
    assert got[("processing_methods", "unknown")] == (1, "Desconocido")
    assert got[("document_types", "BL")] == (2, "Bill of Lading")
    assert ("currencies", "No detectado") not in got and got[("currencies", "USD")] == (1, "USD")


def test_fixed_dimensions_cover_every_error_text():
    categories = {c[0] for c in fv.ERROR_CATEGORIES}
    severities = {s[0] for s in fv.ERROR_SEVERITIES}
    assert all(t[0] in categories and t[1] in severities for t in fv.ERROR_TEXTS.values())


def test_other_field_rules_reach_list_and_metrics(spark):
    df = docs(spark, {"numero_bl": "it's"}, {"numero_bl": "AB"})
    rules = [("numero_bl", "Nº BL", "text", True, {"options": ["it's", "AB\"C"]}, "")]
    listed = quality.error_list(df, ["field_validation"], rules).collect()
    assert [r["field"] for r in listed] == ["numero_bl"] and "it's" in listed[0]["message"]
    metrics = quality.quality_metrics(df, rules).first()
    assert metrics["kind_field_required"] == 1 and metrics["kind_field_optional"] == 0
    assert quality.quality_metrics(df, []).first()["kind_field_required"] == 0
