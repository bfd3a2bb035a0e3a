"""Allocation, parties, reports, services, sessions and batches on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargoledger.operators import allocation, batch, parties, services, sessions, tariff
from cargoledger.plans import reports, shipment
from cargoledger.schemas import BL, INVOICE
from cargoledger.sources import answers, files

ITEMS = "shipment_id long, invoice_idx long, item_idx long, quantity double, unit_price double, total_price double"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEMS)


def test_freight_by_shipment_and_by_invoice(spark):
    df = items(spark, (1, 0, 0, 1.0, 1.0, 100.0), (1, 0, 1, 3.0, 100.0, None), (1, 1, 0, 1.0, 1.0, 100.0))
    bl = spark.createDataFrame([(1, 60.0)], "shipment_id long, freight_cost double")
    got = allocation.allocate_by_shipment(df, bl).orderBy("invoice_idx", "item_idx").collect()
    # The stated total is 200; the middle line falls back to 300, so shares sum to more than 1.
    assert [r["fob_value"] for r in got] == [100.0, 300.0, 100.0]
    assert [r["freight_proportional"] for r in got] == [30.0, 90.0, 30.0]
    assert [r["insurance_calculated"] for r in got] == [1.5, 4.5, 1.5]
    assert [r["cif_value_corrected"] for r in got] == [131.5, 394.5, 131.5]
    got = allocation.allocate_by_invoice(df, bl).orderBy("invoice_idx", "item_idx").collect()
    assert [(r["fob_value"], r["freight_proportional"]) for r in got] == [(100.0, 60.0), (0.0, 0.0), (100.0, 60.0)]


def test_totals_fall_back_to_computed_values(spark):
    df = items(spark, (1, 0, 0, 2.0, 5.0, 0.0), (1, 0, 1, 1.0, 30.0, None), (2, 0, 0, None, 5.0, None))
    bl = spark.createDataFrame([(1, 8.0), (2, 8.0)], "shipment_id long, freight_cost double")
    got = {(r["shipment_id"], r["item_idx"]): r["freight_proportional"]
           for r in allocation.allocate_by_shipment(df, bl).collect()}
    assert got == {(1, 0): 2.0, (1, 1): 6.0, (2, 0): 0.0}


def test_failed_papers_gate_a_shipment(spark):
    df = items(spark, (1, 0, 0, 1.0, 1.0, 10.0), (2, 0, 0, 1.0, 1.0, 10.0), (3, 0, 0, 1.0, 1.0, 10.0))
    bl = spark.createDataFrame([(1, 5.0, None), (2, 5.0, "roto"), (3, 5.0, None)],
                               "shipment_id long, freight_cost double, error string")
    invoices = spark.createDataFrame([(1, 0, None), (1, 1, "roto"), (2, 0, None), (3, 0, None)],
                                     "shipment_id long, invoice_idx long, error string")
    got = {r["shipment_id"]: r["cif_value_corrected"]
           for r in allocation.allocate_by_shipment(df, bl, invoices).collect()}
    assert got == {1: None, 3: 15.15}


def test_shipment_totals(spark):
    df = spark.createDataFrame([(1, 0.1, 1.0), (1, 0.2, 2.0)], "shipment_id long, fob_value double, freight_proportional double")
    r = allocation.shipment_totals(df).first()
    assert (r["fob"], r["freight"]) == (0.3, 3.0)
    assert r["cif"] == pytest.approx(0.3 + 3 + 0.0045)


PARTY = "struct<name:string,address:string,phone:string>"


def test_party_merge(spark):
    df = spark.createDataFrame(
        [(0, ("BL co", "long address", "1"), ("Inv co", "short", None)), (1, ("", None, ""), None),
         (2, ("BL co", " abc ", None), ("", "abc", "9"))],
        f"i int, b {PARTY}, v {PARTY}",
    )
    got = [tuple(r[1]) for r in df.select("i", parties.merge_party(F.col("b"), F.col("v"))).orderBy("i").collect()]
    assert got == [("Inv co", "long address", "1"), ("No detectado",) * 3, ("BL co", "abc", "9")]


def test_fob_cif_completion(spark):
    df = spark.createDataFrame([(0, "FOB", 100.0), (1, "CIF", 203.0), (2, "DAP", 5.0), (3, "FOB", None)],
                               "i int, t string, v double")
    fob, cif = allocation.complete_fob_cif(F.col("t"), F.col("v"), F.lit(10.0))
    got = [(r[1], r[2]) for r in df.select("i", fob, cif).orderBy("i").collect()]
    assert got == [(100.0, 111.5), (pytest.approx(190.0), 203.0), (None, None), (None, None)]


def test_catalog_merge_keeps_first_position_and_last_code(spark):
    upload = spark.createDataFrame(
        [(0, " Blusa  para DAMA", "1"), (1, "zapato", "2"), (2, "Zapato ", "3"), (3, " ", "4"), (4, "x", "PENDIENTE"),
         (5, "y", None)], "pos long, desc string, arancel string")
    merged = tariff.merge_catalog(tariff.default_catalog(spark), tariff.usable_entries(upload))
    rows = [(tuple(r["pos"]), r["key"], r["code"]) for r in merged.orderBy("pos").collect()]
    assert rows == [((0, 0, -2), "blusa para dama", "1"), ((0, 0, -1), "calzado para dama", "6404.19.90.00.00"),
                    ((1, 0, 1), "zapato", "3")]
    first = spark.createDataFrame([(5, "a", "X"), (9, "b", "old")], "pos long, key string, code string")
    second = spark.createDataFrame([(1, 3, "a", "Y"), (0, 7, "a", "Z")], "load long, pos long, key string, code string")
    later = tariff.merge_catalog(first, second).orderBy("pos").collect()
    assert [(tuple(r["pos"]), r["key"], r["code"]) for r in later] == [((0, 0, 5), "a", "Y"), ((0, 0, 9), "b", "old")]
    assert tariff.usable_entries(upload.drop("arancel")).count() == 0


def test_header_match(spark):
    rows = [(1, 0, "Código"), (1, 1, "Nombre del artículo"), (1, 2, "Producto item"), (2, 0, "x"),
            (3, 0, "Posicion Arancelaria"), (3, 1, "posicion arancel codigo")]
    got = {(r["file_id"], r["target"][:3]): r["col_name"]
           for r in tariff.match_headers(spark.createDataFrame(rows, "file_id int, col_pos int, col_name string")).collect()}
    assert got == {(1, "Des"): "Nombre del artículo", (1, "Pos"): "Código", (2, "Des"): None, (2, "Pos"): None,
                   (3, "Des"): None, (3, "Pos"): "Posicion Arancelaria"}


def test_templates(spark):
    docs = spark.createDataFrame([(1, "BL", "10", "4", "100", "x"), (2, "BM", "0", None, "5", "7")],
                                 "doc_id int, numero_bl string, kilos string, valor_flete string, valor_cif string, valor_fob string")
    got = reports.template_data(docs, "logistica").orderBy("doc_id").collect()
    assert [r["Costo Flete por Kilo"] for r in got] == [0.4, 0.0]
    assert got[0]["Bultos (Total)"] is None
    unknown = reports.template_data(docs, "otra").orderBy("doc_id").collect()
    assert [r["Costo Total Flete/Seguro"] for r in unknown] == [0.0, -2.0]
    totals = reports.template_totals(docs).first()
    assert (totals["n_documents"], totals["kilos"], totals["freight_per_kilo"]) == (2, 10.0, 0.4)
    assert reports.template_notice(docs).count() == 0
    assert reports.template_notice(docs.where("false")).first()[0] == "No hay datos para esta plantilla."


def test_service_invoice(spark):
    """The one example with published inputs: subtotal 100, tax 15, total 115."""
    chosen = spark.createDataFrame(
        [(1, {"Servicio de Trámite Aduanal": (1, 100.0)})],
        "invoice_id int, selected map<string, struct<quantity:int, price:double>>")
    clients = spark.createDataFrame(
        [(1, "Test Client", "1234567890", "Test Address", None, None, "BL-TEST-001")],
        "invoice_id int, cliente_preview string, rtn_preview string, direccion_preview string, consignee_name string, "
        "consignee_address string, bl_number string")
    lines = services.explode_selection(chosen)
    r = services.service_invoices(clients, lines, dt.date(2024, 1, 31), "invoice_id").first()
    assert (r["subtotal"], r["isv"], r["total_pagar"]) == (100.0, 15.0, 115.0)
    assert (r["cliente"], r["rtn"], r["bl_number"]) == ("Test Client", "1234567890", "BL-TEST-001")
    assert (r["fecha"], r["fecha_vencimiento"]) == ("31 de January de 2024", "29 de February de 2024")
    assert [i["codigo"] for i in r["items"]] == ["SERV-001"]


def test_service_lines_default(spark):
    lines = spark.createDataFrame([(1, 0, "Otro", None, 3.0)],
                                  "invoice_id int, line_no int, descripcion string, quantity double, price double")
    r = services.invoice_lines(lines).first()
    assert (r["codigo"], r["cantidad"], r["total"]) == ("GEN-001", 1.0, 3.0)


def test_answers(spark):
    texts = [
        '```json\n{"bl_number": "B1", "freight_cost": "12.5", "packages_count": 3, "exporter": {"name": "E"}}\n```',
        'x {"bl_number": "B2"} y',
        '{"exporter": {"name": "E"}, "bl_number": "B3"}',
        "nada",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "shipment_id int, text string")
    got = answers.typed_bl(df).orderBy("shipment_id").collect()
    assert (got[0]["freight_cost"], got[0]["packages_count"], got[0]["exporter"]["name"]) == (12.5, 3, "E")
    assert [r["bl_number"] for r in got] == ["B1", "B2", None, None, None]
    assert [r["error"] for r in got[:3]] == [None, None, "JSON mal formado en la respuesta de la IA."]
    assert got[3]["error"] == "La IA no devolvió un JSON. Respuesta recibida: nada..."
    assert len(BL.fields) == 15 and len(INVOICE.fields) == 8


def test_invoice_items(spark):
    text = '```json\n{"incoterm": "FOB", "items": [{"description": "a", "quantity": 2}, {"description": "b"}]}\n```'
    df = spark.createDataFrame([(1, 0, text), (1, 1, "no")], "shipment_id int, invoice_idx int, text string")
    got = answers.invoice_items(answers.typed_invoices(df)).orderBy("item_idx").collect()
    assert [(r["item_idx"], r["description"], r["quantity"]) for r in got] == [(0, "a", 2.0), (1, "b", None)]


def test_pages_and_routing(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (1, 3, "c" * 151), (2, 1, " ")],
                                  "doc_id int, page_no int, text string")
    texts = files.assemble_pages(pages)
    got = {r["doc_id"]: (r["text"], r["mode"]) for r in files.route_extraction(texts).collect()}
    assert got == {1: ("\nb\n" + "c" * 151, "text"), 2: (" ", "image")}
    parts = files.assemble_pages(pages, span=2).where("doc_id = 1").orderBy("part_no").collect()
    assert "\n".join(p["text"] for p in parts) == got[1][0]


def test_scan_documents(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    checked = files.check_files(files.scan_documents(spark, str(tmp_path))).orderBy("name").collect()
    assert [(r["name"], r["length"], r["check"]["valid"], r["file_type"]) for r in checked] == [
        ("a.PDF", 5, True, "pdf"), ("b.txt", 1, False, "image")]


def test_batches(spark):
    ts = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame(
        [(1, "completed", 4, 3, 1, ts, ts + dt.timedelta(seconds=90)), (2, "running", 2, 0, 1, ts, None),
         (3, "pending", 0, 0, 0, None, None)],
        "job_id int, status string, total_files long, processed_files long, failed_files long, start_time timestamp, end_time timestamp")
    totals = batch.batch_totals(jobs).first()
    assert (totals["n_jobs"], totals["total_files"], totals["success_rate"], totals["files_per_job"]) == (3, 6, 50.0, 2.0)
    metrics = batch.time_metrics(jobs).first()
    assert (metrics["n_jobs"], metrics["seconds_per_file"], metrics["minutes_per_job"]) == (1, 30.0, 1.5)
    assert batch.time_metrics(jobs.where("job_id > 1")).count() == 0
    progress = {r["job_id"]: (r["progress_percentage"], r["remaining"]) for r in batch.job_progress(jobs).collect()}
    assert progress == {1: (100.0, 0), 2: (50.0, 1), 3: (0.0, 0)}
    assert [r["job_id"] for r in batch.latest_first(jobs).collect()] == [1, 2, 3]
    assert batch.jobs_with_status(jobs, "running").count() == 1


def test_job_files(spark):
    rows = [(1, i, f"f{i}.pdf", 10, i % 2 == 0, None if i % 4 else "x") for i in range(120)]
    job_files = spark.createDataFrame(rows, "job_id int, file_index long, filename string, size long, success boolean, error string")
    failed = batch.job_errors(job_files).orderBy("file_index").collect()
    assert [r["file_index"] for r in failed] == list(range(1, 120, 2)) and failed[0]["error"] == "Unknown error"
    shown = batch.first_with_rest(job_files, "job_id", "file_index", 10).orderBy("file_index").collect()
    assert [r["file_index"] for r in shown] == list(range(10)) and {r["n_more"] for r in shown} == {110}
    up = batch.upload_summary(job_files).first()
    assert (up["n_files"], up["minutes_low"], up["minutes_high"]) == (120, 20.0, 60.0)


def working_set(spark):
    return spark.createDataFrame(
        [("a", 0, "B0", "mal", '{"x": 1}', None), ("a", 1, None, None, '{"x": 2}', None),
         ("b", 0, "B9", "mal", '{"x": 3}', '{"y": 4}'), ("c", 0, None, None, '"no"', None)],
        "session_name string, document_index long, bl_number string, error string, original_data string, edited_data string",
    ).withColumn("user_notes", F.lit("n")).withColumn("set_id", F.col("session_name"))


def test_save_load_and_delete_sessions(spark, tmp_path):
    now = F.lit(dt.datetime(2024, 1, 2, 3, 4, 5)).cast("timestamp_ntz")
    saved = sessions.build_sessions(working_set(spark), now)
    sessions.append_sessions(*saved, str(tmp_path))
    again = F.lit(dt.datetime(2024, 1, 2, 3, 4, 6)).cast("timestamp_ntz")
    sessions.append_sessions(*sessions.build_sessions(
        working_set(spark).withColumn("session_name", F.concat("session_name", F.lit("2"))), again), str(tmp_path))
    table, documents = sessions.read_sessions(spark, str(tmp_path))
    assert (table.count(), documents.count()) == (6, 8)
    rows = {r["session_name"]: r for r in table.collect()}
    assert [rows[k]["documents_with_errors"] for k in "abc"] == [1, 0, 0]
    names = {(r["session_id"], r["document_index"]): r for r in documents.collect()}
    a = rows["a"]["id"]
    assert (names[(a, 1)]["filename"], names[(a, 1)]["error_count"]) == ("Documento_2", 1)
    assert names[(rows["b"]["id"], 0)]["validation_status"] == "edited"
    loaded = {r["session_name"]: r["payload"] for r in sessions.load_sessions(table, documents).collect()}
    assert loaded["a"] == '{"bl_data": {"x": 1}, "all_invoices_data": []}'
    assert loaded["b"] == '{"y": 4}'
    assert loaded["c"] == '{"bl_data": {}, "all_invoices_data": []}'
    kept, left = sessions.delete_sessions(table, documents, spark.createDataFrame([(a,)], "id string"))
    assert (kept.count(), left.count()) == (5, 6)
    assert sessions.orphan_documents(kept, documents).count() == 2
    meta = sessions.with_metadata(table).where("session_name = 'b'").first()["metadata"]
    assert (meta["edited_count"], meta["consolidated_flow"], meta["timestamp"]) == ("1", "true", "2024-01-02T03:04:05")


def test_a_save_is_all_or_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    at = lambda second: F.lit(dt.datetime(2024, 1, 2, 3, 4, second)).cast("timestamp_ntz")
    first, second = (sessions.build_sessions(working_set(spark), at(s)) for s in (5, 6))

    def seen():
        return tuple(df.count() for df in sessions.saved_sessions(spark, folder))

    assert sessions.save_sessions(*first, folder, "one") and seen() == (3, 4)
    # A job that fails between the two tables, and one that stops before it is published.
    broken = second[0].withColumn("user_notes", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        sessions.save_sessions(broken, second[1], folder, "two")
    assert seen() == (3, 4)
    left = sessions.stage_sessions(*second, folder, "two")
    assert seen() == (3, 4)
    assert sessions.save_sessions(*second, folder, "two") and seen() == (6, 8)
    # Repeats add nothing, not even two attempts that are both published.
    assert not sessions.save_sessions(*second, folder, "two")
    sessions.publish_save(spark, folder, "two", left)
    assert seen() == (6, 8)
    table, documents = sessions.saved_sessions(spark, folder)
    assert sessions.orphan_documents(table, documents).count() == 0
    assert sorted(table.columns) == sorted(first[0].columns)


def test_session_statistics(spark):
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("1", ts, 4, 1, "completed"), ("2", ts + dt.timedelta(days=5), 2, 0, "otro")],
        "id string, created_at timestamp, total_documents long, documents_with_errors long, processing_status string")
    r = sessions.statistics(df, F.lit(dt.date(2024, 2, 1))).first()
    assert (r["total_sessions"], r["avg_documents_per_session"], r["recent_sessions"]) == (2, 3.0, 1)
    assert r["error_rate"] == pytest.approx(100 / 6)
    none = sessions.statistics(df.where("false"), F.lit(dt.date(2024, 2, 1))).first()
    assert (none["total_documents_processed"], none["error_rate"], none["last_session_date"]) == (0, 0.0, None)
    names = {r["processing_status"]: r["name"] for r in sessions.status_distribution(df).collect()}
    assert names == {"completed": "Completado", "otro": "otro"}


def test_mapped_entries(spark):
    headers = spark.createDataFrame([(1, 0, "Producto"), (1, 1, "Partida"), (2, 0, "x"), (2, 1, "Partida")],
                                    "file_id int, col_pos int, col_name string")
    cells = spark.createDataFrame(
        [(1, 0, 10, {"Producto": "Zapato", "Partida": "64"}), (1, 1, 11, {"Producto": "Blusa", "Partida": None}),
         (2, 0, 20, {"x": "Gorra", "Partida": "65"})],
        "file_id int, row_no int, pos long, cells map<string,string>")
    assert [tuple(r) for r in tariff.mapped_entries(cells, headers).collect()] == [(1, 10, "zapato", "64")]


def test_process_documents(spark, tmp_path):
    """Answers in, priced items and reports out."""
    fence = "```json\n%s\n```"
    bl = [(1, '{"bl_number": "B1", "freight_cost": 10, "exporter": {"name": "E", "address": "far away"}}'),
          (2, '{"bl_number": "B2", "freight_cost": 10}'), (3, "nada")]
    good = '{"invoice_number": "I", "exporter": {"name": "X"}, "items": [{"description": "Red Ring", "total_price": 100, ' \
           '"quantity": 1, "unit_price": 100}]}'
    invoices = [(1, 0, fence % good), (2, 0, fence % good), (2, 1, "nada"), (3, 0, fence % good)]
    glossary = spark.createDataFrame([("red ring", ' "anillo rojo" ')], "key string, text_es string")
    out = shipment.process_documents(
        spark.createDataFrame([(i, t if t == "nada" else fence % t) for i, t in bl], "shipment_id long, text string"),
        spark.createDataFrame(invoices, "shipment_id long, invoice_idx long, text string"),
        glossary,
    )
    items = {r["shipment_id"]: r for r in out.items.collect()}
    assert set(items) == {1, 2}
    assert (items[1]["description"], items[1]["description_original"], items[1]["cif_value_corrected"]) == (
        "anillo rojo", "Red Ring", 111.5)
    assert (items[2]["description"], items[2]["description_es"], items[2]["fob_value"]) == ("Red Ring", None, None)
    parties_of = {r["shipment_id"]: r["exporter_details"] for r in out.bl.collect()}
    assert tuple(parties_of[1]) == ("X", "far away", "No detectado") and parties_of[2] is None
    catalog = spark.createDataFrame([(0, "anillo", "7113")], "pos long, key string, code string")
    typed = answers.invoice_items(answers.typed_invoices(
        spark.createDataFrame(invoices, "shipment_id long, invoice_idx long, text string")))
    report = reports.final_report(typed, out.bl, out.invoices.select("shipment_id", "invoice_idx", "invoice_number",
                                                                  "invoice_date", "error"), glossary, catalog)
    reports.write_report(report, str(tmp_path / "book"))
    aforo = {r["shipment_id"]: r for r in spark.read.parquet(str(tmp_path / "book" / "aforo")).collect()}
    assert (aforo[1]["Posicion Arancelaria"], aforo[1]["Contenido"], aforo[1]["CIF"]) == ("7113", "anillo rojo", 111.5)
    assert (aforo[2]["Posicion Arancelaria"], aforo[2]["Contenido"], aforo[2]["Fob"]) == ("PENDIENTE", "Red Ring", None)
    summary = spark.read.parquet(str(tmp_path / "book" / "resumen_factura")).where("shipment_id = 1")
    assert [r["value"] for r in summary.orderBy("pos").collect()][-4:] == ["100.0", "10.0", "1.5", "111.5"]


def gated(spark):
    party = "struct<name:string,address:string,phone:string>"
    bl = spark.createDataFrame(
        [(i, f"B{i}", 10.0, 1, 2.0, "c", None, None, "mal" if i == 2 else None) for i in (1, 2, 3, 4, 5)],
        f"shipment_id long, bl_number string, freight_cost double, packages_count long, gross_weight double, container_no string, "
        f"exporter {party}, consignee {party}, error string",
    ).selectExpr("*", "'a' AS booking_number", "'b' AS port_of_loading", "'c' AS port_of_discharge", "'d' AS cargo_type")
    invoices = spark.createDataFrame(
        [(1, 0, None), (1, 1, "mal"), (2, 0, None), (3, 0, "mal"), (3, 1, None), (4, 0, None)],
        "shipment_id long, invoice_idx long, error string",
    ).selectExpr(
        "*", "'FOB' AS incoterm", "100.0D AS total_value", "'USD' AS currency", "'n' AS invoice_number", "'d' AS invoice_date",
        "named_struct('name', 'x', 'address', 'y', 'phone', 'z') AS exporter",
    )
    items = spark.createDataFrame([(s, i, 0, 10.0, 1.0, 10.0) for s, i in [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (4, 0)]],
                                  "shipment_id long, invoice_idx long, item_idx long, total_price double, quantity double, unit_price double")
    return bl, invoices, items


def test_failed_papers_stop_before_form_and_reports(spark):
    bl, invoices, items = gated(spark)
    ids = lambda df: {r["shipment_id"] for r in df.collect()}
    open_bl = parties.bl_parties(bl, invoices)
    assert ids(open_bl) == {1, 4, 5}
    assert ids(parties.editable_bl(open_bl)) == {1, 4, 5}
    assert ids(parties.consolidated_documents(open_bl, invoices)) == {1, 4}
    assert ids(allocation.allocate_by_invoice(items, bl, invoices)) == {1, 4}
    summary = reports.invoice_summary(allocation.allocate_by_invoice(items, bl, invoices), open_bl, invoices)
    assert ids(summary) == {1, 4, 5}
    docs = parties.consolidated_documents(open_bl, invoices)
    assert ids(reports.template_data(docs, "comercial")) == {1, 4}
    assert reports.template_totals(docs).first()["n_documents"] == 2
    names = {r["shipment_id"]: r["exporter_details"] for r in open_bl.collect()}
    assert names[4]["name"] == "x" and names[1] is None
    assert ids(parties.editable_invoices(allocation.admitted_rows(invoices, bl, invoices, ["invoice_idx"]))) == {1, 4}
    assert ids(parties.assemble_shipments(bl, invoices, items)) == {1, 4, 5}
    named = items.selectExpr("*", "'Red Ring' AS description", "'P' AS part_number")
    glossary = spark.createDataFrame([("red ring", "anillo rojo")], "key string, text_es string")
    reported = reports.reported_items(named, bl, invoices, glossary, slice_rows=1)
    told = {(r["shipment_id"], r["invoice_idx"]): tuple(r)[3:] for r in reports.translation(reported).collect()}
    assert told == {(1, 0): ("", ""), (1, 1): ("", ""), (4, 0): ("Red Ring", "anillo rojo")}
    assert {r["DESCRIPCION COMERCIAL"] for r in reports.deva(reported).where("shipment_id = 1").collect()} == {""}
    catalog = spark.createDataFrame([(0, "anillo", "7113")], "pos long, key string, code string")
    for level in ("shipment", "invoice"):
        book = reports.final_report(named, bl.withColumn("exporter_details", F.col("exporter")), invoices, glossary, catalog, level=level)
        for name in ("aforo", "listado_deva", "traduccion"):
            assert ids(book[name]) == {1, 4}
        assert ids(book["resumen_factura"]) == {1, 4, 5}


def test_forms_and_item_tables_replace_what_they_edit(spark):
    bl, invoices, items = gated(spark)
    form = spark.createDataFrame([(1, 0, None, "N", "D", "EUR", 5.0)],
                                 "shipment_id long, invoice_idx long, incoterm string, invoice_number string, invoice_date string, "
                                 "currency string, total_value double")
    rows = {(r["shipment_id"], r["invoice_idx"]): r for r in parties.overlay_form(
        invoices, form, ["shipment_id", "invoice_idx"], parties.INVOICE_FORM).collect()}
    assert (rows[1, 0]["incoterm"], rows[1, 0]["currency"], rows[1, 1]["currency"]) == (None, "EUR", "USD") and len(rows) == 6
    table = spark.createDataFrame([(1, 0, 7, 1.0, 1.0, 1.0)], items.schema)
    assert [r["item_idx"] for r in parties.replace_items(items, table).where("shipment_id = 1 AND invoice_idx = 0").collect()] == [7]


def test_the_reference_service_invoice(spark):
    lines = services.invoice_lines(spark.createDataFrame(
        [(1, 0, "Servicio de Trámite Aduanal", 1.0, 100.0)],
        "invoice_id long, line_no long, descripcion string, quantity double, price double"))
    total = services.invoice_totals(lines, "invoice_id").first()
    assert (total["subtotal"], total["isv"], total["total_pagar"]) == (100.0, 15.0, 115.0)


def test_catalog_files_from_upload_to_merge(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Código,Descripción del producto\n1.1,Zapato\n1.2,blusa para dama\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Producto,Posicion_Arancelaria,Nota\nbolsa,2.1,x\n ZAPATO ,2.2,y\nnada,,z\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("uno,dos\nzapato,3.3\n", encoding="utf-8")
    cells, headers = files.read_catalog_files(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")])
    merged = tariff.merge_catalog(tariff.default_catalog(spark), tariff.mapped_entries(cells, headers)).orderBy("pos")
    assert [(r["key"], r["code"]) for r in merged.collect()] == [
        ("blusa para dama", "1.2"), ("calzado para dama", "6404.19.90.00.00"), ("zapato", "2.2"), ("bolsa", "2.1")]
