"""Sample inputs derived from the TPC-H-like test tables.

Every view is one SELECT that Spark and DuckDB read alike; ``{name}`` stands for a base table or
another view. They are projections and plain joins over the whole tables. Positions inside a
group are the tables' own keys rather than computed ranks, so no view gathers a group.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Declared, so that reading a table starts no job to infer it.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Widths that match the sparse positions below: items number up to 7 lines of 10**9 part keys.
ITEM_SPAN = 10**9
INVOICE_SPAN = 64
# Invoices nested in one record: all supplier keys, however many suppliers a table has.
SUPPLIER_SPAN = 2**62

VIEWS = {
    # One BL per order.
    "v_bl": """
SELECT o.o_orderkey AS shipment_id,
  CASE WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE 'BL-' || CAST(o.o_orderkey AS string) END AS bl_number,
  'BK' || CAST(o.o_orderkey AS string) AS booking_number,
  'MSKU' || lpad(CAST(o.o_orderkey % 10000000 AS string), 7, '0') AS container_no,
  'VESSEL ' || CAST(o.o_custkey % 50 AS string) AS vessel_voyage,
  CASE WHEN o.o_orderkey % 43 = 0 THEN NULL ELSE '2024-02-' || lpad(CAST(o.o_orderkey % 28 + 1 AS string), 2, '0') END
    AS date_laden_on_board,
  n.n_name AS port_of_loading, 'PUERTO CORTES' AS port_of_discharge, 'TEGUCIGALPA' AS place_of_delivery,
  o.o_orderpriority AS cargo_type,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(o.o_totalprice / 20) AS double) END AS freight_cost,
  CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE CAST(o.o_orderkey % 500 + 1 AS bigint) END AS packages_count,
  CAST(o.o_orderkey % 900 AS double) + 0.5 AS gross_weight, CAST(o.o_orderkey % 70 AS double) / 4 AS gross_measurement,
  CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE 'Exporter ' || CAST(o.o_orderkey % 100 AS string) END AS exporter_name,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE '  Quay ' || CAST(o.o_orderkey AS string) || ' ' END AS exporter_address,
  CASE WHEN o.o_orderkey % 3 = 0 THEN '' ELSE '+504 ' || CAST(o.o_orderkey AS string) END AS exporter_phone,
  CASE WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE c.c_name END AS consignee_name,
  n.n_name AS consignee_address, CAST(NULL AS string) AS consignee_phone,
  CASE WHEN o.o_orderkey % 89 = 0 THEN 'JSON mal formado en la respuesta de la IA.' END AS error
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    # One invoice per order and supplier.
    "v_invoice": """
SELECT p.shipment_id, p.invoice_idx,
  'INV-' || CAST(p.shipment_id AS string) || '-' || CAST(p.invoice_idx AS string) AS invoice_number,
  CASE WHEN p.invoice_idx % 10 = 9 THEN NULL ELSE '2024-01-' || lpad(CAST(p.shipment_id % 28 + 1 AS string), 2, '0') END
    AS invoice_date,
  CASE p.invoice_idx % 7 WHEN 0 THEN 'FOB' WHEN 1 THEN 'CIF' WHEN 2 THEN 'exw' WHEN 3 THEN 'CFR' WHEN 4 THEN 'DAP'
    WHEN 5 THEN NULL ELSE 'NOT_FOUND' END AS incoterm,
  CASE p.invoice_idx % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN NULL ELSE 'MXN' END AS currency,
  CASE WHEN p.invoice_idx % 11 = 3 THEN NULL ELSE CAST(p.shipment_id % 9000 + 100 AS double) + 0.25 END AS total_value,
  s.s_name AS exporter_name,
  CASE WHEN p.invoice_idx % 5 = 0 THEN NULL ELSE n.n_name || ', Dock ' || CAST(p.invoice_idx AS string) END
    AS exporter_address,
  CASE WHEN p.invoice_idx % 3 = 0 THEN NULL ELSE '+86 ' || CAST(p.invoice_idx AS string) END AS exporter_phone,
  CASE WHEN (p.shipment_id + p.invoice_idx) % 97 = 0 THEN 'La IA no respondió' END AS error
FROM (SELECT DISTINCT l_orderkey AS shipment_id, l_suppkey AS invoice_idx FROM {lineitem}) p
JOIN {supplier} s ON p.invoice_idx = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey""",
    # One item per order line; stated totals are missing on some lines and on all lines of some orders.
    "v_item": """
SELECT l.l_orderkey AS shipment_id, l.l_suppkey AS invoice_idx,
  CAST(l.l_linenumber AS bigint) * 1000000000 + l.l_partkey AS item_idx,
  CASE WHEN p.p_partkey % 31 = 0 THEN NULL ELSE 'P' || CAST(p.p_partkey AS string) END AS part_number,
  CASE WHEN p.p_partkey % 53 = 0 THEN '' WHEN p.p_partkey % 59 = 0 THEN NULL WHEN p.p_partkey % 61 = 0 THEN 'S/M'
    ELSE '  ' || p.p_name END AS description,
  l.l_quantity AS quantity, l.l_extendedprice / l.l_quantity AS unit_price,
  CASE WHEN l.l_orderkey % 23 = 0 OR l.l_linenumber % 5 = 0 THEN 0.0
    WHEN l.l_linenumber = 7 AND l.l_partkey % 3 = 0 THEN NULL ELSE l.l_extendedprice END AS total_price
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    # Catalog uploads: five files whose positions overlap; some names whole, some by their noun, some unusable.
    "v_catalog_upload": """
SELECT p_size % 5 AS file_id, p_partkey AS row_no, p_partkey AS pos,
  CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_name LIKE '%rod' OR p_name LIKE '%anvil' THEN '   '
    WHEN p_name LIKE '%bolt' THEN upper(p_name) || '  '
    WHEN p_name LIKE 'red%' OR p_name LIKE 'old%' THEN substring(p_name, 5) ELSE p_name END AS descr,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'PENDIENTE'
    ELSE p_type || '.' || CAST(p_size AS string) END AS arancel
FROM {part}""",
    # Header texts of catalog files, five columns to a file.
    "v_catalog_header": """
SELECT CAST(floor(c_custkey / 5) AS bigint) AS file_id, c_custkey % 5 AS col_pos,
  CASE (c_custkey * 7 + c_nationkey) % 9 WHEN 0 THEN 'Descripción' WHEN 1 THEN 'PRODUCTO / Item' WHEN 2 THEN 'Código'
    WHEN 3 THEN 'posicion_arancelaria' WHEN 4 THEN 'Partida Arancel' WHEN 5 THEN c_name WHEN 6 THEN 'Nombre del artículo'
    WHEN 7 THEN c_mktsegment ELSE 'Descripcion Producto (Espanol)' END AS col_name
FROM {customer}""",
    # Spanish texts of part names; one name in eight has none, one in nine failed to translate.
    "v_glossary": """
SELECT p_name AS gkey,
  CASE WHEN min(p_partkey) % 9 = 0 THEN 'ERROR_TRADUCCION: ' || p_name
    ELSE ' "*' || replace(replace(replace(replace(replace(replace(p_name, 'red', 'rojo'), 'blue', 'azul'),
      'small', 'pequeño'), 'large', 'grande'), 'ring', 'anillo'), 'plate', 'plato') || '" ' END AS text_es
FROM {part} GROUP BY p_name HAVING min(p_partkey) % 8 <> 0""",
    # Flat documents with defects of every kind.
    "v_doc": """
SELECT o_orderkey AS doc_id, 'doc_' || CAST(o_orderkey AS string) || '.pdf' AS archivo,
  CASE o_orderkey % 6 WHEN 0 THEN 'fallback' WHEN 1 THEN NULL WHEN 2 THEN 'vision_ocr' WHEN 3 THEN 'manual'
    ELSE 'texto_extraido' END AS metodo_procesamiento,
  CASE o_orderkey % 7 WHEN 0 THEN 'PDF_SIN_TEXTO' WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN 'MIXTO'
    WHEN 4 THEN 'FACTURA' ELSE 'BL' END AS tipo_documento,
  CASE o_orderkey % 21 WHEN 0 THEN 'Texto ILEGIBLE|otro' WHEN 1 THEN 'imagen borrosa' WHEN 2 THEN 'Baja CALIDAD|sin texto'
    WHEN 3 THEN 'muy Borroso' END AS errores_txt,
  o_orderkey % 3 = 0 AS conversion_fob_cif,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 13 = 1 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'No detectado'
    WHEN o_orderkey % 13 = 2 THEN 'bl-' || CAST(o_orderkey AS string) || ' ' WHEN o_orderkey % 13 = 3 THEN ''
    ELSE 'BL-' || CAST(o_orderkey AS string) END AS numero_bl,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN 'X'
    WHEN o_orderkey % 11 = 2 THEN 'No detectado' ELSE 'Exportador ' || CAST(o_custkey AS string) END AS exportador,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 7 = 0 THEN 'No detectado' WHEN o_orderkey % 7 = 1 THEN '  '
    ELSE c_name END AS consignatario,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 17 = 1 THEN 'abc'
    WHEN o_orderkey % 17 = 2 THEN '-15.5' WHEN o_orderkey % 17 = 3 THEN '1.234,56' WHEN o_orderkey % 17 = 4 THEN '$ 120'
    ELSE CAST(CAST(floor(o_totalprice / 20) AS bigint) AS string) END AS valor_flete,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 12 = 2 THEN NULL WHEN o_orderkey % 12 = 0 THEN '0'
    WHEN o_orderkey % 12 = 1 THEN '12,5' WHEN o_orderkey % 12 = 3 THEN 'No detectado' WHEN o_orderkey % 12 = 4 THEN '-4'
    ELSE CAST(o_orderkey % 500 + 1 AS string) END AS bultos,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 14 = 3 THEN 'No detectado' WHEN o_orderkey % 14 = 0 THEN '0.05'
    WHEN o_orderkey % 14 = 1 THEN 'abc' WHEN o_orderkey % 14 = 2 THEN NULL WHEN o_orderkey % 14 = 4 THEN '12,5'
    ELSE CAST(o_orderkey % 900 + 1 AS string) || '.5' END AS kilos,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 9 = 2 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'ABCD-123456-7'
    WHEN o_orderkey % 9 = 1 THEN 'ABC123' WHEN o_orderkey % 9 = 3 THEN 'abcd1234567'
    ELSE 'MSKU' || lpad(CAST(o_orderkey % 10000000 AS string), 7, '0') END AS numero_contenedor,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 16 = 2 THEN NULL WHEN o_orderkey % 16 = 0 THEN 'fob'
    WHEN o_orderkey % 16 = 1 THEN 'XXX' WHEN o_orderkey % 16 = 3 THEN 'No detectado' WHEN o_orderkey % 16 = 4 THEN ' cif '
    WHEN o_orderkey % 3 = 0 THEN 'FOB' WHEN o_orderkey % 3 = 1 THEN 'CIF' ELSE 'DAP' END AS incoterm,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 19 = 0 THEN 'No detectado' WHEN o_orderkey % 19 = 1 THEN NULL
    WHEN o_orderkey % 19 = 2 THEN '1,234.56' WHEN o_orderkey % 19 = 3 THEN 'USD 500'
    ELSE CAST(o_totalprice AS string) END AS valor_factura,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 15 = 1 THEN NULL WHEN o_orderkey % 15 = 0 THEN 'No detectado'
    WHEN o_orderkey % 15 = 2 THEN '-10' WHEN o_orderkey % 15 = 3 THEN 'n/a' WHEN o_orderkey % 15 = 4 THEN ''
    ELSE CAST(o_totalprice AS string) END AS valor_fob,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 10 = 0 THEN 'No detectado' WHEN o_orderkey % 10 = 1 THEN NULL
    WHEN o_orderkey % 10 = 2 THEN 'abc' WHEN o_orderkey % 10 = 3 THEN CAST(CAST(floor(o_totalprice * 2) AS bigint) AS string)
    WHEN o_orderkey % 10 = 4 THEN '1' ELSE '$' || CAST(CAST(floor(o_totalprice) + 100 AS bigint) AS string) END AS valor_cif,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 8 = 0 THEN 'No detectado' WHEN o_orderkey % 8 = 1 THEN NULL
    WHEN o_orderkey % 8 = 2 THEN 'usd' WHEN o_orderkey % 8 = 3 THEN 'GBP' WHEN o_orderkey % 5 = 0 THEN 'EUR'
    WHEN o_orderkey % 5 = 1 THEN 'ARS' ELSE 'USD' END AS moneda
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # The same documents with little more than the BL number read.
    "v_doc_poor": """
SELECT doc_id, archivo, metodo_procesamiento, tipo_documento, errores_txt, conversion_fob_cif, numero_bl,
  CASE WHEN doc_id % 3 <> 0 THEN exportador END AS exportador, consignatario,
  CASE WHEN doc_id % 5 = 0 THEN valor_flete END AS valor_flete, CASE WHEN doc_id % 5 = 0 THEN bultos END AS bultos,
  CASE WHEN doc_id % 5 = 0 THEN kilos END AS kilos, CASE WHEN doc_id % 5 = 0 THEN numero_contenedor END AS numero_contenedor,
  CASE WHEN doc_id % 5 = 0 THEN incoterm END AS incoterm, CASE WHEN doc_id % 5 = 0 THEN valor_factura END AS valor_factura,
  CASE WHEN doc_id % 5 = 0 THEN valor_fob END AS valor_fob, CASE WHEN doc_id % 5 = 0 THEN valor_cif END AS valor_cif, moneda
FROM {v_doc}""",
    # Saved forms of BLs and invoices, and the item tables of some invoices.
    "v_bl_edit": """
SELECT shipment_id, bl_number || '-R' AS bl_number, booking_number, container_no, coalesce(freight_cost, 0.0) + 10.0 AS freight_cost,
  port_of_loading, 'LA CEIBA' AS port_of_discharge, cargo_type, CAST(3 AS bigint) AS packages_count, gross_weight,
  'Editado S.A.' AS exporter_name, 'Calle 1' AS exporter_address, 'Receptor' AS consignee_name, consignee_address
FROM {v_bl} WHERE shipment_id % 5 = 0""",
    "v_invoice_edit": """
SELECT shipment_id, invoice_idx, 'FOB' AS incoterm, invoice_number || 'B' AS invoice_number, invoice_date, 'USD' AS currency,
  coalesce(total_value, 0.0) + 1.5 AS total_value
FROM {v_invoice} WHERE invoice_idx % 4 = 1""",
    "v_item_edit": """
SELECT shipment_id, invoice_idx, item_idx, part_number, 'editado' AS description, quantity + 1 AS quantity, unit_price,
  (quantity + 1) * unit_price AS total_price
FROM {v_item} WHERE invoice_idx % 4 = 1 AND quantity > 10""",
    # Saved edits: one document in five has a full form.
    "v_edit": """
SELECT doc_id, numero_bl || 'X' AS numero_bl, 'Editado S.A.' AS exportador, consignatario, valor_flete, '7' AS bultos,
  kilos, numero_contenedor, 'FOB' AS incoterm, valor_factura, '250.00' AS valor_fob, valor_cif, moneda
FROM {v_doc} WHERE doc_id % 5 = 0""",
    # Number texts in every notation.
    "v_value": """
SELECT o_orderkey AS id, CASE o_orderkey % 32 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN 'No detectado'
  WHEN 4 THEN 'None' WHEN 5 THEN 'null' WHEN 6 THEN '12,5' WHEN 7 THEN '1.234,56' WHEN 8 THEN '1,234.56' WHEN 9 THEN '1,234'
  WHEN 10 THEN '1,234,567' WHEN 11 THEN '1,2,34' WHEN 12 THEN '1.234' WHEN 13 THEN '1.234.567' WHEN 14 THEN '5,'
  WHEN 15 THEN '-3' WHEN 16 THEN '$ 10' WHEN 17 THEN 'abc' WHEN 18 THEN '12-3' WHEN 19 THEN '5d' WHEN 20 THEN '1_000'
  WHEN 21 THEN 'nan' WHEN 22 THEN '0' WHEN 23 THEN ' USD 1,250.50 ' WHEN 24 THEN CAST(o_totalprice AS string) || ' EUR'
  WHEN 25 THEN '$' || CAST(o_totalprice AS string) WHEN 26 THEN 'cop ' || CAST(CAST(floor(o_totalprice) AS bigint) AS string)
  WHEN 27 THEN replace(CAST(o_totalprice AS string), '.', ',') WHEN 28 THEN '-' || CAST(o_totalprice AS string)
  WHEN 29 THEN '  a   b  ' || o_orderpriority WHEN 30 THEN CAST(CAST(floor(o_totalprice) AS bigint) AS string)
  ELSE CAST(o_totalprice AS string) END AS txt
FROM {orders}""",
    # Raw model answers around the event properties.
    "v_answer": """
SELECT event_id AS answer_id, CASE event_id % 7
  WHEN 0 THEN 'Claro:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```'
  WHEN 1 THEN 'respuesta ' || props || ' fin' WHEN 2 THEN chr(123) || '"a": ' || props || ', "k": 5' || chr(125)
  WHEN 3 THEN chr(123) || '"k": ' || CAST(event_id AS string) WHEN 4 THEN 'Sin datos: ' || event_type
  WHEN 5 THEN chr(123) || '"k": "' || CAST(event_id AS string) || '"' || chr(125) ELSE NULL END AS text
FROM {events}""",
    "v_file": """
SELECT doc_id, 'doc_' || CAST(doc_id AS string) || CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg'
  WHEN 3 THEN '.jpeg' WHEN 4 THEN '.TIFF' WHEN 5 THEN '.bmp' WHEN 6 THEN '.PDF' ELSE '.docx' END AS name,
  CASE WHEN doc_id % 10 = 0 THEN n_chars ELSE n_chars * 1000 END AS length
FROM {documents}""",
    "v_page_text": """
SELECT conv_id AS doc_id, turn AS page_no, CASE WHEN (conv_id + turn) % 10 = 3 THEN NULL ELSE text END AS text
FROM {conversations}""",
    # One file per event, one job per user.
    "v_job_file": """
SELECT user_id AS job_id, event_id AS file_index,
  'file_' || CAST(event_id AS string) || CASE event_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.png' ELSE '.pdf' END AS filename,
  CAST(floor(value * 100000) AS bigint) AS size, event_type <> 'error' AS has_result,
  CASE event_type WHEN 'view' THEN 'texto_extraido' WHEN 'click' THEN 'vision_ocr' END AS metodo_procesamiento,
  event_type <> 'error' AS success, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Falla ' || CAST(event_id AS string) END AS error,
  ts
FROM {events}""",
    "v_job": """
SELECT user_id AS job_id, CASE WHEN user_id % 12 = 0 THEN '  ' ELSE 'Lote ' || CAST(user_id AS string) END AS name,
  count(*) AS total_files, count(CASE WHEN event_type <> 'error' AND user_id % 5 <> 0 THEN 1 END) AS processed_files,
  count(CASE WHEN event_type = 'error' AND user_id % 5 <> 0 THEN 1 END) AS failed_files,
  CASE user_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE min(ts) END AS start_time,
  CASE WHEN user_id % 5 <= 1 OR user_id % 13 = 0 THEN NULL ELSE max(ts) END AS end_time
FROM {events} GROUP BY user_id""",
    "v_session": """
SELECT CAST(user_id AS string) AS id, 'Sesion_' || CAST(user_id AS string) AS session_name,
  CASE WHEN user_id % 3 = 0 THEN max(ts) ELSE min(ts) END AS created_at,
  max(ts) AS updated_at, 'nota ' || CAST(user_id AS string) AS user_notes, count(*) AS total_documents,
  count(CASE WHEN event_type = 'error' THEN 1 END) AS documents_with_errors,
  CASE user_id % 4 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'review_needed' WHEN 2 THEN 'archivada' ELSE 'completed' END
    AS processing_status,
  CASE WHEN user_id % 9 = 0 THEN '[1]' WHEN user_id % 9 = 1 THEN NULL ELSE min(props) END AS session_data
FROM {events} GROUP BY user_id""",
    "v_session_doc": """
SELECT CAST(user_id AS string) AS session_id, event_id AS document_index,
  CASE WHEN event_id % 17 = 0 THEN '"texto"' WHEN event_id % 23 = 0 THEN NULL ELSE props END AS original_data,
  CASE WHEN event_type = 'purchase' THEN props END AS edited_data
FROM {events}""",
    # Working sets to save: one per user, some under the same name.
    "v_working_set": """
SELECT user_id AS set_id, 'Set_' || CAST(user_id % 50 AS string) AS session_name, 'n' || CAST(user_id AS string) AS user_notes,
  event_id AS document_index, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'BL-' || CAST(event_id AS string) END AS bl_number,
  CASE WHEN event_type = 'error' THEN 'falla' END AS error, props AS original_data,
  CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN props END AS edited_data
FROM {events}""",
    # Services chosen per order, one to a line: price list entries and one that is not listed.
    "v_selection": """
SELECT l_orderkey AS invoice_id, CAST(l_linenumber AS bigint) * 1000000000 + l_partkey AS line_no,
  CASE l_partkey % 6 WHEN 0 THEN 'Servicio de Trámite Aduanal' WHEN 1 THEN 'Logística y Transporte Local'
    WHEN 2 THEN 'Almacenaje Fiscal' WHEN 3 THEN 'Manejo de Documentación' WHEN 4 THEN 'Impuestos de Importación'
    ELSE 'Servicio ' || l_returnflag END AS descripcion,
  CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN l_partkey % 14 = 0 THEN NULL ELSE CAST(floor(l_extendedprice / 100) AS double) + CAST(0.5 AS double) END AS price
FROM {lineitem}""",
    "v_client": """
SELECT o_orderkey AS invoice_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Cliente ' || CAST(o_custkey AS string)
  WHEN o_orderkey % 3 = 1 THEN '' END AS cliente_preview,
  CASE WHEN o_orderkey % 4 = 0 THEN '0801' || CAST(o_custkey AS string) END AS rtn_preview,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Calle ' || CAST(o_custkey AS string) END AS direccion_preview,
  CASE WHEN o_orderkey % 7 <> 0 THEN c_name END AS consignee_name,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Zona ' || CAST(c_nationkey AS string) END AS consignee_address,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'BL-' || CAST(o_orderkey AS string) END AS bl_number,
  CAST(o_orderdate AS date) AS issued
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
}

_NAME = re.compile(r"\{(\w+)\}")


def needs(sql: str) -> list[str]:
    """Names of the tables and views a text refers to."""
    return list(dict.fromkeys(_NAME.findall(sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, read as its files are."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def loader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """``load(name)`` for the base tables and views of a folder; asking twice gives the same frame."""

    @cache
    def load(name: str) -> DataFrame:
        if name not in VIEWS:
            return table(spark, sf_dir, name)
        sql = VIEWS[name]
        return spark.sql(sql, **{n: load(n) for n in needs(sql)})

    return load


def with_views(names: list[str]) -> str:
    """The views as a list of common table expressions, those they need first."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for other in needs(VIEWS[name]):
                add(other)
            ordered[name] = _NAME.sub(r"\1", VIEWS[name])

    for name in names:
        add(name)
    return ",\n".join(f"{name} AS ({sql})" for name, sql in ordered.items())
