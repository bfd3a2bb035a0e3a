"""DuckDB SQL that states independently what each query must return.

The texts are written from the semantics, not from the Spark plans: theta joins, windows and
UNION ALL branches where the Spark side uses balanced joins, aggregates and arrays.
"""

from __future__ import annotations

from cargoledger import fixed_values as fv
from cargoledger.sources.samples import needs, with_views

ORACLES: dict[str, str] = {}

FLOAT = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
SPACE = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"


def oracle(name: str, body: str, *ctes: str) -> None:
    """Store a body, preceded by extra CTE texts and by all the views they name as ``{v_...}``."""
    text = ",\n".join(ctes)
    views = with_views([v for v in needs(text + body)])
    plain = [t.replace("{", "").replace("}", "") for t in (*ctes, body)]
    head = ",\n".join(t for t in [views, *plain[:-1]] if t)
    ORACLES[name] = (f"WITH {head}\n" if head else "") + plain[-1]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(texts) -> str:
    return ", ".join(q(t) for t in texts)


def as_double(x: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({x}), {q(FLOAT)}) THEN try_cast(replace(trim({x}), '_', '') AS DOUBLE) END)"


def as_bigint(x: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({x}), {q(INTEGER)}) THEN try_cast(replace(trim({x}), '_', '') AS BIGINT) END)"


def cents(x: str) -> str:
    return f"coalesce(CAST(round(sum(CAST(coalesce({x}, 0) AS DECIMAL(28,6))), 2) AS DOUBLE), 0.0)"


def missing(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) IN ({listed(fv.MISSING_TEXTS)}))"


def absent(x: str) -> str:
    return f"({x} IS NULL OR {x} IN ('', 'No detectado'))"


def numbers_of(source: str, key: str, columns: list[str], name: str) -> str:
    """CTE ``name(key, field, as_float, as_int)``: the locale-guessing parser, step by step."""
    return f"""{name}_raw AS (SELECT {key}, field, val FROM (SELECT {key}, unnest([{listed(columns)}]) AS field,
    unnest([{', '.join(columns)}]) AS val FROM {source})),
{name}_clean AS (SELECT *, {missing('val')} AS gone, regexp_replace(val, '[^0-9.,\\-]', '', 'g') AS x FROM {name}_raw),
{name}_plain AS (SELECT *, CASE WHEN contains(x, ',') AND contains(x, '.') THEN replace(replace(x, '.', ''), ',', '.')
    WHEN regexp_matches(x, '^[^,]*,[^,]?[^,]?$') THEN replace(x, ',', '.')
    WHEN length(x) - length(replace(x, '.', '')) = 1 THEN x
    WHEN contains(x, ',') AND length(list_last(string_split(x, ','))) <= 2
      THEN array_to_string(list_slice(string_split(x, ','), 1, -2), '') || '.' || list_last(string_split(x, ','))
    WHEN contains(x, ',') THEN replace(x, ',', '') ELSE x END AS y FROM {name}_clean),
{name} AS (SELECT {key}, field, val, gone, CASE WHEN gone THEN 0.0 ELSE coalesce({as_double('y')}, 0.0) END AS as_float,
    CASE WHEN gone THEN 0 ELSE coalesce({as_bigint('y')}, 0) END AS as_int FROM {name}_plain)"""


# --- allocation ----------------------------------------------------------------------------------

FOB = """fob AS (SELECT *, CASE WHEN coalesce(total_price, 0) <> 0 THEN total_price
  ELSE coalesce(quantity, 0) * coalesce(unit_price, 0) END AS f FROM {v_item})"""
TOTALS = f"""tot AS (SELECT shipment_id, CASE WHEN s1 = 0 THEN s2 ELSE s1 END AS total_fob FROM (SELECT shipment_id,
  {cents('total_price')} AS s1, {cents('quantity * unit_price')} AS s2 FROM {{v_item}} GROUP BY shipment_id))"""
ALLOC = """alloc AS (SELECT f.*, CASE WHEN live THEN f END AS fob_value, CASE WHEN live THEN f * 0.015 END AS insurance_calculated,
  CASE WHEN live THEN coalesce(b.freight_cost, 0) * (CASE WHEN total_fob > 0 THEN f / total_fob ELSE 0 END) END
    AS freight_proportional,
  fob_value + freight_proportional + insurance_calculated AS cif_value_corrected, live
  FROM fob f JOIN {v_bl} b USING (shipment_id) JOIN tot USING (shipment_id)
  LEFT JOIN (SELECT shipment_id, NOT bool_or(error IS NOT NULL) AS live FROM {v_invoice} GROUP BY shipment_id) g
    USING (shipment_id) WHERE b.error IS NULL)"""
BY_INVOICE = """byinv AS (SELECT i.*, coalesce(total_price, 0.0) AS fob_value, CASE WHEN t.s > 0
  THEN coalesce(total_price, 0.0) / t.s * coalesce(b.freight_cost, 0.0) ELSE 0.0 END AS freight_proportional
  FROM {v_item} i JOIN (SELECT shipment_id, invoice_idx, %s AS s FROM {v_item} GROUP BY 1, 2) t
    USING (shipment_id, invoice_idx) JOIN open b USING (shipment_id))""" % cents("total_price")
# A failed BL ends the extraction without invoices; after that, a failed BL or first invoice stops the shipment.
FIRST = """first AS (SELECT * FROM {v_invoice} QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY invoice_idx) = 1),
sound AS (SELECT shipment_id FROM {v_invoice} GROUP BY 1 HAVING count(error) = 0),
open AS (SELECT b.* FROM {v_bl} b LEFT JOIN first f ON f.shipment_id = b.shipment_id WHERE b.error IS NULL AND f.error IS NULL)"""


def report_totals(source: str) -> str:
    return f"""SELECT *, fob * 0.015 AS insurance, fob + freight + fob * 0.015 AS cif FROM (SELECT shipment_id,
  count(*) AS n_items, {cents('fob_value')} AS fob, {cents('freight_proportional')} AS freight
  FROM {source} GROUP BY shipment_id)"""


def cents_of(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,6)), 2) AS DOUBLE)"


# Per shipment: its lines' FOB, and its freight in the share that they have in the FOB total.
oracle(
    "cif_by_shipment",
    f"""SELECT *, fob * 0.015 AS insurance, fob + freight + fob * 0.015 AS cif FROM (SELECT b.shipment_id, n AS n_items,
  CASE WHEN live THEN lines ELSE 0.0 END AS fob, CASE WHEN live AND total_fob > 0
    THEN {cents_of('coalesce(freight_cost, 0) * (lines / total_fob)')} ELSE 0.0 END AS freight
  FROM {{v_bl}} b JOIN tot USING (shipment_id) JOIN (SELECT shipment_id, count(*) AS n, {cents('f')} AS lines FROM fob GROUP BY 1)
    USING (shipment_id) LEFT JOIN (SELECT shipment_id, NOT bool_or(error IS NOT NULL) AS live FROM {{v_invoice}} GROUP BY 1)
    USING (shipment_id) WHERE b.error IS NULL)""",
    FOB, TOTALS,
)
oracle("e1_fob_totals", "SELECT * FROM tot", TOTALS)
oracle(
    "e4_freight_shipment",
    "SELECT shipment_id, invoice_idx, item_idx, fob_value, freight_proportional, insurance_calculated, "
    "cif_value_corrected FROM alloc",
    FOB, TOTALS, ALLOC,
)
oracle(
    "p4_error_gate",
    "SELECT shipment_id, count(*) AS n_items, count(cif_value_corrected) AS n_derived FROM alloc GROUP BY 1",
    FOB, TOTALS, ALLOC,
)
oracle(
    "e6_freight_invoice",
    "SELECT shipment_id, invoice_idx, item_idx, fob_value, freight_proportional FROM byinv", FIRST, BY_INVOICE,
)
oracle("e7_report_totals", report_totals("byinv"), FIRST, BY_INVOICE)
oracle(
    "j7_freight_on_items",
    "SELECT shipment_id, invoice_idx, item_idx, freight_cost FROM {v_item} LEFT JOIN {v_bl} USING (shipment_id)",
)

# --- parties ---------------------------------------------------------------------------------------


def merged(prefix: str) -> str:
    """The merged exporter of BL columns ``b`` and invoice columns ``v``."""
    address = """CASE WHEN length(trim(coalesce(v.exporter_address, ''))) > length(trim(coalesce(b.exporter_address, '')))
    THEN trim(coalesce(v.exporter_address, '')) ELSE trim(coalesce(b.exporter_address, '')) END"""
    return f"""coalesce(nullif(v.exporter_name, ''), nullif(b.exporter_name, ''), 'No detectado') AS {prefix}_name,
  coalesce(nullif({address}, ''), 'No detectado') AS {prefix}_address,
  coalesce(nullif(v.exporter_phone, ''), nullif(b.exporter_phone, ''), 'No detectado') AS {prefix}_phone"""


oracle(
    "j5_invoice_parties",
    f"""SELECT shipment_id, invoice_idx, {', '.join(f'CASE WHEN ok THEN m_{c} END AS exporter_details_{c}' for c in ('name', 'address', 'phone'))},
  {', '.join(f'CASE WHEN ok THEN consignee_{c} END AS consignee_details_{c}' for c in ('name', 'address', 'phone'))}
  FROM (SELECT v.shipment_id, v.invoice_idx, v.error IS NULL AS ok, {merged('m')}, b.consignee_name, b.consignee_address,
    b.consignee_phone FROM {{v_invoice}} v JOIN {{v_bl}} b ON v.shipment_id = b.shipment_id WHERE b.error IS NULL)""",
)
BL_PARTIES = f"""blp AS (SELECT b.*, CASE WHEN s.shipment_id IS NOT NULL THEN m_name END AS exporter_details_name,
  CASE WHEN s.shipment_id IS NOT NULL THEN m_address END AS exporter_details_address,
  CASE WHEN s.shipment_id IS NOT NULL THEN m_phone END AS exporter_details_phone,
  CASE WHEN s.shipment_id IS NOT NULL THEN b.consignee_name END AS consignee_details_name,
  CASE WHEN s.shipment_id IS NOT NULL THEN b.consignee_address END AS consignee_details_address,
  CASE WHEN s.shipment_id IS NOT NULL THEN b.consignee_phone END AS consignee_details_phone
  FROM open b LEFT JOIN sound s ON b.shipment_id = s.shipment_id LEFT JOIN (SELECT b.shipment_id AS k, {merged('m')}
    FROM open b JOIN first v ON b.shipment_id = v.shipment_id) m ON m.k = b.shipment_id)"""
DETAILS = ", ".join(f"{p}_details_{c}" for p in ("exporter", "consignee") for c in ("name", "address", "phone"))
oracle("j5_bl_parties", f"SELECT shipment_id, {DETAILS} FROM blp", FIRST, BL_PARTIES)

CONSOLIDATED = """cons AS (SELECT b.shipment_id, b.bl_number AS numero_bl, b.freight_cost AS valor_flete, b.packages_count AS bultos,
  b.gross_weight AS kilos, b.container_no AS numero_contenedor, b.exporter_details_name AS exportador,
  b.consignee_details_name AS consignatario, coalesce(b.bl_number, 'Documento Consolidado') AS archivo,
  'BL_FACTURA' AS tipo_documento, v.incoterm, v.total_value AS valor_factura, v.currency AS moneda,
  CASE v.incoterm WHEN 'FOB' THEN v.total_value WHEN 'CIF' THEN v.total_value / (1 + 0.015) - coalesce(b.freight_cost, 0) END
    AS valor_fob,
  CASE v.incoterm WHEN 'CIF' THEN v.total_value WHEN 'FOB'
    THEN v.total_value + coalesce(b.freight_cost, 0) + v.total_value * 0.015 END AS valor_cif
  FROM blp b JOIN first v ON b.shipment_id = v.shipment_id)"""
CONS = (FIRST, BL_PARTIES, CONSOLIDATED)
oracle("j6_consolidated_documents", "SELECT * FROM cons", *CONS)
oracle(
    "f13_editable_bl",
    """SELECT shipment_id, coalesce(bl_number, '') AS bl_num, coalesce(booking_number, '') AS booking_num,
  coalesce(port_of_loading, '') AS pol, coalesce(port_of_discharge, '') AS pod, coalesce(cargo_type, '') AS cargo_type,
  coalesce(container_no, '') AS container_no, coalesce(exporter_details_name, '') AS exporter_name,
  coalesce(exporter_details_address, '') AS exporter_address, coalesce(consignee_details_name, '') AS consignee_name,
  coalesce(consignee_details_address, '') AS consignee_address, coalesce(freight_cost, 0.0) AS freight_cost,
  coalesce(packages_count, 0) AS packages_count, coalesce(gross_weight, 0.0) AS gross_weight FROM blp""",
    FIRST, BL_PARTIES,
)
oracle(
    "f13_editable_invoices",
    """SELECT shipment_id, invoice_idx, upper(coalesce(incoterm, 'NOT_FOUND')) AS incoterm, coalesce(invoice_number, '') AS inv_num,
  coalesce(invoice_date, '') AS inv_date, coalesce(currency, '') AS inv_curr, coalesce(total_value, 0.0) AS total_val
  FROM {v_invoice} WHERE shipment_id IN (SELECT shipment_id FROM open)""",
    FIRST,
)


def assembled(bl: str, invoices: str, items: str) -> str:
    return f"""SELECT shipment_id, bl_number, container_no, port_of_loading, freight_cost, error, CASE WHEN n IS NOT NULL THEN 0::BIGINT END AS part_no, CAST(coalesce(n, 0) AS INTEGER) AS n_invoices,
  coalesce(invoices, '') AS invoices FROM {bl} LEFT JOIN (SELECT shipment_id, count(*) AS n,
    string_agg(invoice_idx || '/' || concat_ws('/', invoice_number, incoterm, currency, exporter_name, error) || ':' || items, ';'
      ORDER BY invoice_idx) AS invoices
    FROM (SELECT shipment_id, invoice_idx, string_agg(concat_ws('/', item_idx, part_number, description, quantity::DECIMAL(18,2)), ','
      ORDER BY item_idx, quantity) AS items FROM {items}
      GROUP BY 1, 2) JOIN {invoices} USING (shipment_id, invoice_idx) GROUP BY shipment_id) USING (shipment_id)"""


oracle("f14_assembled_shipments", assembled("open", "{v_invoice}", "{v_item}"), FIRST)
oracle(
    "n1_item_numbers",
    """SELECT shipment_id, invoice_idx, item_idx,
  row_number() OVER (PARTITION BY shipment_id ORDER BY invoice_idx, item_idx) AS item_number FROM {v_item}""",
)
oracle("w2_first_invoice", "SELECT shipment_id, invoice_idx, invoice_number FROM first", FIRST)

# --- translation and tariff -------------------------------------------------------------------------


def desc_key(x: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), '')"


TRANSLATED = f"""tr AS (SELECT i.* EXCLUDE (description), i.description AS raw, description_original, es AS description_es,
  CASE WHEN es <> '' AND NOT starts_with(es, 'ERROR_TRADUCCION') THEN es ELSE description_original END AS description
  FROM (SELECT i.*, coalesce(i.description, '') AS description_original,
    CASE WHEN i.description IS NULL OR i.description = '' OR lower(i.description) IN ({listed(fv.UNTRANSLATED_TEXTS)})
        OR g.text_es IS NULL THEN coalesce(i.description, '')
      ELSE replace(replace(trim(g.text_es), '*', ''), '"', '') END AS es
    FROM {{v_item}} i LEFT JOIN {{v_glossary}} g ON g.gkey = {desc_key('i.description')}) i)"""
oracle(
    "j11_translation",
    "SELECT shipment_id, invoice_idx, item_idx, description_original, description_es, description FROM tr",
    TRANSLATED,
)
ENTRIES = f"""entries AS (SELECT CAST(file_id AS BIGINT) AS load, pos, {desc_key('descr')} AS key, arancel AS code FROM {{v_catalog_upload}}
  WHERE {desc_key('descr')} <> '' AND arancel IS NOT NULL AND arancel <> 'PENDIENTE')"""
# The built-in entries come first, then one file after the other.
CATALOG = f"""stored AS (SELECT row(1, load, pos) AS pos, key, code FROM entries
  UNION ALL SELECT row(0, 0, pos), key, code FROM (VALUES {', '.join(f"({i - 2}, {q(k)}, {q(c)})" for i, (k, c) in enumerate(fv.DEFAULT_CATALOG))}) t(pos, key, code)),
catalog AS (SELECT min(pos) AS pos, key, arg_max(code, pos) AS code FROM stored GROUP BY key)"""
PLACE = "CAST(struct_extract(pos, 1) AS INTEGER) AS part, CAST(struct_extract(pos, 2) AS BIGINT) AS load, CAST(struct_extract(pos, 3) AS BIGINT) AS row"


def codes(source: str, column: str) -> str:
    return f"""codes AS (SELECT d, coalesce(arg_min(code, row(d <> key, pos)) FILTER (key IS NOT NULL), 'PENDIENTE') AS code
  FROM (SELECT DISTINCT {desc_key(column)} AS d FROM {source}) LEFT JOIN catalog ON d <> '' AND contains(d, key) GROUP BY d)"""


oracle("p3_catalog_filter", "SELECT * FROM entries", ENTRIES)
oracle("j3_catalog_merge", f"SELECT {PLACE}, key, code FROM catalog", ENTRIES, CATALOG)
oracle(
    "s5_catalog_csv",
    f"SELECT {PLACE}, key, code FROM (SELECT min(row(0, load, pos)) AS pos, key, arg_max(code, row(0, load, pos)) AS code FROM entries GROUP BY key)",
    ENTRIES,
)
oracle(
    "k5_catalog",
    f'SELECT {PLACE}, key AS "Descripción Producto (Español)", code AS "Posicion_Arancelaria" FROM catalog', ENTRIES, CATALOG,
)
oracle(
    "j1_tariff_lookup",
    f"SELECT shipment_id, invoice_idx, item_idx, code AS tariff_code FROM {{v_item}} JOIN codes ON d = {desc_key('description')}",
    ENTRIES, CATALOG, codes("{v_item}", "description"),
)
oracle(
    "s6_catalog_preview",
    """SELECT file_id, row_no, descr AS "desc", arancel FROM {v_catalog_upload}
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY row_no) <= 5""",
)


def bare(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), 'áéíóúüñ', 'aaiouun'), '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\p{{Z}}\\-_.,()/#]', '', 'g')"


def _header_scores() -> str:
    parts = []
    for target, words in fv.CATALOG_HEADER_KEYWORDS.items():
        hits = " + ".join(f"(CASE WHEN contains(h, {bare(q(w))}) THEN 10 ELSE 0 END)" for w in words)
        parts.append(
            f"SELECT file_id, col_pos, col_name, {q(target)} AS target, CASE WHEN h = {bare(q(target))} THEN 100 ELSE {hits} END AS score FROM headers"
        )
    return " UNION ALL ".join(parts)


ORACLES["j2_header_match"] = f"""WITH {with_views(['v_catalog_header'])},
headers AS (SELECT *, {bare('col_name')} AS h FROM v_catalog_header), scored AS ({_header_scores()}),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY file_id, target ORDER BY score DESC, col_pos) = 1)
SELECT file_id, target, CASE WHEN score >= 10 THEN col_name END AS col_name, score FROM best"""

# --- reports --------------------------------------------------------------------------------------------

oracle(
    "k1_aforo",
    f"""SELECT a.shipment_id, row_number() OVER (PARTITION BY a.shipment_id ORDER BY a.invoice_idx, a.item_idx, a.quantity) AS "Item",
  a.quantity AS "Bultos", coalesce(CASE WHEN live THEN a.description_es ELSE raw END, 'No Desc') AS "Contenido", 'S/M' AS "Marca", fob_value AS "Fob", freight_proportional AS "Flete",
  fob_value * 0.015 AS "Seg", coalesce(fob_value, 0) + coalesce(freight_proportional, 0) + coalesce(fob_value * 0.015, 0) AS "CIF",
  '' AS "Peso", '' AS "Aduana", CASE WHEN live THEN code ELSE 'PENDIENTE' END AS "Posicion Arancelaria", '20%' AS "DAI", '0%' AS "SELECTIVO", '18%' AS "ISV"
  FROM alloc a JOIN codes ON d = {desc_key('a.description_es')}""",
    TRANSLATED, FOB.replace("{v_item}", "tr"), TOTALS, ALLOC, ENTRIES, CATALOG, codes("tr", "description_es"),
)
oracle(
    "k1_aforo_invoice",
    f"""SELECT a.shipment_id, row_number() OVER (PARTITION BY a.shipment_id ORDER BY a.invoice_idx, a.item_idx, a.quantity) AS "Item",
  a.quantity AS "Bultos", coalesce(CASE WHEN s.shipment_id IS NOT NULL THEN a.description_es ELSE raw END, 'No Desc') AS "Contenido",
  'S/M' AS "Marca", fob_value AS "Fob", freight_proportional AS "Flete", fob_value * 0.015 AS "Seg",
  coalesce(fob_value, 0) + coalesce(freight_proportional, 0) + coalesce(fob_value * 0.015, 0) AS "CIF", '' AS "Peso", '' AS "Aduana",
  CASE WHEN s.shipment_id IS NOT NULL THEN code ELSE 'PENDIENTE' END AS "Posicion Arancelaria", '20%' AS "DAI", '0%' AS "SELECTIVO", '18%' AS "ISV"
  FROM byinv a JOIN codes ON d = {desc_key('a.description_es')} LEFT JOIN sound s ON s.shipment_id = a.shipment_id""",
    TRANSLATED, FIRST, BY_INVOICE.replace("{v_item}", "tr"), ENTRIES, CATALOG, codes("tr", "description_es"),
)
# Stopped shipments reach no report; one failed invoice ends the processing before any item is translated.
REPORTED = """reported AS (SELECT t.*, CASE WHEN s.shipment_id IS NULL THEN '' ELSE description_original END AS original,
  CASE WHEN s.shipment_id IS NULL THEN '' ELSE description_es END AS texto
  FROM tr t LEFT JOIN sound s ON s.shipment_id = t.shipment_id WHERE t.shipment_id IN (SELECT shipment_id FROM open))"""
oracle(
    "k2_deva",
    """SELECT shipment_id, invoice_idx, item_idx, coalesce(part_number, 'S/C') AS "CODIGO DE BARRAS",
  texto AS "DESCRIPCION COMERCIAL", 'S/M' AS "MARCA", 'S/M' AS "MODELO/ESTILO", 'CHINA' AS "PAIS DE ORIGEN",
  quantity AS "UNIDADES", unit_price AS "PRECIO UNITARIO", quantity * unit_price AS "TOTAL" FROM reported""",
    FIRST, TRANSLATED, REPORTED,
)
oracle(
    "k3_translation",
    'SELECT shipment_id, invoice_idx, item_idx, original AS "DESCRIPCION INGLES", texto AS "DESCRIPCION ESPAÑOL" FROM reported',
    FIRST, TRANSLATED, REPORTED,
)
SUMMARY = (
    FIRST, BL_PARTIES, BY_INVOICE, f"rt AS ({report_totals('byinv')})",
    """summary AS (SELECT b.shipment_id, coalesce(f.invoice_number, 'N/A') AS invoice_number,
  coalesce(f.invoice_date, 'N/A') AS invoice_date, coalesce(b.exporter_details_name, 'N/A') AS supplier,
  coalesce(b.packages_count, 0) AS packages, coalesce(b.gross_weight, 0.0) AS weight, coalesce(fob, 0.0) AS fob,
  coalesce(freight, 0.0) AS freight, coalesce(insurance, 0.0) AS insurance, coalesce(cif, 0.0) AS cif
  FROM blp b LEFT JOIN first f ON f.shipment_id = b.shipment_id LEFT JOIN rt ON rt.shipment_id = b.shipment_id)""",
)
oracle("k4_invoice_summary", "SELECT * FROM summary", *SUMMARY)
oracle(
    "k4_summary_rows",
    """SELECT shipment_id, 0 AS pos, 'FACTURA No.' AS label, invoice_number AS text, CAST(NULL AS DOUBLE) AS amount FROM summary
  UNION ALL SELECT shipment_id, 1, 'FECHA', invoice_date, NULL FROM summary
  UNION ALL SELECT shipment_id, 2, 'PROVEEDOR', supplier, NULL FROM summary
  UNION ALL SELECT shipment_id, 3, 'BULTOS', NULL, CAST(packages AS DOUBLE) FROM summary
  UNION ALL SELECT shipment_id, 4, 'PESO', NULL, weight FROM summary
  UNION ALL SELECT shipment_id, 5, 'VALOR FACTURA', NULL, fob FROM summary
  UNION ALL SELECT shipment_id, 6, 'FLETE', NULL, freight FROM summary
  UNION ALL SELECT shipment_id, 7, 'SEGURO', NULL, insurance FROM summary
  UNION ALL SELECT shipment_id, 8, 'VALOR CIF', NULL, cif FROM summary""",
    *SUMMARY,
)
oracle(
    "k6_template_comercial",
    """SELECT shipment_id, archivo AS "Documento Fuente", numero_bl AS "Nº BL", incoterm AS "INCOTERM",
  valor_factura AS "Valor Factura", valor_fob AS "Valor FOB Consolidado", valor_cif AS "Valor CIF Consolidado",
  coalesce(valor_cif, 0) - coalesce(valor_fob, 0) AS "Costo Total Flete/Seguro" FROM cons""",
    *CONS,
)
oracle(
    "k6_template_logistica",
    """SELECT shipment_id, numero_bl AS "Nº BL", numero_contenedor AS "Nº Contenedor", bultos AS "Bultos (Total)",
  kilos AS "Kilos (Total)", valor_flete AS "Costo Flete BL",
  CASE WHEN kilos > 0 THEN coalesce(valor_flete, 0) / kilos ELSE 0.0 END AS "Costo Flete por Kilo" FROM cons""",
    *CONS,
)


def amount(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 0.0 ELSE {as_double(x)} END)"


# An operand of the rule that is no number makes the result 0.
oracle(
    "k6_template_texts",
    f"""SELECT doc_id, coalesce({amount('valor_cif')} - {amount('valor_fob')}, 0.0) AS "Costo Total Flete/Seguro"
  FROM {{v_doc}}""",
)
oracle(
    "k7_template_summary",
    f"""SELECT l.pos, l.label, CASE l.pos WHEN 0 THEN n WHEN 1 THEN kilos WHEN 2 THEN fob WHEN 3 THEN cif WHEN 4 THEN freight
    ELSE CASE WHEN kilos > 0 THEN freight / kilos ELSE 0.0 END END AS value
  FROM (SELECT CAST(count(*) AS DOUBLE) AS n, {cents('kilos')} AS kilos, {cents('valor_fob')} AS fob, {cents('valor_cif')} AS cif,
    {cents('valor_flete')} AS freight FROM cons),
  (VALUES {', '.join(f'({i}, {q(t)})' for i, t in enumerate(fv.TEMPLATE_SUMMARY_LABELS))}) l(pos, label)""",
    *CONS,
)

oracle(
    "process_documents",
    """SELECT shipment_id, invoice_idx, part_number, CASE WHEN live THEN description_original END AS description_original,
  CASE WHEN live THEN description_es END AS description_es, CASE WHEN live THEN description ELSE raw END AS description,
  fob_value, freight_proportional, insurance_calculated, cif_value_corrected FROM alloc""",
    TRANSLATED, FOB.replace("{v_item}", "tr"), TOTALS, ALLOC,
)

# --- validation ---------------------------------------------------------------------------------------------

NUMBER_FIELDS = [r[0] for r in fv.FIELD_RULES if r[2] in ("integer", "decimal", "currency")]
NUMS = numbers_of("{v_doc}", "doc_id", NUMBER_FIELDS, "nums")


def _field_checks() -> str:
    """One branch per field rule: doc_id, rule_no, field, name, required, value, and up to two messages."""
    parts = []
    for no, (field, name, kind, required, limits, description) in enumerate(fv.FIELD_RULES):
        first, second, value, source = "NULL", "NULL", field, "{v_doc}"
        if kind == "text":
            value = f"trim({field})"
            if "min_length" in limits:
                first = f"CASE WHEN length(trim({field})) < {limits['min_length']} THEN {q(fv.MIN_LENGTH_MESSAGE % limits['min_length'])} END"
            if "pattern" in limits:
                second = f"CASE WHEN NOT regexp_matches(trim({field}), {q(limits['pattern'].replace('{', '<<').replace('}', '>>'))}) THEN {q(fv.PATTERN_MESSAGE % description)} END"
        elif kind == "select":
            first = f"CASE WHEN trim({field}) NOT IN ({listed(limits['options'])}) THEN {q(fv.OPTION_MESSAGE % ', '.join(limits['options']))} END"
        else:
            parsed = "as_int" if kind == "integer" else "as_float"
            first = f"CASE WHEN {parsed} < {limits['min_value']} THEN {q(fv.MIN_VALUE_MESSAGE % limits['min_value'])} END"
            value, source = f"CAST({parsed} AS VARCHAR)", f"(SELECT doc_id, val AS {field}, as_int, as_float FROM nums WHERE field = {q(field)})"
        need = q(fv.REQUIRED_MESSAGE % name) if required else "NULL"
        gone = missing(field)
        parts.append(
            f"SELECT doc_id, {no} AS rule_no, {q(field)} AS field, {q(name)} AS name, {str(required).lower()} AS required, NOT {gone} AS detected, "
            f"CASE WHEN {gone} THEN 'No detectado' ELSE {value} END AS value, CASE WHEN {gone} THEN {need} ELSE {first} END AS m1, "
            f"CASE WHEN {gone} THEN NULL ELSE {second} END AS m2 FROM {source}"
        )
    return "checks AS (" + "\nUNION ALL ".join(parts) + ")"


def finish_patterns(name: str) -> None:
    ORACLES[name] = ORACLES[name].replace("<<", "{").replace(">>", "}")


CHECKS = (NUMS, _field_checks())
MESSAGES = """msgs AS (SELECT doc_id, rule_no, field, required, 1 AS part, name || ': ' || m1 AS message FROM checks WHERE m1 IS NOT NULL
  UNION ALL SELECT doc_id, rule_no, field, required, 2, name || ': ' || m2 FROM checks WHERE m2 IS NOT NULL)"""
oracle(
    "p1_field_validation",
    """SELECT doc_id, field, m1 IS NULL AND m2 IS NULL AS valid, value, concat_ws('|', m1, m2) AS messages FROM checks""",
    *CHECKS,
)
PER_DOC = """per_doc AS (SELECT doc_id, count(*) AS n, count(CASE WHEN m1 IS NULL AND m2 IS NULL THEN 1 END) AS v FROM checks GROUP BY 1)"""
oracle(
    "p2_document_validation",
    """SELECT p.doc_id, n = v AS valid, CAST(n AS INTEGER) AS total_fields, CAST(v AS INTEGER) AS valid_fields,
  CAST(n - v AS INTEGER) AS invalid_fields, v / n * 100 AS completion_rate, coalesce(error_messages, '') AS error_messages
  FROM per_doc p LEFT JOIN (SELECT doc_id, string_agg(message, '|' ORDER BY rule_no, part) AS error_messages FROM msgs
    GROUP BY 1) USING (doc_id)""",
    *CHECKS, MESSAGES, PER_DOC,
)
oracle(
    "e14_validation_report",
    """SELECT field, count(*) AS total, count(CASE WHEN m1 IS NULL AND m2 IS NULL THEN 1 END) AS valid,
  count(CASE WHEN detected THEN 1 END) AS detected, count(CASE WHEN n = v THEN 1 END) AS valid_documents,
  count(CASE WHEN n = v THEN 1 END) / count(*) * 100 AS document_validity_rate
  FROM checks JOIN per_doc USING (doc_id) GROUP BY field""",
    *CHECKS, PER_DOC,
)
oracle(
    "e15_common_errors", "SELECT message, count(*) AS n, min(doc_id) AS first_doc FROM msgs GROUP BY message", *CHECKS, MESSAGES,
)


def present(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} NOT IN ('', 'No detectado'))"


FIXES = (
    numbers_of("{v_doc}", "doc_id", fv.MONEY_FIELDS, "mon"),
    f"""wide AS (SELECT doc_id, {', '.join(f"max(CASE WHEN field = {q(f)} THEN as_float END) AS n_{f}" for f in fv.MONEY_FIELDS)}
  FROM mon GROUP BY doc_id),
fixed AS (SELECT d.* REPLACE (CASE WHEN {present('numero_bl')} THEN trim(upper(numero_bl)) ELSE numero_bl END AS numero_bl,
  CASE WHEN {present('numero_contenedor')} AND length(regexp_replace(upper(numero_contenedor), '[^A-Z0-9]', '', 'g')) = 11
    THEN regexp_replace(upper(numero_contenedor), '[^A-Z0-9]', '', 'g') ELSE numero_contenedor END AS numero_contenedor,
  CASE WHEN trim(upper(incoterm)) IN ({listed(fv.INCOTERMS)}) THEN trim(upper(incoterm)) ELSE incoterm END AS incoterm,
  {', '.join(f"CASE WHEN {present(f)} AND n_{f} > 0 THEN CAST(n_{f} AS VARCHAR) ELSE {f} END AS {f}" for f in fv.MONEY_FIELDS)}),
  n_valor_fob FROM {{v_doc}} d JOIN wide USING (doc_id)),
cif AS (SELECT *, CASE WHEN incoterm = 'FOB' AND {present('valor_fob')} AND n_valor_fob > 0 THEN n_valor_fob * 1.15 END AS valor_cif_num
  FROM fixed)""",
)
# Two decimals, halves to even.
TEXT_CIF = """(SELECT cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') FROM (SELECT m // 10000 + CASE
    WHEN m % 10000 > 5000 OR (m % 10000 = 5000 AND m // 10000 % 2 = 1) THEN 1 ELSE 0 END AS cents
    FROM (SELECT CAST(CAST(valor_cif_num AS DECIMAL(28,6)) * 1000000 AS HUGEINT) AS m)))"""
oracle(
    "f15_auto_fix",
    f"""SELECT doc_id, numero_bl, numero_contenedor, incoterm, valor_flete, valor_factura, valor_fob,
  CASE WHEN valor_cif_num IS NULL THEN valor_cif ELSE {TEXT_CIF} END AS valor_cif, valor_cif_num,
  conversion_fob_cif OR valor_cif_num IS NOT NULL AS conversion_fob_cif FROM cif""",
    *FIXES,
)
oracle(
    "f16_recalculate_cif",
    f"""SELECT doc_id, CASE WHEN valor_cif_num IS NULL THEN valor_cif ELSE {TEXT_CIF} END AS valor_cif, valor_cif_num,
  conversion_fob_cif OR valor_cif_num IS NOT NULL AS conversion_fob_cif FROM (SELECT d.*,
    CASE WHEN d.incoterm = 'FOB' AND {present('d.valor_fob')} AND n_valor_fob > 0 THEN n_valor_fob * 1.15 END AS valor_cif_num
    FROM {{v_doc}} d JOIN wide USING (doc_id))""",
    *FIXES,
)
_EDITED = ", ".join(
    f"CASE WHEN e.doc_id IS NOT NULL THEN e.{r[0]} ELSE d.{r[0]} END AS {r[0]}" for r in fv.FIELD_RULES if r[0] != "valor_cif"
)
oracle(
    "j8_edit_overlay",
    f"""SELECT d.doc_id, e.doc_id IS NOT NULL AS edited, {_EDITED}, CASE WHEN e.doc_id IS NULL THEN d.valor_cif ELSE '287.50' END AS valor_cif,
  CASE WHEN e.doc_id IS NOT NULL THEN 250.00::DOUBLE * 1.15::DOUBLE END AS valor_cif_num,
  conversion_fob_cif OR e.doc_id IS NOT NULL AS conversion_fob_cif FROM {{v_doc}} d LEFT JOIN {{v_edit}} e ON d.doc_id = e.doc_id""",
)

_FORM = ["bl_number", "booking_number", "container_no", "freight_cost", "port_of_loading", "port_of_discharge", "cargo_type",
         "packages_count", "gross_weight"]


def _over(columns: list[str], base: str = "b") -> str:
    return ", ".join(f"CASE WHEN e.shipment_id IS NOT NULL THEN e.{c} ELSE {base}.{c} END AS {c}" for c in columns)


oracle(
    "j8_bl_edits",
    f"""SELECT b.shipment_id, {_over(_FORM)},
  {', '.join(f"CASE WHEN e.shipment_id IS NOT NULL THEN {'NULL' if c == 'phone' else f'e.{p}_{c}'} ELSE b.{p}_details_{c} END AS {p}_details_{c}"
             for p in ('exporter', 'consignee') for c in ('name', 'address', 'phone'))}
  FROM blp b LEFT JOIN {{v_bl_edit}} e ON e.shipment_id = b.shipment_id""",
    FIRST, BL_PARTIES,
)
INVOICE_EDITS = f"""edited AS (SELECT v.shipment_id, v.invoice_idx,
  {_over(['incoterm', 'invoice_number', 'invoice_date', 'currency', 'total_value'], 'v')}
  FROM {{v_invoice}} v LEFT JOIN {{v_invoice_edit}} e ON e.shipment_id = v.shipment_id AND e.invoice_idx = v.invoice_idx)"""
oracle("j8_invoice_edits", "SELECT * FROM edited WHERE shipment_id IN (SELECT shipment_id FROM open)", FIRST, INVOICE_EDITS)
ITEM_EDITS = """items AS (SELECT * FROM {v_item} i WHERE NOT EXISTS (SELECT 1 FROM {v_item_edit} e
    WHERE e.shipment_id = i.shipment_id AND e.invoice_idx = i.invoice_idx) UNION ALL SELECT * FROM {v_item_edit})"""
oracle("j8_item_edits", "SELECT * FROM items WHERE shipment_id IN (SELECT shipment_id FROM open)", FIRST, ITEM_EDITS)
oracle(
    "f14_edited_nested",
    assembled("papers", "(SELECT e.*, v.exporter_name, v.error FROM edited e JOIN {v_invoice} v USING (shipment_id, invoice_idx))", "items"),
    FIRST, INVOICE_EDITS, ITEM_EDITS,
    f"papers AS (SELECT b.shipment_id, b.error, {_over(['bl_number', 'container_no', 'port_of_loading', 'freight_cost'])} "
    "FROM open b LEFT JOIN {v_bl_edit} e ON e.shipment_id = b.shipment_id)",
)
oracle(
    "f14_edited_shipments",
    report_totals("byedit"),
    FIRST, ITEM_EDITS,
    f"""byedit AS (SELECT i.*, coalesce(total_price, 0.0) AS fob_value, CASE WHEN t.s > 0
  THEN coalesce(total_price, 0.0) / t.s * coalesce(CASE WHEN e.shipment_id IS NOT NULL THEN e.freight_cost ELSE b.freight_cost END, 0.0)
  ELSE 0.0 END AS freight_proportional
  FROM items i JOIN (SELECT shipment_id, invoice_idx, {cents('total_price')} AS s FROM items GROUP BY 1, 2) t
    USING (shipment_id, invoice_idx) JOIN open b USING (shipment_id) LEFT JOIN {{v_bl_edit}} e ON e.shipment_id = i.shipment_id)""",
)

# --- quality ------------------------------------------------------------------------------------------------------

NAMES = {r[0]: r[1] for r in fv.FIELD_RULES}


def _row(kind: str, order: str, message: str | None = None, field: str | None = None, part: str = "0") -> str:
    category, severity, text, where, action, impact = fv.ERROR_TEXTS[kind]
    return (
        f"SELECT doc_id, {order} AS ord, {part} AS part, {q(category)} AS category, {q(severity)} AS severity, {message or q(text)} AS message, "
        f"{field or q(where)} AS field, {q(action)} AS suggested_action, {q(impact)} AS impact"
    )


def _names_if(fields: list[str], names: bool) -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {absent(f)} THEN {q(NAMES[f] if names else f)} END" for f in fields) + ")"


def _count_if(fields: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {absent(f)} THEN 1 ELSE 0 END" for f in fields) + ")"


def _with(kind: str, value: str) -> str:
    before, after = fv.ERROR_TEXTS[kind][2].replace("%%", "%").split("%s")
    return f"{q(before)} || {value} || {q(after)}"


def loose(x: str) -> str:
    return as_double(f"replace(replace({x}, ',', ''), '$', '')")


WATCHED = fv.CRITICAL_FIELDS + fv.IMPORTANT_FIELDS + fv.OPTIONAL_FIELDS
SHARE = "(" + " + ".join(f"CASE WHEN {absent(f)} THEN 0 ELSE 1 END" for f in WATCHED) + f") / {len(WATCHED)} * 100"
RULE_BRANCHES = {
    "ocr_quality": [
        _row("fallback", "1") + " FROM {v_doc} WHERE metodo_procesamiento = 'fallback'",
        _row("ocr_text", "2", _with("ocr_text", "m"), part="i")
        + " FROM (SELECT doc_id, unnest(string_split(errores_txt, '|')) AS m, generate_subscripts(string_split(errores_txt, '|'), 1) AS i"
        + " FROM {v_doc}) WHERE " + " OR ".join(f"contains(lower(m), {q(k)})" for k in fv.OCR_KEYWORDS),
        _row("many_critical", "3", _with("many_critical", _names_if(fv.CRITICAL_FIELDS, False)))
        + f" FROM {{v_doc}} WHERE {_count_if(fv.CRITICAL_FIELDS)} >= 2",
    ],
    "field_validation": [
        _row("field_required", "4", "message", "field", "rule_no * 10 + part") + " FROM msgs WHERE required",
        _row("field_optional", "4", "message", "field", "rule_no * 10 + part") + " FROM msgs WHERE NOT required",
    ],
    "document_structure": [
        _row("no_type", "5") + " FROM {v_doc} WHERE coalesce(tipo_documento, '') IN ('', 'PDF_SIN_TEXTO')",
        _row("no_typical_fields", "6") + " FROM {v_doc} WHERE "
        + " AND ".join(absent(f) for f in ("numero_bl", "numero_contenedor", "valor_factura", "incoterm")),
        _row("fob_without_value", "7")
        + " FROM {v_doc} WHERE incoterm = 'FOB' AND coalesce(valor_fob, 'No detectado') = 'No detectado'",
    ],
    "data_completeness": [
        _row("critical_missing", "8", _with("critical_missing", _names_if(fv.CRITICAL_FIELDS, True)))
        + f" FROM {{v_doc}} WHERE {_count_if(fv.CRITICAL_FIELDS)} > 0",
        _row("important_missing", "9", _with("important_missing", _names_if(fv.IMPORTANT_FIELDS, True)))
        + f" FROM {{v_doc}} WHERE {_count_if(fv.IMPORTANT_FIELDS)} >= 3",
        _row("low_completeness", "10", _with("low_completeness", f"printf('%.1f', {SHARE})")) + f" FROM {{v_doc}} WHERE {SHARE} < 50",
    ],
    "calculation_errors": [
        _row("cif_not_above_fob", "11") + f" FROM {{v_doc}} WHERE conversion_fob_cif AND {loose('valor_cif')} <= {loose('valor_fob')}",
        _row("ratio_high", "12", _with("ratio_high", "printf('%.2f', ratio)"))
        + f" FROM (SELECT doc_id, conversion_fob_cif, CASE WHEN {loose('valor_fob')} > 0 THEN {loose('valor_cif')} / {loose('valor_fob')} END"
        + " AS ratio FROM {v_doc}) WHERE conversion_fob_cif AND ratio > 1.5",
        _row("conversion_not_numeric", "13")
        + f" FROM {{v_doc}} WHERE conversion_fob_cif AND ({loose('valor_cif')} IS NULL OR {loose('valor_fob')} IS NULL)",
        *[
            _row("negative", "14", q(fv.ERROR_TEXTS["negative"][2] % NAMES[f]), q(f), str(i))
            + f" FROM {{v_doc}} WHERE NOT {absent(f)} AND {loose(f)} < 0"
            for i, f in enumerate(fv.NUMERIC_FIELDS)
        ],
        *[
            _row("not_numeric", "14", q(fv.ERROR_TEXTS["not_numeric"][2] % NAMES[f]), q(f), str(i))
            + f" FROM {{v_doc}} WHERE NOT {absent(f)} AND {loose(f)} IS NULL"
            for i, f in enumerate(fv.NUMERIC_FIELDS)
        ],
    ],
}


def errors_cte(categories) -> str:
    return "errs AS (" + "\nUNION ALL ".join(b for c in categories for b in RULE_BRANCHES[c]) + ")"


ERROR_LIST = "SELECT doc_id, category, severity, message, field, suggested_action, impact FROM errs"
for _name, _category in {
    "a1_ocr_errors": "ocr_quality",
    "a4_validation_errors": "field_validation",
    "a5_structure_errors": "document_structure",
    "a8_completeness_errors": "data_completeness",
    "a11_calculation_errors": "calculation_errors",
}.items():
    _extra = (*CHECKS, MESSAGES) if _category == "field_validation" else ()
    oracle(_name, ERROR_LIST, *_extra, errors_cte([_category]))
ALL_ERRORS = (*CHECKS, MESSAGES, errors_cte(RULE_BRANCHES))
NUMBERED = "row_number() OVER (PARTITION BY doc_id ORDER BY ord, part)"
oracle(
    "a16_document_errors",
    f"SELECT doc_id, CAST({NUMBERED} AS INTEGER) AS seq, category, severity, field, message FROM errs", *ALL_ERRORS,
)
oracle(
    "e16_error_rollup",
    f"""SELECT category, count(e.doc_id) AS n FROM (SELECT unnest([{listed(c[0] for c in fv.ERROR_CATEGORIES)}]) AS category)
  LEFT JOIN errs e USING (category) GROUP BY category""",
    *ALL_ERRORS,
)
DETECTED = " + ".join(f"CASE WHEN {absent(r[0])} THEN 0 ELSE 1 END" for r in fv.FIELD_RULES)
METRICS = f"""base AS (SELECT count(*) AS docs, (SELECT count(DISTINCT doc_id) FROM errs) AS bad, (SELECT count(*) FROM errs) AS n_errors,
    sum({DETECTED}) AS detected FROM {{v_doc}}),
metrics AS (SELECT docs AS total_documents, bad AS documents_with_errors, n_errors AS total_errors,
  round(bad / docs * 100, 2) AS error_rate, round(100 - bad / docs * 100, 2) AS success_rate,
  round(detected * 100.0::DOUBLE / (docs * 12), 2) AS average_completeness,
  round(((100 - bad / docs * 100) + detected * 100.0::DOUBLE / (docs * 12)) / 2, 2) AS quality_score FROM base)"""
RATES = "rates AS (" + " UNION ALL ".join(
    f"SELECT {i} AS pos, {q(r[0])} AS field, {q(r[1])} AS name, round(count(CASE WHEN NOT {absent(r[0])} THEN 1 END) / count(*) * 100, 1) AS rate FROM {{v_doc}}"
    for i, r in enumerate(fv.FIELD_RULES)
) + ")"
SHARES = f"""shares AS (SELECT severity, name, count(e.doc_id) AS n, round(count(e.doc_id) / (SELECT count(*) FROM errs) * 100, 1) AS percentage
  FROM (VALUES {', '.join(f'({q(c)}, {q(n)})' for c, n, _ in fv.ERROR_SEVERITIES)}) s(severity, name) LEFT JOIN errs e USING (severity)
  GROUP BY severity, name)"""
oracle("e17_quality_metrics", "SELECT * FROM metrics", *ALL_ERRORS, METRICS)
oracle(
    "e18_detection_rates",
    "SELECT field, rate, name, CASE WHEN rate >= 90 THEN 'Excelente' WHEN rate >= 70 THEN 'Bueno' ELSE 'Necesita Mejora' END "
    "AS label FROM rates",
    RATES,
)
oracle("e19_severity_distribution", "SELECT severity, n, percentage FROM shares", *ALL_ERRORS, SHARES)


def named(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in names.items()) + f" ELSE {column} END"


oracle(
    "e20_processing_statistics",
    f"""SELECT metric, value, count(*) AS n, CASE metric WHEN 'processing_methods' THEN {named('value', fv.METHOD_NAMES)}
    WHEN 'document_types' THEN {named('value', fv.DOCUMENT_TYPE_NAMES)} ELSE value END AS name
  FROM (SELECT 'processing_methods' AS metric, coalesce(metodo_procesamiento, 'unknown') AS value FROM {{v_doc}}
    UNION ALL SELECT 'document_types', coalesce(tipo_documento, 'unknown') FROM {{v_doc}}
    UNION ALL SELECT 'incoterms', incoterm FROM {{v_doc}} WHERE incoterm <> 'No detectado'
    UNION ALL SELECT 'currencies', moneda FROM {{v_doc}} WHERE moneda <> 'No detectado') GROUP BY metric, value""",
)
oracle("e21_errors_by_document", "SELECT doc_id, CAST(count(*) AS INTEGER) AS n_errors FROM errs GROUP BY doc_id", *ALL_ERRORS)


def _advice() -> str:
    parts = []
    fills = {
        "error_rate": ("(SELECT error_rate FROM metrics) > 50", None),
        "ocr": ("(SELECT count(*) FROM errs WHERE category = 'ocr_quality') > 0",
                "(SELECT CAST(count(*) AS VARCHAR) FROM errs WHERE category = 'ocr_quality')"),
        "completeness": ("(SELECT average_completeness FROM metrics) < 70",
                         "(SELECT printf('%.1f', average_completeness) FROM metrics)"),
        "low_fields": ("(SELECT count(*) FROM rates WHERE rate < 50) > 0",
                       "(SELECT string_agg(name, ', ' ORDER BY pos) FROM rates WHERE rate < 50)"),
    }
    for i, (rule, (condition, fill)) in enumerate(fills.items()):
        priority, category, title, description, actions = fv.RECOMMENDATIONS[rule]
        pieces = description.replace("%%", "%").split("%s")
        text = f" || {fill} || ".join(q(p) for p in pieces) if fill else q(pieces[0])
        parts.append(
            f"SELECT {i} AS ord, {fv.PRIORITY_ORDER.index(priority)}::BIGINT AS rank, {q(priority)} AS priority, {q(category)} AS category, "
            f"{q(title)} AS title, {text} AS description, {q('|'.join(actions))} AS actions WHERE {condition}"
        )
    return "advice AS (" + " UNION ALL ".join(parts) + ")"


ADVICE = (*ALL_ERRORS, METRICS, RATES, _advice())
oracle("q1_recommendations", "SELECT rank, priority, category, title, description, actions FROM advice", *ADVICE)
POOR = [c.replace("{v_doc}", "{v_doc_poor}") for c in ADVICE]
oracle("q1_recommendations_poor", "SELECT rank, priority, category, title, description, actions FROM advice", *POOR)
oracle(
    "e18_detection_rates_poor",
    "SELECT field, rate, name, CASE WHEN rate >= 90 THEN 'Excelente' WHEN rate >= 70 THEN 'Bueno' ELSE 'Necesita Mejora' END "
    "AS label FROM rates",
    RATES.replace("{v_doc}", "{v_doc_poor}"),
)
oracle(
    "q6_overview",
    "SELECT success_rate, total_errors, documents_with_errors, average_completeness, quality_score FROM metrics",
    *ALL_ERRORS, METRICS,
)
oracle(
    "k8_overview",
    " UNION ALL ".join(
        f"SELECT {q(label)} AS label, CAST({c} AS DOUBLE) AS value FROM metrics"
        for label, c in zip(fv.QUALITY_LABELS, ["total_documents", "documents_with_errors", "success_rate",
                                                "average_completeness", "quality_score"])
    ),
    *ALL_ERRORS, METRICS,
)
oracle(
    "k8_error_list",
    f"""SELECT doc_id AS "Documento", CAST({NUMBERED} AS INTEGER) AS seq,
  {named('category', {c: n for c, n, _ in fv.ERROR_CATEGORIES})} AS "Categoría",
  {named('severity', {c: n for c, n, _ in fv.ERROR_SEVERITIES})} AS "Severidad", field AS "Campo", message AS "Mensaje",
  suggested_action AS "Acción Sugerida", impact AS "Impacto" FROM errs""",
    *ALL_ERRORS,
)
oracle(
    "k8_metrics",
    "SELECT 'detection' AS section, name AS label, rate AS value FROM rates UNION ALL SELECT 'severity', name, percentage FROM shares",
    *ALL_ERRORS, RATES, SHARES,
)
oracle(
    "k8_recommendations",
    """SELECT CAST(no AS INTEGER) AS rec_no, CAST(i - 1 AS INTEGER) AS line_no, line FROM (SELECT no, unnest(lines) AS line,
    generate_subscripts(lines, 1) AS i FROM (SELECT no, list_concat([CAST(no AS VARCHAR) || '. ' || title,
      'Prioridad: ' || upper(priority), description, 'Acciones recomendadas:'],
      string_split('• ' || replace(actions, '|', '|• '), '|')) AS lines
    FROM (SELECT *, ord + 1 AS no FROM (SELECT * REPLACE (row_number() OVER (ORDER BY ord) - 1 AS ord) FROM advice))))""",
    *ADVICE,
)
for _name in list(ORACLES):
    finish_patterns(_name)

# --- intake -----------------------------------------------------------------------------------------------------------

SIZE = """CASE WHEN length < 1024 THEN CAST(length AS VARCHAR) || ' B' WHEN length < 1048576 THEN printf('%.1f KB', length / 1024)
  ELSE printf('%.1f MB', length / 1048576) END"""
FILE_ERROR = f"""CASE WHEN length > 10485760 THEN 'Archivo demasiado grande (' || ({SIZE}) || '). Máximo permitido: 10MB'
  WHEN NOT ({' OR '.join(f"ends_with(lower(name), {q(e)})" for e in fv.ALLOWED_EXTENSIONS)}) THEN {q(fv.FILE_TYPE_NOT_ALLOWED)} END"""
oracle(
    "s2_file_check",
    f"""SELECT doc_id, error IS NULL AS valid, CASE WHEN error IS NULL THEN CASE WHEN ends_with(lower(name), '.pdf') THEN 'PDF'
    ELSE 'Imagen' END END AS type, CASE WHEN error IS NULL THEN label END AS size, error,
  CASE WHEN ends_with(lower(name), '.pdf') THEN 'pdf' ELSE 'image' END AS file_type
  FROM (SELECT *, {SIZE} AS label, {FILE_ERROR} AS error FROM {{v_file}})""",
)
oracle("s4_size_label", f"SELECT doc_id, {SIZE} AS size_label FROM {{v_file}}")
oracle(
    "s7_page_text",
    """SELECT doc_id, CAST(0 AS BIGINT) AS part_no, CAST(count(*) AS INTEGER) AS n_pages,
  string_agg(coalesce(text, ''), chr(10) ORDER BY page_no) AS text FROM {v_page_text} GROUP BY doc_id""",
)
ORACLES["s8_extraction_mode"] = f"""SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '^{SPACE}+|{SPACE}+$', '', 'g')) > 150
  THEN 'text' ELSE 'image' END AS mode FROM documents"""
oracle(
    "s8_image_pages", "SELECT doc_id, count(*) AS n_pages FROM {v_page_text} WHERE page_no + 1 <= 5 GROUP BY doc_id",
)
ORACLES["s9_answer_parse"] = f"""WITH {with_views(['v_answer'])},
found AS (SELECT answer_id, coalesce(text, '') AS said, coalesce(nullif(regexp_extract(text, '```json\\s*(\\{{.*?\\}})\\s*```', 1, 's'), ''),
  nullif(regexp_extract(text, '(\\{{.*?\\}})', 1, 's'), '')) AS j FROM v_answer)
SELECT answer_id, CASE WHEN json_valid(j) THEN try_cast(json_extract_string(j, '$.k') AS BIGINT) END AS k,
  CASE WHEN j IS NULL THEN 'La IA no devolvió un JSON. Respuesta recibida: ' || substring(said, 1, 500) || '...'
    WHEN NOT json_valid(j) THEN {q(fv.BAD_JSON_ERROR)} END AS error FROM found"""
oracle(
    "s10_typed_bl",
    """SELECT shipment_id, bl_number, booking_number, container_no, vessel_voyage, port_of_loading, port_of_discharge,
  place_of_delivery, date_laden_on_board, cargo_type, freight_cost, packages_count, gross_weight, gross_measurement,
  exporter_name, exporter_address, exporter_phone, consignee_name, consignee_address, consignee_phone,
  CAST(NULL AS VARCHAR) AS error FROM {v_bl}""",
)
oracle(
    "s10_typed_items",
    """SELECT shipment_id, invoice_idx, row_number() OVER (PARTITION BY shipment_id, invoice_idx ORDER BY item_idx, quantity) - 1 AS item_idx,
  part_number, description, quantity, unit_price, total_price FROM {v_item}""",
)
oracle(
    "s11_session_payload",
    """SELECT id, CAST(CASE WHEN starts_with(session_data, '{') THEN len(json_keys(session_data)) ELSE 0 END AS INTEGER) AS n_keys,
  CASE WHEN starts_with(session_data, '{') THEN json_extract_string(session_data, '$.k') END AS k FROM {v_session}""".replace(
        "'{'", "chr(123)"
    ),
)

# --- batches ----------------------------------------------------------------------------------------------------------------

OUTCOME = FILE_ERROR.replace("length", "size").replace("lower(name)", "lower(filename)")
oracle(
    "u4_file_outcomes",
    f"""SELECT job_id, file_index, e IS NULL AS success, e AS error, CASE WHEN e IS NULL THEN filename END AS archivo,
  CASE WHEN e IS NULL THEN file_index END AS indice_archivo,
  CASE WHEN e IS NULL THEN CASE WHEN ends_with(lower(filename), '.pdf') THEN 'pdf' ELSE 'image' END END AS tipo_archivo,
  CASE WHEN e IS NULL THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS fecha_procesamiento,
  CASE WHEN e IS NULL THEN coalesce(metodo_procesamiento, 'desconocido') END AS metodo_procesamiento
  FROM (SELECT *, coalesce({OUTCOME}, CASE WHEN NOT has_result THEN {q(fv.FILE_NOT_PROCESSED)} END) AS e FROM {{v_job_file}})""",
)
oracle(
    "p5_batch_guard",
    """SELECT job_id, refused IS NULL AS accepted, refused FROM (SELECT job_id, CASE WHEN trim(name) = ''
    THEN 'Debe ingresar un nombre para el lote' WHEN total_files > 50 THEN 'Máximo 50 archivos por lote' END AS refused FROM {v_job})""",
)
FINISHED = "status = 'completed' AND start_time IS NOT NULL AND end_time IS NOT NULL"
oracle("p7_finished_jobs", f"SELECT job_id, status FROM {{v_job}} WHERE {FINISHED}")
oracle(
    "e22_batch_totals",
    """SELECT n_jobs, processed_files, failed_files, total_files, processed_files / total_files * 100 AS success_rate,
  total_files / n_jobs AS files_per_job FROM (SELECT count(*) AS n_jobs, CAST(sum(processed_files) AS BIGINT) AS processed_files,
    CAST(sum(failed_files) AS BIGINT) AS failed_files, CAST(sum(total_files) AS BIGINT) AS total_files FROM {v_job})""",
)
oracle("e23_job_status", "SELECT status, count(*) AS n FROM {v_job} GROUP BY status")
oracle(
    "e24_time_metrics",
    f"""SELECT n_jobs, secs / processed AS seconds_per_file, secs / 60 / n_jobs AS minutes_per_job FROM (SELECT count(*) AS n_jobs,
    CAST(sum(CAST(date_diff('microsecond', start_time, end_time) / 1e6 AS DECIMAL(28,6))) AS DOUBLE) AS secs,
    sum(processed_files) AS processed FROM {{v_job}} WHERE {FINISHED})""",
)
oracle(
    "e25_job_progress",
    """SELECT job_id, (processed_files + failed_files) / total_files * 100 AS progress_percentage,
  processed_files / total_files * 100 AS success_rate, total_files - (processed_files + failed_files) AS remaining,
  date_diff('microsecond', start_time, end_time) / 1e6 AS elapsed_seconds FROM {v_job}""",
)
oracle(
    "e26_job_counts",
    """SELECT job_id, count(*) AS total_files, count(CASE WHEN success THEN 1 END) AS processed_files,
  count(CASE WHEN NOT success THEN 1 END) AS failed_files FROM {v_job_file} GROUP BY job_id""",
)
oracle(
    "e26_job_errors",
    "SELECT job_id, file_index, filename, coalesce(error, 'Unknown error') AS error FROM {v_job_file} WHERE NOT success",
)
oracle("e26_job_results", "SELECT job_id, file_index, filename FROM {v_job_file} WHERE success")
oracle(
    "e27_upload_summary",
    """SELECT job_id, count(*) AS n_files, CAST(sum(size) AS DOUBLE) / 1048576 AS total_mb, count(*) * 10 / 60 AS minutes_low,
  count(*) * 30 / 60 AS minutes_high FROM {v_job_file} GROUP BY job_id""",
)
oracle("o3_latest_jobs", "SELECT job_id, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time FROM {v_job}")
for _name, _where, _n in (("o5_first_files", "true", 10), ("o5_first_errors", "NOT success", 5)):
    oracle(
        _name,
        f"""SELECT job_id, file_index, filename, n_more FROM (SELECT job_id, file_index, filename,
    row_number() OVER (PARTITION BY job_id ORDER BY file_index) AS r,
    greatest(count(*) OVER (PARTITION BY job_id) - {_n}, 0) AS n_more FROM {{v_job_file}} WHERE {_where}) WHERE r <= {_n}""",
    )

# --- sessions -------------------------------------------------------------------------------------------------------------------

oracle(
    "o1_recent_sessions",
    """SELECT id, session_name, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, total_documents FROM {v_session} AS s
  ORDER BY s.updated_at DESC, id LIMIT 50""",
)
ORACLES["j9_session_load"] = f"""WITH {with_views(['v_session', 'v_session_doc'])},
f AS (SELECT * FROM v_session_doc QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY document_index) = 1)
SELECT s.id AS session_id, session_name, CASE WHEN edited_data IS NOT NULL THEN edited_data WHEN original_data IS NOT NULL THEN
  '{{"bl_data": ' || CASE WHEN starts_with(original_data, '{{') THEN original_data ELSE '{{}}' END || ', "all_invoices_data": []}}' END AS payload
FROM v_session s LEFT JOIN f ON f.session_id = s.id"""
oracle(
    "j10_orphan_documents",
    """SELECT session_id, document_index FROM {v_session_doc} WHERE session_id NOT IN
  (SELECT id FROM {v_session} WHERE processing_status <> 'archivada')""",
)
oracle("u2_delete_sessions", "SELECT id, processing_status FROM {v_session} WHERE processing_status <> 'archivada'")
oracle(
    "u2_delete_documents",
    """SELECT session_id, document_index FROM {v_session_doc} JOIN {v_session} ON id = session_id
  WHERE processing_status <> 'archivada'""",
)
oracle(
    "u3_update_notes",
    """SELECT id, CASE WHEN processing_status = 'completed' THEN 'revisada ' || id ELSE user_notes END AS user_notes,
  CASE WHEN processing_status = 'completed' THEN '2024-02-01 12:30:00' ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
  FROM {v_session}""",
)
SETS = """sets AS (SELECT set_id, min(session_name) AS session_name, min(user_notes) AS user_notes, count(*) AS n, count(edited_data) AS edits,
  CASE WHEN count(edited_data) = 0 AND arg_min(error IS NOT NULL, document_index) THEN 1 ELSE 0 END AS bad FROM {v_working_set}
  GROUP BY set_id)"""
_META = """'{"total_documents":' || n || ',"documents_with_errors":' || bad || ',"edited_count":' || edits ||
  ',"timestamp":"2024-02-01T12:30:00","processing_complete":true,"validation_mode":' || (edits > 0) || ',"consolidated_flow":true}'"""
oracle(
    "u1_save_sessions",
    """SELECT md5('session|' || set_id || '|2024-02-01T12:30:00.000000') AS id, session_name, user_notes, n AS total_documents, CAST(bad AS BIGINT) AS documents_with_errors,
  'completed' AS processing_status, META AS session_data, '2024-02-01 12:30:00' AS created_at FROM sets""",
    SETS,
)
ORACLES["u1_save_sessions"] = ORACLES["u1_save_sessions"].replace("META", _META)
oracle(
    "u1_save_documents",
    """SELECT md5('document|' || set_id || '|2024-02-01T12:30:00.000000|' || document_index) AS id,
  md5('session|' || set_id || '|2024-02-01T12:30:00.000000') AS session_id, document_index,
  coalesce(bl_number, 'Documento_' || (document_index + 1)) AS filename, original_data, edited_data,
  CASE WHEN edited_data IS NULL THEN 'original' ELSE 'edited' END AS validation_status, CAST(bad AS BIGINT) AS error_count
  FROM {v_working_set} JOIN sets USING (set_id)""",
    SETS,
)
for _name in ("k10_session_append", "k10_committed_sessions"):
    oracle(_name, "SELECT md5('session|' || set_id || '|2024-02-01T12:30:00.000000') AS id, session_name, n AS n_documents FROM sets", SETS)
oracle(
    "e28_session_statistics",
    """SELECT count(*) AS total_sessions, CAST(sum(total_documents) AS BIGINT) AS total_documents_processed,
  CAST(sum(documents_with_errors) AS BIGINT) AS total_documents_with_errors, avg(total_documents) AS avg_documents_per_session,
  strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_session_date,
  count(CASE WHEN created_at >= DATE '2024-02-01' - INTERVAL 30 DAY THEN 1 END) AS recent_sessions,
  sum(documents_with_errors) / sum(total_documents) * 100 AS error_rate FROM {v_session}""",
)
oracle(
    "e29_sessions_by_status",
    f"""SELECT processing_status, count(*) AS n, {named('processing_status', fv.SESSION_STATUS_NAMES)} AS name
  FROM {{v_session}} GROUP BY processing_status""",
)
oracle("p6_recent_sessions", "SELECT id FROM {v_session} WHERE created_at >= DATE '2024-02-01' - INTERVAL 30 DAY")

# --- services --------------------------------------------------------------------------------------------------------------------

CODE = "CASE descripcion " + " ".join(f"WHEN {q(d)} THEN {q(c)}" for c, d, _ in fv.SERVICES) + " ELSE 'GEN-001' END"
LINES = f"""lines AS (SELECT invoice_id, line_no, {CODE} AS codigo, descripcion, coalesce(quantity, 1.0) AS cantidad,
  coalesce(price, 0.0) AS precio_unitario, coalesce(quantity, 1.0) * coalesce(price, 0.0) AS total FROM {{v_selection}})"""
BILLS = f"""bills AS (SELECT *, subtotal * 0.15 AS isv, subtotal + subtotal * 0.15 AS total_pagar FROM (SELECT invoice_id, count(*) AS n_lines,
  {cents('total')} AS subtotal FROM lines GROUP BY invoice_id))"""
oracle("j4_service_lines", "SELECT * FROM lines", LINES)
oracle("e11_invoice_totals", "SELECT * FROM bills", LINES, BILLS)
oracle(
    "e12_selection_preview",
    "SELECT invoice_id, line_no, descripcion, cantidad, total, subtotal AS estimate FROM lines JOIN bills USING (invoice_id)",
    LINES, BILLS,
)
oracle(
    "n4_selection_lines",
    """SELECT o_orderkey AS invoice_id, 0 AS line_no, 'ALM-001' AS codigo, 'Almacenaje Fiscal' AS descripcion,
  CAST(o_orderkey % 5 AS DOUBLE) AS cantidad, 75.5::DOUBLE AS precio_unitario, (o_orderkey % 5) * 75.5::DOUBLE AS total FROM {orders}
  UNION ALL SELECT o_orderkey, 1, 'GEN-001', 'Otro', 1.0, o_totalprice, o_totalprice FROM {orders}""",
)


def long_date(x: str) -> str:
    months = " ".join(f"WHEN {i} THEN {q(m)}" for i, m in enumerate(fv.MONTH_NAMES, 1))
    return f"strftime({x}, '%d') || ' de ' || CASE month({x}) {months} END || ' de ' || strftime({x}, '%Y')"


DATES = f"{long_date('issued')} AS fecha, {long_date('(issued + INTERVAL 1 MONTH)')} AS fecha_vencimiento"
oracle("f18_invoice_dates", f"SELECT invoice_id, {DATES} FROM {{v_client}}")
CLIENT = """coalesce(nullif(cliente_preview, ''), consignee_name, 'CLIENTE GENÉRICO S.A.') AS cliente,
  coalesce(nullif(rtn_preview, ''), '00000000000000') AS rtn,
  coalesce(nullif(direccion_preview, ''), consignee_address, 'CIUDAD GENÉRICA, PAÍS') AS direccion, coalesce(bl_number, '') AS bl_number"""
oracle("f19_client_block", f"SELECT invoice_id, {CLIENT} FROM {{v_client}}")
oracle(
    "k9_service_invoice",
    f"""SELECT c.invoice_id, CAST(0 AS BIGINT) AS part_no, {CLIENT}, {DATES}, n_lines, subtotal, isv, total_pagar, items
  FROM {{v_client}} c JOIN bills USING (invoice_id) JOIN (SELECT invoice_id,
    string_agg(concat_ws('/', codigo, line_no, descripcion, cantidad::DECIMAL(18,2), precio_unitario::DECIMAL(18,2),
      total::DECIMAL(18,2)), ',' ORDER BY line_no, codigo, descripcion, cantidad, precio_unitario) AS items FROM lines GROUP BY 1) USING (invoice_id)""",
    LINES, BILLS,
)

# --- scalar functions ------------------------------------------------------------------------------------------------------------------

ORACLES["f1_normalize_text"] = f"SELECT doc_id, {bare('text')} AS normalized FROM documents"
ORACLES["f2_description_key"] = f"""SELECT doc_id, regexp_replace(regexp_replace(lower(text), '{SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS key
FROM documents"""
oracle("f3_safe_float", f"SELECT id, coalesce({as_double('txt')}, 0.0) AS n FROM {{v_value}}")
oracle("f4_safe_str", "SELECT id, coalesce(txt, '') AS s FROM {v_value}")
oracle("f5_safe_numeric", f"""SELECT id, coalesce({as_double("replace(txt, ',', '')")}, 0.0) AS n FROM {{v_value}}""")
oracle(
    "f6_clean_value",
    f"""SELECT id, CASE WHEN txt IS NULL OR txt IN ({listed(fv.MISSING_TEXTS)}) OR trim(txt) = '' THEN 'No detectado'
  ELSE trim(regexp_replace(txt, '\\s+', ' ', 'g')) END AS cleaned FROM {{v_value}}""",
)
_CLEAN = "trim(replace(replace(replace(txt, '$', ''), ',', ''), 'USD', ''))"
oracle(
    "f7_numeric_check",
    f"""SELECT id, NOT gone AND number IS NOT NULL AS valid, CASE WHEN gone THEN 'No detectado' WHEN number IS NOT NULL THEN cleaned
    ELSE txt END AS value, CASE WHEN gone THEN 'Flete no detectado' WHEN number IS NULL THEN 'Flete no es un valor numérico válido' END AS error
  FROM (SELECT id, txt, {absent('txt')} AS gone, {_CLEAN} AS cleaned, {as_double(_CLEAN)} AS number FROM {{v_value}})""",
)
_AMOUNT = "replace(replace(upper(txt), '$', ''), ',', '')"
for _code in fv.CURRENCIES:
    _AMOUNT = f"replace({_AMOUNT}, {q(_code)}, '')"
oracle(
    "f8_currency_split",
    f"""SELECT id, CASE WHEN {absent('txt')} THEN 'No detectado' {' '.join(f"WHEN contains(upper(txt), {q(c)}) THEN {q(c)}" for c in fv.CURRENCIES)}
    ELSE 'USD' END AS currency, CASE WHEN NOT {absent('txt')} AND {as_double('a')} IS NOT NULL THEN trim(a) ELSE 'No detectado' END AS amount
  FROM (SELECT id, txt, {_AMOUNT} AS a FROM {{v_value}})""",
)
oracle("f9_number_parser", "SELECT id, as_float, as_int FROM nums", numbers_of("{v_value}", "id", ["txt"], "nums"))

# Other ways to the same rows.
for _name, _same in {
    "e4_freight_sliced": "e4_freight_shipment",
    "e6_freight_sliced": "e6_freight_invoice",
    "n1_item_numbers_sliced": "n1_item_numbers",
}.items():
    ORACLES[_name] = ORACLES[_same]
