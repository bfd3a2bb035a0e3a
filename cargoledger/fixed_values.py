"""Texts, lists and rates that results must reproduce exactly.

Nothing here is logic. Order matters where a list is searched in order.
"""

# --- Fixed values: sentinels -------------------------------------------------
NOT_DETECTED = "No detectado"
MISSING_TEXTS = ["", "No detectado", "None", "null"]
PENDING_CODE = "PENDIENTE"
UNTRANSLATED_TEXTS = ["no detectado", "s/m", "por definir", "null"]
TRANSLATION_ERROR_PREFIX = "ERROR_TRADUCCION"

# --- Fixed values: codes -----------------------------------------------------
CURRENCIES = ["USD", "EUR", "COP", "PEN", "MXN", "CLP", "ARS"]
INCOTERMS = ["FOB", "CIF", "EXW", "CFR", "DAP", "DDP"]

# --- Fixed values: rates and limits ------------------------------------------
INSURANCE_RATE = 0.015
CIF_MARKUP = 1.15
SERVICE_TAX_RATE = 0.15
MAX_FILE_BYTES = 10 * 1024 * 1024
MIN_TEXT_CHARS = 150
MAX_IMAGE_PAGES = 5
MAX_BATCH_FILES = 50
SECONDS_PER_FILE_LOW = 10
SECONDS_PER_FILE_HIGH = 30
RECENT_DAYS = 30
SESSION_LIST_LIMIT = 50

# --- Fixed values: file checks -----------------------------------------------
ALLOWED_EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp"]
FILE_TOO_LARGE = "Archivo demasiado grande (%s). Máximo permitido: 10MB"
FILE_TYPE_NOT_ALLOWED = "Tipo de archivo no permitido. Use: PDF, PNG, JPG, JPEG, TIFF, BMP"
FILE_NOT_PROCESSED = "No se pudo procesar el documento"
UNKNOWN_METHOD = "desconocido"

# --- Fixed values: model-answer parsing --------------------------------------
FENCED_JSON_PATTERN = r"(?s)```json\s*(\{.*?\})\s*```"
BARE_JSON_PATTERN = r"(?s)(\{.*?\})"
BAD_JSON_ERROR = "JSON mal formado en la respuesta de la IA."
NO_JSON_ERROR = "La IA no devolvió un JSON. Respuesta recibida: %s..."

# --- Fixed values: default tariff catalog, in order ---------------------------
DEFAULT_CATALOG = [
    ("blusa para dama", "6206.40.00.00.00"),
    ("calzado para dama", "6404.19.90.00.00"),
]

# --- Fixed values: catalog header targets and keywords ------------------------
CATALOG_HEADER_KEYWORDS = {
    "Descripción Producto (Español)": ["descripcion", "producto", "articulo", "item", "nombre"],
    "Posicion_Arancelaria": ["posicion", "arancel", "clasificacion", "codigo", "partida"],
}

# --- Fixed values: service price list ----------------------------------------
SERVICES = [
    ("SERV-001", "Servicio de Trámite Aduanal", 150.00),
    ("LOG-001", "Logística y Transporte Local", 200.00),
    ("ALM-001", "Almacenaje Fiscal", 75.50),
    ("DOC-001", "Manejo de Documentación", 50.00),
    ("IMP-001", "Impuestos de Importación", 0.00),
]
GENERIC_SERVICE_CODE = "GEN-001"
GENERIC_CLIENT = "CLIENTE GENÉRICO S.A."
GENERIC_TAX_ID = "00000000000000"
GENERIC_ADDRESS = "CIUDAD GENÉRICA, PAÍS"

# --- Fixed values: the twelve document fields and their rules -----------------
# (field, display name, type, required, rule, description)
FIELD_RULES = [
    ("numero_bl", "Número de BL", "text", True, {"pattern": r"^[A-Z0-9\-]+$"},
     "Formato: Letras mayúsculas, números y guiones"),
    ("exportador", "Exportador", "text", True, {"min_length": 2}, "Nombre completo del exportador"),
    ("consignatario", "Consignatario", "text", True, {"min_length": 2}, "Nombre completo del consignatario"),
    ("valor_flete", "Valor del Flete", "currency", False, {"min_value": 0}, "Valor numérico del flete"),
    ("bultos", "Bultos", "integer", False, {"min_value": 1}, "Número de bultos/paquetes"),
    ("kilos", "Kilos", "decimal", False, {"min_value": 0.1}, "Peso en kilogramos"),
    ("numero_contenedor", "Número de Contenedor", "text", False, {"pattern": r"^[A-Z]{4}[0-9]{7}$"},
     "Formato: 4 letras + 7 números (ej: ABCD1234567)"),
    ("incoterm", "INCOTERM", "select", True, {"options": INCOTERMS}, "Término de comercio internacional"),
    ("valor_factura", "Valor Factura", "currency", False, {"min_value": 0}, "Valor total de la factura"),
    ("valor_fob", "Valor FOB", "currency", False, {"min_value": 0}, "Valor Free On Board"),
    ("valor_cif", "Valor CIF", "currency", False, {"min_value": 0}, "Valor Cost, Insurance and Freight"),
    ("moneda", "Moneda", "select", False, {"options": CURRENCIES}, "Moneda de los valores"),
]
REQUIRED_MESSAGE = "Campo obligatorio: %s"
MIN_LENGTH_MESSAGE = "Mínimo %s caracteres"
PATTERN_MESSAGE = "Formato inválido: %s"
MIN_VALUE_MESSAGE = "Valor mínimo: %s"
OPTION_MESSAGE = "Debe seleccionar una opción válida: %s"

# --- Fixed values: error dimensions -------------------------------------------
ERROR_CATEGORIES = [
    ("ocr_quality", "Calidad OCR", "Problemas relacionados con la extracción de texto"),
    ("field_validation", "Validación de Campos", "Errores en la validación de datos extraídos"),
    ("document_structure", "Estructura del Documento", "Problemas con el formato o tipo de documento"),
    ("data_completeness", "Completitud de Datos", "Campos faltantes o incompletos"),
    ("calculation_errors", "Errores de Cálculo", "Problemas en cálculos automáticos"),
]
ERROR_SEVERITIES = [
    ("critical", "Crítico", 4),
    ("high", "Alto", 3),
    ("medium", "Medio", 2),
    ("low", "Bajo", 1),
]

# --- Fixed values: fields the quality analyzers look at ------------------------
OCR_KEYWORDS = ["texto", "ilegible", "borroso", "calidad"]
CRITICAL_FIELDS = ["numero_bl", "exportador", "consignatario"]
IMPORTANT_FIELDS = ["valor_flete", "bultos", "kilos", "incoterm"]
OPTIONAL_FIELDS = ["numero_contenedor", "valor_factura", "moneda"]
NUMERIC_FIELDS = ["valor_flete", "bultos", "kilos", "valor_factura", "valor_fob", "valor_cif"]
MONEY_FIELDS = ["valor_flete", "valor_factura", "valor_fob", "valor_cif"]

# --- Fixed values: error texts (category, severity, message, field, action, impact) ---
ERROR_TEXTS = {
    "fallback": ("ocr_quality", "critical",
                 "Documento requiere conversión a imagen para procesamiento OCR", "metodo_procesamiento",
                 "Convertir PDF a imagen de alta resolución antes del procesamiento",
                 "No se pudieron extraer datos del documento"),
    "ocr_text": ("ocr_quality", "high", "Problema de calidad en OCR: %s", "general",
                 "Mejorar calidad de imagen o usar documento original",
                 "Datos extraídos pueden ser incorrectos"),
    "many_critical": ("ocr_quality", "high", "Múltiples campos críticos no detectados: %s", "multiple",
                      "Verificar calidad de imagen y orientación del documento",
                      "Documento puede no ser procesable correctamente"),
    "field_required": ("field_validation", "critical", "%s", None,
                       "Revisar y corregir el valor manualmente", "Campo obligatorio faltante"),
    "field_optional": ("field_validation", "medium", "%s", None,
                       "Revisar y corregir el valor manualmente", "Datos incorrectos en el reporte final"),
    "no_type": ("document_structure", "high", "Tipo de documento no identificado o sin texto extraíble",
                "tipo_documento", "Verificar que el documento sea un BL o factura válida",
                "Procesamiento incompleto del documento"),
    "no_typical_fields": ("document_structure", "critical",
                          "No se detectaron campos típicos de BL ni de factura", "general",
                          "Verificar que el documento sea del tipo correcto",
                          "Documento no puede ser procesado correctamente"),
    "fob_without_value": ("document_structure", "medium", "INCOTERM es FOB pero no se detectó valor FOB",
                          "valor_fob", "Verificar si el valor FOB está presente en el documento",
                          "Cálculo CIF puede ser incorrecto"),
    "critical_missing": ("data_completeness", "critical", "Campos críticos faltantes: %s", "multiple",
                         "Completar manualmente los campos críticos",
                         "El documento no puede ser procesado sin estos campos"),
    "important_missing": ("data_completeness", "medium", "Múltiples campos importantes faltantes: %s",
                          "multiple", "Revisar el documento para completar campos faltantes",
                          "Información incompleta para análisis y reportes"),
    "low_completeness": ("data_completeness", "high", "Completitud de datos muy baja: %s%%", "general",
                         "Revisar calidad del documento y procesar nuevamente",
                         "Datos insuficientes para generar reporte confiable"),
    "cif_not_above_fob": ("calculation_errors", "medium", "Valor CIF no es mayor que FOB después de conversión",
                          "valor_cif", "Verificar valores FOB y CIF manualmente",
                          "Cálculo de conversión puede ser incorrecto"),
    "ratio_high": ("calculation_errors", "low", "Ratio CIF/FOB muy alto: %s (esperado ~1.15)",
                   "conversion_fob_cif", "Verificar si los costos de flete y seguro son correctos",
                   "Conversión FOB a CIF puede estar sobrestimada"),
    "conversion_not_numeric": ("calculation_errors", "medium",
                               "No se pudo validar conversión FOB a CIF por valores no numéricos",
                               "conversion_fob_cif", "Verificar que los valores FOB y CIF sean números válidos",
                               "Conversión automática falló"),
    "negative": ("calculation_errors", "medium", "%s tiene valor negativo", None,
                 "Corregir el valor manualmente", "Valor inválido en cálculos"),
    "not_numeric": ("calculation_errors", "low", "%s no es un número válido", None,
                    "Convertir a formato numérico correcto", "Campo no puede ser usado en cálculos"),
}

# --- Fixed values: recommendations (priority, category, title, description, actions) ---
RECOMMENDATIONS = {
    "error_rate": ("critical", "general", "Alta tasa de errores detectada",
                   "Más del 50%% de los documentos tienen errores",
                   ["Verificar calidad de las imágenes/PDFs",
                    "Asegurar que los documentos estén bien orientados",
                    "Revisar que sean documentos BL o facturas válidas"]),
    "ocr": ("high", "ocr_quality", "Problemas de calidad OCR detectados",
            "%s errores relacionados con extracción de texto",
            ["Usar imágenes de mayor resolución (mínimo 300 DPI)",
             "Asegurar buen contraste entre texto y fondo",
             "Convertir PDFs escaneados a imágenes de alta calidad"]),
    "completeness": ("medium", "data_completeness", "Completitud de datos baja", "Completitud promedio: %s%%",
                     ["Revisar manualmente los documentos con más campos faltantes",
                      "Verificar que todos los campos estén visibles en el documento",
                      "Usar la función de edición manual para completar datos"]),
    "low_fields": ("medium", "field_validation", "Campos con baja detección", "Campos problemáticos: %s",
                   ["Verificar ubicación de estos campos en los documentos",
                    "Asegurar que el texto esté claramente legible",
                    "Considerar usar plantillas de documentos estandarizadas"]),
}
PRIORITY_ORDER = ["critical", "high", "medium", "low"]
DETECTION_LABELS = [(90, "Excelente"), (70, "Bueno")]
DETECTION_LABEL_ELSE = "Necesita Mejora"

# --- Fixed values: display names ------------------------------------------------
SESSION_STATUS_NAMES = {
    "completed": "Completado",
    "in_progress": "En Progreso",
    "review_needed": "Necesita Revisión",
}
METHOD_NAMES = {
    "texto_extraido": "Texto Extraído (PDF)",
    "vision_ocr": "OCR con Visión (Imagen)",
    "fallback": "Procesamiento de Respaldo",
    "unknown": "Desconocido",
}
DOCUMENT_TYPE_NAMES = {
    "BL": "Bill of Lading",
    "FACTURA": "Factura",
    "MIXTO": "Documento Mixto",
    "PDF_SIN_TEXTO": "PDF sin Texto",
    "unknown": "Desconocido",
}
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]

# --- Fixed values: report labels -------------------------------------------------
NO_BRAND = "S/M"
NO_PART_NUMBER = "S/C"
NO_DESCRIPTION = "No Desc"
ORIGIN_COUNTRY = "CHINA"
DUTY_RATES = ("20%", "0%", "18%")
SUMMARY_LABELS = ["FACTURA No.", "FECHA", "PROVEEDOR", "BULTOS", "PESO", "VALOR FACTURA", "FLETE", "SEGURO",
                  "VALOR CIF"]
QUALITY_LABELS = ["Total de documentos", "Documentos con errores", "Tasa de éxito (%)",
                  "Completitud promedio (%)", "Puntuación de calidad"]
TEMPLATE_SUMMARY_LABELS = ["Total Documentos Procesados", "Total Kilos", "Total Valor FOB", "Total Valor CIF",
                           "Total Costo Flete BL", "Costo Flete Promedio por Kilo"]
NO_TEMPLATE_DATA = "No hay datos para esta plantilla."

# --- Fixed values: report templates (field, column name, format, calc rule) -----
TEMPLATES = {
    "comercial": [
        ("archivo", "Documento Fuente", "text", None),
        ("numero_bl", "Nº BL", "text", None),
        ("incoterm", "INCOTERM", "text", None),
        ("valor_factura", "Valor Factura", "currency", None),
        ("valor_fob", "Valor FOB Consolidado", "currency", None),
        ("valor_cif", "Valor CIF Consolidado", "currency", None),
        ("diff_fob_cif", "Costo Total Flete/Seguro", "currency", "CIF - FOB"),
    ],
    "logistica": [
        ("numero_bl", "Nº BL", "text", None),
        ("numero_contenedor", "Nº Contenedor", "text", None),
        ("bultos", "Bultos (Total)", "integer", None),
        ("kilos", "Kilos (Total)", "decimal", None),
        ("valor_flete", "Costo Flete BL", "currency", None),
        ("cost_per_kg", "Costo Flete por Kilo", "currency", "Flete / Kilos"),
    ],
}
