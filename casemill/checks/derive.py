"""Report rows derived from the given tables by one SQL text that both engines run.

The tables hold no report forms, so forms are written out of their columns: the number of reports,
studies and distinct texts grows with `part`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casemill import constants as K
from casemill.checks.sql import q
from casemill.session import scratch_dir, spread, table


def _text(*lines: tuple[str, str] | str) -> str:
    """SQL for lines of text; (condition, expression) lines appear only when it holds."""
    parts = []
    for line in lines:
        if isinstance(line, tuple):
            parts.append(f"CASE WHEN {line[0]} THEN {line[1]} || chr(10) ELSE '' END")
        else:
            parts.append(f"{line} || chr(10)")
    return " || ".join(parts)


def _choose(number: str, options: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {q(o)}" for i, o in enumerate(options))
    return f"CASE {number} % {len(options)} {cases} END"


INTERVENTIONS = [
    "TUMORECTOMÍA Y BSGC",
    "Mastectomía radical modificada",
    "MASTECTOMIA SIMPLE + LINFADENECTOMÍA",
    "Cuadrantectomía y biopsia selectiva de ganglio centinela",
    "Exéresis",
    "MRM",
    "Tumorectomia guiada por arpón y BSGC",
    "Ampliación de márgenes",
    "MASTECTOMÍA RADICAL (IZQUIERDA)",
    "tumorectmia mas linfadenectomia",
    "BIOPSIA SELECTIVA GANGLIO CENTINELA / MASTECTOMIA",
    "Extirpación, linfadenectomía axilar y BSG centinela",
]
TYPES = [
    "CARCINOMA DUCTAL INFILTRANTE",
    "Ca. lobulillar infiltrante",
    "CARCINOMA MUCINOSO",
    "CARCINOMA PAPILAR INFILTRANTE",
    "Carcinoma medular atípico",
    "CDI",
    "Sarcoma pleomórfico",
    "CARCINOMA DUCTAL INFILTRANTE CON COMPONENTE IN SITU",
    "ca ductal",
]

_size = "CAST(f % 9 + 1 AS STRING) || ',' || CAST(f % 10 AS STRING)"
# the manual label sheet knows some of the intervention texts (see MANUAL_SQL)
_intervention = (
    f"{_choose('f', INTERVENTIONS)} || CASE WHEN f % 5 = 0 THEN ' pieza ' || CAST(f % 7 AS STRING) "
    "ELSE '' END"
)
FORM1 = _text(
    ("f % 11 <> 0", f"'TIPO DE INTERVENCIÓN:  ' || {_intervention}"),
    ("f % 11 = 0 AND f % 2 = 0", f"'TIPO DE INTERVENCIÓN:' || chr(10) || '  ' || {_intervention}"),
    ("f % 11 = 0 AND f % 2 = 1", "'TIPO DE INTERVENCIÓN:' || chr(10) || 'Nº BIOPSIAS previas'"),
    ("f % 5 <> 3", "chr(10) || 'NÚMERO DE BIOPSIAS / CITOLOGÍAS PREVIAS: B' || CAST(f AS STRING)"),
    ("f % 13 <> 5", _text(
        "'1- CARACTERÍSTICAS DEL TUMOR:'",
        ("g % 3 = 0", f"'- TAMAÑO:  ' || {_size} || ' cm'"),
        ("g % 3 = 1", f"'- TAMAÑO: ' || {_size} || '   cm  LOCALIZACIÓN: UC ' || CAST(f % 4 AS STRING)"),
        f"'- CARACTER:  ' || {_choose('g', ['INFILTRANTE', 'Microinvasor (foco/s)', 'bien circunscrito', 'infiltrante + microinvasor'])}",
        ("g % 4 <> 3", f"'- MÚLTIPLE:    ' || {_choose('g', ['NO', 'SÍ (multiples focos)', 'no hay', 'indeterminado'])}"),
        ("f % 6 = 1", "'- SI ES MÚLTIPLE: Nº DE TUMORES: ' || CAST(f % 4 AS STRING) || ' LOCALIZACIÓN: CSE, CSI'"
                      " || CASE WHEN f % 12 = 1 THEN ' TAMAÑO DEL MAYOR: 3 cm' ELSE chr(10) || 'TAMAÑO DEL MAYOR: 2,5 cm' END"),
        ("f % 7 <> 2", "chr(10) || '-INFILTRACIÓN DEL MARGEN QUIRÚRGICO / MÁRGENES DE LA BIOPSIA:' || chr(10) || chr(10)"
                       " || 'LIBRE (a más de ' || CAST(f % 3 AS STRING) || 'cm):'"),
        f"'- TIPO HISTOLÓGICO:  ' || {_choose('g', TYPES)}",
        ("f % 9 <> 4", "'- GRADO HISTOLÓGICO DE BLOOM Y RICHARDSON  (SOLO CDI)' || chr(10) || '  * GRADO '"
                       " || CASE g % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' ELSE 'INTERMEDIO' END"
                       " || ' (' || CAST(f % 10 AS STRING) || ' puntos)'"),
        "'  · FORMACIÓN DE TÚBULOS' || chr(10) || '    · ' || CAST(f % 3 + 1 AS STRING) || ' :puntos'",
        ("f % 2 = 0", "'  · GRADO NUCLEAR' || chr(10) || '    · moderado'"),
        ("f % 3 = 0", "'  · GRADO MITÓSICO' || chr(10) || '   ' || chr(10) || 'bajo'"),
        f"'- INVASIÓN VASCULAR PERITUMORAL: ' || {_choose('f', ['NO', 'SI', ''])}",
        ("f % 4 = 1", "'- FRENTE DE INVASIÓN:  expansivo'"),
        ("f % 5 = 1", "'- NECROSIS TUMORAL  (COMP. INFILTRANTE): focal'"),
        ("f % 5 = 2", "'- RESPUESTA LINFOPLASMOCITARIA ESTROMAL: escasa'"),
        ("f % 5 = 4", "'- INFILTRACIÓN DE LA PIEL: no'"),
        ("f % 6 = 3", "'- COMPONENTE IN SITU: ' || CAST(f % 100 AS STRING) || '%'"),
        ("f % 6 = 4", "'- PATRÓN ARQUITECTURAL DEL COMPONENTE IN SITU: cribiforme'"),
    )),
    ("f % 3 <> 1", _text(
        "'2- CARACTERÍSTICAS DEL PARÉNQUIMA MAMARIO NO TUMORAL:'",
        ("g % 2 = 0", "'  - MASTOPATÍA PROLIFERATIVA ' || CAST(f % 8 AS STRING)"),
        ("g % 3 <> 0", "'- CALCIFICACIONES: presentes'"),
        ("g % 5 <> 0", "'- MASTOPATÍA NO PROLIFERATIVA: Fibrosis'"),
    )),
    ("f % 7 <> 3", _text(
        "'3-  DATOS DE LOS GANGLIOS AXILARES:'",
        "'- NÚMERO TOTAL DE GANGLIOS AISLADOS: ' || CAST(f % 20 AS STRING)",
        ("g % 2 = 1", "'- NÚMERO DE GANGLIOS CON METÁSTASIS: ' || CAST(f % 5 AS STRING)"),
        ("g % 3 = 1", "'- NÚMERO DE GANGLIOS CON METÁSTASIS POR NIVELES' || chr(10) || ' *NIVEL I 3/' || CAST(f % 10 AS STRING)"
                      " || chr(10) || ' *NIVEL II ' || CASE WHEN f % 2 = 0 THEN '1/4' ELSE '' END"),
        ("g % 4 = 1", "'- TAMAÑO DE LA  METÁSTASIS MAYOR (TEJIDO TUMORAL): 8 mm'"),
        ("g % 4 = 2", "'- METÁSTASIS  MENOR ( \" \" ): 2 mm'"),
        ("g % 4 = 3", "'- TIPO DE METÁSTASIS: micrometástasis'"),
    )),
    ("f % 4 <> 2", _text(
        "'4- ESTUDIO DE RECEPTORES HORMONALES (ESTRÓGENOS Y PROGESTERONA , MÉTODO INMUNOHISTOQUÍMICO)'",
        ("g % 5 = 0", "'RESULTADO: PENDIENTE'"),
        ("g % 5 <> 0", "'RESULTADO: RE: positivo ' || CAST(f % 100 AS STRING) || '%  RP: negativo'"),
        ("g % 5 = 4", "'RESULTADO: RE: corregido'"),
    )),
    ("f % 3 = 0", "'5-  ESTUDIO INMUNOHISTOQUIMICO DE HER2/NEU:' || chr(10) || 'RESULTADO: negativo (PUNTUACIÓN: ' || CAST(f % 4 AS STRING) || '+)'"),
    ("f % 3 = 2", "'5- ESTUDIO INMUNOHISTOQUIMICO DE HER2/NEU' || chr(10) || 'RESULTADO: pendiente'"),
    ("f % 4 <> 3", "'6- INDICE PROLIFERATIVO ( KI67 ): ' || CAST(f % 90 AS STRING) || '%'"),
    ("f % 5 <> 0", "'7- PT Y PN' || chr(10) || ' - PT' || CAST(f % 4 AS STRING) || 'c' || CASE WHEN f % 2 = 0 THEN ' PN' || CAST(f % 3 AS STRING) ELSE '' END"),
    ("f % 6 = 0", "'7- COMENTARIOS: ninguno'"),
)
FORM2 = _text(
    f"'TIPO DE INTERVENCIÓN:  ' || {_intervention}",
    "'Nº BIOPSIAS/ CITOLOGÍAS PREVIAS:  B10-' || CAST(f AS STRING)",
    "'DATOS DEL TUMOR:'",
    ("f % 8 <> 7", "' 1.- TIPO:   ' || chr(10) || '        CARCINOMA DUCTAL IN SITU' || CASE WHEN f % 3 = 0 THEN chr(10) || 'CON MICROINVASIÓN' ELSE '' END"),
    "'2.- LOCALIZACIÓN:  ' || CASE WHEN f % 4 = 1 THEN '' ELSE 'CSI ' || CAST(f % 6 AS STRING) END",
    f"'3- TAMAÑO: ' || {_size} || ' CM'",
    ("f % 5 <> 4", f"'4.- GRADO NUCLEAR DE VAN NUYS  (Solo CDIS):  ' || {_choose('g', ['INTERMEDIO', 'ALTO', 'BAJO'])}"),
    "chr(10) || '5.- NECROSIS  (Solo CDIS):  PRESENTE (TIPO COMEDO)'",
    "'6.- PATRÓN ARQUITECTURAL (SOLO CDIS):  CRIBIFORME / SÓLIDO'",
    "'7.- MÁRGENES DE LA BIOPSIA (Solo CDIS. Siempre marcados con tinta china):' || chr(10) || ' - LIBRE (a 1 cm o más):  1,' || CAST(f % 10 AS STRING) || ' cm'",
    ("f % 6 <> 5", "'8.- MICROCALCIFICACIONES:  PRESENTES'"),
    "'COMENTARIOS: ninguno'",
)

# Three rows per study. Rows of even studies repeat one form, rows of odd ones differ.
REPORTS_SQL = f"""
SELECT k AS row_seq, study, year, clinical, diagnosis, macro, micro, f,
       CASE WHEN k % 5 = 4 THEN 'Sin formulario' WHEN f % 4 IN (0, 1) THEN form1
            WHEN f % 4 = 2 THEN form2 ELSE 'Nota previa ' || CAST(k % 3 AS STRING) END AS extra,
       CASE WHEN k % 7 = 0 THEN form2 WHEN k % 7 = 1 THEN 'nota' END AS notes
FROM (
  SELECT *, {FORM1} AS form1, {FORM2} AS form2,
         CASE WHEN k % 4 = 3 THEN NULL ELSE 'Nódulo en mama ' || p_brand END AS clinical,
         'PIEZA DE ' || upper(p_name) || CASE WHEN f % 3 = 0 THEN ' CON TUMOR DE ' || {_size} || ' CMS ( UCE )'
              ELSE ' CON FOCOS' END || ' Y ' || CAST(f % 4 AS STRING) || ' x 1.5 cm ' || p_type AS diagnosis,
         CASE WHEN s % 3 = 0 THEN 'Pieza de 20 x ' || CAST(f % 6 + 1 AS STRING) || ',5 cms, nódulo de 4 mm (7x4x2 cm).'
              WHEN s % 3 = 1 THEN 'Mide 3.5 cm x ' || CAST(f % 5 AS STRING) || ' cm, 3.4x1 cm y 2 x 1 mm  ' END AS macro,
         CASE WHEN k % 6 = 0 THEN p_type || ' ' || CAST(p_size AS STRING) END AS micro
  FROM (
    SELECT *, CAST(floor(f / 4) AS BIGINT) AS g,
           'B' || CAST(15 + s % 4 AS STRING) || '-' || CAST(s AS STRING) AS study,
           CAST(2015 + s % 4 AS STRING) AS year
    FROM (
      SELECT *, CASE WHEN s % 2 = 0 THEN s * 3 ELSE k END AS f
      FROM (SELECT p_partkey AS k, CAST(floor(p_partkey / 3) AS BIGINT) AS s, p_name, p_brand,
                   p_type, p_size FROM {{part}}) a) b) c) d"""

FORMS_SQL = f"SELECT row_seq, study, f, extra AS form_text FROM ({REPORTS_SQL}) r"


_WRITTEN: dict[tuple[str, str, str], str] = {}


def once(
    spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """A derived table that several queries read, written once per application and source."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _WRITTEN:
        path = scratch_dir(spark, name)
        spread(build()).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def reports(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        return spark.sql(REPORTS_SQL, part=spread(table(spark, folder, "part")))

    return once(spark, folder, "reports", build)


def reports_cte() -> str:
    return REPORTS_SQL.replace("{part}", "part")


# a manual label sheet over the distinct cleaned texts of the interventions above
MANUAL_TEXTS = [
    ("tumorectomia + bsgc", "Tumorectomía + BSGC"),
    ("mastectomia radical modificada", "Mastectomía radical modificada"),
    ("mastectomia simple + linfadenectomia", "linfadenectomia + mastectomia simple"),
    ("exeresis", "No mama"),
    ("mrm", "mrm"),
    ("tumorectomia guiada por arpon + bsgc", "Tumorectomia+ bsgc"),
    ("cuadrantectomia + biopsia selectiva de ganglio centinela", "cuadrantectomia + bsgc"),
    ("ampliacion de margenes", "ambiguo"),
]


def manual_sheet(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({q(x)}, {q(y)})" for x, y in MANUAL_TEXTS)
    names = f"`{K.MANUAL_SHEET_TEXT}`, `{K.MANUAL_SHEET_LABEL}`"
    return spark.sql(f"SELECT * FROM VALUES {rows} AS sheet({names})")
