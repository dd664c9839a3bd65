"""Word lists, titles, field tables and patterns that the results depend on."""

# Python's str.isspace() characters; Spark's trim and Java's \s know fewer.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
# The same set as a regex class body, valid in Java regexes and in RE2.
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{SPACE_CLASS}]"
NOT_SPACE = f"[^{SPACE_CLASS}]"

# --- cleaning -------------------------------------------------------------------------------
MODEL_SPACE_CHARS = "[/(){}\\]|@,;:+"
ENTRY_MARKER = r"##entry_\d*##"
DISPLAY_MARKER = r"##ENTRY_\d+##"
NUMBER_TO_STRIP = r"\d+(?:[,.]\d+)?"

# --- interventions: class -> spellings, in matching order --------------------------------------
INTERVENTION_CLASSES = {
    "mrm": ["mastectomia radical modificada", "mrm", "m.r.m."],
    "mr": ["mastectomia radical"],
    "ms": ["mastectomia simple", "mastectomia"],
    "tumorectomia": ["tumorectomia"],
    "bsgc": [
        "bsgc",
        "biopsia selectiva ganglio centinela",
        "bsg centinela",
        "bs gc",
        "biopsia ganglio centinela",
        "bsg",
    ],
    "linfadenectomia": ["linfadenectomia"],
    "cuadrantectomia": ["cuadrantectomia"],
    "invalid": ["exeresis", "amputacion"],
    "": ["extirpacion", "ampliacion margenes"],
}
MASTECTOMY_ORDER = ["mrm", "mr", "ms"]
MANDATORY_INTERVENTIONS = ["tumorectomia", "ms", "mrm", "mr", "cuadrantectomia"]
INTERVENTION_CHARS_DELETE = "/+();"
# manual label sheet: long names to codes, applied in this order
MANUAL_RENAMES = [
    ("mastectomia radical modificada", "mrm"),
    ("mastectomia radical", "mr"),
    ("mastectomia simple", "ms"),
    ("no mama", "invalid"),
    ("ambiguo", "invalid"),
    ("eliminar", "invalid"),
]
MANUAL_SHEET_TEXT = "Tipo Intervención Texto"
MANUAL_SHEET_LABEL = "Tipo de intervención corregido"
INVALID_STUDIES = ["B17-10176"]

# --- histological types: class -> spellings, in matching order ---------------------------------
HISTOLOGICAL_TYPES = {
    "carcinoma ductal infiltrante": [
        "carcinoma ductal infiltrante",
        "carcinoma ductal infiltrante in situ",
        "cdi",
        "carcinoma ductal",
    ],
    "carcinoma lobulillar infiltrante": [
        "carcinoma lobulillar infiltrante",
        "carcinoma lobulillar infiltrante in situ",
    ],
    "carcinoma tubular": ["carcinoma tubular"],
    "carcinoma cribiforme": ["carcinoma cribiforme"],
    "carcinoma metaplásico": ["carcinoma metaplásico"],
    "carcinoma medular": [
        "carcinoma medular",
        "carcinoma medular atipico",
        "carcinoma invasivo con caracteristicas medulares",
    ],
    "carcinoma con diferenciacion apocrina": ["carcinoma con diferenciación apocrina"],
    "carcinoma adenoide quistico": ["carcinoma adenoide quistico"],
    "carcinoma mucoepidermoide": ["carcinoma mucoepidermoide"],
    "carcinoma polimorfo": ["carcinoma polimorfo"],
    "carcinoma mucinoso": [
        "carcinoma mucinoso",
        "carcinoma con diferenciacion de celulas en anillo de sello",
    ],
    "carcinoma papilar invasivo": [
        "carcinoma papilar invasivo",
        "carcinoma micropapilar invasivo",
        "carcinoma papilar infiltrante",
        "carcinoma micropapilar infiltrante",
        "carcinoma papilar",
    ],
    "carcinoma inflamatorio": ["carcinoma inflamatorio"],
}
CDI = "carcinoma ductal infiltrante"
HISTOLOGY_CUTOFF = 85
OTHER = "otro"

# --- measures ---------------------------------------------------------------------------------
_N = r"\d+(?:[.,']\d+)?" + SPACE + "*"
_X = r"[(por)xy]" + SPACE + "*"
# the last class snaps the unit out to its whole token ("cms")
MEASURE = rf"(?i){_N}(?:{_X}{_N})?(?:{_X}{_N})?[mc]?m[\p{{L}}\d]*"
MEASURE_VALUE = r"^(\d+(?:\.\d+)?)(?:[(por)xy](\d+(?:\.\d+)?))?(?:[(por)xy](\d+(?:\.\d+)?))?([mc]?m)"
# number factors per unit; the inverted mm and m factors give the published results
PUBLISHED_FACTORS = {"mm": 10.0, "cm": 1.0, "m": 0.01}
CM_FACTORS = {"mm": 0.1, "cm": 1.0, "m": 100.0}
_NUM = r"\d+(?:[.,]\d+)?"
_UNIT = r"[mc]?m\p{L}*"
_BY = r"[(por)x]"
# older token rules, longest shape first: "3.5 cm x 5 cm", "4.1 cm x 5.4", "3.4 x 1 cm", "3.4x1 cm"
AREA_SHAPES = [
    rf"{_NUM} +{_UNIT} +{_BY} +{_NUM} +{_UNIT}",
    rf"{_NUM} +{_UNIT} +{_BY} +{_NUM}",
    rf"{_NUM} +{_BY} +{_NUM} +{_UNIT}",
    rf"{_NUM}{_BY}{_NUM} +{_UNIT}",
]
DISTANCE_SHAPE = rf"{_NUM} +{_UNIT}"
SIZE_LABEL = "TUMOR_SIZE"

# --- report columns ---------------------------------------------------------------------------
STUDY = "Estudio"
FORM_COLUMNS = ["Texto del complementario", "Notas (Muestra)"]
FORM_OUTPUT = "Formulario"
X_COLUMNS = ["Datos clínicos", "Diagnóstico", "Macro", "Micro"]
# the part after the last underscore of an extract's file or folder name
YEAR_IN_PATH = r"_([^_/]+)\.[^./]+(?:/[^/]*)?$"
SECTION_HEADINGS = ["Datos", "Diagnóstico", "Macro", "Micro"]

# --- layout 1 ---------------------------------------------------------------------------------
FORM_START = "tipo de intervención:"
NEXT_FIELD_MARKS = ["biopsias /", "nº biopsias"]
TITLES = [
    "1- características del tumor",
    "2- características del parénquima mamario no tumoral",
    "3-  datos de los ganglios axilares",
    "4- estudio de receptores hormonales (estrógenos y progesterona , método inmunohistoquímico)",
    "5-  estudio inmunohistoquimico de her2/neu",
    "5- estudio inmunohistoquimico de her2/neu",
    "6- indice proliferativo ( ki67 )",
    "6- p",
    "7- p",
    "7-   comentarios  /  notas adicionales",
    "7- comentarios",
    "8-   comentarios  /  notas adicionales",
]
SECTIONS = {
    "tumor": [TITLES[0]],
    "parenchyma": [TITLES[1]],
    "nodes": [TITLES[2]],
    "hormone": [TITLES[3]],
    "her2": [TITLES[4], TITLES[5]],
}
# (output, phrase that marks the line, lines to skip, regexes to delete)
SIMPLE_FIELDS = [
    ("n_biopsias", "número de biopsias / citologías previas:", 0,
     ["número de biopsias / citologías previas:"]),
    ("proliferative_index", "6- indice proliferativo ( ki67 )", 0,
     [r"6- indice proliferativo \( ki67 \):"]),
]
TUMOR_FIELDS = [
    ("caracter", "- caracter", 0, ["- caracter", ":"]),
    ("is_multiple", "- múltiple", 0, ["- múltiple", ":"]),
    ("margin", "infiltración del margen quirúrgico / márgenes de la biopsia", 1, []),
    ("histological_type", "- tipo histológico", 0, ["- tipo histológico", ":"]),
    ("histological_degree", "- grado histológico de bloom y richardson  (solo cdi)", 1,
     [r"\*", ":"]),
    ("tubule_formation", "· formación de túbulos", 1, ["·", ":"]),
    ("nuclear_degree", "· grado nuclear", 1, ["·", ":"]),
    ("mythosical_degree", "· grado mitósico", 1, ["·", ":"]),
    ("vascular_invasion", "- invasión vascular peritumoral", 0,
     ["- invasión vascular peritumoral", ":"]),
    ("invasion_front", "- frente de invasión", 0, ["- frente de invasión", ":"]),
    ("tumor_necrosis", "- necrosis tumoral  (comp. infiltrante)", 0,
     [r"- necrosis tumoral  \(comp. infiltrante\)", ":"]),
    ("lymphoplasmcitary_response", "- respuesta linfoplasmocitaria estromal", 0,
     ["- respuesta linfoplasmocitaria estromal", ":"]),
    ("perinueral_infiltration", "- infiltración perineural", 0,
     ["- infiltración perineural", ":"]),
    ("skin_infiltration", "- infiltración de la piel", 0, ["- infiltración de la piel", ":"]),
    ("vascular_infiltration", "- infiltración vascular in dermis", 0,
     ["- infiltración vascular in dermis", ":"]),
    ("nipple_infiltration", "- infiltración del pezón", 0, ["- infiltración del pezón", ":"]),
    ("muscle_wall_infiltration", "- infiltración pared muscular", 0,
     ["- infiltración pared muscular", ":"]),
    ("insitu_component", "- componente in situ", 0, ["- componente in situ", ":"]),
    ("nuclear_degree_insitu", "- grado nuclear del componente in situ", 0,
     ["- grado nuclear del componente in situ", ":"]),
    ("architectural_patern_insitu", "- patrón arquitectural del componente in situ", 0,
     ["- patrón arquitectural del componente in situ", ":"]),
    ("comedo_necrosis", "- necrosis tipo comedo", 0, ["- necrosis tipo comedo", ":"]),
]
PARENCHYMA_FIELDS = [
    ("calcifications", "- calcificaciones:", 0, ["- calcificaciones:"]),
    ("mastopathy", "- mastopatía no proliferativa:", 0, ["- mastopatía no proliferativa:"]),
]
NODE_FIELDS = [
    ("isolated_ganglions", "- número total de ganglios aislados:", 0,
     ["- número total de ganglios aislados:"]),
    ("isolated_metastasis", "- número de ganglios con metástasis:", 0,
     ["- número de ganglios con metástasis:"]),
    ("size_biggest_metastasis", "- tamaño de la  metástasis mayor (tejido tumoral):", 0,
     [r"- tamaño de la  metástasis mayor \(tejido tumoral\):"]),
    ("size_smallest_metastasis", "metástasis  menor", 0,
     ["metástasis  menor", rf'\({SPACE}*"{SPACE}*"{SPACE}*\)', ":"]),
    ("metastasis_type", "- tipo de metástasis:", 0, ["- tipo de metástasis:"]),
]
NODE_LEVELS_HEADING = "- número de ganglios con metástasis por niveles"

# --- layout 2 ---------------------------------------------------------------------------------
_S = SPACE
NUMBERED = rf"(?:\n|^){_S}*\d\.?-?{_S}*"
LAYOUT2_LAST = "microcalcificaciones|$"
LAYOUT2_TITLES = {
    "histological_type": "tipo",
    "location": "localizaci[oó]n",
    "size": "tama[nñ]o",
    "van_nuys_degree": rf"grado{_S}*nuclear{_S}*de{_S}*van{_S}*nuys{_S}*\(s[oó]lo{_S}*cdis\)",
    "tumor_necrosis": "necrosis",
    "architectural_patern_insitu": rf"patr[oó]n{_S}*arquitectural{_S}*\(solo{_S}*cdis\)",
    "margin": rf"m[áa]rgenes{_S}*de{_S}*la{_S}*biopsia{_S}*"
    rf"\(solo{_S}*cdis.{_S}*siempre{_S}*marcados{_S}*con{_S}*tinta{_S}*china\)",
}
