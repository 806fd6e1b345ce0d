"""Schemas, closed domains and alias tables.

Everything under "FIXED VALUES" must equal the values of the product whose
behaviour this library reproduces; they are data, not logic.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# FIXED VALUES: feature names, closed domains, defaults, dictionaries
# --------------------------------------------------------------------------
NUMERIC_FEATURES = ["edad", "ingresos_mensuales", "cargas_familiares", "creditos_activos"]
CATEGORICAL_FEATURES = ["sexo", "educacion", "historial_pagos", "institucion",
                        "tipo_credito", "situacion_laboral"]
TARGET = "aprobado"
REQUIRED_COLUMNS = NUMERIC_FEATURES + CATEGORICAL_FEATURES + [TARGET]

CREDIT_TYPES = ["Hipotecario", "Vehicular", "Personal", "Microcrédito", "Productivo", "Emprendimiento"]
EMPLOYMENT = ["Empleado Público", "Empleado Privado", "Emprendedor", "Negocio Propio",
              "Trabajo Informal", "Desempleado"]
EDUCATION = ["Primaria", "Secundaria", "Universitaria", "Posgrado"]
PAYMENT_HISTORY = ["Malo", "Regular", "Bueno", "Excelente"]  # ordered, worst to best
# Institution names are neutral stand-ins (see FIXTURES.md).
INSTITUTIONS = ["Banco A", "Banco B", "Banco C", "Banco D", "Cooperativa E"]
SEX = ["Masculino", "Femenino"]

DOMAINS = {
    "sexo": SEX,
    "educacion": EDUCATION,
    "historial_pagos": PAYMENT_HISTORY,
    "institucion": INSTITUTIONS,
    "tipo_credito": CREDIT_TYPES,
    "situacion_laboral": EMPLOYMENT,
}

# Defaults for absent applicant fields.
APPLICANT_DEFAULTS = {
    "edad": 35.0,
    "ingresos_mensuales": 800.0,
    "cargas_familiares": 0.0,
    "creditos_activos": 0.0,
    "sexo": "Masculino",
    "educacion": "Secundaria",
    "historial_pagos": "Bueno",
    "institucion": "Banco A",
    "tipo_credito": "Personal",
    "situacion_laboral": "Empleado Privado",
}

# Display labels of the base variables.
FRIENDLY_LABELS = {
    "edad": "Tu edad",
    "ingresos_mensuales": "Tus ingresos mensuales",
    "cargas_familiares": "Tus cargas familiares",
    "creditos_activos": "Tus créditos activos",
    "sexo": "Sexo",
    "educacion": "Tu nivel educativo",
    "historial_pagos": "Tu historial de pagos",
    "institucion": "La institución financiera",
    "tipo_credito": "El tipo de crédito",
    "situacion_laboral": "Tu situación laboral",
}

# Header spellings accepted for each canonical column (matched after text
# normalisation: strip, lower case, blanks to "_", accents of vowels removed).
COLUMN_ALIASES = {
    "edad": ["edad", "age", "años", "anios"],
    "ingresos_mensuales": ["ingresos_mensuales", "ingresos", "ingreso", "salario", "income", "sueldo"],
    "cargas_familiares": ["cargas_familiares", "cargas", "dependientes", "hijos", "carga_familiar"],
    "creditos_activos": ["creditos_activos", "creditos", "prestamos_activos", "deudas_activas", "num_creditos"],
    "sexo": ["sexo", "genero", "género", "sex", "gender"],
    "educacion": ["educacion", "educación", "nivel_educativo", "estudios", "education"],
    "historial_pagos": ["historial_pagos", "historial", "historial_pago", "payment_history", "buro"],
    "institucion": ["institucion", "institución", "banco", "entidad", "cooperativa"],
    "tipo_credito": ["tipo_credito", "tipo_crédito", "tipo", "producto", "credito"],
    "situacion_laboral": ["situacion_laboral", "situación_laboral", "empleo", "trabajo", "ocupacion", "laboral"],
    "aprobado": ["aprobado", "aprobada", "resultado", "target", "approved", "decision", "estado"],
}

# Target dictionaries: text token (after trim + lower case) -> class.
TARGET_DICTIONARIES = {
    # lab binary-text normaliser
    "lab": {
        "sí": 1, "si": 1, "yes": 1, "y": 1, "true": 1, "1": 1, "verdadero": 1,
        "no": 0, "n": 0, "false": 0, "0": 0, "falso": 0,
    },
    # production retrain
    "production": {
        "1": 1, "0": 0, "si": 1, "sí": 1, "no": 0, "yes": 1, "true": 1, "false": 0,
        "aprobado": 1, "aprobada": 1, "rechazado": 0, "rechazada": 0, "negado": 0,
        "approved": 1, "denied": 0, "default": 0, "pago": 1, "impago": 0, "y": 1, "n": 0,
    },
    # dataset cleaner (tokens compared after header-style normalisation)
    "cleaner": {
        "1": 1, "si": 1, "sí": 1, "yes": 1, "true": 1, "aprobado": 1, "aprobada": 1,
        "approved": 1, "y": 1, "v": 1, "verdadero": 1,
        "0": 0, "no": 0, "false": 0, "rechazado": 0, "rechazada": 0, "denied": 0,
        "n": 0, "f": 0, "falso": 0,
    },
    # model report fairness section
    "report": {
        "1": 1, "si": 1, "sí": 1, "yes": 1, "true": 1, "aprobado": 1, "aprobada": 1,
        "0": 0, "no": 0, "false": 0, "rechazado": 0, "rechazada": 0,
    },
}

# Text read as missing after trimming.
MISSING_TOKENS = ["", "nan", "NaN", "None"]

# Decision and risk thresholds.
DECISION_THRESHOLDS = (0.66, 0.40)        # inclusive: APROBAR / REVISAR / RECHAZAR
LAB_DECISION_THRESHOLDS = (0.65, 0.40)    # strict
RISK_BANDS = [("alta", "Excelente"), ("media", "Moderada"), ("baja", "Riesgosa")]
GUEST_NAME = "Invitado"

# Seed scorecard (latent approval rule, no noise term).
SCORECARD_INTERCEPT = -1.2
SCORECARD_INCOME_SCALE = 1500.0
SCORECARD_INCOME_WEIGHT = 1.6
SCORECARD_HISTORY = {"Malo": -1.6, "Regular": -0.4, "Bueno": 0.7, "Excelente": 1.7}
SCORECARD_EDUCATION = {"Primaria": -0.3, "Secundaria": 0.0, "Universitaria": 0.5, "Posgrado": 0.9}
SCORECARD_CREDITS = -0.45
SCORECARD_DEPENDANTS = -0.15
SCORECARD_EMPLOYMENT = {"Empleado Público": 0.8, "Empleado Privado": 0.6, "Emprendedor": 0.1,
                        "Negocio Propio": 0.4, "Trabajo Informal": -0.6, "Desempleado": -1.8}
SCORECARD_CREDIT_TYPE = {"Microcrédito": 0.5, "Personal": 0.2, "Emprendimiento": 0.0,
                         "Productivo": -0.1, "Vehicular": -0.2, "Hipotecario": -0.5}
SCORECARD_AGE_CENTRE = 40.0
SCORECARD_AGE_WEIGHT = -0.012
# --------------------------------------------------------------------------
