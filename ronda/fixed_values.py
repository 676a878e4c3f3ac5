"""Fixed values.

These are part of the data contract: stored tables hold them or callers read
them, so they have to be exactly these.
"""

# Traffic-light names and the percentages at which they start.
BAND_GREEN = "VERDE"
BAND_AMBER = "AMARILLO"
BAND_RED = "ROJO"
BAND_GREY = "GRIS"
GREEN_FROM = 0.95
AMBER_FROM = 0.80

# Service type shown when a row carries none.
DEFAULT_SERVICE = "1 Servicio"

# Survey modes, survey states and the message state.
MODE_SHARED = "compartida"
MODE_INDIVIDUAL = "individual"
STATE_PENDING = "pendiente"
STATE_DONE = "completada"
MESSAGE_PENDING = "pendiente"

# Role id of a client, and the responder type stored for one.
ROLE_CLIENT = "CLIENTE"
RESPONDER_CLIENT = "cliente"

# Staff ranks.  A staff role id is a rank, an underscore and the organisation
# code; the survey inbox and the answer page accept different ranks.
INBOX_STAFF_RANKS = ("ADMIN", "SUBGERENTE", "JEFE", "SUPERVISOR", "GERENTE")
ANSWER_STAFF_RANKS = ("ADMIN", "SUBGERENTE_JEFE", "SUPERVISOR")

# Permission flags of a profile.
PERMISSION_FLAGS = (
    "puede_ver_cobertura",
    "puede_ver_encuestas",
    "puede_enviar_mensajes",
    "puede_ver_empresas",
    "puede_ver_metricas_globales",
    "puede_ver_trabajadores",
    "puede_ver_mensajes_recibidos",
    "es_admin",
)

# Wording of the punctuality label and of a push notification.
LATE_PREFIX = "Retraso: "
LATE_SUFFIX = " minutos"
ON_TIME = "A tiempo"
PUSH_TITLE_PREFIX = "Nuevo mensaje de "
PUSH_KIND = "nuevo_mensaje"
PUSH_BODY_CHARS = 100
PUSH_BODY_TAIL = "..."

# Separator between the names in a relief text.
RELIEF_SEPARATOR = " | "

# Characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Default trailing window, refresh interval and inbox length.
HISTORY_DAYS = 90
REFRESH_MINUTES = 5
INBOX_ROWS = 100
