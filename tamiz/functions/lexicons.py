"""Word lists that decide results. Fixed values."""

# Words that say nothing in a search.
SEARCH_STOPWORDS = [
    "a", "al", "asi", "con", "de", "del", "el", "en", "es", "fue",
    "la", "las", "lo", "los", "mas", "para", "por", "que", "se",
    "su", "sus", "un", "una", "y",
]
# Words left out of trends.
TREND_STOPWORDS = [
    "para", "como", "este", "esta", "esto", "esos", "esas", "ellos", "ellas",
    "pero", "sobre", "entre", "desde", "hasta", "cuando", "donde",
    "también", "tambien", "solo", "más", "mas", "que", "con", "los", "las",
    "del", "una", "por", "sus", "nuevo", "nueva", "nuevos", "nuevas",
]
# Words left out of discourse statistics.
DISCOURSE_STOPWORDS = [
    "a", "al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los",
    "para", "por", "que", "se", "son", "su", "sus", "un", "una", "y",
]
# Words left out of basic text statistics.
BASIC_STOPWORDS = [
    "de", "la", "el", "en", "y", "a", "los", "las", "un", "una", "que",
    "con", "por", "para", "del", "al", "se", "es", "son", "como",
]
# Words of good and of bad news, for documents.
POSITIVE = [
    "avance", "avances", "celebra", "celebran", "crecimiento", "innovadora", "mejora", "mejoras",
    "mejoran", "nuevo", "nueva", "oportunidad", "optimiza", "positiva", "revolucionan", "significativas",
]
NEGATIVE = [
    "alarma", "bajaron", "caidas", "caídas", "crisis", "incertidumbre", "negativa", "peores", "preocupacion",
    "preocupante", "preocupantes", "riesgo", "tensiones", "volatilidad", "volatiles",
]
# Words of good and of bad tone, for messages of a thread.
THREAD_POSITIVE = [
    "bueno", "buena", "excelente", "bien", "positivo", "positiva",
    "innovacion", "increible", "importante", "mejor", "avance", "logro",
    "beneficio", "favorable", "prometedor", "util", "eficiente", "valioso",
    "ganancia", "oportunidad", "progreso", "mejorar", "acuerdo", "apoyo",
    "transparencia", "esperanza", "optimista", "educacion", "calidad",
    "exitoso", "fuerte", "colaboracion", "propuesta", "valiosa", "progresista",
    "adecuada", "responsablemente", "capacitacion", "equidad", "solida",
    "adaptarse", "aprovechar", "integre", "marco", "pedagogico",
]
THREAD_NEGATIVE = [
    "malo", "mala", "terrible", "negativo", "negativa", "preocupa",
    "preocupaciones", "crisis", "desempleo", "problema", "riesgo", "dano",
    "perdida", "fracaso", "corrupcion", "desigualdad", "conflicto", "amenaza",
    "desastre", "recesion", "peligro", "injusticia", "violencia", "pobreza",
    "desacuerdo", "censura", "inflacion", "privacidad", "sesgo", "perjuicio",
    "error", "caida", "deterioro", "plagio", "deshonestidad", "restricciones",
    "perdemos",
]
# Words before a name that say what it names.
PERSON_CONTEXT = [
    "presidente", "director", "secretario", "doctor", "dr", "ing", "lic", "señor",
    "señora", "ministro", "gobernador", "senador", "diputado", "general", "fiscal",
]
PLACE_CONTEXT = [
    "ciudad", "estado", "municipio", "país", "región", "colonia", "calle", "avenida",
    "pueblo", "localidad", "delegación", "capital", "territorio",
]
ORGANISATION_CONTEXT = [
    "empresa", "instituto", "universidad", "secretaría", "ministerio", "partido",
    "organización", "asociación", "corporación", "fundación", "comisión", "consejo",
]
# Substrings of a question in natural language that filter a search, in order.
FILTER_POSITIVE = ["buena", "positiva", "positivo", "optimista"]
FILTER_NEGATIVE = ["mala", "negativa", "negativo", "pesimista", "preocupante"]
FILTER_CATEGORY = [
    ("tecnologia", "tecnologia"), ("tecnología", "tecnologia"), ("tech", "tecnologia"), ("computacion", "tecnologia"),
    ("computación", "tecnologia"), ("programacion", "tecnologia"), ("programación", "tecnologia"), ("python", "tecnologia"),
    ("economia", "economia"), ("economía", "economia"), ("mercados", "economia"), ("finanzas", "economia"),
    ("ciencia", "ciencia"), ("cientifico", "ciencia"), ("científico", "ciencia"), ("investigacion", "ciencia"),
    ("investigación", "ciencia"), ("clima", "ciencia"), ("gobierno", "politica"), ("politica", "politica"),
    ("política", "politica"), ("datos abiertos", "politica"),
]
# Substrings of a folded question that tell its intent, in order.
QUESTION_INTENTS = [
    ("conteo", ["cuantas", "cuantos", "total", "numero"]),
    ("resumen", ["resumen", "resume", "sintetiza"]),
    ("sentimiento", ["sentimiento", "tono", "opinion", "positiv", "negativ"]),
    ("categoria", ["categoria", "tema", "tipo", "clasifica"]),
    ("comparacion", ["compara", "diferencia", "relacion"]),
    ("recomendacion", ["recomienda", "sugiere", "similar"]),
]
DIALOGUE_INTENTS = [
    ("conteo", ["cuantas", "cuantos", "total", "numero", "cantidad", "cuantos hay"]),
    ("sentimiento", ["sentimiento", "tono", "opinion", "positiv", "negativ", "emocion"]),
    ("categoria", ["categoria", "tema", "tipo", "clasifica", "categorias", "temas"]),
    ("resumen", ["resumen", "resume", "sintetiza", "sintesis", "panorama"]),
]
# Words and phrases that refer to what was said before.
REFERENCES = ["eso", "esa", "ese", "anterior", "mas sobre", "otra", "similar", "continua", "explicame", "dame mas", "lo mismo"]
# Words that tell the topic of a message.
DIALOGUE_TOPICS = [
    ("tecnologia", ["tecnologia", "ia", "inteligencia", "artificial", "python", "programacion", "software", "algoritmo", "machine", "learning", "datos", "digital", "computacion", "red", "internet", "app", "sistema", "automatico"]),
    ("economia", ["economia", "mercado", "mercados", "finanzas", "dinero", "inflacion", "inversion", "bolsa", "precio", "banco", "credito", "deuda"]),
    ("ciencia", ["ciencia", "investigacion", "cientifico", "experimento", "laboratorio", "calentamiento", "estudio", "descubrimiento", "fisico", "quimico"]),
    ("politica", ["gobierno", "politica", "presidente", "congreso", "reforma", "ley", "ministro", "eleccion", "voto", "partido", "diputado", "senado"]),
    ("salud", ["salud", "hospital", "vacuna", "medicina", "tratamiento", "paciente", "enfermedad", "medico", "virus", "pandemia", "clinica"]),
    ("medio_ambiente", ["clima", "carbono", "contaminacion", "ambiente", "emisiones", "ambiental", "naturaleza", "ecosistema", "biodiversidad", "reciclaje"]),
]
# Texts whose TF-IDF profiles tell the topic of a conversation.
TOPIC_PROFILES = [
    ("tecnologia", "inteligencia artificial programacion software apps tecnologia computadora robot digital innovacion machine learning desarrolladores"),
    ("economia", "dinero inversion mercado bolsa finanzas banco economia empleo trabajo tasas interes fondos"),
    ("ciencia", "investigacion cientifico descubrimiento estudio laboratorio clima universo datos"),
    ("politica", "gobierno elecciones presidente ley congreso partido democracia legislativo transparencia"),
]
# URL segments that name a section, and its category.
URL_SECTIONS = [
    ("ciencia", "ciencia"), ("ciencias", "ciencia"), ("deportes", "deportes"), ("economia", "economia"), ("economía", "economia"),
    ("estados", "estados"), ("espectaculos", "espectaculos"), ("espectáculos", "espectaculos"), ("mundo", "mundo"), ("opinion", "opinion"),
    ("opinión", "opinion"), ("politica", "politica"), ("política", "politica"), ("tecnologia", "tecnologia"), ("tecnología", "tecnologia"),
]
