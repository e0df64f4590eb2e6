"""Table layouts and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the published tables, in order.
EVENT_FIELDS = (
    "nome", "camada", "data", "data_original", "hora_marcador", "status_data", "uf", "endereco_ou_localizacao", "latitude",
    "longitude", "link", "site_leiloeiro", "fonte_data_hora", "link_edital", "resumo_edital", "descricao",
)
LOT_FIELDS = (
    "titulo", "descricao", "lance_atual", "lote", "leiloeiro", "evento", "data", "data_original", "hora", "uf", "local",
    "link_evento", "link_lote", "foto_lote", "link_edital", "resumo_edital", "fonte", "capturado_em", "status_captura",
)
# The federation's unit codes.
UNIT_CODES = (
    "AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT", "PA",
    "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO",
)
# Labels of links and titles that name no lot.
NAVIGATION_LABELS = (
    "anterior", "cadastre-se", "cadastro", "compartilhar", "contato", "copiar link", "entrar", "facebook", "home", "inicio", "início", "instagram",
    "linkedin", "login", "politica de privacidade", "política de privacidade", "proximo", "próximo", "termos", "twitter", "whatsapp",
)
# What a page says when it turns a reader away.
CHALLENGE_PHRASES = ("403 forbidden", "access denied", "attention required", "checking your browser", "just a moment", "verificando")
# Hosts served by the offer interface, and hosts that never hold lots.
API_DOMAINS = ("eckertleiloes.com.br", "sold.com.br", "superbid.com.br", "superbid.net")
SOCIAL_HOSTS = ("facebook.com", "linkedin.com", "twitter.com", "whatsapp.com", "x.com")
LOT_PATHS = ("/item", "/lote", "/maquina/", "/oferta", "/produto/", "/veiculo/")
IMAGE_WORDS = ("avatar", "facebook", "icon", "instagram", "logo", "pixel", "placeholder", "spacer", "whatsapp")
# Month names.
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
# Status words.
FUTURE, PAST, UNDATED = "futuro_ou_hoje", "passado", "sem_data"
CARRIED = "preservado_apos_falha:"
TIMEZONE = "America/Sao_Paulo"

ATTEMPT = T.StructType([T.StructField("url", T.StringType()), T.StructField("status", T.StringType()), T.StructField("http", T.IntegerType()), T.StructField("lotes", T.IntegerType())])
LOG = T.StructType(
    [T.StructField("n", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("evento", "data", "link", "final_url", "status")]]
    + [T.StructField("lotes", T.IntegerType()), T.StructField("fontes_tentadas", T.ArrayType(ATTEMPT)), T.StructField("erro", T.StringType())]
)


def strings(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


EVENT, LOT = strings(EVENT_FIELDS), strings(LOT_FIELDS)


def conform(df: DataFrame, names: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the named columns, as strings, missing and null ones empty; ``keep``
    names further columns to pass on."""
    have = set(df.columns)
    return df.select(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) if n in have else F.lit("").alias(n) for n in names], *keep)


def filled(*columns: Column | str) -> Column:
    """The first column that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns], F.lit(""))
