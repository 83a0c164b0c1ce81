"""Texts and limits that answers must show exactly."""

PAYMENT_LABELS = {
    "pix": "PIX",
    "debit": "Cartão de Débito",
    "boleto": "Boleto Bancário",
}
CARD_LABEL = "Cartão de Crédito {n}x"
NO_PAYMENT = "-"

SELLABLE = ("active", "coming_soon")
ACTIVE = "active"
DELIVERED = "delivered"

REPENTANCE_DAYS = 7
DEFECT_DAYS = 30
DATE_FORMAT = "dd/MM/yyyy"
REFERENCE_TEXT = "entrega estimada em "
PATH_EXPIRED = (
    "prazos de arrependimento (7d) e troca por defeito (30d) EXPIRADOS; "
    "orientar garantia junto ao fabricante via certificado do produto, "
    "com a loja intermediando mediante solicitação (§4.2)"
)
PATH_DEFECT = "arrependimento (7d) expirado, mas troca por defeito ainda possível até a data indicada (§4.2)"
PATH_OPEN = "direito de arrependimento (7d) e troca por defeito (30d) vigentes (§4.1/§4.2)"
NOTE_NOT_DELIVERED = "pedido não consta como entregue; prazos de troca/devolução correm a partir do recebimento"
NOTE_NO_DATE = "data de entrega indisponível"

ADVICE_NOTHING = (
    "nenhum resultado; tente outro termo, ou use load_context para carregar o catálogo ou o manual completo"
)
ADVICE_PARTIAL = (
    "nenhum produto cobre todos os termos da busca; resultados parciais. "
    "Carregue o catálogo (load_context, source=catalogo, sem section) "
    "para ver os nomes disponíveis e refaça a busca com o nome exato"
)
ADVICE_SIMILAR = "nenhum produto encontrado. Nomes mais parecidos no catálogo: "
ADVICE_SIMILAR_END = ". Refaça a busca usando o nome exato."
INDEX_NOTE = (
    "índice completo do catálogo (nome, categoria, preço vigente); "
    "para detalhes, estoque e promoção, refaça a busca no search_store "
    "com o nome exato do produto"
)
UNKNOWN_SOURCE = "fonte desconhecida: "
UNKNOWN_TOOL = "ferramenta desconhecida: "
APOLOGY = (
    "Desculpa, tive um problema pra consultar nossos sistemas agora. "
    "Pode tentar de novo em instantes?"
)
ROLE_CUSTOMER = "Cliente"
ROLE_AGENT = "Agente"
COVER_SECTION = "Capa"
COVER_TAG = "capa"
PAGE_FOOTER = "^Página \\p{Nd}+$"

PART_PRODUCTS = "produtos"
PART_PROMOTIONS = "promocoes"
PART_CUSTOMERS = "clientes"
PART_ORDERS = "pedidos"
PART_ADVICE = "aviso"
PART_ERROR = "error"
SOURCE_MANUAL = "manual"
SOURCE_CATALOGUE = "catalogo"
TOOL_SEARCH = "search_store"
TOOL_CONTEXT = "load_context"

DEFAULT_LIMIT = 6
CATEGORY_PAGE = 100
SUGGESTION_PAGE = 1000
SUGGESTIONS_SHOWN = 5
HISTORY_LIMIT = 24
MAX_CHUNK_CHARS = 1200
MAX_TITLE_CHARS = 90
STORE_ZONE = "America/Campo_Grande"
