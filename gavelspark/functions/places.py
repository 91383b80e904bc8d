"""States, cities in text, categories and auction types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STATES
from .binding import let
from .text import fold_accents

#: Fixed values.
STATE_NAMES = {
    "acre": "AC", "alagoas": "AL", "amapa": "AP", "amazonas": "AM", "bahia": "BA", "ceara": "CE", "distrito federal": "DF", "espirito santo": "ES", "goias": "GO",
    "maranhao": "MA", "mato grosso": "MT", "mato grosso do sul": "MS", "minas gerais": "MG", "para": "PA", "paraiba": "PB", "parana": "PR", "pernambuco": "PE",
    "piaui": "PI", "rio de janeiro": "RJ", "rio grande do norte": "RN", "rio grande do sul": "RS", "rondonia": "RO", "roraima": "RR", "santa catarina": "SC",
    "sao paulo": "SP", "sergipe": "SE", "tocantins": "TO",
}
#: States by name, in the order in which parts of names are compared. Fixed values.
STATE_LABELS = {
    "AC": "Acre", "AL": "Alagoas", "AP": "Amapá", "AM": "Amazonas", "BA": "Bahia", "CE": "Ceará", "DF": "Distrito Federal", "ES": "Espírito Santo", "GO": "Goiás", "MA": "Maranhão", "MT": "Mato Grosso",
    "MS": "Mato Grosso do Sul", "MG": "Minas Gerais", "PA": "Pará", "PB": "Paraíba", "PR": "Paraná", "PE": "Pernambuco", "PI": "Piauí", "RJ": "Rio de Janeiro", "RN": "Rio Grande do Norte",
    "RS": "Rio Grande do Sul", "RO": "Rondônia", "RR": "Roraima", "SC": "Santa Catarina", "SP": "São Paulo", "SE": "Sergipe", "TO": "Tocantins",
}
#: Spellings of a listing's category, and the parts of words that are looked for after them, in order. Fixed values.
CATEGORY_SPELLINGS = {
    "apartamento": "Apartamento", "apto": "Apartamento", "apt": "Apartamento", "casa": "Casa", "residencia": "Casa", "residência": "Casa", "sobrado": "Casa", "terreno": "Terreno", "lote": "Terreno", "gleba": "Terreno",
    "comercial": "Comercial", "prédio comercial": "Comercial", "predio comercial": "Comercial", "galpão": "Comercial", "galpao": "Comercial", "rural": "Rural", "fazenda": "Rural", "sítio": "Rural", "sitio": "Rural",
    "chácara": "Rural", "chacara": "Rural", "garagem": "Garagem", "vaga": "Garagem", "box": "Garagem", "loja": "Loja", "sala comercial": "Sala Comercial", "sala": "Sala Comercial", "conjunto": "Sala Comercial",
    "área": "Área", "area": "Área", "outro": "Outro", "outros": "Outro", "não informado": "Outro", "nao informado": "Outro", "": "Outro",
}
CATEGORY_PARTS = [
    ("Apartamento", "apartamento|apto"), ("Casa", "casa|sobrado|residencia"), ("Terreno", "terreno|lote"), ("Comercial", "comercial|galpão|galpao"), ("Rural", "rural|fazenda|sítio|chácara"), ("Garagem", "garagem|vaga"),
    ("Loja", "loja"), ("Sala Comercial", "sala"),
]
#: Category by the first word that is met in this order. Fixed values.
CATEGORY_WORDS = [
    ("Apartamento", "apartamento|apto|flat|kitnet|cobertura|loft|studio"), ("Casa", "casa|sobrado|residencia|residência|chalé|chale|mansão"),
    ("Terreno", "terreno|lote|gleba"), ("Comercial", "comercial|loja|sala|galpão|galpao|escritório|escritorio|ponto"), ("Estacionamento", "estacionamento|garagem|vaga|box"),
    ("Rural", "rural|fazenda|sítio|sitio|chácara|chacara|haras"), ("Prédio", "prédio|predio|edifício|edificio"), ("Área", "área|area"),
]
#: Words of things that are no real estate, and of those that are. Fixed values.
OTHER_GOODS = (
    "carro|moto|motocicleta|caminhão|caminhao|veículo|veiculo|automóvel|automovel|auto|ônibus|onibus|van|pickup|picape|trator|reboque|carreta|cavalo mecânico|empilhadeira|retroescavadeira|escavadeira|motoniveladora|"
    "pá carregadeira|rolo compactador|máquina|maquina|equipamento|ferramenta|gerador|compressor|motor|bomba|eletrônico|eletronico|computador|notebook|celular|smartphone|tablet|televisão|televisao|tv|monitor|impressora|"
    "servidor|joia|jóia|relógio|relogio|anel|colar|pulseira|brinco|obra de arte|quadro|escultura|móvel|movel|mobília|mobilia|sofá|sofa|mesa|cadeira|armário|armario|estante|eletrodoméstico|eletrodomestico|geladeira|fogão|"
    "crédito|credito|direito|ação|acao|quota|participação|participacao|título|titulo|semovente|gado|boi|vaca|cavalo|animal|sucata"
)
ESTATE_WORDS = "imóvel|imovel|apartamento|casa|terreno|lote|sala|loja|galpão|galpao|fazenda|sítio|sitio|chácara|chacara|prédio|predio|garagem|sobrado"


def state_code(c: Column) -> Column:
    """A code, a full name, or XX."""
    up, name = F.upper(F.trim(c)), fold_accents(F.lower(F.trim(c)))
    names = F.create_map(*(F.lit(x) for pair in STATE_NAMES.items() for x in pair))
    return F.when(up.isin(*STATES), up).otherwise(F.coalesce(names[name], F.lit("XX")))


def short_state(c: Column) -> Column:
    """As state_code, but any two letters stay as they are."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "XX").when(F.length(F.trim(c)) == 2, F.upper(F.trim(c))).otherwise(state_code(c))


def state_prefix(c: Column) -> Column:
    """The code that a text begins with, in any case, else XX."""
    code = F.upper(F.left(F.upper(F.trim(c)), F.lit(2)))
    return F.when(code.isin(*STATES), code).otherwise("XX")


def named_state(c: Column) -> Column:
    """A code; the code of a name; of the first name that holds the text or is held
    by it; else the text's first two letters. Nothing for less than two."""

    def chosen(s: Column) -> Column:
        low = F.lower(s)
        exact = F.create_map(*(F.lit(x) for code, name in STATE_LABELS.items() for x in (name.lower(), code)))[low]
        part = F.coalesce(*(F.when(F.contains(F.lit(name.lower()), low) | F.contains(low, F.lit(name.lower())), code) for code, name in STATE_LABELS.items()))
        return F.when(s == "", "").when(s.isin(*STATES), s).otherwise(F.coalesce(exact, part, F.when(F.length(s) >= 2, F.left(s, F.lit(2))), F.lit("")))

    return let(F.upper(F.trim(F.coalesce(c, F.lit("")))), chosen)


def listing_category(c: Column) -> Column:
    """A spelling of a category, else the first of which a part is in the text, else Outro."""

    def chosen(low: Column) -> Column:
        parts = F.coalesce(*(F.when(low.rlike(words), name) for name, words in CATEGORY_PARTS))
        return F.coalesce(F.create_map(*(F.lit(x) for pair in CATEGORY_SPELLINGS.items() for x in pair))[low], parts, F.lit("Outro"))

    return let(F.lower(F.trim(F.coalesce(c, F.lit("")))), chosen)


def place_from(text: Column, url: Column) -> Column:
    """(state, city) of "city/UF" or of the last two parts between commas, else of
    the path /uf/city-name/ of the page."""
    parts = F.split(text, r"\s*,\s*")
    last = F.trim(F.element_at(parts, -1))
    own = place_in(text)
    by_comma = last.isin(*STATES) & (F.size(parts) > 1)
    path = F.upper(F.regexp_extract(url, r"/([a-z]{2})/([a-z-]+)/", 1))
    by_path = F.when(path.isin(*STATES), F.initcap(F.replace(F.regexp_extract(url, r"/([a-z]{2})/([a-z-]+)/", 2), F.lit("-"), F.lit(" "))))
    return F.struct(
        F.coalesce(F.when(by_comma, last), own["state"], F.when(path.isin(*STATES), path)).alias("state"),
        F.coalesce(F.when(by_comma, F.trim(F.get(parts, F.size(parts) - 2))), F.trim(F.regexp_replace(own["city"], r"^.*,\s*", "")), by_path).alias("city"),
    )


def state_in(c: Column) -> Column:
    """The state code that ends a text, after a dash, slash, comma or bracket; else null."""
    code = F.regexp_extract(c, r"[-/,(]\s*([A-Z]{2})\)?\s*$", 1)
    return F.when(code.isin(*STATES), code)


def place_in(c: Column) -> Column:
    """(city, state) of "… , City/UF" or "City - UF"."""
    pattern = r"([\p{L}'. ]+?)\s*[-/]\s*([A-Z]{2})\b"
    state = F.regexp_extract(c, pattern, 2)
    good = state.isin(*STATES)
    return F.struct(F.when(good, F.trim(F.regexp_extract(c, pattern, 1))).alias("city"), F.when(good, state).alias("state"))


def category(c: Column) -> Column:
    """The first category one of whose words is in the text, as a whole word; else Outro."""
    s, out = F.lower(F.coalesce(c, F.lit(""))), None
    for name, words in CATEGORY_WORDS:
        hit = s.rlike(rf"(?U)\b({words})s?\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Outro")


def auction_type(c: Column) -> Column:
    """Extrajudicial is tested before judicial, which it contains."""
    s = fold_accents(F.lower(F.coalesce(c, F.lit(""))))
    return F.when(s.contains("extrajudicial"), "Extrajudicial").when(s.contains("judicial"), "Judicial").when(s.contains("venda direta"), "Venda Direta").when(s.rlike("sfi|fiduci"), "Leilão SFI").otherwise("Outros")


def occupancy(c: Column) -> Column:
    s = fold_accents(F.lower(F.coalesce(c, F.lit(""))))
    return F.when(s.rlike(r"\b(desocupad[oa]|vag[oa]|livre)\b"), "desocupado").when(s.rlike(r"\bocupad[oa]\b"), "ocupado")


def is_estate(title: Column, url: Column, strict: bool = False) -> Column:
    """URL of other goods, then word of other goods, then word of real estate, else as strict says."""
    t, u = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return F.when(u.rlike(r"/(veiculos?|automoveis|automovel|carros?|motos?|maquinas?|equipamentos?|outros|diversos|bens-moveis|sucatas?)(/|$)"), False).when(t.rlike(rf"(?U)\b({OTHER_GOODS})s?\b"), False).when(t.rlike(rf"(?U)\b({ESTATE_WORDS})s?\b"), True).otherwise(not strict)
