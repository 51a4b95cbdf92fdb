"""Column expressions over registry cells, search texts and small domain tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.documents import CNPJ_IN_TEXT, cpf_in_text, documents_in_text, let, normalize_name, strip_documents

# The states of Brazil.
UFS = ("AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO")
# Bank words that are no part of a name.
BANK_WORDS = (
    "CRED PIX", "DEB PIX", "CRED TEV", "DEB TEV", "PIX TRANSF", "PIX RECEBIDO", "RECEBIDO EFETIVADO", "PAGTO", "PAGAMENTO", "TED", "DOC", "DOC/TED",
    "DEPOSITO", "SAQUE", "TARIFA", "SALDO", "TRANSFERENCIA", "TRANSF",
)
# What names a person's type, in capitals without accents, words joined by underscores.
PERSON_TYPES = {"PF": "PF", "PJ": "PJ", "FISICA": "PF", "JURIDICA": "PJ", "PESSOA_FISICA": "PF", "PESSOA_JURIDICA": "PJ"}
# Error classes and what a message says that falls into one; the first that fits counts.
ERROR_CLASSES = (
    ("OPENROUTER_NAO_CONFIGURADO", r"OPENROUTER_API_KEY"),
    ("OPENROUTER_NAO_CONFIGURADO", r"(?is)^(?=.*openrouter http 401)(?=.*(?:user not found|missing authentication))"),
    ("PDF_MUITAS_PAGINAS", r"(?i)mais de [0-9]+ p[áÁ]ginas"),
    ("OPENROUTER_FALHA", r"(?i)openrouter http|abort|openrouter response|runtime timeout|task timed out"),
    ("PDF_INVALIDO", r"(?i)@napi-rs/canvas|invalid pdf|pdfdocument|dommatrix|pdf-parse|path2d|imagedata"),
    ("STORAGE_FALHA", r"(?i)falha no storage|falha ao baixar arquivo|blob"),
    ("PDF_SEM_TEXTO_E_VISAO_FALHOU", r"(?i)sem texto|texto insuficiente|vis[ãÃ]o|vision|n[ãÃ]o foi poss[íÍ]vel extrair"),
)
_BEFORE, _AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def is_uf(c: Column) -> Column:
    return F.upper(c).isin(*UFS)


def is_placeholder_cnpj(c: Column) -> Column:
    """Whether a filing entity's number is one of those that stand in for a real one: eleven zeros first."""
    return F.startswith(c, F.lit("0" * 11))


def error_class(message: Column) -> Column:
    """The class of an ingest error, by its message."""
    kind = F.lit("INGESTAO_DESCONHECIDA")
    for name, says in reversed(ERROR_CLASSES):
        kind = F.when(message.rlike(says), name).otherwise(kind)
    return kind


def person_type(c: Column) -> Column:
    """PF or PJ for what a type cell says, else null."""
    key = F.regexp_replace(normalize_name(c), " ", "_")
    known = F.create_map(*[F.lit(x) for kv in PERSON_TYPES.items() for x in kv])
    return F.try_element_at(known, key)


def number_cell(c: Column) -> Column:
    """The text of a numeric cell: its integer digits, padded to a document's length where leading zeros went missing."""
    padded = lambda d: F.when(F.length(d).between(7, 10), F.lpad(d, 11, "0")).when(F.length(d).between(12, 13), F.lpad(d, 14, "0")).otherwise(d)
    return let(F.abs(c.cast("decimal(38,0)")).cast("string"), padded)


def text_cell(c: Column) -> Column:
    """The text of a cell: trimmed, numbers in scientific notation written out, a decimal part of zeros dropped; null is empty."""

    def written_out(text: Column) -> Column:
        number = F.abs(F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))
        whole = let(number, lambda n: F.when(n < 1e18, F.floor(n).cast("decimal(38,0)")).when(n < 1e38, n.cast("decimal(38,0)")))
        scientific = F.when(text.rlike(r"^[+-]?[0-9]+[,.]?[0-9]*[eE][+-]?[0-9]+$"), number_cell(whole))
        return F.coalesce(scientific, F.when(text.rlike("^[0-9]+[,.]0+$"), F.regexp_replace(text, "[,.]0+$", "")).otherwise(text))

    return let(F.trim(F.coalesce(c, F.lit(""))), written_out)


def prepared_document(c: Column, tipo: Column | None = None) -> Column:
    """A struct of tipo, documento and erro for a document cell.

    Label, blanks and marks go. Without a type given, up to 11 characters are a CPF and up to 14 a CNPJ. A CPF is padded
    to 11 digits, an all-digit CNPJ of 12 or more to 14.
    """

    def sized(clean: Column) -> Column:
        n = F.length(clean)
        guessed = F.when(n <= 11, "PF").when(n <= 14, "PJ")
        kind = guessed if tipo is None else F.coalesce(tipo, guessed)
        cpf, cnpj = F.regexp_replace(clean, "[^0-9]", ""), F.upper(clean)
        digits_only = cnpj.rlike("^[0-9]+$")
        fits = F.when(kind == "PF", F.length(cpf) <= 11).when(kind == "PJ", (n <= 14) & (~digits_only | (n >= 12)))
        error = F.when(clean == "", "Documento vazio").when(~F.coalesce(fits, F.lit(False)), "Documento com tamanho inválido")
        document = F.when(kind == "PF", F.lpad(cpf, 11, "0")).when(digits_only, F.lpad(cnpj, 14, "0")).otherwise(cnpj)
        found = F.struct(kind.alias("tipo"), document.alias("documento"), error.alias("erro"))
        return let(found, lambda f: F.struct(F.when(f["erro"].isNull(), f["tipo"]).alias("tipo"), F.when(f["erro"].isNull(), f["documento"]).alias("documento"), f["erro"].alias("erro")))

    bare = F.regexp_replace(F.regexp_replace(text_cell(c), r"[\s\x{00A0}\x{2007}\x{202F}]+", ""), r"(?i)^(cpf|cnpj)[:#.]?", "")
    bare = let(bare, lambda b: F.when(b.rlike("^[0-9]+[,.]0+$"), F.regexp_replace(b, "[,.]0+$", "")).otherwise(b))
    return let(F.regexp_replace(bare, "[^A-Za-z0-9]", ""), sized)


def suggested_name(description: Column) -> Column:
    """The counterparty's name that a description holds: without its first document, labels, bank words and marks; empty below 3 characters."""
    first = F.coalesce(cpf_in_text(description), F.nullif(F.regexp_extract(description, CNPJ_IN_TEXT, 0), F.lit("")), F.lit(""))
    at = F.instr(description, first)
    without = F.when(first == "", description).otherwise(F.concat(F.substring(description, F.lit(1), at - 1), F.substring(description, at + F.length(first), F.length(description))))
    for words in (("CPF", "CNPJ"), BANK_WORDS):
        without = F.regexp_replace(without, rf"(?i){_BEFORE}(?:{'|'.join(words)}){_AFTER}", "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(without, "[-|:,]", ""), r"\s+", " "))
    return F.when(F.length(clean) >= 3, normalize_name(clean)).otherwise("")


def clean_description(c: Column) -> Column:
    return normalize_name(strip_documents(c))


def name_is_empty(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) < 3


def effective_name(kept: Column, origins: Column) -> Column:
    """The counterparty of a line: the name kept, else one derived from its origins (an array of papel and descricao structs, in order).

    The PIX name counts where the COMPLETO line holds a document, then COMPLETO, then PIX, then the first longest of all.
    """
    names = F.transform(origins, lambda o: F.struct(o["papel"].alias("papel"), suggested_name(F.coalesce(o["descricao"], F.lit(""))).alias("nome"), o["descricao"].alias("descricao")))
    first = lambda role: F.get(F.filter(names, lambda o: o["papel"] == role), F.lit(0))
    pix, full = first("PIX"), first("COMPLETO")
    documented = F.coalesce(F.size(documents_in_text(full["descricao"])) > 0, F.lit(False))
    longest = F.aggregate(names, F.lit(""), lambda a, o: F.when(F.length(o["nome"]) > F.length(a), o["nome"]).otherwise(a))
    derived = F.when(~name_is_empty(pix["nome"]) & documented, pix["nome"]).when(~name_is_empty(full["nome"]), full["nome"]).when(~name_is_empty(pix["nome"]), pix["nome"]).otherwise(longest)
    return F.when(~name_is_empty(kept), normalize_name(kept)).otherwise(derived)


def search_amount(c: Column) -> Column:
    """An amount text as decimal(15,2): grouped or plain, comma or dot, with or without R$; null if it is none."""
    text = F.trim(F.regexp_replace(c, r"(?i)R\$\s*", ""))
    grouped = text.rlike(r"^[0-9]{1,3}(\.[0-9]{3})*,[0-9]{2}$")
    plain = F.when(grouped, F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
    number = F.regexp_replace(plain, ",", ".")
    return F.when(number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), number.try_cast("decimal(15,2)"))


def amount_texts(amount: Column) -> Column:
    """How a statement may write an amount: eight forms."""
    dot = amount.cast("decimal(15,2)").cast("string")
    comma = F.replace(dot, F.lit("."), F.lit(","))
    grouped = F.regexp_replace(comma, r"\B(?=([0-9]{3})+(?![0-9]))", ".")
    forms = (grouped, comma, dot)
    return F.array(*forms, *[F.concat(F.lit("R$ "), f) for f in forms], F.concat(F.lit("R$"), grouped), F.concat(F.lit("R$"), dot))


def date_texts(day: Column) -> Column:
    """How a statement may write a date: three forms, the last within the others."""
    return F.array(*[F.date_format(day, f) for f in ("dd/MM/yyyy", "dd/MM/yy", "dd/MM")])


def period_text(first: Column, last: Column) -> Column:
    """dd/mm/yyyy, or two of them joined by a."""
    a, b = F.date_format(first, "dd/MM/yyyy"), F.date_format(last, "dd/MM/yyyy")
    return F.when(first == last, a).otherwise(F.concat(a, F.lit(" a "), b))


def box_is_valid(box: Column) -> Column:
    """Whether x, y, w and h lie in 0 to 1, with an extent, and reach no farther than 1.001."""
    sides = [box[n] for n in ("x", "y", "w", "h")]
    inside = sides[0].between(0, 1)
    for s in sides[1:]:
        inside = inside & s.between(0, 1)
    return F.coalesce(inside & (box["w"] > 0) & (box["h"] > 0) & (box["x"] + box["w"] <= 1.001) & (box["y"] + box["h"] <= 1.001), F.lit(False))


