"""Where each attribute of a consolidation event comes from: arrays of tagged references.

A reference is a struct with a tipo and the fields of all kinds, those of other kinds null; as JSON (references_json) it
has the fields of its kind alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = (
    "struct<tipo:string,movimentacao_id:bigint,arquivo_id:bigint,nome_arquivo:string,pagina:int,indice_linha:int,bbox:struct<x:double,y:double,w:double,h:double>,campo:string,"
    "pessoa:struct<tipo:string,id:bigint>,match_tipo:string,movimentacao_ids:array<bigint>,regra:string,detalhe:string,motivo:string>"
)
ATTRIBUTES = ("data_movimento", "valor", "direcao", "pessoa", "confianca")
# What an event's justification says, and the rule that it stands for; the first that fits counts.
RULES = (
    ("Mesmo CPF", "MESMA_DATA_VALOR_CPF"), ("CPF no extrato completo", "CPF_COMPLETO_NOME_CADASTRO"), ("cadastro", "NOME_CADASTRO_UF"), ("descrição equivalente", "MESMA_DATA_VALOR_NOME"), ("CPF na linha", "CPF_LINHA_CADASTRO"),
)
OTHER_RULE = "MESMA_DATA_VALOR_DIRECAO"
BY_NAME = ("Nome único", "nome alinhado")


def rule_of(justification: Column) -> Column:
    """The rule that a justification names."""
    found = F.lit(OTHER_RULE)
    for says, rule in reversed(RULES):
        found = F.when(justification.contains(says), rule).otherwise(found)
    return found


def _reference(**fields: Column | str) -> Column:
    """A reference with these fields, all others null."""
    names = [part.split(":")[0] for part in ("tipo", "movimentacao_id", "arquivo_id", "nome_arquivo", "pagina", "indice_linha", "bbox", "campo", "pessoa", "match_tipo", "movimentacao_ids", "regra", "detalhe", "motivo")]
    value = lambda n: fields[n] if isinstance(fields.get(n), Column) else F.lit(fields.get(n))
    return F.struct(*[value(n).alias(n) for n in names]).cast(REFERENCE)


def _of_page(line: Column, field: str) -> Column:
    """The place on a page of a line's field, or of the line where the field has none of its own; null without an origin."""
    origin = line["origem"]
    own = F.try_element_at(origin["campos"], F.lit(field))
    at = lambda n: F.coalesce(own[n], origin[n])
    page = _reference(tipo="PDF", movimentacao_id=line["id"], arquivo_id=origin["arquivo_id"], nome_arquivo=origin["nome_arquivo"], pagina=at("pagina"), indice_linha=at("indice_linha"), bbox=at("bbox"), campo=field)
    return F.when(origin.isNotNull(), page)


def _or_missing(reference: Column) -> Column:
    return F.coalesce(reference, _reference(tipo="INDISPONIVEL", motivo="ingestao_anterior"))


def event_origins(events: DataFrame, event_lines: DataFrame, lines: DataFrame) -> DataFrame:
    """evento_id and for each of ATTRIBUTES its references.

    events: evento_id, justificativa, confianca, pessoa (tipo and id, or null). event_lines: evento_id, posicao, id.
    lines: id, cpf (read from the line), origem (arquivo_id, nome_arquivo, pagina, indice_linha, bbox, cpf and cnpj, and
    campos: field to pagina, indice_linha and bbox), or null for a line of an older ingest. Lines that are not there are
    left out. An event's lines are few and are gathered in its row.
    """
    members = event_lines.join(lines.select("id", "cpf", "origem"), "id").groupBy("evento_id").agg(F.array_sort(F.collect_list(F.struct("posicao", "id", "cpf", "origem")), lambda a, b: F.when(a["posicao"] < b["posicao"], -1).when(a["posicao"] > b["posicao"], 1).otherwise(0)).alias("linhas"))
    d = events.select("evento_id", F.coalesce("justificativa", F.lit("")).alias("_dito"), "confianca", "pessoa").join(members, "evento_id", "left")
    d = d.withColumns({"linhas": F.coalesce("linhas", F.array().cast(members.schema["linhas"].dataType)), "_regra": rule_of(F.col("_dito"))})
    # What several references are made of is a column of its own, so that it is worked out once for an event.
    documented = F.filter("linhas", lambda m: (F.coalesce(m["cpf"], F.lit("")) != "") | m["origem"]["cpf"].isNotNull() | m["origem"]["cnpj"].isNotNull())
    d = d.withColumns({"_documentada": F.get(documented, F.lit(0)), "_primeira": F.get("linhas", F.lit(0)), "_ids": F.transform("linhas", lambda m: m["id"])})
    d = d.withColumns({"_cpf": _of_page(F.col("_documentada"), "cpf"), "_cpf_primeira": _of_page(F.col("_primeira"), "cpf")})
    n, none = F.size("linhas"), F.array().cast(f"array<{REFERENCE}>")
    each = lambda field: F.transform("linhas", lambda m: _or_missing(_of_page(m, field)))
    crossed = lambda detail: F.array(_reference(tipo="CRUZAMENTO_PDF", movimentacao_ids=F.col("_ids"), regra=F.col("_regra"), detalhe=detail))
    some = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    of_lines = F.when(n >= 2, F.concat(crossed(F.col("_dito")), some(F.col("_cpf")))).when(n == 1, F.array(F.coalesce(F.col("_cpf_primeira"), _or_missing(_of_page(F.col("_primeira"), "nome"))))).otherwise(none)
    by_name = F.col("_dito").contains(BY_NAME[0]) | F.col("_dito").contains(BY_NAME[1])
    known = _reference(tipo="CADASTRO_UF", pessoa=F.col("pessoa"), match_tipo=F.when(by_name, "NOME_CADASTRO").otherwise("CPF_CADASTRO"))
    of_registry = F.when(F.col("pessoa").isNotNull(), F.array(known)).otherwise(none)
    d = d.withColumn("_pessoa", F.concat(of_lines, of_registry))
    score = F.concat(F.lit("confianca="), F.regexp_replace(F.col("confianca").cast("string"), r"\.0$", ""))
    return d.select(
        "evento_id", each("data").alias("data_movimento"), each("valor").alias("valor"), each("direcao").alias("direcao"),
        F.when(F.size("_pessoa") > 0, F.col("_pessoa")).otherwise(F.array(_reference(tipo="INDISPONIVEL", motivo="sem_vinculo"))).alias("pessoa"),
        crossed(F.when(n >= 2, F.col("_dito")).otherwise(score)).alias("confianca"),
    )


def reference_rows(origins: DataFrame) -> DataFrame:
    """evento_id, atributo, posicao and r: a row for each reference. The rows of origins are read once for all attributes."""
    each = origins.select("evento_id", F.explode(F.array(*[F.struct(F.lit(a).alias("atributo"), F.col(a).alias("refs")) for a in ATTRIBUTES])).alias("x"))
    return each.select("evento_id", "x.atributo", F.posexplode("x.refs").alias("posicao", "r"))


def references_json(origins: DataFrame) -> DataFrame:
    """evento_id and origem_atributos: version and references as JSON, each with the fields of its kind."""
    return origins.select("evento_id", F.to_json(F.struct(F.lit(1).alias("versao"), *ATTRIBUTES)).alias("origem_atributos"))


def read_back(documents: DataFrame) -> DataFrame:
    """event_origins()' rows from what references_json() wrote."""
    schema = "struct<versao:int," + ",".join(f"{a}:array<{REFERENCE}>" for a in ATTRIBUTES) + ">"
    return documents.select("evento_id", F.from_json("origem_atributos", schema).alias("o")).select("evento_id", *[f"o.{a}" for a in ATTRIBUTES])


def enrichment(origins: DataFrame) -> DataFrame:
    """evento_id and refs: the references that an approval leaves on the main line, those of the person but pages, then those
    of the confidence; null if there are none."""
    refs = F.concat(F.filter("pessoa", lambda r: r["tipo"] != "PDF"), "confianca")
    return origins.select("evento_id", F.when(F.size(refs) > 0, refs).alias("refs"))
