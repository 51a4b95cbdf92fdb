"""A model's opinion on lines: the registry's candidates that it is asked about, and what its answers change.

The model is called elsewhere; its answers are a table. Candidates come from documents in a line's text and from names
that hold one of its words, found through an inverted index of runs of four characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.documents import documents_in_text, normalize_cnpj, normalize_cpf
from ledgerloom.operators.consolidate import _grams
from ledgerloom.operators.ledger import APPROVED, CONFLICT_CAP, REQUIRED
from ledgerloom.operators.storage import written

#: Length of the index's runs, which is that of the shortest word looked up; words of a line, and people for each word and type.
GRAM, WORDS, PEOPLE = 4, 3, 3
UNKNOWN = "Cadastro pendente"
EVIDENCE = "array<struct<tipo:string,peso:double,detalhe:string>>"


def probe_words(text: Column) -> Column:
    """The first WORDS words of GRAM characters or more of a text."""
    return F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\x{00A0}]+"), lambda t: F.length(t) >= GRAM), 1, WORDS)


def people_holding(words: DataFrame, registry: DataFrame) -> DataFrame:
    """palavra, tipo, pessoa_id, documento, nome and k: for each distinct word the first PEOPLE people of each type, by id, whose name holds it.

    A name is indexed by its distinct runs of GRAM characters and a word looks up the rarest of its own, so no word meets
    the whole registry unless it is in all names. The best of each word are kept before the shuffle (a window's group
    limit). Capitals count, and no character is a wildcard.
    """
    words = words.select("palavra").distinct()
    names = registry.select("tipo", "pessoa_id", "documento", "nome").where("nome IS NOT NULL")
    posted = names.withColumn("_run", F.explode(F.array_distinct(_grams(F.col("nome"), GRAM))))
    sizes = posted.groupBy("_run").agg(F.count("*").alias("_n"))
    runs = words.withColumn("_run", F.explode(F.array_distinct(_grams(F.col("palavra"), GRAM)))).join(sizes, "_run", "left")
    # A word with a run that no name has is in no name.
    rarest = runs.groupBy("palavra").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_run")).alias("r")).where("r.n > 0").select("palavra", "r._run")
    # Written, so that Spark knows its size: few words meet the index without a shuffle of it, in which a run of most names would fill one task.
    rarest = written(rarest, "rarest")
    met = rarest.join(posted, "_run").where(F.col("nome").contains(F.col("palavra")))
    place = F.row_number().over(Window.partitionBy("palavra", "tipo").orderBy("pessoa_id"))
    return met.withColumn("k", place).where(F.col("k") <= PEOPLE).drop("_run")


def candidates(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """id, ordem, tipo, documento and nome: the people to ask about for each line (id, descricao_raw), each once.

    First those whose documents stand in the text (UNKNOWN for a document that the registry lacks), then for each of its
    words the people whose names hold it, PF before PJ, by id.
    """
    d = written(lines.select("id", documents_in_text(F.coalesce("descricao_raw", F.lit(""))).alias("documentos"), probe_words(F.col("descricao_raw")).alias("palavras")), "asked")
    said = d.select("id", F.posexplode("documentos").alias("at", "documento")).withColumn("tipo", F.when(F.length("documento") == 11, "PF").otherwise("PJ"))
    # Only people whose documents are said are looked up, and written, so that Spark knows their size: a frequent document fills no task of a join.
    known = registry.join(said.select("tipo", "documento").distinct(), ["tipo", "documento"], "left_semi").groupBy("tipo", "documento").agg(F.min("nome").alias("nome"))
    known = written(known, "known")
    of_documents = said.join(known, ["tipo", "documento"], "left").select("id", F.struct(F.lit(0).alias("a"), F.col("at").alias("b"), F.lit("").alias("c"), F.lit(0).alias("d")).alias("_at"), "tipo", "documento", F.coalesce("nome", F.lit(UNKNOWN)).alias("nome"))
    asked = d.select("id", F.posexplode("palavras").alias("at", "palavra"))
    held = written(people_holding(asked, registry), "probe")
    of_words = asked.join(held, "palavra").select("id", F.struct(F.lit(1).alias("a"), F.col("at").alias("b"), F.col("tipo").alias("c"), F.col("k").alias("d")).alias("_at"), "tipo", "documento", "nome")
    # A line has few candidates: its documents and at most WORDS times two times PEOPLE names.
    each = of_documents.unionByName(of_words).groupBy("id", "tipo", "documento").agg(F.min(F.struct("_at", "nome")).alias("m"))
    return each.withColumn("ordem", F.row_number().over(Window.partitionBy("id").orderBy("m._at"))).select("id", "ordem", "tipo", "documento", F.col("m.nome").alias("nome"))


def _proof(kind: Column | str, detail: Column | str, weight: Column | float = 0.0) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(kind).alias("tipo"), as_column(weight).cast("double").alias("peso"), as_column(detail).alias("detalhe"))


def apply_answers(lines: DataFrame, evidence: DataFrame, registry: DataFrame, classes: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines and evidence (movimentacao_id, tipo, peso, detalhe) after the model's answers.

    answers: movimentacao_id, mesmo_evento, confianca, justificativa, pessoa_tipo, pessoa_documento, campos_faltantes
    and evidencias (tipo, detalhe); one row for a line, an empty confianca standing for a failed call. Approved lines
    stay as they are. All others have their evidence replaced: by the answer's, by IA_INDISPONIVEL if a line with
    candidates has no answer, by gaps alone if it has no candidates. The answer's person is taken if the registry has the
    document; a wrong one is noted. Confidence is the evidence's sum, under the conflict's cap, and every line is blocked,
    as no classification is looked at when the score is taken; a line without an answer becomes a draft.
    """
    open_lines = lines.where(~F.col("status").isin(*APPROVED))
    asked = candidates(open_lines, registry).select("id").distinct().withColumn("_asked", F.lit(True))
    gaps = classes.select(F.col("movimentacao_id").alias("id"), F.array_compact(F.array(*[F.when(F.coalesce(F.col(f), F.lit("")) == "", f) for f in REQUIRED])).alias("_gaps"))
    said = answers.where("confianca IS NOT NULL").dropDuplicates(["movimentacao_id"]).select(F.col("movimentacao_id").alias("id"), F.struct(*[c for c in answers.columns if c != "movimentacao_id"]).alias("_a"))
    d = open_lines.join(asked, "id", "left").join(gaps, "id", "left").join(said, "id", "left")
    d = d.withColumn("_a", F.when(F.col("_asked"), F.col("_a")))
    answered = F.col("_a").isNotNull()
    number = F.nullif(F.regexp_replace("_a.pessoa_documento", "[^0-9]", ""), F.lit(""))
    told = F.col("_a.pessoa_tipo").isin("PF", "PJ") & number.isNotNull()
    valid = F.when(F.col("_a.pessoa_tipo") == "PF", normalize_cpf(number)).otherwise(normalize_cnpj(number))
    d = d.withColumns({"_numero": F.when(told, number), "_valido": F.when(told, valid), "_tipo": F.when(told, F.col("_a.pessoa_tipo"))})
    known = registry.groupBy(F.col("tipo").alias("_tipo"), F.col("documento").alias("_valido")).agg(F.min("pessoa_id").alias("_quem"))
    some = d.where("_valido IS NOT NULL").join(known, ["_tipo", "_valido"], "left")
    d = some.unionByName(d.where("_valido IS NULL").withColumn("_quem", F.lit(None).cast("long")))

    certain = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_a.confianca")))
    missing = F.coalesce("_a.campos_faltantes", F.array().cast("array<string>"))
    given = F.transform(F.coalesce("_a.evidencias", F.array().cast("array<struct<tipo:string,detalhe:string>>")), lambda e: _proof(F.coalesce(e["tipo"], F.lit("IA_JUSTIFICATIVA")), F.coalesce(e["detalhe"], F.lit(""))))
    gap = lambda c: _proof("LACUNA_XSD", c)
    of_answer = F.concat(
        F.array(_proof("IA_MESMO_EVENTO", F.when(F.col("_a.mesmo_evento"), "mesmo evento").otherwise("evento incerto"), certain), _proof("IA_JUSTIFICATIVA", F.coalesce("_a.justificativa", F.lit("")))),
        given, F.transform(missing, gap),
    )
    wrong = F.when(F.col("_numero").isNotNull() & F.col("_valido").isNull(), F.array(_proof("DOCUMENTO_INVALIDO", F.concat(F.lit("Documento inválido: "), "_numero"))))
    rest = F.transform(F.filter(F.coalesce("_gaps", F.array(*[F.lit(f) for f in REQUIRED])), lambda g: ~F.array_contains(missing, g)), gap)
    none = F.array().cast(EVIDENCE)
    proofs = F.concat(F.when(answered, of_answer).when(F.col("_asked"), F.array(_proof("IA_INDISPONIVEL", "OpenRouter indisponível"))).otherwise(none), F.coalesce(wrong, none), rest)
    d = d.withColumn("_provas", proofs)
    total = F.aggregate("_provas", F.lit(0.0), lambda a, e: a + F.when(e["tipo"].startswith("CONFLITO"), 0.0).otherwise(e["peso"]))
    capped = F.exists("_provas", lambda e: e["tipo"].startswith("CONFLITO"))
    new = {
        "confianca": F.least(F.lit(1.0), total, F.when(capped, CONFLICT_CAP)), "bloqueio_export": F.lit(True), "status": F.when(answered, "PENDENTE_REVISAO").otherwise("RASCUNHO"),
        "pessoa": F.when(F.col("_quem").isNotNull(), F.struct(F.col("_tipo").alias("tipo"), F.col("_quem").alias("id"))).otherwise(F.col("pessoa")),
    }
    d = written(d.withColumns({f"_novo_{c}": v for c, v in new.items()}).drop("_a"), "answered")
    changed = d.select(*[F.col(f"_novo_{c}").alias(c) if c in new else F.col(c) for c in lines.columns])
    kept = evidence.select("movimentacao_id", "tipo", "peso", "detalhe").join(d.select(F.col("id").alias("movimentacao_id")), "movimentacao_id", "left_anti")
    proven = d.select(F.col("id").alias("movimentacao_id"), F.explode("_provas").alias("e")).select("movimentacao_id", "e.tipo", "e.peso", "e.detalhe")
    return lines.where(F.col("status").isin(*APPROVED)).unionByName(changed), kept.unionByName(proven)
