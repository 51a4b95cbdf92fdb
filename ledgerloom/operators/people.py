"""Changes of the person registry: updates, deletions, resolved conflicts, and merges with re-pointed references.

Every function takes a list of requests and gives new tables; of several requests on one person the first counts, as they
are asked one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.documents import normalize_name
from ledgerloom.operators.storage import written

NOT_FOUND, GONE, INVALID = "Cadastro não encontrado", "Cadastro já excluído", "Dados inválidos ou sem alteração"
KEY = ["tipo", "pessoa_id"]


def _first(requests: DataFrame, *keys: str) -> DataFrame:
    """The first request of each key by ordem."""
    rest = [c for c in requests.columns if c not in keys]
    return requests.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ordem").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def delete_people(people: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """people with deletado set, and tipo, pessoa_id and resultado of each request (tipo, pessoa_id, ordem): excluida or why not."""
    asked = _first(requests, *KEY)
    d = asked.join(people.select(*KEY, F.col("deletado").alias("_era")), KEY, "left")
    result = F.when(F.col("_era").isNull(), NOT_FOUND).when(F.col("_era"), GONE).otherwise("excluida")
    new = people.join(asked.select(*KEY, F.lit(True).alias("_sai")), KEY, "left").withColumn("deletado", F.col("deletado") | F.coalesce("_sai", F.lit(False)))
    return new.select(*people.columns), d.select(*KEY, result.alias("resultado"))


def update_people(people: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """people with new names, voter numbers and aliases, and tipo, pessoa_id and resultado of each request: atualizada, igual or why not.

    requests: tipo, pessoa_id, ordem, campos (which of nome, titulo_eleitor and aliases are given), nome, titulo_eleitor
    and aliases. A name is normalised and must say something, a voter number is a natural person's, empty ones are none,
    aliases are taken as they are. A request that gives nothing, or nothing valid, changes nothing.
    """
    given = lambda f: F.array_contains(F.coalesce("campos", F.array().cast("array<string>")), f)
    asked = _first(requests, *KEY).select(
        *KEY, given("nome").alias("_n"), given("titulo_eleitor").alias("_t"), given("aliases").alias("_a"), normalize_name(F.coalesce("nome", F.lit(""))).alias("_nome"),
        F.nullif(F.trim("titulo_eleitor"), F.lit("")).alias("_titulo"), F.col("aliases").alias("_aliases"),
    )
    d = people.join(asked.withColumn("_pedida", F.lit(True)), KEY, "full")
    there = F.col("deletado").isNotNull() & ~F.coalesce("deletado", F.lit(True))
    bad = (~F.col("_n") & ~F.col("_t") & ~F.col("_a")) | (F.col("_n") & (F.col("_nome") == "")) | (F.col("_t") & (F.col("tipo") == "PJ"))
    same = lambda flag, old, new: ~F.col(flag) | F.col(old).eqNullSafe(F.col(new))
    equal = same("_n", "nome", "_nome") & same("_t", "titulo_eleitor", "_titulo") & same("_a", "aliases", "_aliases")
    # Without any field the request is refused before the person is looked for.
    nothing = ~F.col("_n") & ~F.col("_t") & ~F.col("_a")
    result = F.when(nothing, INVALID).when(~there, NOT_FOUND).when(bad, INVALID).when(equal, "igual").otherwise("atualizada")
    d = written(d.withColumn("resultado", F.when(F.col("_pedida"), result)), "updates")
    changed = F.col("resultado") == "atualizada"
    new = {"nome": ("_n", "_nome"), "titulo_eleitor": ("_t", "_titulo"), "aliases": ("_a", "_aliases")}
    column = lambda c: F.when(changed & F.col(new[c][0]), F.col(new[c][1])).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
    return d.where("deletado IS NOT NULL").select(*[column(c) for c in people.columns]), d.where("_pedida").select(*KEY, "resultado")


def resolve_conflicts(conflicts: DataFrame, people: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Resolves name conflicts: conflitos, pessoas, decisoes (conflito_id, ordem, resultado) and escopos (ordem, uf, exercicio).

    conflicts: conflito_id, tipo, pessoa_id, nome_proposto, status, resolucao, uf, exercicio. decisions: conflito_id,
    ordem, resolucao (MANTER_NOME, ATUALIZAR_NOME or IGNORADO). Only the first decision on a pending conflict counts. Of
    several names for a person the last is kept. escopos are the states and years to rematch, in order, each with the
    names up to then; a conflict without a state or year has none.
    """
    first = decisions.groupBy("conflito_id").agg(F.min("ordem").alias("_primeira"))
    known = conflicts.select("conflito_id", F.col("status").alias("_status"))
    d = decisions.join(first, "conflito_id").join(known, "conflito_id", "left")
    taken = (F.col("_status") == "PENDENTE") & (F.col("ordem") == F.col("_primeira"))
    result = F.when(F.col("_status").isNull(), "Conflito não encontrado").when(taken, "resolvido").otherwise("Conflito já foi resolvido")
    outcome = written(d.withColumn("resultado", result), "conflicts")
    good = outcome.where("resultado = 'resolvido'").select("conflito_id", "ordem", F.col("resolucao").alias("_nova"))
    all_of = conflicts.join(good, "conflito_id", "left")
    ignored = F.col("_nova") == "IGNORADO"
    status = F.when(F.col("_nova").isNull(), F.col("status")).when(ignored, "IGNORADO").otherwise("RESOLVIDO")
    reason = F.when(F.col("_nova").isNull(), F.col("resolucao")).when(~ignored, F.col("_nova"))
    renamed = all_of.where("_nova = 'ATUALIZAR_NOME' AND pessoa_id IS NOT NULL")
    names = renamed.groupBy(*KEY).agg(F.max_by("nome_proposto", "ordem").alias("_nome"))
    new_people = people.join(names, KEY, "left").withColumn("nome", F.coalesce("_nome", "nome")).select(*people.columns)
    scopes = all_of.where("_nova = 'ATUALIZAR_NOME' AND uf IS NOT NULL AND uf <> '—' AND exercicio <> 0").select("ordem", "uf", "exercicio")
    settled = {"status": status, "resolucao": reason}
    return {"conflitos": all_of.select(*[settled.get(c, F.col(c)).alias(c) for c in conflicts.columns]), "pessoas": new_people, "decisoes": outcome.select("conflito_id", "ordem", "resultado"), "escopos": scopes}


def survivors(merges: DataFrame) -> DataFrame:
    """tipo, pessoa_id and fica: who stands for each merged person in the end.

    merges: tipo, de, para, ordem; a person's first merge counts, one with itself is none. Chains are followed by joining
    the mapping with itself, which doubles the steps each round, so a chain of n takes log n rounds. A circle is an error.
    """
    first = merges.where("de <> para").groupBy("tipo", "de").agg(F.min_by("para", "ordem").alias("para"))
    now = written(first, "merges")
    steps = 0
    while True:
        nxt = now.select("tipo", F.col("de").alias("para"), F.col("para").alias("_alem"))
        joined = written(now.join(nxt, ["tipo", "para"], "left").select("tipo", "de", F.coalesce("_alem", "para").alias("para"), F.col("_alem").isNotNull().alias("_andou")), "merges")
        if not joined.where("_andou").limit(1).count():
            return joined.select("tipo", F.col("de").alias("pessoa_id"), F.col("para").alias("fica"))
        steps += 1
        if steps > 60 or not joined.where("de = para").isEmpty():
            raise ValueError("merges go round in a circle")
        now = joined.drop("_andou")


def repointed(table: DataFrame, mapping: DataFrame, person: str = "pessoa") -> DataFrame:
    """table with its person (tipo and id) replaced by who stands for them; rows without a person don't travel to the join."""
    keys = mapping.select(F.struct("tipo", F.col("pessoa_id").alias("id")).alias("_de"), F.struct("tipo", F.col("fica").alias("id")).alias("_para"))
    some = table.where(F.col(person).isNotNull())
    held = some.withColumn("_quem", F.struct(F.col(f"{person}.tipo").alias("tipo"), F.col(f"{person}.id").alias("id")))
    moved = held.join(keys, F.col("_quem") == F.col("_de"), "left").withColumn(person, F.coalesce("_para", "_quem")).select(*table.columns)
    return moved.unionByName(table.where(F.col(person).isNull()))


def merge_people(people: DataFrame, merges: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Merges people: the registry, and every table (by name, with its person's column) re-pointed.

    Merged people are deleted; who stands for them takes their names and aliases as aliases, but for its own name, sorted. A merge with a person that the
    registry lacks, in any step, is left out, so that no reference dangles.
    """
    known = people.select("tipo", F.col("pessoa_id").alias("de"))
    real = merges.join(known, ["tipo", "de"], "left_semi").join(known.withColumnRenamed("de", "para"), ["tipo", "para"], "left_semi")
    mapping = written(survivors(real), "survivors")
    empty = F.array().cast("array<string>")
    gained = mapping.join(people, KEY).select("tipo", F.col("fica").alias("pessoa_id"), F.explode(F.concat(F.array("nome"), F.coalesce("aliases", empty))).alias("_n")).where("_n IS NOT NULL").groupBy(*KEY).agg(F.collect_set("_n").alias("_novos"))
    d = people.join(mapping.select(*KEY, F.lit(True).alias("_foi")), KEY, "left").join(gained, KEY, "left")
    aliases = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("aliases", empty), F.col("_novos")), lambda n: n != F.coalesce("nome", F.lit("")))))
    changed: dict[str, Column] = {"deletado": F.col("deletado") | F.coalesce("_foi", F.lit(False)), "aliases": F.when(F.col("_novos").isNotNull(), aliases).otherwise(F.col("aliases"))}
    registry = d.select(*[changed.get(c, F.col(c)).alias(c) for c in people.columns])
    return registry, {name: repointed(t, mapping, column) for name, (t, column) in tables.items()}
