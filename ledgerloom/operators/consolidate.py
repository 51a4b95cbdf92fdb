"""Consolidation: pairs the same transaction seen in two statements.

An interval join makes candidate pairs, rules score them, and an exact greedy assignment uses each line once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.documents import may_agree, name_masks, names_agree, normalize_name
from ledgerloom.functions.fields import WINDOW, day_and_minutes, hour_minutes
from ledgerloom.operators.storage import written

SAME_DOCUMENT, ONE_DOCUMENT, HOUR_PERSON, HOUR, NAME_PERSON, NAME, NOTHING = 0.95, 0.9, 0.85, 0.75, 0.8, 0.65, 0.55
CAP_SAME_VALUE, STRONG = 0.64, 0.9
SINGLE_DOCUMENT, SINGLE_NAME, SINGLE_NOTHING = 0.85, 0.8, 0.4
#: Minutes that a statement's document number may differ from a payment's hour, and those beyond which two hours contradict each other.
HOUR_NEAR, HOUR_APART = 5, 60


def _grams(name: Column, n: int) -> Column:
    """All runs of n characters of a name."""
    return F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, n))).otherwise(F.array().cast("array<string>"))


def _keys(name: Column) -> tuple[Column, Column]:
    """Blocking keys of a name as the shorter and as the longer one: names that agree meet in one of them.

    A name within another begins with a run of characters that the other holds; one whose tokens are all in another has its
    longest token there, or, made of initials only, its first letter as an initial.
    """
    tokens = F.split(name, " ")
    longest = F.array_max(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    head = F.when(F.length(name) >= 8, F.substring(name, 1, 8)).otherwise(F.substring(name, 1, 4))
    word = F.when(F.length(longest) > 1, F.concat(F.lit("t:"), longest)).otherwise(F.concat(F.lit("i:"), F.substring(name, 1, 1)))
    short = F.array(F.concat(F.lit("g:"), head), word)
    long = F.concat(
        F.transform(F.concat(_grams(name, 4), _grams(name, 8)), lambda g: F.concat(F.lit("g:"), g)),
        F.transform(tokens, lambda t: F.concat(F.lit("t:"), t)),
        F.transform(tokens, lambda t: F.concat(F.lit("i:"), F.substring(t, 1, 1))),
    )
    return short, F.array_distinct(long)


def _agree(x: Column, y: Column, mx: Column, my: Column) -> Column:
    """names_agree(), which goes through tokens only where the names' masks allow it."""
    return F.coalesce(F.when(may_agree(x, y, mx, my), names_agree(x, y)), F.lit(False))


def people_by_name(names: DataFrame, registry: DataFrame) -> DataFrame:
    """nome, n_pessoas and unico (tipo and id, if there is one alone) of those normalised names that agree with people of the registry.

    names has nome. Distinct names are compared, each with the registry's names that share a blocking key, so a
    frequent name costs one row and no pair that agrees is missed. The distinct names are written, so that Spark knows
    their size and few names meet the registry's keys without a shuffle.
    """
    who = F.struct("tipo", F.col("pessoa_id").alias("id"))
    people = registry.groupBy(normalize_name(F.col("nome")).alias("_known")).agg(F.count("*").alias("_n"), F.min(who).alias("_who")).where(F.length("_known") > 3).withColumn("_known_m", name_masks(F.col("_known")))
    said = written(names.select("nome").distinct().where(F.length("nome") > 3).withColumn("_m", name_masks(F.col("nome"))), "names")
    (s_short, s_long), (p_short, p_long) = _keys(F.col("nome")), _keys(F.col("_known"))
    meet = lambda a, b: said.select("nome", "_m", F.explode(a).alias("_key")).join(people.select("_known", "_known_m", "_n", "_who", F.explode(b).alias("_key")), "_key").drop("_key")
    agreed = _agree(F.col("nome"), F.col("_known"), F.col("_m"), F.col("_known_m"))
    met = meet(s_short, p_long).unionByName(meet(s_long, p_short)).where(agreed).drop("_m", "_known_m").distinct()
    found = met.groupBy("nome").agg(F.sum("_n").alias("n_pessoas"), F.min("_who").alias("unico"))
    return found.withColumn("unico", F.when(F.col("n_pessoas") == 1, F.col("unico")))


def _known_to(lines: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """lines (with id) left-joined to known on a key; lines without it meet nothing and are spread over all tasks."""
    spread = F.coalesce(F.col(key), F.concat(F.lit(" "), F.col("id").cast("string")))
    d, other = lines.withColumn("_spread", spread), known.withColumnRenamed(key, "_known")
    return d.join(other, (F.col("_spread") == F.col("_known")) & F.col(key).isNotNull(), "left").drop("_spread", "_known")


def linked(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """Lines with what pair scoring needs of each: nome normalised, marcas (its name_masks), pf and pj (quem: tipo and id,
    registered nome and marcas, by the line's documents), n_pessoas and unico (how many people's names agree, and who if one
    alone), minutos (of hora) and dia_hora (of nr_documento).

    The lines are written once and asked for their distinct documents and names; what the registry says of those is
    written as well, so that Spark knows its size: a frequent document or name, or none, fills no task of a join.
    """
    who = F.struct("tipo", F.col("pessoa_id").alias("id"))
    named = {"nome": normalize_name(F.col("nome")), "minutos": hour_minutes(F.col("hora")), "dia_hora": day_and_minutes(F.col("nr_documento"))}
    d = written(lines.withColumns(named).drop("hora", "nr_documento"), "lines")

    def of(kind: str, name: str, key: str) -> DataFrame:
        said = d.where(F.col(key).isNotNull()).select(F.col(key).alias("documento")).distinct()
        people = registry.where(F.col("tipo") == kind).join(said, "documento", "left_semi").groupBy(F.col("documento").alias(key)).agg(F.min(F.struct(who.alias("quem"), normalize_name(F.col("nome")).alias("nome"))).alias("p"))
        return written(people.select(key, F.struct("p.quem", "p.nome", name_masks(F.col("p.nome")).alias("marcas")).alias(name)), name)

    d = d.withColumn("marcas", name_masks(F.col("nome")))
    for known, key in ((of("PF", "pf", "cpf"), "cpf"), (of("PJ", "pj", "cnpj"), "cnpj"), (written(people_by_name(d, registry), "by_name"), "nome")):
        d = _known_to(d, known, key)
    return d


def candidate_pairs(lines: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of lines of different files with equal amount and direction: a_* is the earlier line, b_* the later.

    Any two roles meet on one day, and a line without a role only those that are neither PIX nor COMPLETO; a PIX line
    also meets COMPLETO lines of the WINDOW days after. Each PIX line is dealt to those days, so that both branches are
    plain equi-joins, each line is shuffled as few times as they need, and a pair comes once. Accounts must be equal
    where both are known. scope names further columns that must be equal.
    """
    keys = ["valor", "direcao", *scope]
    others = [c for c in lines.columns if c not in keys]
    side = lambda p, day: [*keys, day.alias("_day"), *[F.col(c).alias(f"{p}_{c}") for c in others]]
    apart = "a_arquivo_id <> b_arquivo_id AND coalesce(a_conta_id = b_conta_id, true)"
    day = F.col("data_movimento")
    on_day = lines.select(*side("a", day)).join(lines.select(*side("b", day)), [*keys, "_day"]).where(apart)
    on_day = on_day.where("a_id < b_id OR (a_id = b_id AND a_papel = 'PIX' AND b_papel = 'COMPLETO')")
    on_day = on_day.where("(a_papel IS NOT NULL AND b_papel IS NOT NULL) OR a_papel NOT IN ('PIX', 'COMPLETO') OR b_papel NOT IN ('PIX', 'COMPLETO')")
    ahead = F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, WINDOW)))
    later = lines.where("papel = 'PIX'").select(*side("a", ahead)).join(lines.where("papel = 'COMPLETO'").select(*side("b", day)), [*keys, "_day"]).where(apart)
    return on_day.unionByName(later).drop("_day")


def main_pairs(scored: DataFrame) -> DataFrame:
    """The scored pairs that may become events; the others are hypotheses of lone lines (weak_pairs) or nothing."""
    return scored.where("elegivel AND NOT fraco")


def weak_pairs(scored: DataFrame) -> DataFrame:
    """Both lines of every weak pair: id, outra_id and the hypothesis' confidence, one row for each direction."""
    ends = F.explode(F.array(F.struct(F.col("a_id").alias("id"), F.col("b_id").alias("outra_id")), F.struct(F.col("b_id").alias("id"), F.col("a_id").alias("outra_id"))))
    return scored.where("fraco").select(ends.alias("x")).select("x.*", F.lit(NOTHING).alias("confianca"))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Adds confianca, regra, pessoa (tipo and id, or null), fraco and elegivel to pairs of linked() lines.

    The first rule that holds counts; of documents known on one side b's stand before a's, CPF before CNPJ. fraco: nothing but value
    and date agree, or the hours lie more than HOUR_APART minutes apart. All of a line's own work was done before lines
    were paired, so a pair costs three comparisons of normalised names at most, mostly of their masks, and no join.
    """
    same = lambda f: F.coalesce(F.col(f"a_{f}") == F.col(f"b_{f}"), F.lit(False))
    sided = lambda f, of: F.when(F.col(f"b_{of}").isNotNull(), F.col(f"b_{f}")).otherwise(F.col(f"a_{f}"))
    roles = lambda x, y: (F.col(f"{x}_papel") == "PIX") & (F.col(f"{y}_papel") == "COMPLETO")
    on_time = lambda x, y: roles(x, y) & (F.col(f"{y}_dia_hora.day") == F.dayofmonth(f"{x}_data_movimento")) & (F.abs(F.col(f"{y}_dia_hora.minutes") - F.col(f"{x}_minutos")) <= HOUR_NEAR)
    d = pairs.withColumns({"_pf": sided("pf", "cpf"), "_pj": sided("pj", "cnpj"), "_hour": F.coalesce(on_time("a", "b") | on_time("b", "a"), F.lit(False))})
    d = d.withColumns({"_names": _agree(F.col("a_nome"), F.col("b_nome"), F.col("a_marcas"), F.col("b_marcas")), "_pix_unico": F.when(F.col("a_papel") == "PIX", F.col("a_unico")).otherwise(F.col("b_unico"))})

    def registered(person: str) -> Column:
        says = lambda x: _agree(F.col(f"{x}_nome"), F.col(f"{person}.nome"), F.col(f"{x}_marcas"), F.col(f"{person}.marcas"))
        return F.col(person).isNotNull() & (F.col("_names") | says("a") | says("b"))

    by_document = F.coalesce(F.col("_pf.quem"), F.col("_pj.quem"))
    at_hour, by_name = F.coalesce(by_document, F.col("_pix_unico")), F.coalesce(by_document, F.col("a_unico"), F.col("b_unico"))
    rules: list[tuple[Column, str, Column, Column]] = [
        (same("cpf"), "MESMO_CPF", F.lit(SAME_DOCUMENT), F.col("b_pf.quem")),
        (same("cnpj"), "MESMO_CNPJ", F.lit(SAME_DOCUMENT), F.col("b_pj.quem")),
        (F.col("_hour"), "DOCUMENTO_HORA", F.when(at_hour.isNotNull(), HOUR_PERSON).otherwise(HOUR), at_hour),
        (registered("_pf"), "CPF_CADASTRO", F.lit(ONE_DOCUMENT), F.col("_pf.quem")),
        (registered("_pj"), "CNPJ_CADASTRO", F.lit(ONE_DOCUMENT), F.col("_pj.quem")),
        (F.col("_names"), "NOME", F.when(by_name.isNotNull(), NAME_PERSON).otherwise(NAME), by_name),
    ]
    rule = F.lit(len(rules))
    for k, (holds, *_) in reversed(list(enumerate(rules))):
        rule = F.when(holds, k).otherwise(rule)
    d = d.withColumn("_rule", rule)
    pick = lambda values, otherwise: F.coalesce(*[F.when(F.col("_rule") == k, v) for k, v in enumerate(values)], otherwise)
    d = d.withColumns({"confianca": pick([x[2] for x in rules], F.lit(NOTHING)), "regra": pick([F.lit(x[1]) for x in rules], F.lit("VALOR_DATA")), "pessoa": pick([x[3] for x in rules], F.lit(None))})
    apart = F.coalesce(F.abs(F.col("a_minutos") - F.col("b_minutos")) > HOUR_APART, F.lit(False))
    d = d.withColumns({"fraco": apart | (F.col("_rule") == len(rules)), "elegivel": same("cpf") | same("cnpj") | F.col("_hour") | F.col("_names")})
    return d.drop("_pf", "_pj", "_hour", "_names", "_pix_unico", "_rule")


def _tied(left: DataFrame, best: DataFrame) -> DataFrame:
    """Pairs of whole tie groups, the k-th line of one side with the k-th of the other: a_id, b_id, rank.

    A line's first class are its pairs of best confidence and date. Lines whose first classes name the same partners, and
    no one else's, make a group in which every pair is equal; by the order of ids such a group pairs off in one step.
    best has the first class of every line (id, top).
    """
    key = F.struct("rank.c", "rank.a_data_movimento")
    ends = left.select(F.explode(F.array(F.struct(F.col("a_id").alias("id"), F.col("b_id").alias("other")), F.struct(F.col("b_id").alias("id"), F.col("a_id").alias("other")))).alias("e"), key.alias("key")).select("e.*", "key")
    sets = ends.join(best.select("id", "top"), "id").where("key = top").groupBy("id", "top").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("other")).alias("h"), F.min("other").alias("m"), F.max("other").alias("x"))
    sets = written(sets, "ties")
    side = lambda s: sets.select(F.col("id").alias(f"{s}_id"), F.struct("top", "n", "h", "m", "x").alias(f"{s}_set"))
    # Of every set of partners the lines that have it, told the same way.
    owners = sets.groupBy(F.struct("top", "n", "h", "m", "x").alias("a_set")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("h"), F.min("id").alias("m"), F.max("id").alias("x"))
    met = left.join(side("a"), "a_id").where(key == F.col("a_set.top")).join(side("b"), "b_id").join(owners, "a_set")
    whole = F.col("b_set") == F.struct(F.col("a_set.top").alias("top"), "n", "h", "m", "x")
    good = met.groupBy("a_set").agg(F.bool_and(whole).alias("whole"), F.count("*").alias("pairs"), F.first("n").alias("lines")).where("whole AND pairs = lines * a_set.n AND pairs > 1").select("a_set")
    group = met.join(good, "a_set").select("a_set", "a_id", "b_id", "rank")
    number = lambda s: group.select("a_set", f"{s}_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy("a_set").orderBy(f"{s}_id")))
    return number("a").join(number("b"), ["a_set", "k"]).join(group, ["a_set", "a_id", "b_id"]).select("a_id", "b_id", "rank")


def assign(pairs: DataFrame) -> DataFrame:
    """The pairs that the greedy takes: best first, each line once.

    The order is confidence descending, then a's date, a and b. In each round every pair that is the best of both its
    lines is taken, and every whole group of ties, and the pairs that touch their lines go; with a strict order that
    gives what taking one by one gives, and no group of pairs must fit one task. Rounds are tables in the shared folder.
    """
    spark = pairs.sparkSession
    rank = F.struct((-F.col("confianca")).alias("c"), "a_data_movimento", "a_id", "b_id")
    left = written(pairs.select("a_id", "b_id", "a_data_movimento", "confianca").withColumn("rank", rank), "pairs")
    taken = None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("a_id", "b_id")).alias("id"), "rank")
        best = written(ends.groupBy("id").agg(F.min("rank").alias("best")).withColumn("top", F.struct("best.c", "best.a_data_movimento")), "best")
        mutual = best.groupBy("best").agg(F.count("*").alias("n")).where("n = 2").select("best.a_id", "best.b_id", F.col("best").alias("rank"))
        chosen = mutual.unionByName(_tied(left, best)).dropDuplicates(["a_id", "b_id"]).select("a_id", "b_id", "rank.a_data_movimento", (-F.col("rank.c")).alias("confianca"))
        chosen = written(chosen, "chosen")
        taken = chosen if taken is None else taken.unionByName(chosen)
        used = chosen.select(F.explode(F.array("a_id", "b_id")).alias("id"))
        left = written(left.join(used.withColumnRenamed("id", "a_id"), "a_id", "left_anti").join(used.withColumnRenamed("id", "b_id"), "b_id", "left_anti"), "pairs")
    return taken if taken is not None else spark.createDataFrame([], left.schema).drop("rank")


def singles(lines: DataFrame, taken: DataFrame, scored: DataFrame) -> DataFrame:
    """The linked() lines in no taken pair: id, confianca (by registered document, by a name that is unique, or neither) and
    n_hipoteses, the number of their weak pairs. The hypotheses themselves are rows of weak_pairs().

    Weak pairs are counted where they are made, so that a task hands on one row for each line that it has met.
    """
    known = F.col("pf").isNotNull() | F.col("pj").isNotNull()
    confidence = F.when(known, SINGLE_DOCUMENT).when(F.col("unico").isNotNull(), SINGLE_NAME).otherwise(SINGLE_NOTHING)
    used = taken.select(F.explode(F.array("a_id", "b_id")).alias("id"))
    weak = scored.where("fraco").select(F.explode(F.array("a_id", "b_id")).alias("id")).groupBy("id").agg(F.count("*").alias("n_hipoteses"))
    alone = lines.select("id", confidence.alias("confianca")).join(used, "id", "left_anti").join(weak, "id", "left")
    return alone.select("id", "confianca", F.coalesce("n_hipoteses", F.lit(0)).alias("n_hipoteses"))


def partner_counts(lines: DataFrame) -> DataFrame:
    """id and n_pares, the number of candidate_pairs() that each line is in, counted without making them.

    Lines are grouped by what decides whether they meet; those of a line's days and roles are counted, less those of its
    own file, itself among them. The work grows with the groups of a day and amount, of which there are few, not with pairs.
    """
    role = F.when(F.col("papel").isin("PIX", "COMPLETO"), F.col("papel")).when(F.col("papel").isNotNull(), "OUTRO").otherwise("NENHUM")
    d = lines.select("id", "valor", "direcao", F.col("data_movimento").alias("dia"), role.alias("papel"), "conta_id", "arquivo_id")
    keys = ["valor", "direcao", "dia", "papel", "conta_id"]
    day, pair = F.col("dia"), lambda x, y: (F.col("papel") == x) & (F.col("_papel") == y)
    days = F.when(F.col("papel") == "PIX", F.sequence(day, F.date_add(day, WINDOW))).when(F.col("papel") == "COMPLETO", F.sequence(F.date_sub(day, WINDOW), day)).otherwise(F.array(day))
    in_window = pair("PIX", "COMPLETO") | pair("COMPLETO", "PIX")
    on_day = (F.col("papel") == "OUTRO") | (F.col("_papel") == "OUTRO") | ((F.col("papel") == F.col("_papel")) & (F.col("papel") != "NENHUM"))
    meets = (in_window | ((F.col("_day") == day) & on_day)) & F.coalesce(F.col("conta_id") == F.col("_conta"), F.lit(True))

    def met(*file: str) -> DataFrame:
        groups = d.where("arquivo_id IS NOT NULL").groupBy(*keys, *file).agg(F.count("*").alias("_n"))
        other = groups.select("valor", "direcao", *file, F.col("dia").alias("_day"), F.col("papel").alias("_papel"), F.col("conta_id").alias("_conta"), "_n")
        near = groups.drop("_n").withColumn("_day", F.explode(days)).join(other, ["valor", "direcao", *file, "_day"])
        return near.where(meets).groupBy(*keys, *file).agg(F.sum("_n").alias("_n"))

    def counted(x: DataFrame, name: str, *file: str) -> DataFrame:
        y = met(*file).select(*[F.col(k).alias(f"_{k}") for k in (*keys, *file)], F.col("_n").alias(name))
        same = [F.col("conta_id").eqNullSafe(F.col("_conta_id")), *[F.col(k) == F.col(f"_{k}") for k in (*keys[:-1], *file)]]
        return x.join(y, same, "left").drop(*[f"_{k}" for k in (*keys, *file)])

    files = counted(d.where("arquivo_id IS NOT NULL"), "_own", "arquivo_id")
    # The statement table may repeat an id; its rows count together, as they do in pairs.
    return counted(files, "_all").groupBy("id").agg(F.sum(F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("n_pares"))


def cap_same_value(events: DataFrame, keys: tuple[str, ...] = ("data_movimento", "valor", "direcao")) -> DataFrame:
    """Adds n_mesmo_valor, and caps the confidence of events that share date, amount and direction unless a person is strongly linked.

    The counts are joined back, so that a common amount is no single task's partition.
    """
    sizes = events.groupBy(*keys).agg(F.count("*").alias("n_mesmo_valor"))
    strong = F.col("pessoa_id").isNotNull() & (F.col("confianca") >= STRONG)
    capped = F.when((F.col("n_mesmo_valor") > 1) & ~strong, F.least("confianca", F.lit(CAP_SAME_VALUE))).otherwise(F.col("confianca"))
    return events.join(sizes, list(keys)).withColumn("confianca", capped)


def tier(confidence: Column, person: Column, document: Column) -> Column:
    """ALTA, MEDIA or BAIXA."""
    return F.when((confidence >= STRONG) & person & document, "ALTA").when(confidence >= NAME_PERSON, "MEDIA").otherwise("BAIXA")


def auto_approvable(events: DataFrame, high: float = 0.85) -> DataFrame:
    """id and whether an event needs no review: a person, high confidence and the highest tier before the cap, which wants a document (tem_documento)."""
    person = F.col("pessoa_id").isNotNull()
    d = events.withColumn("_tier", tier(F.col("confianca"), person, F.col("tem_documento")))
    return cap_same_value(d).select("id", F.col("confianca"), F.col("_tier").alias("tier"), (F.col("pessoa_id").isNotNull() & (F.col("confianca") >= high) & (F.col("_tier") == "ALTA")).alias("auto"))


def canonical(lines: DataFrame, event: str) -> DataFrame:
    """For each event its main line: COMPLETO, else PIX, else any; the first of them."""
    rank = F.when(F.col("papel") == "COMPLETO", 0).when(F.col("papel") == "PIX", 1).otherwise(2)
    return lines.groupBy(event).agg(F.min_by("id", F.struct(rank, "id")).alias("canonica_id"), F.count("*").alias("n_linhas"))
