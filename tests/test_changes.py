"""Merges of people, the store of events, and candidates by words."""

import os
import random

import pytest

from ledgerloom.operators import aimatch, events, incremental, people, validation
from ledgerloom.plans import changes, registered

SF = "/root/testdata/sf0.001"


def test_long_chains_and_circles(spark):
    schema = "tipo string, de long, para long, ordem int"
    chain = [("PF", k, k + 1, 1) for k in range(100)] + [("PF", 5, 50, 2), ("PF", 7, 7, 0), ("PJ", 3, 9, 1)]
    found = {(r.tipo, r.pessoa_id): r.fica for r in people.survivors(spark.createDataFrame(chain, schema)).collect()}
    assert found == {**{("PF", k): 100 for k in range(100)}, ("PJ", 3): 9}
    with pytest.raises(ValueError):
        people.survivors(spark.createDataFrame([("PF", 1, 2, 1), ("PF", 2, 3, 1), ("PF", 3, 1, 1)], schema))
    assert people.survivors(spark.createDataFrame([], schema)).count() == 0


def test_no_reference_dangles_after_a_merge(spark):
    p, m = registered.view(spark, SF, "pessoa"), registered.view(spark, SF, "movimentacao")
    registry, tables = changes._merged(p, m)
    gone = registry.where("deletado").join(changes._people(p).where("NOT deletado"), ["tipo", "pessoa_id"], "left_semi").selectExpr("struct(tipo, pessoa_id id) pessoa")
    assert gone.count() > 20 and tables["linhas"].join(gone, "pessoa", "left_semi").count() == 0
    assert tables["linhas"].count() == m.count()


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_replacing_pending_events_is_repeatable_and_leaves_other_sessions_alone(spark, tmp_path):
    m = registered.view(spark, SF, "movimentacao").where("sessao_id < 500").cache()
    lines, path = m.selectExpr("id", "'N' remetente_destinatario"), f"file://{tmp_path}/store"
    every = m.select("sessao_id").distinct()
    events.replace_pending(path, changes._drafts(m, "id % 3 = 0"), lines, every)
    before, rows = files(tmp_path), sorted(map(str, events.stored(spark, path).collect()))
    assert len(rows) == m.where("id % 3 = 0").count()
    some = every.where("sessao_id % 2 = 0")
    events.replace_pending(path, changes._drafts(m, "id % 3 = 0 AND sessao_id % 2 = 0"), lines, some)
    assert sorted(map(str, events.stored(spark, path).collect())) == rows
    after = files(tmp_path)
    odd = {f: t for f, t in before.items() if int(f.split("sessao_id=")[1].split("/")[0]) % 2}
    assert odd and all(after.get(f) == t for f, t in odd.items()) and before != after
    events.replace_pending(path, changes._drafts(m, "false"), lines, some)
    assert events.stored(spark, path).where("sessao_id % 2 = 0").count() == 0 and events.stored(spark, path).count() == m.where("id % 3 = 0 AND sessao_id % 2 = 1").count()
    with pytest.raises(ValueError):
        events.replace_pending(path, changes._drafts(m, "id % 3 = 0"), lines, some)


def test_words_find_the_same_people_as_a_scan(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("ABC ") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    rows = [(rng.choice(["PF", "PJ"]), k, str(k), n if k % 17 else None) for k, n in enumerate(names)]
    words = sorted({"".join(rng.choice("ABC%_") for _ in range(rng.randint(4, 6))) for _ in range(200)} | {"AAAA", "ABCABC"})
    found = aimatch.people_holding(spark.createDataFrame([(w,) for w in words], "palavra string"), spark.createDataFrame(rows, "tipo string, pessoa_id long, documento string, nome string")).collect()
    want = {(w, t, k + 1, i) for w in words for t in ("PF", "PJ") for k, i in enumerate(sorted(r[1] for r in rows if r[0] == t and r[3] and w in r[3])[:3])}
    assert {(r.palavra, r.tipo, r.k, r.pessoa_id) for r in found} == want and len(want) > 30


def test_requests_on_empty_registries(spark):
    none = spark.createDataFrame([], "tipo string, pessoa_id long, nome string, titulo_eleitor string, deletado boolean, aliases array<string>")
    asked = spark.createDataFrame([("PF", 1, 1), ("PF", 1, 2)], "tipo string, pessoa_id long, ordem int")
    new, outcome = people.delete_people(none, asked)
    assert new.count() == 0 and [r.resultado for r in outcome.collect()] == [people.NOT_FOUND]
    more = asked.selectExpr("*", "array('nome') campos", "'x' nome", "cast(null as string) titulo_eleitor", "cast(null as array<string>) aliases")
    new, outcome = people.update_people(none, more)
    assert new.count() == 0 and [r.resultado for r in outcome.collect()] == [people.NOT_FOUND]


def test_only_unseen_contents_are_extracted(spark, tmp_path):
    path, asked = f"file://{tmp_path}/cache", []

    def answer(new):
        asked.append(sorted(r.conteudo or "" for r in new.collect()))
        return new.selectExpr("chave", "CASE WHEN length(conteudo) > 0 THEN upper(conteudo) END resposta")

    files = spark.createDataFrame([(1, "a", "m"), (2, "b", "m"), (3, "a", "m"), (4, None, "m"), (5, "a", "n"), (6, "m", "")], "id int, conteudo string, modelo string")
    for n, want in ((5, ["", "a", "a", "b", "m"]), (1, [""])):
        found, new = incremental.extracted(files, path, answer)
        assert new == n and asked[-1] == want and {r.id: r.resposta for r in found.collect()} == {1: "A", 2: "B", 3: "A", 4: None, 5: "A", 6: "M"}
    before = files_of(tmp_path)
    assert incremental.extracted(files.where("id < 4"), path, answer)[1] == 0 and len(asked) == 2 and files_of(tmp_path) == before


def files_of(path):
    return sorted(files(path))


def test_fragments_against_a_schema(spark, tmp_path):
    (tmp_path / "n.xsd").write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="n" type="xs:int"/></xs:schema>')
    rows = [("n", "<n>1</n>"), ("n", "<n>x</n>"), ("n", "<n>"), ("n", ""), ("n", None), ("o", "<o/>"), (None, "<n>1</n>")]
    docs = spark.createDataFrame(rows, "documento string, xml string")
    found = validation.validated(docs, {"n": str(tmp_path / "n.xsd")})
    assert [r.validacao for r in found.collect()] == ["valido", "invalido", "invalido", "invalido", "invalido", "nao_validado", "nao_validado"]
    assert {r.documento: (r.valido, r.invalido, r.exportavel) for r in validation.verdicts(docs, {"n": str(tmp_path / "n.xsd")}).collect()} == {"n": (1, 4, False), "o": (0, 0, True), None: (0, 0, True)}
