"""Approvals taken one by one, as a person would, against the set-based cascade."""

import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import approval
from ledgerloom.plans import approvals, registered

SF = "/root/testdata/sf0.001"
LINES = "id long, uf long, exercicio int, status string, pessoa struct<tipo:string,id:long>, cpf string, cnpj string, remetente_destinatario string, descricao_raw string, confianca double, bloqueio_export boolean, canonica_id long"
EVENTS = "evento_id long, uf long, exercicio int, status string, remetente_destinatario string, confianca double, canonica_id long"


def agree(a, b):
    a, b = (re.sub(r"\s+", " ", x or "").strip().upper() for x in (a, b))
    return None if min(len(a), len(b)) <= 3 else a in b or b in a


class OneByOne:
    """The registry, the lines and the events as mutable records; decisions are applied in turn."""

    def __init__(self, lines, evidence, events, members, people):
        self.lines = {r["id"]: dict(r) for r in lines}
        self.evidence = {i: [] for i in self.lines}
        for r in evidence:
            self.evidence[r["movimentacao_id"]].append((r["tipo"], r["peso"]))
        self.events = {r["evento_id"]: dict(r) for r in events}
        self.members = {}
        for r in sorted(members, key=lambda r: (r["evento_id"], r["posicao"])):
            self.members.setdefault(r["evento_id"], []).append(r)
        self.people = people
        self.by_document = {(p["tipo"], p["documento"]): p for p in people}
        self.named = {}

    def found_by_name(self, name):
        if name not in self.named:
            self.named[name] = [p for p in self.people if agree(name, p["nome"])]
        return self.named[name]

    def match(self, i):
        m = self.lines[i]
        name = m["remetente_destinatario"]
        empty = len((name or "").strip()) < 3
        proofs, person = [], None
        if m["cpf"] and m["cnpj"]:
            proofs = [("CONFLITO_DOCUMENTO", 0.0)]
        elif m["cpf"] or m["cnpj"]:
            kind = "CPF" if m["cpf"] else "CNPJ"
            person = self.by_document.get(("PF", m["cpf"]) if m["cpf"] else ("PJ", m["cnpj"]))
            if person is None:
                proofs = [(f"{kind}_SEM_CADASTRO", 0.0)]
            else:
                proofs = [(f"{kind}_CADASTRO", 0.45)] + ([("NOME_DIVERGE_CADASTRO", 0.0)] if not empty and agree(name, person["nome"]) is False else [])
        elif not empty:
            people = self.found_by_name(name)
            if len(people) == 1:
                person, proofs = people[0], [("NOME_CADASTRO", 0.45 * 0.85)]
            elif people:
                proofs = [("CONFLITO_NOME", 0.0)]
        self.evidence[i] = list(proofs)
        m.update(pessoa=person and (person["tipo"], person["pessoa_id"]), confianca=min(1.0, sum(w for _, w in proofs)), bloqueio_export=True, status="PENDENTE_REVISAO")

    def rematch(self, uf, year):
        stub = {(p["tipo"], p["pessoa_id"]) for p in self.people if p["nome"].strip().upper() == approval.STUBS[p["tipo"]]}
        for i, m in self.lines.items():
            if (m["uf"], m["exercicio"]) == (uf, year) and m["status"] in approval.PENDING and (m["cpf"] or m["cnpj"] or len((m["remetente_destinatario"] or "").strip()) >= 3):
                if m["pessoa"] is None or tuple(m["pessoa"]) in stub:
                    self.match(i)

    def decide(self, event, decision):
        e = self.events.get(event)
        if e is None:
            return approval.NOT_FOUND
        if decision == "REJEITAR":
            e["status"] = "REJEITADO"
            return "rejeitado"
        if e["status"] != "PENDENTE":
            return approval.PROCESSED
        members = self.members[event]
        main = next((r["id"] for role in ("COMPLETO", "PIX", "OUTRO") for r in members if r["papel"] == role))
        texts = [self.lines[r["id"]]["descricao_raw"] or "" for r in members]
        self.lines[main].update(descricao_raw=" | ".join(dict.fromkeys(t.strip() for t in texts if t.strip())), remetente_destinatario=e["remetente_destinatario"], confianca=e["confianca"])
        for r in members:
            if r["id"] != main:
                self.lines[r["id"]].update(canonica_id=main, status="REJEITADO")
        self.match(main)
        self.evidence[main].append((approval.CROSSED, e["confianca"]))
        e.update(status="APROVADO", canonica_id=main)
        self.rematch(e["uf"], e["exercicio"])
        return "aprovado"


def rows(df):
    return [r.asDict() for r in df.collect()]


def plain_line(r):
    return (r["id"], r["status"], r["pessoa"] and tuple(r["pessoa"]), r["remetente_destinatario"], r["descricao_raw"], round(r["confianca"], 9), r["bloqueio_export"], r["canonica_id"])


def compare(lines, evidence, events, members, people, decisions):
    done = approval.approve(lines, evidence, events, members, people, decisions)
    one = OneByOne(rows(lines), rows(evidence), rows(events), rows(members), rows(people))
    outcome = {r["ordem"]: one.decide(r["evento_id"], r["decisao"]) for r in sorted(rows(decisions), key=lambda r: r["ordem"])}
    assert {r.ordem: r.resultado for r in done["decisoes"].collect()} == outcome
    assert sorted(map(plain_line, rows(done["linhas"]))) == sorted(map(plain_line, one.lines.values())) if lines.count() == 0 else {r["id"]: plain_line(r) for r in rows(done["linhas"])} == {i: plain_line(m) for i, m in one.lines.items()}
    assert {r.evento_id: (r.status, r.canonica_id) for r in done["eventos"].collect()} == {i: (e["status"], e["canonica_id"]) for i, e in one.events.items()}
    proofs = {i: [] for i in one.lines}
    for r in done["evidencias"].collect():
        proofs[r.movimentacao_id].append((r.tipo, r.peso))
    for i, want in one.evidence.items():
        got = sorted(proofs[i])
        assert [t for t, _ in got] == [t for t, _ in sorted(want)] and all(math.isclose(a[1], b[1]) for a, b in zip(got, sorted(want))), (i, got, want)
    return outcome, one


def test_cascade_equals_one_by_one(spark):
    m, p = (registered.view(spark, SF, v) for v in ("movimentacao", "pessoa"))
    lines, evidence, people = (d.cache() for d in approvals.case(m, p))
    events, members, decisions = approvals.events_of(lines)
    outcome, one = compare(lines, evidence, events, members, people, decisions)
    assert set(outcome.values()) == {"aprovado", "rejeitado", approval.NOT_FOUND, approval.PROCESSED}
    crossed = sum(t == approval.CROSSED for v in one.evidence.values() for t, _ in v)
    assert crossed and any(m["status"] == "REJEITADO" for m in one.lines.values()) and any(" | " in (m["descricao_raw"] or "") for m in one.lines.values())


def test_chains_of_events_take_each_others_main_lines(spark):
    n = 12
    lines = spark.createDataFrame([(i, 1, 1996, "PENDENTE_REVISAO", None, None, None, None, f"d{i % 5}", 0.5, False, None) for i in range(n + 1)], LINES)
    events = spark.createDataFrame([(k, 1, 1996, "PENDENTE", f"Name {k}" if k % 2 else None, 0.9, None) for k in range(n)], EVENTS)
    # Event k has the lines 0 and k + 1; line 0 is the main line but of every third, where it is absorbed.
    members = spark.createDataFrame([x for k in range(n) for x in ((k, 0, 0, "PIX" if k % 3 else "OUTRO"), (k, 1, k + 1, "OUTRO" if k % 3 else "COMPLETO"))], "evento_id long, posicao int, id long, papel string")
    people = spark.createDataFrame([(1, "PF", "1", "Name 1"), (2, "PJ", "2", "DESCONHECIDA")], "pessoa_id long, tipo string, documento string, nome string")
    evidence = spark.createDataFrame([(0, "IA", 0.1)], "movimentacao_id long, tipo string, peso double")
    decisions = spark.createDataFrame([(k, k * 5 % n, "APROVAR") for k in range(n)], "evento_id long, ordem long, decisao string")
    compare(lines, evidence, events, members, people, decisions)


def test_empty_tables_and_unknown_ids(spark):
    lines, events = spark.createDataFrame([], LINES), spark.createDataFrame([], EVENTS)
    members = spark.createDataFrame([], "evento_id long, posicao int, id long, papel string")
    people = spark.createDataFrame([], "pessoa_id long, tipo string, documento string, nome string")
    evidence = spark.createDataFrame([], "movimentacao_id long, tipo string, peso double")
    decisions = spark.createDataFrame([(1, 1, "APROVAR"), (1, 2, "REJEITAR")], "evento_id long, ordem long, decisao string")
    done = approval.approve(lines, evidence, events, members, people, decisions)
    assert {r.resultado for r in done["decisoes"].collect()} == {approval.NOT_FOUND}
    assert done["linhas"].count() == done["eventos"].count() == done["evidencias"].count() == 0
    one = spark.createDataFrame([(1, 1, 1996, "RASCUNHO", None, None, None, None, None, 0.5, False, None)], LINES)
    out, proofs = approval.deterministic_match(one, evidence, people, spark.createDataFrame([(1,), (1,), (7,)], "id long"))
    assert [r.asDict() for r in out.collect()] == [{**one.first().asDict(), "status": "PENDENTE_REVISAO", "confianca": 0.0, "bloqueio_export": True}] and proofs.count() == 0
    out, _ = approval.rematch_pending(one, evidence, people)
    assert out.first().status == "RASCUNHO"


@pytest.mark.parametrize("tier, score, person, blocked, want", [("ALTA", 0.9, True, False, "CONFIRMADO"), ("ALTA", 0.8, True, False, "PENDENTE_REVISAO"), ("MEDIA", 0.9, True, False, "PENDENTE_REVISAO"), ("ALTA", 0.9, False, False, "PENDENTE_REVISAO"), ("ALTA", 0.9, True, True, "PENDENTE_REVISAO")])
def test_status_by_tier(spark, tier, score, person, blocked, want):
    assert spark.range(1).select(approval.status_by_tier(*map(F.lit, (tier, score, person, blocked)))).first()[0] == want
