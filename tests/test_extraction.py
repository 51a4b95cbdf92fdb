"""Answers to rows, registry cells, page lines and their scores, exports of files."""

import datetime
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cells as C
from ledgerloom.operators import export, extraction, locate, mutations, registry, sheet
from ledgerloom.plans import sheets
from ledgerloom.plans.views import view

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2025, 3, 1)


def one(spark, e, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(e(F.col("x"))).first()[0]


def test_answers_become_items(spark):
    rows = [
        (1, 'Claro:\n```json\n[{"data": "2025-03-01", "valor": 12.5, "direcao": "ENTRADA", "cpf": "529.982.247-25"}, {"valor": "1.234,56"}]\n```'),
        (2, 'aqui {"transacoes": [{"valor": -3, "descricao": "x"}], "saldo": 1}'), (3, "nada"), (4, None), (5, '{"transacoes": []}'), (6, "[1"),
    ]
    found = extraction.items_of(spark.createDataFrame(rows, "pagina int, conteudo string"), "pagina").collect()
    assert sorted((r.pagina, r.indice, r.valor, r.erro) for r in found if r.erro is None) == [(1, 0, "12,50", None), (1, 1, "1.234,56", None), (2, 0, "-3,00", None)]
    assert sorted(r.pagina for r in found if r.erro) == [3, 4, 6]
    items = extraction.items_of(spark.createDataFrame(rows, "pagina int, conteudo string"), "pagina").where("erro IS NULL")
    row = extraction.rows_of(extraction.normalised(items), "pagina", "indice").where("situacao = 'linha'").collect()
    assert [(r.valor, r.descricao_raw, r.cpf, r.campos["valor"]) for r in row] == [(Decimal("12.50"), "CPF 52998224725", "52998224725", "12.50")]


@pytest.mark.parametrize(("kept", "origins", "want"), [
    ("José Lima", [("PIX", "Ana Souza")], "JOSE LIMA"), (None, [("PIX", "Ana Souza"), ("COMPLETO", "TED 529.982.247-25 Outro")], "ANA SOUZA"),
    ("x", [("PIX", "Ana Souza"), ("COMPLETO", "Bia Reis")], "BIA REIS"), (None, [("OUTRO", "Rui"), ("OUTRO", "Rui Paz"), ("OUTRO", "Ana Paz")], "RUI PAZ"), (None, [], ""), (None, [("COMPLETO", None)], ""),
])
def test_effective_names(spark, kept, origins, want):
    d = spark.createDataFrame([(kept, origins)], "k string, o array<struct<papel string, descricao string>>")
    assert d.select(C.effective_name(F.col("k"), F.col("o"))).first()[0] == want


def test_cells_and_search_texts(spark):
    assert one(spark, C.number_cell, 1234567, "long") == "00001234567" and one(spark, C.number_cell, 123456789012, "long") == "00123456789012" and one(spark, C.number_cell, 12, "long") == "12"
    assert one(spark, C.text_cell, "12,00") == "12" and one(spark, C.text_cell, None) == "" and one(spark, C.text_cell, "5.2998224725E10") == "52998224725"
    assert one(spark, C.person_type, " Pessoa  Física ") == "PF" and one(spark, C.person_type, "x") is None and one(spark, C.person_type, None) is None
    assert [one(spark, C.search_amount, t) for t in ("R$ 1.234,56", "1234,5", "12.30", "7", "1.234.567", "abc", "")] == [Decimal("1234.56"), Decimal("1234.50"), Decimal("12.30"), Decimal("7.00"), None, None, None]
    assert one(spark, C.amount_texts, Decimal("1234567.80"), "decimal(15,2)") == ["1.234.567,80", "1234567,80", "1234567.80", "R$ 1.234.567,80", "R$ 1234567,80", "R$ 1234567.80", "R$1.234.567,80", "R$1234567.80"]
    assert one(spark, C.date_texts, DAY, "date") == ["01/03/2025", "01/03/25", "01/03"]
    assert one(spark, C.is_uf, "sp") and not one(spark, C.is_uf, "XX") and one(spark, C.is_placeholder_cnpj, "00000000000101")
    boxes = spark.createDataFrame([((0.1, 0.1, 0.5, 0.5),), ((0.6, 0.1, 0.5, 0.5),), ((0.1, 0.1, 0.0, 0.5),), ((None, 0.1, 0.1, 0.5),)], "b struct<x: double, y: double, w: double, h: double>")
    assert [r[0] for r in boxes.select(C.box_is_valid(F.col("b"))).collect()] == [True, False, False, False]
    d = spark.createDataFrame([(DAY, DAY), (DAY, datetime.date(2025, 3, 9))], "a date, b date")
    assert [r[0] for r in d.select(C.period_text(F.col("a"), F.col("b"))).collect()] == ["01/03/2025", "01/03/2025 a 09/03/2025"]


def test_page_lines_gather_what_lies_near_their_first_item(spark):
    ys = [0.1, 0.115, 0.119, 0.125, 0.5, 0.1, 0.52, 0.521]
    rows = [(1, 1, float(i), y, 1.0, 0.01, f"t{i}") for i, y in enumerate(ys)] + [(1, 2, 0.0, 0.1, 1.0, 0.01, "u")]
    want, anchor = [], None
    for y, i in sorted((y, i) for i, y in enumerate(ys)):
        if anchor is None or y - anchor > locate.TOLERANCE:
            anchor = y
            want.append([])
        want[-1].append(i)
    found = locate.page_lines(spark.createDataFrame(rows, "arquivo_id long, pagina long, x double, y double, width double, height double, str string"))
    assert [r.texto for r in found.where("pagina = 1").orderBy("linha").collect()] == [" ".join(f"t{i}" for i in sorted(w)) for w in want]


def brute_scores(lines, wanted):
    """Every line of a file against every wanted line; names are left to the operator's own comparison."""
    out = set()
    for w in wanted:
        v = Decimal(w.valor)
        plain = f"{v:.2f}"
        grouped = f"{v:,.2f}".replace(",", "_").replace(".", ",").replace("_", ".")
        forms, dates = (grouped, plain.replace(".", ","), plain), (w.data_movimento.strftime("%d/%m/%Y"), w.data_movimento.strftime("%d/%m/%y"), w.data_movimento.strftime("%d/%m"))
        for x in lines:
            if x.arquivo_id == w.arquivo_id:
                has_v, has_d = any(f in x.texto for f in forms), any(d in x.texto for d in dates)
                doc = re.sub(r"\D", "", w.documento or "")
                has_doc = len(doc) >= 4 and doc in re.sub(r"\D", "", x.texto)
                if (has_doc and has_d) or (has_v and (has_d or w.relaxa)):
                    words = [t for t in re.split("[^a-z0-9]+", x.texto.lower()) if len(t) > 1]
                    sought = {t for t in re.split("[^a-z0-9]+", w.descricao_raw.lower()) if len(t) > 1}
                    points = (25 if has_doc and has_d else 10 if has_d else 1) + 5 * has_v + 5 * sum(t in sought for t in words)
                    points += 0 if not w.documento else 40 if has_doc else 0 if w.relaxa else -5
                    points += 15 if w.hora and w.hora in x.texto else 0
                    out.add((w.id, x.pagina, x.linha, points))
    return out


def test_scores_equal_every_pair(spark):
    lines = spark.createDataFrame([
        (1, 1, 0, "01/03/2025 Compra de tintas 1.234,56"), (1, 1, 1, "01/03 loja 4,56 doc 998877"), (1, 1, 2, "tintas 1234.56 10:07"), (1, 2, 0, "02/03/2025 compra 21.234,56"), (2, 1, 0, "01/03/2025 Compra de tintas 1.234,56"), (1, 3, 0, "nada"),
    ], "arquivo_id long, pagina int, linha int, texto string").withColumn("caixa", F.lit(None).cast("string"))
    wanted = spark.createDataFrame([
        (1, 1, DAY, "1234.56", "compra de tintas", None, None, None, False), (2, 1, DAY, "1234.56", "tintas", None, None, "10:07", True), (3, 1, DAY, "99", "loja", None, "99-88-77", None, False), (4, 2, DAY, "1234.56", "x", None, "5555", None, False),
        (5, 1, DAY, "0.56", "x", None, None, None, True), (6, 1, DAY, "abc", "x", None, None, None, False), (7, 9, DAY, "1", "x", None, None, None, True), (8, 1, DAY, "1234.56", "x", "Outra Pessoa", None, None, False),
    ], "id long, arquivo_id long, data_movimento date, valor string, descricao_raw string, remetente_destinatario string, documento string, hora string, relaxa boolean")
    found = {(r.id, r.pagina, r.linha, r.pontos) for r in locate.scores(lines, wanted.where("id NOT IN (6, 8)")).collect()}
    assert found == brute_scores(lines.collect(), wanted.where("id NOT IN (6, 8)").collect()) and len(found) >= 5
    best = {r.id: (r.pagina, r.motivo) for r in locate.located(lines, wanted).collect()}
    assert best[1] == (1, None) and best[6] == (None, "Valor inválido") and best[7][0] is None and best[8] == (None, "Nenhuma linha com valor e data na mesma linha") and len(best) == 8


def test_donations_need_a_person_and_a_receipt(spark):
    m = view(spark, SF, "movimentacao").withColumns({"uf_sigla": F.lit("sp"), "partido": F.lit(13), "nr_extrato_bancario": F.lit(None).cast("string"), "conta": F.lit(None).cast("struct<agencia: string, conta: string, dv: string>")})
    c = view(spark, SF, "classificacao").withColumn("especie_recurso", F.when(F.col("movimentacao_id") % 2 == 0, "EP"))
    links = m.select(F.col("id").alias("movimentacao_id"), (F.col("id") % 3 != 0).alias("sincronizado"))
    found = export.donation_items(m, c, view(spark, SF, "pessoa"), links).collect()
    assert found and all((r.xml is None) == (r.erro is not None) and r.id % 3 for r in found)
    good = [r for r in found if r.xml]
    assert {r.erro for r in found} == {None, "sem pessoa", "sem recibo"}
    assert all(f"<nrReciboDoacao>{r.id}</nrReciboDoacao>" in r.xml and "<uf>SP</uf>" in r.xml and "<agenciaOrigem>0000</agenciaOrigem>" in r.xml for r in good)


def test_approved_file(spark):
    m = view(spark, SF, "movimentacao").limit(5)
    lines = [r.value for r in export.approved_file(m.withColumn("descricao_raw", F.lit('a"b'))).collect()]
    assert lines[0] == "﻿" + ",".join(export.APPROVED_COLUMNS) and len(lines) == 6 and '"a""b"' in lines[1] and lines[1].count(",") == 14
    assert export.approved_file(m.limit(0)).count() == 1


def test_filters_counters_and_empty_logs(spark):
    m = view(spark, SF, "movimentacao")
    rows = sheets.rows(m, view(spark, SF, "pessoa")).cache()
    held = [r.asDict() for r in rows.collect()]
    want = {
        "prontas": lambda r: r["estado"] == "pronta", "sem_rd": lambda r: len((r["remetente_destinatario"] or "").strip()) < 3, "sem_pessoa": lambda r: r["pessoa"] is None,
        "baixa_confianca": lambda r: r["confianca"] < 0.6, "merge_pendente": lambda r: r["estado"] == "merge_pendente", "extracao_duvidosa": lambda r: r["estado"] == "extracao_duvidosa",
    }
    assert want.keys() == sheet.FILTERS.keys()
    for name, holds in want.items():
        assert 0 < sheet.filtered(rows, name).count() == sum(map(holds, held)) < len(held)
    actions = registry.classify_upserts(spark.createDataFrame([("1", "ANA", False)], "documento string, nome string, deletado boolean"), spark.createDataFrame([("1", "Ana", 1), ("2", "Bia", 2), ("1", "Rui", 3)], "documento string, nome string, ordem int"))
    assert {r.contador: r.n for r in mutations.import_counters(actions).collect()} == {"inseridos": 1, "atualizados": 0, "ignorados": 1, "conflitos": 1}
    log = spark.createDataFrame([], "id long, campo string, valor string, ordem int")
    few = m.select("id", "pessoa_id")
    assert mutations.edited(few, log, ("pessoa_id",)).exceptAll(few).count() == 0


def test_hours_of_a_sheet_as_seconds(spark):
    texts = ["10:07", " 9:30 ", "08:05:30", "7", "", "cedo", "10:xx", None]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", sheet.seconds_of(F.col("t")).alias("s")).orderBy("k").collect()
    assert [r.s for r in found] == [36420, 34200, 29130, 25200, 0, None, None, None]


def test_first_values_of_fields_win(spark):
    parts = spark.createDataFrame([(1, 0, {"a": "", "b": "x", "c": None}), (1, 1, {"a": "y", "b": "z"}), (1, 2, {"a": "w", "c": " "}), (2, 0, {}), (3, 0, None)], "k int, n int, m map<string,string>")
    assert {r.k: r.campos for r in sheet.merged_fields(parts, "k", "m", "n").collect()} == {1: {"a": "y", "b": "x", "c": " "}}
