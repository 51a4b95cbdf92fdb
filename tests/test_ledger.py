"""Ledger queries against their SQL in DuckDB, the greedy against brute force, and single functions."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import documents as D
from ledgerloom.functions import fields as X
from ledgerloom.operators import consolidate, export, ingest, sheet
from ledgerloom.plans import registered, sheets
from ledgerloom.plans.views import TABLES, view
from ledgerloom.sources import ofx, registry_csv

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in (*TABLES, "events", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_equals_its_sql(spark, con, name):
    found = registered.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registered.SQL[name]}) AS q").fetchall()
    assert plain(found.collect()) == plain(want)
    assert want or name == "reject_anti"


def brute_greedy(pairs):
    used, out = set(), []
    for p in sorted(pairs, key=lambda p: (-p.confianca, p.a_data_movimento, p.a_id, p.b_id)):
        if p.a_id not in used and p.b_id not in used:
            used |= {p.a_id, p.b_id}
            out.append((p.a_id, p.b_id, p.confianca))
    return out


def test_greedy_equals_one_by_one(spark):
    lines, people = view(spark, SF, "linha"), view(spark, SF, "pessoa")
    lines = consolidate.linked(lines, people).cache()
    scored = consolidate.score_pairs(consolidate.candidate_pairs(lines)).cache()
    assert {r[0] for r in scored.select("regra").distinct().collect()} >= {"DOCUMENTO_HORA", "CPF_CADASTRO", "NOME", "VALOR_DATA"}
    pairs = scored.select("a_id", "b_id", "a_data_movimento", "confianca")  # weak ones too: the more there are, the harder the order
    assert 0 < consolidate.main_pairs(scored).count() < scored.count()
    found = consolidate.assign(pairs).select("a_id", "b_id", "confianca").collect()
    assert plain(found) == plain(brute_greedy(pairs.collect())) and len(found) > 10
    singles = consolidate.singles(lines, consolidate.assign(pairs), scored)
    assert singles.count() == lines.count() - 2 * len(found)


def test_greedy_along_a_chain(spark):
    day = datetime.date(2025, 1, 1)
    rows = [(i, i + 1, day, 0.5 + i / 1000) for i in range(40)]
    pairs = spark.createDataFrame(rows, "a_id long, b_id long, a_data_movimento date, confianca double")
    assert plain(r[:] for r in consolidate.assign(pairs).select("a_id", "b_id", "confianca").collect()) == plain(brute_greedy(pairs.collect()))
    assert consolidate.assign(pairs.limit(0)).count() == 0


def one(spark, e, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(e(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("529.982.247-25", "52998224725"), ("111.111.111-11", None), ("52998224724", None), (None, None), ("", None)])
def test_cpf(spark, text, want):
    assert one(spark, D.normalize_cpf, text) == want


@pytest.mark.parametrize(("a", "b", "want"), [("José da Silva", "JOSE DA SILVA", "bate"), ("J da Silva", "José da Silva", "bate"), ("Ana", "Ana Paula", "indefinido"), ("Maria Souza", "Pedro Lima", "difere"), ("Silva Souza", "Ana Silva Souza", "bate"), (None, "Ana Paula", "indefinido"), ("Ana Ana Lima", "Ana Lima Costa Reis", "difere")])
def test_names(spark, a, b, want):
    d = spark.createDataFrame([(a, b)], "a string, b string")
    assert d.select(D.compare_names(F.col("a"), F.col("b"))).first()[0] == want


def test_documents_in_a_text(spark):
    text = "pago a 529.982.247-25 e 11.222.333/0001-81, CPF 52998224725"
    assert one(spark, D.documents_in_text, text) == ["11222333000181", "52998224725"]
    assert one(spark, D.cpf_in_text, text) == "529.982.247-25" and one(spark, D.cpf_in_text, "x") is None
    assert one(spark, D.strip_documents, "Ana CPF: 529.982.247-25 fim") == "Ana fim"
    assert one(spark, D.normalize_name, "  Ação  de Graças ") == "ACAO DE GRACAS"


@pytest.mark.parametrize(("text", "want"), [("1.234,56", "1234.56"), ("1234.56", "123456.00"), ("-5", "-5.00"), ("abc", None), ("12,5 C", "12.50")])
def test_amounts(spark, text, want):
    found = one(spark, X.amount_br, text)
    assert found == (None if want is None else Decimal(want))


def test_fields(spark):
    assert one(spark, X.hour_minutes, "07:52:22") == 472 and one(spark, X.hour_minutes, "27:00") is None
    assert one(spark, X.day_and_minutes, "100752").asDict() == {"day": 10, "minutes": 472} and one(spark, X.day_and_minutes, "990752") is None
    assert one(spark, X.counterparty_of_history, "Pix Recebido - João  Lima") == "JOAO LIMA" and one(spark, X.counterparty_of_history, "Tarifa") is None
    assert one(spark, X.csv_cell, 'a"b,c') == '"a""b,c"' and one(spark, X.csv_cell, None) == ""
    assert one(spark, X.header_key, " Razão Social ") == "razao_social"
    with pytest.raises(ValueError, match="not a month"):
        X.month_bounds("2025-13")


def test_field_maps_merge(spark):
    d = spark.sql("SELECT map('a', '1', 'b', CAST(NULL AS STRING)) AS a, map('b', '2', 'c', '', 'd', '4') AS b")
    assert d.select(ingest.merge_fields(F.col("a"), F.col("b"))).first()[0] == {"a": "1", "b": None, "d": "4"}


def test_statement_files(spark, tmp_path):
    (tmp_path / "a.ofx").write_text("<OFX><STMTTRN><TRNAMT>1000.00<DTPOSTED>20250115120000<FITID>C1<NAME>Doacao</STMTTRN>\n<STMTTRN><TRNAMT>-250,50\n<DTPOSTED>20250120\n<MEMO>Pagamento\n</STMTTRN><STMTTRN><MEMO>no amount</STMTTRN>")
    (tmp_path / "b.txt").write_text("not a statement")
    rows = ofx.read(spark, f"file://{tmp_path}").orderBy("posicao").collect()
    assert [(r.posicao, r.data_movimento.isoformat(), r.valor, r.direcao, r.descricao_raw, r.nr_extrato_bancario) for r in rows] == [(1, "2025-01-15", Decimal("1000.00"), "ENTRADA", "Doacao", "C1"), (2, "2025-01-20", Decimal("250.50"), "SAIDA", "Pagamento", None)]


def test_registry_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("CPF,Nome\n52998224725,Ana Lima\n123,Bob\n,X\n11222333000181,Loja\n52998224725,\n")
    rows = registry_csv.read(spark, f"file://{tmp_path}/r.csv").orderBy("linha").collect()
    assert [(r.linha, r.tipo, r.documento, r.nome, r.erro) for r in rows] == [
        (2, "PF", "52998224725", "ANA LIMA", None), (3, "PF", "00000000123", "BOB", None), (4, None, None, "X", "documento inválido"), (5, "PJ", "11222333000181", "LOJA", None), (6, "PF", "52998224725", "", "nome vazio"),
    ]


def test_documents_and_csv(spark):
    m, c, p = (view(spark, SF, v) for v in ("movimentacao", "classificacao", "pessoa"))
    items = export.origin_items(m, c, p)
    own = items.groupBy("cnpj_prestador", "exercicio").count().orderBy(F.desc("count")).first()
    lines = [r.xml for r in export.origin_document(items, str(own.cnpj_prestador), own.exercicio).collect()]
    assert f"<totalOrigem>{own[2]}</totalOrigem>" in lines[0] and len(lines) == own[2] + 2 and lines[-1].startswith("</origens>")
    assert export.csv_lines(m.select("id", "descricao_raw"), ["id"]).first()[0].count(",") == 1


def test_empty_tables_give_empty_results(spark):
    m = view(spark, SF, "movimentacao").limit(0)
    assert sheet.summary(sheets.rows(m, view(spark, SF, "pessoa")), "sessao_id").count() == 0
    assert consolidate.candidate_pairs(view(spark, SF, "linha").limit(0)).count() == 0
    assert not math.isnan(ingest.BALANCE_TOLERANCE)


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == registered.queries()["approved_list"](spark, SF).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", sorted(set(registered.QUERIES) - set(registered.SQL)))
def test_queries_without_sql_run_whole(spark, name):
    found = registered.queries()[name](spark, SF)
    assert found.count() > 0


def test_greedy_pairs_ties_off_at_once(spark):
    day, later = datetime.date(2025, 1, 1), datetime.date(2025, 1, 2)
    whole = [(i, 1000 + j, day, 0.55) for i in range(70) for j in range(50)]  # a whole group, more lines on one side
    broken = [(2000 + i, 3000 + j, day, 0.8) for i in range(12) for j in range(12) if (i * j) % 7 != 3]  # not all pairs
    crossed = [(4000 + i, 5000 + j, later if i % 2 else day, 0.6 + (j % 3) / 10) for i in range(10) for j in range(10)]
    bridge = [(0, 3005, day, 0.9), (4001, 1001, later, 0.56), (6000, 1002, day, 0.55)]
    pairs = spark.createDataFrame([*whole, *broken, *crossed, *bridge], "a_id long, b_id long, a_data_movimento date, confianca double")
    found = consolidate.assign(pairs).select("a_id", "b_id", "confianca").collect()
    assert plain(found) == plain(brute_greedy(pairs.collect()))


@pytest.mark.parametrize("name", ["pair_join", "registry_link"])
def test_lines_are_made_once(spark, name):
    """Lines are written before they are joined, so no join makes them anew from the statement table."""
    assert not [f for f in registered.queries()[name](spark, SF).inputFiles() if "lineitem" in f]


def test_masks_lose_no_name_that_agrees(spark):
    names = ["ANA LIMA", "A LIMA", "ANA L", "LIMA ANA MARIA", "A L M N", "SUPPLIER 3", "SUPPLIER 34", "SUPPLIER#000000003", "MARIA MARIA", "MARIA", "JOSE", "3 SUPPLIER"]
    d = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    d = d.withColumns({"agree": D.names_agree(F.col("a"), F.col("b")), "may": D.may_agree(F.col("a"), F.col("b"), D.name_masks(F.col("a")), D.name_masks(F.col("b")))})
    assert d.where("agree").count() > len(names) and d.where("agree AND NOT may").count() == 0
    assert d.where("a = 'ANA LIMA' AND b = 'JOSE' AND may").count() == 0


def test_lines_of_a_third_role_meet_all_of_their_day(spark):
    day = datetime.date(2025, 1, 1)
    rows = [(i, i, role, day, Decimal(1), "C") for i, role in enumerate(["PIX", "COMPLETO", "OUTRO", "PIX", "OUTRO", "COMPLETO", "X"])]
    lines = spark.createDataFrame(rows, "id long, arquivo_id long, papel string, data_movimento date, valor decimal(15,2), direcao string").withColumn("conta_id", F.lit(None).cast("long"))
    found = sorted((r.a_id, r.b_id) for r in consolidate.candidate_pairs(lines).select("a_id", "b_id").collect())
    assert found == [(a, b) for a in range(7) for b in range(a + 1, 7)]
