"""Registered queries over workbooks: each writes the tables' rows as workbooks into the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import export, ledger
from ledgerloom.operators.storage import fresh_path
from ledgerloom.plans.registered import query
from ledgerloom.sources import sheets, xlsx


def _round_trip(rows: DataFrame, *order: str, first_only: bool = False, most_rows: int = xlsx.MOST_ROWS) -> DataFrame:
    """rows written as workbooks and read again; arquivo is the file's name."""
    spark = rows.sparkSession
    path = fresh_path(spark, "workbooks")
    xlsx.write(rows, path, *order, most_rows=most_rows)
    return xlsx.read(spark, path, first_only).withColumn("arquivo", F.element_at(F.split("arquivo", "/"), -1))


def _flat(d: DataFrame) -> DataFrame:
    return d.select("arquivo", "planilha", F.col("linha").cast("long").alias("linha"), F.array_join(F.transform("celulas", lambda c: c["texto"]), "|").alias("celulas"))


def _joined(*columns: str) -> str:
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)


# Lines and classifications with all columns of the audit workbook; the same text runs in Spark and in DuckDB.
BOOK_LINES = "SELECT *, CASE WHEN id % 4 = 1 THEN 'C&D <' || CAST(id % 9 AS VARCHAR(9)) END AS cred_dev FROM {m}"
BOOK_CLASSES = "SELECT *, CASE WHEN movimentacao_id % 3 = 0 THEN '12' END AS classificacao_receita, CASE WHEN movimentacao_id % 5 = 0 THEN '401' END AS cd_descricao_gasto, CASE WHEN movimentacao_id % 2 = 0 THEN 'FISCAL' END AS tipo_documento, CASE WHEN movimentacao_id % 7 = 0 THEN CAST(movimentacao_id AS VARCHAR(20)) END AS nr_documento FROM {c}"
_SHEETS = {"Origem": ("direcao = 'ENTRADA'", "direcao, descricao_raw, cred_dev, fonte_recurso, natureza_recurso, tipo_origem_recurso, classificacao_receita"), "Aplicacao": ("direcao <> 'ENTRADA'", "direcao, descricao_raw, cred_dev, cd_descricao_gasto, tipo_documento, nr_documento"), "Doacao": ("direcao = 'ENTRADA' AND nr_recibo_doacao <> ''", "descricao_raw, nr_recibo_doacao")}
_BOOKS = f""", l AS ({BOOK_LINES.format(m="movimentacao")}), k AS ({BOOK_CLASSES.format(c="classificacao")}), b AS (SELECT l.*, k.* EXCLUDE (movimentacao_id), 'espelho_' || cnpj_prestador || '_' || exercicio || '.xlsx' AS arquivo FROM l LEFT JOIN k ON id = movimentacao_id WHERE status = 'CONFIRMADO')
"""


def _mirror(m: DataFrame, c: DataFrame) -> DataFrame:
    spark = m.sparkSession
    return _flat(_round_trip(export.mirror_rows(spark.sql(BOOK_LINES, m=m), spark.sql(BOOK_CLASSES, c=c)), *export.BOOK_ORDER))


query("mirror_workbooks", "movimentacao classificacao", _BOOKS + " UNION ALL ".join(
    f"""SELECT arquivo, '{s}' AS planilha, CAST(1 AS BIGINT) AS linha, '{"|".join(export.MIRROR[s])}' AS celulas FROM (SELECT DISTINCT arquivo FROM b)
UNION ALL SELECT arquivo, '{s}', 1 + row_number() OVER (PARTITION BY arquivo ORDER BY data_movimento, id), {_joined("data_movimento", "valor", *columns.split(", "))} FROM b WHERE {where}""" for s, (where, columns) in _SHEETS.items()
))(_mirror)


def _approved(m: DataFrame, p: DataFrame, r: DataFrame) -> DataFrame:
    rows = ledger.described(ledger.approved(m), p, r).withColumnsRenamed({"documento": "pessoa_documento", "confianca": "confianca_global", "sessao_id": "sessao_prestacao_id"})
    return _flat(_round_trip(export.approved_rows(rows, "uf", "exercicio"), *export.BOOK_ORDER, most_rows=500))


query("approved_workbooks", "movimentacao pessoa prestador", f"""
, a AS (SELECT m.*, 'movimentacoes_' || m.uf || '_' || exercicio || '.xlsx' AS arquivo, coalesce(nome_estadual, nome_municipal) AS prestador_nome, q.nome AS pessoa_nome, substr(documento, 1, 3) || '.' || substr(documento, 4, 3) || '.' || substr(documento, 7, 3) || '-' || substr(documento, 10, 2) AS documento
  FROM movimentacao m LEFT JOIN prestador p ON m.cnpj_prestador = p.cnpj_prestador LEFT JOIN pessoa q ON q.tipo = 'PF' AND m.pessoa_id = q.pessoa_id WHERE status IN ('CONFIRMADO', 'EXPORTADO') AND NOT deletado AND canonica_id IS NULL),
t AS (SELECT arquivo, 0 AS n, '{"|".join(export.APPROVED_COLUMNS)}' AS celulas FROM (SELECT DISTINCT arquivo FROM a) UNION ALL SELECT arquivo, row_number() OVER (PARTITION BY arquivo ORDER BY data_movimento DESC, cnpj_prestador, id), {_joined("id", "data_movimento", "valor", "direcao", "pessoa_nome", "documento", "cnpj_prestador", "prestador_nome", "descricao_raw", "uf", "status", "sessao_id", "confianca")} || '||' FROM a)
SELECT arquivo, CASE WHEN n < 500 THEN 'Movimentacoes' ELSE 'Movimentacoes (' || CAST(n // 500 + 1 AS BIGINT) || ')' END AS planilha, CAST(n % 500 + 1 AS BIGINT) AS linha, celulas FROM t""")(_approved)


def _cell(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("tipo"), text.cast("string").alias("texto"))


def _statement_books(m: DataFrame) -> DataFrame:
    """Statements of 17 files: dates, amounts and directions in all forms, some wrong, blank rows, a file without amounts."""
    k = F.col("id")
    form = lambda n, *options: F.coalesce(*[F.when(k % n == i, o) for i, o in options])
    day = F.coalesce(F.when(k % 5 == 0, _cell("data", F.col("data_movimento"))), _cell("texto", F.coalesce(F.when(k % 5 == 1, F.date_format("data_movimento", "dd/MM/yyyy")), F.when(k % 5 == 2, F.date_format("data_movimento", " yyyy-MM-dd ")), F.when(k % 5 == 3, F.date_format("data_movimento", "dd-MM-yyyy")), F.when(k % 15 == 4, F.lit("31/02/2024")), F.date_format("data_movimento", "dd/MM/yyyy"))))
    plain = F.col("valor").cast("string")
    amount = F.coalesce(form(7, (0, _cell("numero", -F.col("valor"))), (1, _cell("texto", F.replace(plain, F.lit("."), F.lit(",")))), (2, _cell("texto", F.concat(F.lit("1."), F.lpad(F.replace(plain, F.lit("."), F.lit(",")), 9, "0")))), (3, _cell("texto", F.concat(F.lit("-"), plain, F.lit(" BRL"))))), F.when(k % 21 == 4, _cell("texto", F.lit("x"))), F.when(k % 21 == 5, _cell("texto", F.lit(" "))), _cell("numero", F.col("valor")))
    kind = form(6, (0, _cell("texto", F.lit(" c "))), (1, _cell("texto", F.lit("Débito"))), (2, _cell("texto", F.when(k % 12 == 2, "?").otherwise("ENTRADA"))))
    blank = F.array(_cell("texto", F.lit(" ")), F.lit(None).cast(xlsx.CELL), _cell("texto", F.lit("nota")))
    file = F.concat(F.lit("extrato_"), (k % 17).cast("string"), F.lit(".xlsx"))
    rows = m.select(file.alias("arquivo"), F.lit("Plan1").alias("planilha"), F.lit(1).alias("_parte"), "id", F.when(k % 31 == 0, blank).otherwise(F.array(day, amount, F.lit(None).cast(xlsx.CELL), _cell("texto", F.concat(F.lit(" "), F.col("descricao_raw"))), kind)).alias("celulas"))
    titles = F.when(F.col("arquivo") == "extrato_3.xlsx", F.array(*[_cell("texto", F.lit(t)) for t in ("Data", "Quantia", "nota", "Descricao", "tipo")])).otherwise(F.array(*[_cell("texto", F.lit(t)) for t in (" DATA ", "valor", "nota", "Descricao", "Tipo")]))
    head = rows.select("arquivo", "planilha").distinct().select("arquivo", "planilha", F.lit(0).alias("_parte"), F.lit(None).cast("long").alias("id"), titles.alias("celulas"))
    return head.unionByName(rows)


query("excel_statements", "movimentacao", """
, n AS (SELECT *, id % 17 AS f, row_number() OVER (PARTITION BY id % 17 ORDER BY id) + 1 AS linha, CASE WHEN id % 7 IN (0, 3) THEN -valor WHEN id % 7 = 2 THEN CAST('1' || lpad(CAST(valor AS VARCHAR), 9, '0') AS DECIMAL(15,2)) WHEN id % 7 = 1 OR id % 21 NOT IN (4, 5) THEN valor END AS v FROM movimentacao),
e AS (SELECT *, CASE WHEN v IS NULL AND id % 21 = 4 THEN 'Valor inválido: x' WHEN v IS NULL THEN 'Valor inválido: vazio' WHEN id % 12 = 2 THEN 'Tipo inválido: ?' WHEN id % 15 = 4 THEN 'Data inválida: 31/02/2024' END AS erro FROM n WHERE f <> 3 AND id % 31 <> 0)
SELECT 'extrato_' || f || '.xlsx' AS arquivo, linha, CASE WHEN erro IS NULL THEN data_movimento END AS data_movimento, CASE WHEN erro IS NULL THEN CAST(abs(v) AS DECIMAL(15,2)) END AS valor,
  CASE WHEN erro IS NULL THEN CASE WHEN id % 6 IN (0, 2) THEN 'ENTRADA' WHEN id % 6 = 1 THEN 'SAIDA' WHEN v >= 0 THEN 'ENTRADA' ELSE 'SAIDA' END END AS direcao, CASE WHEN erro IS NULL THEN descricao_raw END AS descricao_raw, erro FROM e
UNION ALL SELECT 'extrato_3.xlsx', NULL, NULL, NULL, NULL, NULL, 'Colunas obrigatórias ausentes: valor' WHERE EXISTS (SELECT 1 FROM n WHERE f = 3)""")(
    lambda m: sheets.statement_rows(_round_trip(_statement_books(m), "_parte", "id", first_only=True))
)


def _registry_books(p: DataFrame) -> DataFrame:
    """Registries of 5 files: titled in two ways, without titles with either column first, and one without a document column."""
    k = F.col("pessoa_id")
    document = F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.lit("111.111.111-11")).when(k % 17 == 0, F.lit("123456789012345")).when(F.col("tipo") == "PF", F.concat_ws("-", F.substring("documento", 1, 9), F.substring("documento", 10, 2))).otherwise(F.col("documento"))
    name = F.when(k % 19 == 0, F.lit(" ")).otherwise(F.concat(F.col("nome"), F.lit(" é")))
    kind = F.when(k % 23 == 0, F.lit("Coisa")).when(k % 3 == 0, F.when(F.col("tipo") == "PF", "Pessoa Física").otherwise("jurídica"))
    file = k % 5
    d, n, t = _cell("texto", document), _cell("texto", name), F.when(kind.isNotNull(), _cell("texto", kind))
    cells = F.when(file == 0, F.array(n, d, t)).when(file == 1, F.array(t, F.lit(None).cast(xlsx.CELL), d, n)).when(file == 2, F.array(n, d, t)).when(file == 3, F.array(d, n, t)).otherwise(F.array(n, n))
    rows = p.select(F.concat(F.lit("cadastro_"), file.cast("string"), F.lit(".xlsx")).alias("arquivo"), F.lit("A").alias("planilha"), F.lit(1).alias("_parte"), F.concat("tipo", F.lpad(k.cast("string"), 12, "0")).alias("_chave"), cells.alias("celulas"))
    text = lambda *titles: F.array(*[_cell("texto", F.lit(x)) for x in titles])
    person = lambda *cells: F.array(*[_cell("texto", F.lit(x)) for x in cells])
    titles = F.when(F.col("arquivo") == "cadastro_0.xlsx", text("Nome Completo", "CPF/CNPJ", "Tipo")).when(F.col("arquivo") == "cadastro_1.xlsx", text("Pessoa", "", "Nº Documento", "Razão Social")).when(F.col("arquivo") == "cadastro_2.xlsx", person("Ana Lima", "529.982.247-25", "PF")).when(F.col("arquivo") == "cadastro_3.xlsx", person("52998224725", "Ana Lima", "")).otherwise(text("Nome", "Apelido"))
    head = rows.select("arquivo", "planilha").distinct().select("arquivo", "planilha", F.lit(0).alias("_parte"), F.lit("").alias("_chave"), titles.alias("celulas"))
    return head.unionByName(rows)


query("excel_registries", "pessoa", """
, n AS (SELECT *, pessoa_id % 5 AS f, row_number() OVER (PARTITION BY pessoa_id % 5 ORDER BY tipo, lpad(CAST(pessoa_id AS VARCHAR), 12, '0')) + 1 AS linha, CASE WHEN pessoa_id % 5 = 3 THEN NULL WHEN pessoa_id % 23 = 0 THEN 'Coisa' WHEN pessoa_id % 3 = 0 THEN tipo END AS dito FROM pessoa),
e AS (SELECT *, CASE WHEN pessoa_id % 11 = 0 THEN 'Documento vazio' WHEN pessoa_id % 19 = 0 THEN 'Nome vazio' WHEN dito = 'Coisa' THEN 'Tipo inválido: Coisa' WHEN pessoa_id % 13 = 0 AND dito = 'PJ' THEN 'Documento com tamanho inválido' WHEN pessoa_id % 13 = 0 THEN 'CPF inválido: sequência repetida'
  WHEN pessoa_id % 17 = 0 THEN 'Documento com tamanho inválido' END AS erro FROM n WHERE f < 4)
SELECT 'cadastro_' || f || '.xlsx' AS arquivo, linha, CASE WHEN erro IS NULL THEN tipo END AS tipo, CASE WHEN erro IS NULL THEN documento END AS documento, CASE WHEN erro IS NULL THEN upper(nome) || ' E' END AS nome, erro FROM e
UNION ALL SELECT 'cadastro_' || f || '.xlsx', 1, 'PF', '52998224725', 'ANA LIMA', NULL FROM (SELECT DISTINCT f FROM n WHERE f IN (2, 3))
UNION ALL SELECT 'cadastro_4.xlsx', NULL, NULL, NULL, NULL, 'Colunas obrigatórias ausentes: documento. Mapeie manualmente.' WHERE EXISTS (SELECT 1 FROM n WHERE f = 4)""")(
    lambda p: sheets.registry_rows(_round_trip(_registry_books(p), "_parte", "_chave", first_only=True)).select("arquivo", "linha", "tipo", "documento", "nome", "erro")
)
