"""The driver's tables seen as a ledger. The same text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "prestador": """SELECT n_nationkey AS cnpj_prestador, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS nome_estadual, r_name AS nome_municipal, r_regionkey AS uf
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "pessoa": """SELECT c_custkey AS pessoa_id, 'PF' AS tipo, lpad(CAST(c_custkey AS VARCHAR(20)), 11, '0') AS documento, c_name AS nome FROM {customer}
UNION ALL
SELECT s_suppkey AS pessoa_id, 'PJ' AS tipo, lpad(CAST(s_suppkey AS VARCHAR(20)), 14, '0') AS documento, s_name AS nome FROM {supplier}""",
    "movimentacao": """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS data_movimento, CAST(o_totalprice AS DECIMAL(15,2)) AS valor,
  CASE WHEN o_orderkey % 3 = 0 THEN 'SAIDA' ELSE 'ENTRADA' END AS direcao,
  CASE o_orderstatus WHEN 'F' THEN 'CONFIRMADO' WHEN 'O' THEN 'PENDENTE_REVISAO' ELSE 'EXPORTADO' END AS status,
  CAST(year(o_orderdate) AS INT) AS exercicio, n_regionkey AS uf, c_nationkey AS cnpj_prestador,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS pessoa_id, o_orderkey % 7 AS arquivo_id,
  c_nationkey * 100 + month(o_orderdate) AS sessao_id, o_orderkey % 11 = 0 AS bloqueio_export, o_orderkey % 13 = 0 AS deletado,
  CAST((o_orderkey * 7919) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confianca, o_orderpriority AS descricao_raw,
  CASE WHEN o_orderkey % 10 < 4 THEN NULL ELSE lpad(CAST(o_orderkey % 24 AS VARCHAR(2)), 2, '0') || ':30' END AS hora,
  CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey - 1 END AS canonica_id
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "evidencia": """SELECT l_orderkey AS movimentacao_id,
  CASE WHEN l_linenumber = 7 THEN 'CONFLITO_NOME' WHEN l_returnflag = 'A' THEN 'CPF_EXATO' WHEN l_returnflag = 'R' THEN 'VALOR_DATA' ELSE 'NOME_FUZZY' END AS tipo,
  CASE WHEN l_linestatus = 'F' THEN l_discount END AS peso FROM {lineitem}""",
    "classificacao": """SELECT o_orderkey AS movimentacao_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'OR' END AS fonte_recurso,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '0' END AS natureza_recurso, CASE WHEN o_orderkey % 2 = 0 THEN 'PF' ELSE 'PJ' END AS tipo_origem_recurso,
  CASE WHEN o_orderkey % 8 = 1 THEN CAST(o_orderkey AS VARCHAR(20)) END AS nr_recibo_doacao FROM {orders} WHERE o_orderkey % 17 <> 0""",
    "linha": """SELECT DISTINCT ((l_orderkey * 10 + l_linenumber) * 10000 + l_partkey % 10000) * 10000 + l_suppkey % 10000 AS id, l_suppkey AS arquivo_id, CASE l_linestatus WHEN 'O' THEN 'PIX' ELSE 'COMPLETO' END AS papel,
  CAST(l_shipdate AS DATE) AS data_movimento, CAST(l_quantity AS DECIMAL(15,2)) AS valor, l_returnflag AS direcao, l_partkey AS sessao_id,
  CASE WHEN l_orderkey % 9 = 0 THEN lpad(CAST(l_suppkey % 5 + 1 AS VARCHAR(20)), 11, '0') END AS cpf,
  CASE WHEN l_orderkey % 9 = 1 THEN lpad(CAST(l_suppkey % 5 + 1 AS VARCHAR(20)), 14, '0') END AS cnpj,
  CASE WHEN l_orderkey % 8 = 2 THEN 'Supplier#' || lpad(CAST(l_suppkey % 6 AS VARCHAR(20)), 9, '0') WHEN l_orderkey % 8 = 6 THEN 'Customer#' || lpad(CAST(l_suppkey % 5 + 1 AS VARCHAR(20)), 9, '0')
    WHEN l_orderkey % 4 <> 0 THEN 'SUPPLIER ' || CAST(l_suppkey % 6 AS VARCHAR(20)) END AS nome,
  CASE WHEN l_orderkey % 3 <> 0 THEN lpad(CAST(l_orderkey % 2 + 10 AS VARCHAR(2)), 2, '0') || ':' || lpad(CAST(l_partkey % 10 AS VARCHAR(2)), 2, '0') END AS hora,
  CASE WHEN l_orderkey % 5 = 2 THEN lpad(CAST(day(l_shipdate) AS VARCHAR(2)), 2, '0') || '10' || lpad(CAST(l_suppkey % 10 AS VARCHAR(2)), 2, '0') END AS nr_documento,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_partkey % 3 END AS conta_id FROM {lineitem}""",
    "item": """SELECT o_orderkey AS id, o_orderkey % 40 AS arquivo_id, o_orderkey % 3 + 1 AS pagina,
  CASE WHEN o_orderkey % 23 = 0 THEN '31/12/1996' WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(make_date(1996, CAST(o_orderkey % 12 + 1 AS INT), CAST(o_orderkey % 2 + 1 AS INT)) AS VARCHAR(10)) END AS data,
  CASE o_orderkey % 5 WHEN 0 THEN '1.234,56' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'R$ 10' END WHEN 2 THEN '-' || CAST(o_orderkey % 3 AS VARCHAR(10)) || ',5' WHEN 3 THEN CAST(o_orderkey % 4 AS VARCHAR(10)) ELSE '12,30 C' END AS valor,
  CASE o_orderkey % 7 WHEN 0 THEN ' entrada ' WHEN 1 THEN 'X' WHEN 2 THEN 'ENTRADA' WHEN 3 THEN 'Saida' ELSE 'SAIDA' END AS direcao,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'DP DIN LOT' WHEN 2 THEN 'Pix recebido de João da Silva' WHEN 3 THEN ' abc ' WHEN 4 THEN NULL ELSE 'PAG ' || o_orderpriority END AS descricao,
  CASE o_orderkey % 4 WHEN 0 THEN 'joão da silva' WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE 'MARIA' END AS nome, CASE WHEN o_orderkey % 9 = 0 THEN 'Loja Ação' END AS contraparte,
  CASE o_orderkey % 8 WHEN 0 THEN 'Ana Lima' WHEN 1 THEN 'Jo' WHEN 2 THEN ' ' END AS remetente_destinatario, CASE o_orderkey % 10 WHEN 0 THEN 'NULL' WHEN 1 THEN 'C' END AS cred_dev,
  CASE o_orderkey % 11 WHEN 0 THEN '529.982.247-25' WHEN 1 THEN '52998224724' WHEN 2 THEN '' END AS cpf, CASE o_orderkey % 12 WHEN 0 THEN '11.222.333/0001-81' WHEN 1 THEN '123' END AS cnpj,
  CASE o_orderkey % 13 WHEN 0 THEN '11222333000181' WHEN 1 THEN '529.982.247-25' WHEN 2 THEN '11111111111' END AS cpf_cnpj, CASE o_orderkey % 14 WHEN 0 THEN 'null' WHEN 1 THEN ' 100752 ' END AS documento,
  CASE WHEN o_orderkey % 3 = 0 THEN '10:07' END AS hora, CAST(NULL AS VARCHAR(10)) AS historico, CAST(NULL AS VARCHAR(10)) AS tipo_pix, CAST(NULL AS VARCHAR(10)) AS situacao, CASE WHEN o_orderkey % 2 = 0 THEN ' 5 ' END AS saldo
FROM {orders}""",
    "celula": """SELECT o_orderkey AS id, CASE o_orderkey % 16 WHEN 0 THEN '529.982.247-25' WHEN 1 THEN 'CPF: 52998224725' WHEN 2 THEN '5.2998224725E10' WHEN 3 THEN '1,1222333000181e13' WHEN 4 THEN '123.0' WHEN 5 THEN ' cnpj 11.222.333/0001-81 '
  WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN '123456789012345' WHEN 9 THEN 'ab.cde.fgh/0001-81' WHEN 10 THEN CAST(o_orderkey % 100000 AS VARCHAR(10)) WHEN 11 THEN '112223330001' WHEN 12 THEN '1e400' WHEN 13 THEN '7e7' WHEN 14 THEN '1,5' ELSE 'Pessoa Física' END AS texto,
  CASE o_orderkey % 9 WHEN 0 THEN 'CRED PIX - 529.982.247-25 João  da Silva' WHEN 1 THEN 'TED | Ana: Lima, CPF 52998224725' WHEN 2 THEN 'Saldo' WHEN 3 THEN 'PAGAMENTO DE Fornecedor Doces' WHEN 4 THEN '11.222.333/0001-81' WHEN 5 THEN 'pix' WHEN 6 THEN 'Pix recebido-Bia Souza 11.222.333/0001-81' WHEN 7 THEN 'teddy transf' ELSE '' END AS descricao,
  CASE o_orderkey % 8 WHEN 0 THEN 'OpenRouter HTTP 401: User not found' WHEN 1 THEN 'openrouter http 500' WHEN 2 THEN 'mais de 12 páginas' WHEN 3 THEN 'Invalid PDF' WHEN 4 THEN 'Blob gone' WHEN 5 THEN 'página sem texto' WHEN 6 THEN 'colunas obrigatórias' ELSE 'OPENROUTER_API_KEY ausente' END AS mensagem FROM {orders}""",
}
TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A ledger view over the tables of a folder."""
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def with_views(*names: str) -> str:
    """The head of an oracle query that names the views it uses."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names) + "\n"
