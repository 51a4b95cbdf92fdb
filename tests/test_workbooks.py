"""Workbooks there and back, failing writes, foreign files, CSV registries in several splits."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import registry_csv, sheets, xlsx

SCHEMA = f"arquivo string, planilha string, n int, celulas array<{xlsx.CELL}>"
CELLS = [("texto", " a<&>\"é 𝒳"), None, ("numero", "1.5"), ("numero", "-7"), ("data", "2024-02-29"), ("data", "2024-02-03 10:11:12"), ("logico", "true"), ("logico", "false"), ("texto", "")]


def test_cells_there_and_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i % 3}.xlsx", "A & B", i, [*CELLS, ("texto", str(i))]) for i in range(20)], SCHEMA)
    xlsx.write(rows, f"file://{tmp_path}/out", "n", most_rows=4)
    assert sorted(os.listdir(tmp_path / "out")) == ["f0.xlsx", "f1.xlsx", "f2.xlsx"]
    found = xlsx.read(spark, f"file://{tmp_path}/out").collect()
    assert all(r.erro is None for r in found) and {r.planilha for r in found} == {"A & B", "A & B (2)"}
    got = sorted((os.path.basename(r.arquivo), r.indice, r.linha, [c and tuple(c) for c in r.celulas]) for r in found)
    want = [(f"f{f}.xlsx", k // 4, k % 4 + 1, [*CELLS, ("texto", str(i))]) for f in range(3) for k, i in enumerate(range(f, 20, 3))]
    assert got == want
    assert all(r.indice == 0 for r in xlsx.read(spark, f"file://{tmp_path}/out", first_only=True).collect())


def test_a_failed_write_leaves_no_file_and_a_name_is_not_taken_twice(spark, tmp_path):
    good = spark.createDataFrame([("a.xlsx", "S", 1, [("texto", "x")])], SCHEMA)
    bad = spark.createDataFrame([(f"b{i}.xlsx", "S", 1, [("numero", "no number" if i == 3 else "1")]) for i in range(6)], SCHEMA)
    xlsx.write(good, str(tmp_path / "out"), "n")
    with pytest.raises(Exception, match="no number"):
        xlsx.write(bad, str(tmp_path / "out"), "n")
    assert os.listdir(tmp_path / "out") == ["a.xlsx"]
    with pytest.raises(Exception, match="there already"):
        xlsx.write(good, str(tmp_path / "out"), "n")
    assert os.listdir(tmp_path / "out") == ["a.xlsx"]
    xlsx.write(good.withColumn("arquivo", F.lit("c.xlsx")), str(tmp_path / "out"), "n", mode="overwrite")
    assert os.listdir(tmp_path / "out") == ["c.xlsx"]


def foreign(path, sheet, shared="", styles="", relations=True):
    """A workbook as other programs write it: shared strings, own styles, rows and cells without references."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="P" sheetId="1" r:id="rId9"/></sheets></workbook>')
        if relations:
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>{shared}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")


def test_foreign_workbooks(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="0.0 &quot;dias&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="22"/></cellXfs>'
    shared = '<si><t>one</t></si><si><r><t>t</t></r><r><t xml:space="preserve">wo </t></r><rPh><t>no</t></rPh></si>'
    sheet = '<row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2" t="s"><v>0</v></c></row><row r="5"/><row><c><v>45292</v></c><c s="1"><v>45292</v></c><c s="2"><v>2.5</v></c><c s="3"><v>45292.5</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>f</v></c><c t="b"><v>1</v></c></row>'
    foreign(tmp_path / "a.xlsx", sheet, shared, styles)
    (tmp_path / "b.xlsx").write_bytes(b"no archive")
    foreign(tmp_path / "c.xlsx", "", relations=False)
    found = {(os.path.basename(r.arquivo), r.linha): r for r in xlsx.read(spark, str(tmp_path)).collect()}
    assert found.keys() == {("a.xlsx", 2), ("a.xlsx", 6), ("b.xlsx", None)} and "BadZipFile" in found["b.xlsx", None].erro
    assert [c and tuple(c) for c in found["a.xlsx", 2].celulas] == [None, ("texto", "two "), *[None] * 24, ("texto", "one")]
    assert [tuple(c) for c in found["a.xlsx", 6].celulas] == [("numero", "45292"), ("data", "2024-01-01"), ("numero", "2.5"), ("data", "2024-01-01 12:00:00"), ("erro", "#N/A"), ("texto", "f"), ("logico", "true")]


def test_amounts_and_refused_files(spark):
    cell = lambda t, kind="texto": (kind, t)
    amounts = [cell("1.234,56"), cell("12,5"), cell("-3"), cell("7 BRL"), cell("1,2,3"), cell("abc"), cell("1e2"), cell("-0.5", "numero"), cell(""), None]
    rows = [("a", 1, [cell("data"), cell("VALOR"), cell("descricao")])] + [("a", k + 2, [cell("01/02/2024"), x, cell("d")]) for k, x in enumerate(amounts)] + [("b", 1, [cell("x")])]
    cells = spark.createDataFrame(rows, f"arquivo string, linha long, celulas array<{xlsx.CELL}>")
    found = sheets.statement_rows(cells)
    got = {r.linha: r.valor and (float(r.valor), r.direcao) for r in found.where("arquivo = 'a'").collect()}
    assert got == {2: (1234.56, "ENTRADA"), 3: (12.5, "ENTRADA"), 4: (3.0, "SAIDA"), 5: (7.0, "ENTRADA"), 6: (1.2, "ENTRADA"), 7: None, 8: (100.0, "ENTRADA"), 9: (0.5, "SAIDA"), 10: None, 11: None}
    assert {r.arquivo: (r.linha, r.erro) for r in sheets.refused(found).collect()} == {"a": (7, "Valor inválido: abc"), "b": (None, "Colunas obrigatórias ausentes: data, descricao, valor")}
    assert sheets.statement_rows(cells.limit(0)).count() == 0


def test_registries_in_csv_keep_their_line_numbers(spark, tmp_path):
    people = [f"Pessoa {k};{str(k).zfill(11)};{'PF' if k % 2 else ''}" for k in range(1, 3001)]
    (tmp_path / "a.csv").write_text("﻿Nome Completo;CPF/CNPJ;Tipo\r\n" + "\r\n\r\n".join(people) + "\r\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("doc,nome\n52998224725,Ana Lima\n\n111.111.111-11,Bia\n,Cia\n529,\n123456789012345,Dia\n", encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        cells = sheets.csv_cells(spark, str(tmp_path))
        assert cells.where("arquivo LIKE '%a.csv'").count() == 3001
        found = {(os.path.basename(r.arquivo), r.linha): r for r in sheets.registry_rows(cells, headerless=False).collect()}
        assert registry_csv.read(spark, str(tmp_path / "a.csv")).where("erro IS NULL AND nome = 'PESSOA ' || (linha - 1)").count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert all(found["a.csv", k + 1].nome == f"PESSOA {k}" and found["a.csv", k + 1].documento == str(k).zfill(11) for k in range(1, 3001) if k < 11 or k == 3000)
    assert [(r.tipo, r.nome, r.erro) for r in (found["b.csv", k] for k in range(2, 7))] == [("PF", "ANA LIMA", None), (None, None, "CPF inválido: sequência repetida"), (None, None, "Documento vazio"), (None, None, "Nome vazio"), (None, None, "Documento com tamanho inválido")]
    mapped = sheets.registry_rows(cells.where("arquivo LIKE '%b.csv'"), {"documento": "NOME", "nome": "doc"}, headerless=False)
    assert mapped.where("linha = 2").first().documento_lido == "Ana Lima"
    lost = sheets.registry_rows(cells.where("arquivo LIKE '%b.csv'"), {"documento": "doc", "nome": "nom"}, headerless=False)
    assert [r.erro for r in lost.collect()] == ["Coluna mapeada não encontrada: nom (nome)"]


def test_header_previews(spark):
    rows = [("a", 1, ["Razão Social", " ", "CNPJ", ""]), ("b", 1, ["52998224725", "Ana Lima", "PF", "x"]), ("c", 1, ["Apelido", "Cor"]), ("d", 2, ["nome", "cpf"])]
    cells = spark.createDataFrame([(a, n, [("texto", t) for t in c]) for a, n, c in rows], f"arquivo string, linha long, celulas array<{xlsx.CELL}>")
    found = {r.arquivo: (r.titulos, r.sem_cabecalho, r.documento, r.nome, r.tipo) for r in sheets.header_preview(cells).collect()}
    assert found == {"a": (["Razão Social", "CNPJ"], False, "CNPJ", "Razão Social", None), "b": (["nome", "documento", "tipo", "coluna_4"], True, "documento", "nome", "tipo"), "c": (["Apelido", "Cor"], False, None, None, None), "d": ([], False, None, None, None)}


def test_our_sheets_take_the_quick_path_and_others_the_parser(tmp_path):
    def book(path, sheets):
        with open(path, "wb") as f:
            b = xlsx._Book(xlsx._Counted(f), 3)
            for name, cells in sheets:
                b.add(name, [c and c[0] for c in cells], [c and c[1] for c in cells])
            b.close()
        return path.read_bytes()

    rows = [("A", [*CELLS, ("texto", "&amp; x\ny")]), ("A", [None, ("numero", "3")]), ("A", [("texto", "last")]), ("A", [("texto", "on")])]
    raw = book(tmp_path / "a.xlsx", rows)
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        path = "xl/worksheets/sheet1.xml"
        dates, slow = xlsx._date_styles(z), list(xlsx._rows(z.open(path), [], xlsx._date_styles(z), xlsx.EPOCH))
        assert list(xlsx._plain_rows(z.open(path), [], dates, xlsx.EPOCH)) == slow and [n for n, _ in slow] == [1, 2, 3]
    # A full first sheet goes on in the next, whose rows are counted on; one that isn't full doesn't.
    assert [r[2] for r in xlsx.rows_of_book(raw, True, 3)] == [1, 2, 3, 4] and [r[2] for r in xlsx.rows_of_book(raw, True, 4)] == [1, 2, 3]
    # A carriage return, a number's entity or a comment in a later row leaves it and the rows after it to the parser.
    for odd in ("a\r\nb", "&#65;", "<!-- c -->d"):
        text = f'<row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t xml:space="preserve">{odd}</t></is></c></row><row r="3"><c r="B3"><v>2</v></c></row>'
        foreign(tmp_path / "b.xlsx", text)
        with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
            z.writestr("s.xml", xlsx._HEAD + text.encode() + xlsx._TAIL)
        with zipfile.ZipFile(tmp_path / "c.xlsx") as z:
            assert list(xlsx._rows_of_sheet(z, "s.xml", [], [], xlsx.EPOCH)) == list(xlsx._rows(z.open("s.xml"), [], [], xlsx.EPOCH))
