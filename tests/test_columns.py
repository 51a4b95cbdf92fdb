"""Headers found on random pages against a walk over the boxes, and the checks of column maps."""

import math
import random

from ledgerloom.operators import columns


def runs_of(band):
    found = []
    for x, _, text in sorted((t for t in band if t[2].strip()), key=lambda t: (t[0], t[1])):
        if not found or x - found[-1][0] > columns.GAP:
            found.append([x, text.strip()])
        else:
            found[-1][1] += " " + text.strip()
    return found


def fields_of(title):
    return [f for f, words in columns.KEYWORDS.items() if any(w in title.lower() for w in words)]


def plain(page, width):
    """The header's columns of one page; page is (ordem, x, y, str)."""
    bands = {}
    for ordem, x, y, text in sorted(page):
        bands.setdefault(math.floor(y / columns.BAND + 0.5), []).append((x, ordem, text))
    best, most = [], -1
    for band in bands.values():
        runs = runs_of(band)
        score = sum(len(fields_of(t)) for _, t in runs)
        if score > most:
            best, most = runs, score
    if most < columns.LEAST:
        return []
    at = [x / width for x, _ in best]
    edge = [0.0, *[(a + b) / 2 for a, b in zip(at, at[1:])], 1.0]
    return [(k, fields_of(t)[0], t, round(min(1, max(0, edge[k])), 9), round(min(1, max(0, edge[k + 1])), 9)) for k, (_, t) in enumerate(best) if fields_of(t)]


def test_headers_of_random_pages(spark):
    rng = random.Random(2)
    words = ["Data", "VALOR", "Nr.", "Doc", "Histórico", "Favorecido", "CPF/CNPJ", "Saldo", "abc", " ", "12,00", "Tipo", "Débito", "Hora", "x"]
    pages = {p: [(k, float(rng.randrange(0, 600, 7)), float(rng.randrange(0, 90, 5)), rng.choice(words)) for k in range(rng.randint(1, 25))] for p in range(150)}
    items = spark.createDataFrame([(p, *t, 600.0) for p, texts in pages.items() for t in texts], "p int, ordem int, x double, y double, str string, largura double")
    found = {}
    for r in columns.header_columns(items, "p").orderBy("p", "coluna_index").collect():
        found.setdefault(r.p, []).append((r.coluna_index, r.campo, r.titulo, round(r.x_inicio, 9), round(r.x_fim, 9)))
    want = {p: w for p, texts in pages.items() if (w := plain(texts, 600.0))}
    assert found == want and len(want) > 50
    seen = {r.p: r.coluna_direcao_detectada for r in columns.has_direction_header(items, "p").collect()}
    for p, texts in pages.items():
        bands = {}
        for ordem, x, y, text in texts:
            bands.setdefault(math.floor(y / columns.BAND + 0.5), []).append((x, ordem, text))
        assert seen[p] == any("direcao" in fields_of(t) for band in bands.values() for _, t in runs_of(band))
    assert columns.header_columns(items.limit(0), "p").count() == 0


def test_column_maps_are_checked(spark):
    c = lambda *names: [(n, k) for k, n in enumerate(names)]
    maps = [
        (1, 1, 1, False, False, c("data", "valor", "direcao", "remetente_destinatario")), (1, 2, 1, True, False, c("data", "valor", "tipo_pix")), (2, 3, 1, True, True, c("data", "valor")), (2, 4, 1, None, None, c("data", "valor")),
        (2, 5, 2, True, False, c("data", "valor")), (2, 6, 1, True, False, c("valor")), (2, 7, 1, True, False, c("data")), (2, 8, 1, True, False, [("data", -1), ("valor", 1)]), (3, 9, 1, True, False, [("data", None)]), (3, 10, 1, True, False, c("data", "valor", "remetente_destinatario", "documento")),
    ]
    table = spark.createDataFrame(maps, "sessao_id int, id int, pagina_referencia int, inferir_direcao boolean, coluna_direcao_detectada boolean, colunas array<struct<campo:string,coluna_index:int>>")
    found = {r.id: r.problema for r in columns.map_problems(table).collect()}
    assert found == {1: None, 2: None, 3: "Mapeie a coluna direcao", 4: "Mapeie direcao ou marque inferir do valor", 5: "paginaReferencia deve ser 1", 6: "Mapeie a coluna data", 7: "Mapeie a coluna valor", 8: "colunaIndex inválido para data", 9: "colunaIndex inválido para data", 10: None}
    assert {r.sessao_id: r.problema for r in columns.session_problems(table).collect()} == {1: None, 2: "Falta mapear remetente_destinatario em pelo menos um extrato", 3: "Falta mapear historico em pelo menos um extrato"}


def test_header_columns_deal_texts_once(spark):
    """All of a page's work follows from one shuffle, and its width is that of its widest text, in the header's band or not."""
    items = spark.createDataFrame([(1, k, x, y, t, w) for k, (x, y, t, w) in enumerate([(10.0, 10.0, "Data", 100.0), (60.0, 10.0, "Valor", 100.0), (10.0, 40.0, "1", 200.0)])], "p int, ordem int, x double, y double, str string, largura double")
    found = columns.header_columns(items, "p")
    assert [(r.campo, r.x_inicio, r.x_fim) for r in found.orderBy("coluna_index").collect()] == [("data", 0.0, 0.175), ("valor", 0.175, 1.0)]
    # The plan as it is made before it runs: joins of parts of a page would deal it again.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
