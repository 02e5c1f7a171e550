"""XML curricula to records, compact profiles and units.

An XML tree has no fixed schema, so one Arrow-batched function turns each file into rows (section, kind,
place, fields), fields being the ordered (name, value) leaves of a record. All that follows is relational:
recency by window, compaction by array filters, unit numbering by row_number.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X

# Elements and attributes that are left out.
PRUNED = frozenset(["ENDERECO", "ENDERECO-PROFISSIONAL", "AUTORES", "PARTICIPANTE-BANCA", "INFORMACOES-ADICIONAIS", "INFORMACOES-ADICIONAIS-INSTITUICOES", "INFORMACOES-ADICIONAIS-CURSOS"])
PERSONAL = frozenset([
    "NOME-COMPLETO", "NOME-COMPLETO-DO-AUTOR", "NOME-PARA-CITACAO", "NOME-CITACAO", "NOME-DO-CANDIDATO", "NOME-COMPLETO-DO-ORIENTADOR", "NOME-DO-ORIENTADOR",
    "NOME-COMPLETO-DO-PARTICIPANTE-DA-BANCA", "NOME-DO-PARTICIPANTE", "NOME-COMPLETO-DO-CO-AUTOR", "CPF", "NUMERO-DO-CPF", "ORCID-ID", "ID-ORCID", "E-MAIL", "EMAIL", "TELEFONE",
    "CELULAR", "FAX", "DATA-NASCIMENTO", "DATA-DE-NASCIMENTO", "CIDADE-NASCIMENTO", "UF-NASCIMENTO", "PAIS-DE-NASCIMENTO", "NACIONALIDADE", "SEXO", "NUMERO-IDENTIFICADOR",
])
WORTHLESS = frozenset([
    "NOME-INSTITUICAO", "NOME-DA-INSTITUICAO", "NOME-AGENCIA", "SEQUENCIA-FORMACAO", "SEQUENCIA-ATIVIDADE", "SEQUENCIA-IMPORTANCIA", "SEQUENCIA-HISTORICO", "SEQUENCIA-FUNCAO-ATIVIDADE",
    "SEQUENCIA-ESPECIFICACAO", "NIVEL", "FLAG-BOLSA", "FLAG-DEDICACAO-EXCLUSIVA", "FLAG-VINCULO-EMPREGATICIO", "DOI", "ISBN", "ISSN", "VOLUME", "FASCICULO", "SERIE", "PAGINA-INICIAL", "PAGINA-FINAL",
])
#: What names of left-out attributes begin with, and what they must hold besides; names of people.
NAME_RULES = {"CODIGO-": [], "HOME-PAGE": [], "SEQUENCIA-": [], "NOME": ["INSTITUICAO"], "": ["URL"]}
PEOPLE = ["AUTOR", "ORIENTADOR", "CANDIDATO", "PARTICIPANTE"]

# Field names that a compact record is read from, and those that make a unit's text.
TITLE = ["TITULO", "TITULO_DO_TRABALHO", "TITULO_DO_ARTIGO", "TITULO_DO_LIVRO", "TITULO_DO_CAPITULO_DO_LIVRO", "TITULO_DA_PRODUCAO", "TITULO_DA_ORIENTACAO"]
YEAR = ["ANO", "ANO_DO_TRABALHO", "ANO_DO_ARTIGO", "ANO_DO_LIVRO", "ANO_DO_CAPITULO", "ANO_DA_PRODUCAO", "ANO_DE_PUBLICACAO", "ANO_DE_REALIZACAO", "ANO_DE_CONCLUSAO"]
NATURE = ["NATUREZA", "TIPO", "FINALIDADE"]
AREAS = ["NOME_GRANDE_AREA_DO_CONHECIMENTO", "NOME_DA_AREA_DO_CONHECIMENTO", "NOME_DA_SUB_AREA_DO_CONHECIMENTO", "NOME_DA_ESPECIALIDADE"]
START, END = ["ANO_INICIO", "ANO_DE_INICIO"], ["ANO_FIM", "ANO_DE_FIM"]
COURSE = ["NOME_DO_CURSO", "NOME_CURSO"]
LIMITS = {"producao_bibliografica": 30, "producao_tecnica": 20, "orientacoes_concluidas": 20, "demais_trabalhos": 20}
SECTIONS = ["formacao_academica", "atuacao_profissional", "areas_de_atuacao", "linhas_de_pesquisa", "ensino", "producao_bibliografica", "producao_tecnica", "orientacoes_concluidas", "demais_trabalhos"]
UNIT_FIELDS = {
    "formacao_academica": ["curso", "titulo"],
    "atuacao_profissional": ["vinculo_cargo"],
    "areas_de_atuacao": ["areas"],
    "linhas_de_pesquisa": ["linha", "descricao"],
    "ensino": ["cursos", "disciplinas"],
    **dict.fromkeys(LIMITS, ["titulo", "natureza", "palavras_chave", "areas"]),
}

RECORDS = "author string, section string, kind string, pos int, fields array<struct<name:string,value:string>>"
_HTML, _ENTITY, _SPACE = re.compile(X.HTML), re.compile(X.ENTITIES["basic"]), re.compile(r"\s+")
_ODD = re.compile(X.KEEP["basic"].removeprefix("(?U)").replace(r"\p{L}\p{N}_", r"\w"))


def left_out(attribute: str) -> bool:
    """Personal attributes and those without value for what someone works on, by name or by a rule on names."""
    n = attribute.upper().strip()
    holds = lambda parts: any(p in n for p in parts)
    if n in PERSONAL | WORTHLESS or ("NOME" in n and holds(PEOPLE)):
        return True
    return any(n.startswith(begin) and (not besides or holds(besides)) for begin, besides in NAME_RULES.items())


def _clean(value: str | None) -> str:
    return _SPACE.sub(" ", _ODD.sub(" ", _ENTITY.sub(" ", _HTML.sub(" ", value or "")))).strip()


def _name(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _field(name: str) -> str:
    return re.sub(r"[^A-Z0-9]+", "_", name.upper()).strip("_")


def _grouped(e: ET.Element, skip=frozenset()) -> dict[str, list[ET.Element]]:
    """Children with content, by name in order of first appearance."""
    out: dict[str, list] = {}
    for c in e:
        n = _name(c.tag)
        if n and n not in PRUNED and n not in skip and leaves(c, skip):
            out.setdefault(n, []).append(c)
    return out


def _own(e: ET.Element) -> list[tuple[str, str]]:
    return [(_field(n), v) for n, raw in e.attrib.items() if not left_out(n) and (v := _clean(raw))]


def leaves(e: ET.Element, skip=frozenset()) -> list[tuple[str, str]]:
    """Ordered (name, value) of all that is kept under an element."""
    out = _own(e)
    if text := _clean(e.text):
        out.append(("TEXTO", text))
    for same in _grouped(e, skip).values():
        for c in same:
            out += leaves(c, skip)
    return out


def _publications(e: ET.Element) -> list[ET.Element]:
    """Elements that have a DADOS-BASICOS-* child, outermost first."""
    groups = _grouped(e)
    if any(n.upper().startswith("DADOS-BASICOS-") for n in groups):
        return [e]
    return [p for same in groups.values() for c in same for p in _publications(c)]


def records(root: ET.Element) -> list[tuple[str, str | None, list[tuple[str, str]]]]:
    """(section, kind, fields) of each record of a curriculum, in document order."""
    out = []

    def add(section, kind, fields):
        if fields:
            out.append((section, kind, fields))

    for e in root.iter():
        n = _name(e.tag)
        kids = [c for c in e if _name(c.tag) and _name(c.tag) not in PRUNED]
        if n == "FORMACAO-ACADEMICA-TITULACAO" or n == "ORIENTACOES-CONCLUIDAS":
            for c in kids:
                if f := leaves(c):
                    add("formacao_academica" if n[0] == "F" else "orientacoes_concluidas", _name(c.tag), [("TIPO", _clean(_name(c.tag))), *f])
        elif n == "AREAS-DE-ATUACAO":
            for c in kids:
                add("areas_de_atuacao", None, leaves(c))
        elif n == "ATUACOES-PROFISSIONAIS":
            for c in kids:
                if _name(c.tag) == "ATUACAO-PROFISSIONAL":
                    add("atuacao_profissional", None, leaves(c, frozenset(["LINHA-DE-PESQUISA", "ATIVIDADES-DE-ENSINO"])))
        elif n == "LINHA-DE-PESQUISA":
            add("linhas_de_pesquisa", None, leaves(e))
        elif n == "ATIVIDADES-DE-ENSINO":
            for c in kids:
                add("ensino", None, leaves(c))
        elif n == "PRODUCAO-BIBLIOGRAFICA":
            for block in kids:
                kind, found = _name(block.tag), _publications(block)
                for p in found:
                    add("producao_bibliografica", kind, leaves(p))
                if not found:
                    add("producao_bibliografica", kind, _own(block))
                    for same in _grouped(block).values():
                        for c in same:
                            add("producao_bibliografica", kind, leaves(c))
        elif n == "PRODUCAO-TECNICA":
            for block in kids:
                several = [c for same in _grouped(block).values() if len(same) > 1 for c in same]
                for c in several or [block]:
                    add("producao_tecnica", _name(block.tag), leaves(c))
        elif n == "DEMAIS-TRABALHOS":
            add("demais_trabalhos", "DEMAIS-TRABALHOS", leaves(e))
        elif n.startswith(("PARTICIPACAO-EM-BANCA-DE-", "BANCA-JULGADORA-PARA-")):
            add("participacao_em_bancas", n, leaves(e))
    return out


def _parse(batches):
    for b in batches:
        rows = []
        for author, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                root = ET.fromstring(content)
            except (ET.ParseError, TypeError, ValueError):
                rows.append((author, None, None, 0, []))
                continue
            rows += [(author, s, k, i, [{"name": n, "value": v} for n, v in f]) for i, (s, k, f) in enumerate(records(root))]
        cols = list(zip(*rows)) or [()] * 5
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["author", "section", "kind", "pos", "fields"])


def curriculum_records(files: DataFrame) -> DataFrame:
    """files(author, content) -> author, section, kind, pos, fields. A file that doesn't parse gives one row
    with section null."""
    return files.select("author", "content").mapInArrow(_parse, RECORDS)


def values(fields: Column, names: list[str]) -> Column:
    """Distinct values of the named fields, in record order."""
    return F.array_distinct(F.transform(F.filter(fields, lambda x: x["name"].isin(names)), lambda x: x["value"]))


def values_like(fields: Column, parts: list[str]) -> Column:
    hit = lambda x: reduce(lambda a, b: a | b, [x["name"].contains(p) for p in parts])
    return F.array_distinct(F.transform(F.filter(fields, hit), lambda x: x["value"]))


def first(fields: Column, names: list[str]) -> Column:
    return F.get(values(fields, names), F.lit(0))


def year(fields: Column) -> Column:
    """The latest year in fields whose name holds ANO; -1 if there is none."""
    years = F.transform(F.filter(fields, lambda x: x["name"].contains("ANO")), lambda x: X.year_of(x["value"]))
    return F.coalesce(F.array_max(years), F.lit(-1))


def recent(rows: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """The most recent records of each limited section: year descending, input order on ties, no year last."""
    at = F.row_number().over(Window.partitionBy("author", "section").orderBy(F.desc(year(F.col("fields"))), "pos"))
    most = reduce(lambda c, kv: c.when(F.col("section") == kv[0], kv[1]), limits.items(), F)
    limited = F.col("section").isin(*limits)
    return rows.withColumn("recency", F.when(limited, at)).where(~limited | (F.col("recency") <= most.otherwise(0)))


def compact(rows: DataFrame) -> DataFrame:
    """author, section, pos, recency and a record with the compact fields of its section; null or empty where
    the record or the section has none. Bibliographic records need one informative field besides the kind."""
    f, s = F.col("fields"), F.col("section")
    other = F.get(F.transform(F.filter(f, lambda x: x["name"].startswith("TITULO_") & ~x["name"].contains("ANAIS") & ~x["name"].contains("PROCEEDINGS")), lambda x: x["value"]), F.lit(0))
    works = s.isin(*LIMITS)
    none = F.array().cast("array<string>")
    only = lambda cond, v: F.when(cond, v)
    many = lambda cond, v: F.when(cond, v).otherwise(none)
    job = s == "atuacao_profissional"
    degree, line, teach = s == "formacao_academica", s == "linhas_de_pesquisa", s == "ensino"
    links = values(f, ["TIPO_DE_VINCULO", "OUTRO_VINCULO_INFORMADO", "ENQUADRAMENTO_FUNCIONAL", "OUTRO_ENQUADRAMENTO_FUNCIONAL_INFORMADO"])
    out = rows.select(
        "author", "section", "pos", "recency",
        only(works | degree, F.col("kind")).alias("tipo"),
        F.when(works, first(f, YEAR)).alias("ano"),
        F.when(works, F.coalesce(first(f, TITLE), other)).when(degree, first(f, ["TITULO_DA_DISSERTACAO_TESE", "TITULO_DO_TRABALHO_DE_CONCLUSAO_DE_CURSO", "TITULO"])).alias("titulo"),
        only(works, first(f, NATURE)).alias("natureza"),
        many(works, values_like(f, ["PALAVRA_CHAVE"])).alias("palavras_chave"),
        many(works | (s == "areas_de_atuacao"), values(f, AREAS)).alias("areas"),
        many(job, F.array_union(links, values_like(f, ["CARGO", "FUNCAO"]))).alias("vinculo_cargo"),
        only(degree, first(f, COURSE)).alias("curso"),
        many(teach, values(f, COURSE)).alias("cursos"),
        many(teach, values_like(f, ["DISCIPLINA"])).alias("disciplinas"),
        F.when(job | teach, values(f, START)).when(degree, F.filter(F.array(first(f, ["ANO_DE_INICIO", "ANO_INICIO"])), lambda x: x.isNotNull())).otherwise(none).alias("ano_inicio"),
        F.when(job | teach, values(f, END)).when(degree, F.filter(F.array(first(f, ["ANO_DE_CONCLUSAO", "ANO_CONCLUSAO"])), lambda x: x.isNotNull())).otherwise(none).alias("ano_fim"),
        only(line, first(f, ["NOME_DA_LINHA_DE_PESQUISA", "TITULO_DA_LINHA_DE_PESQUISA", "LINHA_DE_PESQUISA"])).alias("linha"),
        only(line, first(f, ["OBJETIVOS_LINHA_DE_PESQUISA", "OBJETIVO_DA_LINHA_DE_PESQUISA", "DESCRICAO_DA_LINHA_DE_PESQUISA"])).alias("descricao"),
    )
    told = F.coalesce("ano", "titulo", "natureza", "linha", "descricao", "curso").isNotNull()
    listed = reduce(lambda a, b: a | b, [F.size(c) > 0 for c in ("palavras_chave", "areas", "vinculo_cargo", "cursos", "disciplinas", "ano_inicio", "ano_fim")])
    return out.where(told | listed | (F.col("tipo").isNotNull() & (F.col("section") != "producao_bibliografica")))


def profile(files: DataFrame) -> DataFrame:
    """The compact curriculum of each file: records of the used sections, limited to the most recent."""
    return compact(recent(curriculum_records(files).where(F.col("section").isin(*SECTIONS))))


def units(compacted: DataFrame) -> DataFrame:
    """author, doc_id (section_NNN), section, pieces: one unit a record with text, areas each their own."""
    def pieces(names):
        kinds = dict(compacted.dtypes)
        return F.array_distinct(F.filter(F.flatten(F.array(*[F.col(n) if kinds[n].startswith("array") else F.array(n) for n in names])), lambda x: x.isNotNull() & (x != "")))

    text = reduce(lambda c, kv: c.when(F.col("section") == kv[0], pieces(kv[1])), UNIT_FIELDS.items(), F)
    rows = compacted.withColumn("pieces", text).where(F.size("pieces") > 0).withColumn("o", F.coalesce("recency", "pos"))
    area = F.col("section") == "areas_de_atuacao"
    each = rows.where(~area).select("author", "section", "o", F.lit(0).alias("k"), "pieces")
    split = rows.where(area).select("author", "section", "o", F.posexplode("pieces").alias("k", "p"))
    split = split.groupBy("author", "section", "p").agg(F.min(F.struct("o", "k")).alias("x")).select("author", "section", "x.o", "x.k", F.array("p").alias("pieces"))
    number = (F.row_number().over(Window.partitionBy("author", "section").orderBy("o", "k")) - 1).cast("string")
    number = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return each.unionByName(split).select("author", F.concat("section", F.lit("_"), number).alias("doc_id"), "section", "pieces")


def section_summary(compacted: DataFrame) -> DataFrame:
    """section, authors, mean and greatest number of records."""
    n = compacted.groupBy("section", "author").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("section").agg(F.count(F.lit(1)).alias("authors"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def unit_summary(units_table: DataFrame) -> DataFrame:
    """section, units, authors, mean, least and most units an author; the row of section null is over all."""
    n = units_table.groupBy("author", "section").agg(F.count(F.lit(1)).alias("n"))
    stats = (F.sum("n").alias("units"), F.count(F.lit(1)).alias("authors"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))
    total = n.groupBy("author").agg(F.sum("n").alias("n"))
    return n.groupBy("section").agg(*stats).unionByName(total.agg(*stats).select(F.lit(None).cast("string").alias("section"), "units", "authors", "mean", "least", "most"))


def uncovered(field_units: DataFrame, ngram_units: DataFrame) -> DataFrame:
    """Units with fields but without n-grams: must be empty before coverage is measured."""
    return field_units.select("author", "doc_id").join(ngram_units.select("author", "doc_id"), ["author", "doc_id"], "left_anti")


def alignment(curricula: DataFrame, judged: DataFrame, units_table: DataFrame) -> DataFrame:
    """One row: authors with a curriculum, of those judged, not judged, judged without a unit (missing), and with
    units though not both (extra)."""
    own, known = curricula.select("author").distinct(), judged.select("author").distinct()
    both, has = own.join(known, "author", "left_semi"), units_table.select("author").distinct()
    count = lambda df: df.select(F.count(F.lit(1))).scalar()
    extra = has.join(both, "author", "left_anti")
    return own.agg(F.count(F.lit(1)).alias("curricula")).select("curricula", count(both).alias("judged"), count(own.join(known, "author", "left_anti")).alias("not_judged"), count(both.join(has, "author", "left_anti")).alias("missing"), count(extra).alias("extra"))


def audit_report(curricula: DataFrame, judged: DataFrame, units_table: DataFrame) -> dict:
    """The report beside the units: alignment, totals by section and the spread over authors. Extra authors are an error."""
    told = alignment(curricula, judged, units_table).first().asDict()
    if told["extra"]:
        raise ValueError(f"{told['extra']} authors have units without a judged curriculum")
    rows = {r.section: r for r in unit_summary(units_table).collect()}  # a row a section
    over = rows.get(None)
    return told | {
        "sections": SECTIONS, "fields": UNIT_FIELDS, "units_by_section": {s: rows[s].units if s in rows else 0 for s in SECTIONS},
        "mean_units": over.mean or 0.0, "least_units": over.least or 0, "most_units": over.most or 0,
    }
