"""Rows for both engines of what no input table has; spread over the parts of the catalogue they are as many as those ask for."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession


def worded(column: str) -> str:
    """The column, in every second row with the part's name behind it."""
    return f"CASE WHEN k % 2 = 1 THEN {column} || ' ' || word ELSE {column} END"


@dataclass
class Rows:
    """Rows of a schema ("name type, ...", with types that both engines know); in over(), each part of the catalogue has one group of them.

    group: the column that tells groups apart, each row by default. vary: expressions that both engines know for columns as over() has them, of the
    columns, k (the part's key), word (its name) and size.
    """

    schema: str
    rows: list[tuple]
    group: str | None = None
    vary: dict[str, str] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def _names(self) -> list[tuple[str, str]]:
        return [tuple(c.strip().split(" ", 1)) for c in self.schema.split(", ")]

    def _grouped(self) -> tuple[list[tuple], int]:
        """The rows with the number of their group behind, and how many groups there are."""
        at = [n for n, _ in self._names()].index(self.group) if self.group else None
        keys = list(dict.fromkeys(r[at] for r in self.rows)) if self.group else list(range(len(self.rows)))
        return [(*r, keys.index(r[at]) if self.group else i) for i, r in enumerate(self.rows)], len(keys)

    def over(self, spark: SparkSession, d: str) -> DataFrame:
        rows, n = self._grouped()
        parts = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS k", "p_name AS word", "p_size AS size", f"CAST(p_partkey % {n} AS INT) AS _g")
        both = parts.join(spark.createDataFrame(rows, self.schema + ", _g int"), "_g")
        return both.selectExpr(*[f"CAST({self.vary.get(c, f'`{c}`')} AS {kind}) AS `{c}`" for c, kind in self._names()])

    def over_sql(self) -> str:
        rows, n = self._grouped()
        columns = ", ".join(f'CAST({self.vary.get(c, chr(34) + c + chr(34))} AS {KINDS.get(kind, kind)}) AS "{c}"' for c, kind in self._names())
        return f"(SELECT {columns} FROM {self._values(rows, self.schema + ', _g int')} v JOIN (SELECT p_partkey AS k, p_name AS word, p_size AS size FROM part) p ON p.k % {n} = v._g)"

    def sql(self) -> str:
        return self._values(self.rows, self.schema)

    @staticmethod
    def _values(rows: list[tuple], schema: str) -> str:
        def literal(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).upper()
            if isinstance(v, date):
                return f"DATE '{v}'"
            if isinstance(v, (int, float, Decimal)):
                return str(v)
            return "'" + v.replace("'", "''") + "'"

        names = [c.strip().split(" ", 1) for c in schema.split(", ")]
        casts = ", ".join(f'CAST("{n}" AS {KINDS.get(k, k)}) AS "{n}"' for n, k in names)
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
        return f"(SELECT {casts} FROM (VALUES {values}) v({', '.join(f'"{n}"' for n, _ in names)}))"


KINDS = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}
ID = {"id": "k * 1000 + id"}
DOC = {"doc_id": "k * 1000 + doc_id"}
D = Decimal
AMOUNTS = Rows("raw string", [(x,) for x in (
    "16 600", "9000 тг", "14 400,00", "1 234 567", "16\u00a0600", "", None, "договорная", "0", "-500", "14.400,00", "5,000.50", "1.234.567", "1,23,45",
    "12.500", "100 200", "5000 тенге", "от 3 980 тг.", "12\t500", "₸ 700", "7,5", "7,555", "USD 99.90", "3",
)])
LABELS = Rows("label string", [(x,) for x in (
    "для резидентов", "для нерезидентов", "дальнее зарубежье", "страховые", "Стоимость", "Граждане РК", "Первичный", "повторный прием", "маркер", None, "", "Базовый тариф", "по страховке РК",
)], vary={"label": worded("label")})
PRICES = Rows("id long, name string, pos int, label string, raw string", [
    (1, "Прием", 0, "Резидент РК", "5000"), (1, "Прием", 1, "Нерезидент", "8000"),
    (2, "УЗИ", 0, "РК", "1000"), (2, "УЗИ", 1, "СНГ", "1500"), (2, "УЗИ", 2, "дальнее зарубежье", "2000"),
    (3, "Терапевт", 0, "первичный", "9000"), (3, "Терапевт", 1, "повторный", "6000"), (3, "Терапевт", 2, "Стоимость", "7000"),
    (4, "ЭКГ", 0, "Стоимость", "нет"), (5, "Анализ", 0, "нерезидент", "3000"), (6, "Массаж", 0, "Цена", "700"), (6, "Массаж", 1, "Тариф", "700"),
], group="id", vary=ID | {"name": worded("name")})
NAMES = Rows("raw string", [(x,) for x in (
    "  Общий   Анализ крови ", "ОАК", "Прием д.м.н. Иванова", "Ёлка", "УЗИ, почек (2)", "МРТ/КТ", "врач высшей категории", "", None, "к.м.н.", "Глюкоза_крови", "Naïve Café №5",
)], vary={"raw": worded("raw")})
PARTNERS = Rows("raw string", [(x,) for x in ('ТОО "Клиника Альфа"', "ИП Бета", "Медицинский центр «Гамма»", "МЦ Дельта-Плюс", "Тоолчи", "АО'Ё", "", None, "клиника 5", "Зао Зао")])
CODES = Rows("raw string", [(x,) for x in (" а02.004.000 ", "В02.110.002", "b03 328", "", None, "   ", "СТ-7", "K1")])
FILES = Rows("name string, head string, body string", [
    ("Клиника 5 прайс 12.03.2024.pdf", "25504446", None), ("прайс_2023.docx", "504B0304", None), ("a.XLSX", "504B0304", None), ("b.xls", "D0CF11E0", None),
    ("без расширения", "504B0304", "прейскурант на 2022 год"), ("старый", "D0CF11E0", "без года"), ("c.txt", "41424344", None), ("d.docx", "25504446", None),
    ("Прайс 31.02.2024.xlsx", "504B0304", None), ("клиника  12 new_1-2-2025.pdf", "25504446", None), (".pdf", "25504446", None),
], vary={"name": "CASE WHEN k % 2 = 1 THEN word || ' ' || name ELSE name END"})
VALIDATION = Rows("id long, name string, resident decimal(14,2), nonresident decimal(14,2), original decimal(14,2), effective date, currency string", [
    (1, "Прием", D("5000.00"), D("8000.00"), D("5000.00"), date(2024, 1, 1), "KZT"), (2, " ", D("1.00"), None, None, None, None), (3, "X", None, None, None, None, "KZT"),
    (4, "X", D("0.00"), D("-1.00"), None, None, "KZT"), (5, "X", D("10.00"), D("9.00"), None, date(2999, 1, 1), "USD"), (6, "X", None, None, D("7.00"), None, ""),
    (7, "X", D("9.00"), D("9.00"), None, date(2020, 2, 29), "RUB"), (8, None, None, None, None, None, None),
], vary=ID | {"name": worded("name"), "original": "original + size"})
ANSWERS = Rows("id long, answer string", [
    (1, '{"choice": 2, "confidence": 0.9, "reason": "same"}'), (2, 'Ответ: {"choice": 1} конец'), (3, "не знаю"), (4, '{"choice": '), (5, None), (6, '{"confidence": 0.4}'),
], vary=ID | {"answer": worded("answer")})
PAGES = Rows("id long, body string", [
    (1, "Наименование услуги и цена в тенге: консультация терапевта первичная 5000, анализ крови 1500"), (2, ""), (3, None), (4, "short"),
    (5, "Yliliepiia mepania npnem Bpaua mepaneBma 5000 KoHcy.nbmauua nepBuuHaa"), (6, "Кoнсультaция врачa тeрaпeвта пeрвичнaя пoвтoрнaя приeм oсмoтр лечение"),
    (7, "Прием врача терапевта первичный, прием врача повторный, осмотр на дому, выезд"),
])
CELLS = Rows("raw string", [(x,) for x in (
    "5000 тенге", "9 Выездная консультация врача", "5000 тг аппарат Тонзилор", "U1.7", "B03.328", "557.002.1", "16600", "1.7", "ЦИТОЛОГИЯ", "АЛАТ АСАТ ГГТ ЩФ",
    "Раздел 2. Анализы", "Приложение № 1 к договору от 01.01.2026", "2 канала", "9) Прием врача", "12. Снятие ЭКГ", "3D реконструкция", "ГОРМОНЫ КРОВИ", "(АМА-М2", "", "Иен 100", "  иена   x\t y ",
)], vary={"raw": worded("raw")})
TABLE = Rows("doc_id long, row int, text string, priced boolean", [
    (1, 0, "Прайс-лист", False), (1, 1, "Код Наименование услуги Цена", False), (1, 2, "ЛАБОРАТОРИЯ", False), (1, 3, "ОАК 1500", True), (1, 4, "ОАМ 900", True), (1, 5, "УЗИ", False), (1, 6, "Почки 5000", True),
    (2, 0, "Глюкоза 700", True), (2, 1, "", False), (2, 2, "Стоимость", False), (3, 0, "Код", False), (3, 1, "x 1", True),
], group="doc_id", vary=DOC | {"text": worded("text")})
SERIES = Rows("id long, pos int, v double", [(i, j, float(v)) for i, vs in enumerate(([1, 2, 3, 4], [9, 10, 1, 2, 3], [2, 2, 2], [100, 250, 90], [1, 2], [1, 2.5, 3], [5, 6, 7, 1, 2], [200000, 200001, 200002])) for j, v in enumerate(vs)], group="id", vary=ID | {"v": "v + k % 100"})
STATUS = Rows("items int, review int", [(0, 0), (3, 0), (3, 2), (None, 1), (-1, 0)], vary={"items": "items + k % 3"})
FX = Rows("amount decimal(14,2), currency string", [(D("100.00"), "USD"), (D("0.03"), "USD"), (D("55.50"), "RUB"), (D("7.00"), None), (None, "USD"), (D("1.01"), "KZT")], vary={"amount": "amount + size"})
SYNONYMS = Rows("name string, raw string", [("ОАК", "общий анализ; кровь ;;"), ("ЭКГ", ""), ("УЗИ", "ультразвук")], vary={"name": worded("name"), "raw": worded("raw")})
DECISIONS = Rows("action string, n int", [("confirm", 0), ("correct", 1), ("reject", 2)])
