"""Text normalisation, codes and text quality as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the contract: abbreviations and what they stand for.
ABBREVIATIONS = {
    "оак": "общий анализ крови",
    "оам": "общий анализ мочи",
    "бак": "биохимический анализ крови",
    "экг": "электрокардиография",
    "ээг": "электроэнцефалография",
    "узи": "ультразвуковое исследование",
    "кт": "компьютерная томография",
    "мрт": "магнитно резонансная томография",
    "д.м.н.": "доктор медицинских наук",
    "дмн": "доктор медицинских наук",
    "к.м.н.": "кандидат медицинских наук",
    "кмн": "кандидат медицинских наук",
    "врач высшей категории": "врач высшей категории",
}
# Words of legal forms that a partner's name loses.
LEGAL_FORMS = ("тоо", "ип", "ао", "оао", "зао", "клиника", "медицинский центр", "мц", "гкп")
# Cyrillic letters that look like Latin ones, and those.
HOMOGLYPHS = ("АВЕКМНОРСТУХ", "ABEKMHOPCTYX")
# Words that show a readable price list.
QUALITY_ANCHORS = (
    "наименование", "услуга", "услуги", "цена", "стоимость", "код", "прайс", "прейскурант", "консультация",
    "анализ", "приём", "прием", "исследование", "тенге", "тг", "категория", "раздел",
)
# Units that a leading number counts.
QUANTITY_UNITS = ("канал", "зон", "сеанс", "фракц", "проекц", "сустав", "сегмент", "поле", "точк", "зуб", "ед.", "шт", "штук")

SPACES = r"[\s\x{00A0}]+"
NOT_WORD = r"[^\p{L}\p{N}_\s\x{00A0}]"


def squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, SPACES, " "))


def normalize(text: Column) -> Column:
    """Lower case, е for ё, no punctuation, single blanks, abbreviations spelt out; '' for null."""
    s = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е"))
    for short, full in ABBREVIATIONS.items():
        if "." in short:
            s = F.replace(s, F.lit(short), F.lit(f" {full} "))
    words = F.split(squeezed(F.regexp_replace(s, NOT_WORD, " ")), " ")
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(known[w], w)), " ")


def tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(normalize(text), " "), lambda w: w != "")))


def normalize_name(text: Column) -> Column:
    """A partner's name without quotes, legal forms and punctuation."""
    s = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е"))
    s = F.regexp_replace(s, "[\"«»'`]", " ")
    s = F.regexp_replace(s, rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(LEGAL_FORMS)})(?![\p{{L}}\p{{N}}_])", " ")
    return squeezed(F.regexp_replace(s, NOT_WORD, " "))


def normalize_code(code: Column) -> Column:
    upper = F.replace(F.upper(F.trim(code)), F.lit(" "), F.lit(""))
    return F.nullif(F.translate(upper, *HOMOGLYPHS), F.lit(""))


def text_quality(text: Column) -> Column:
    """char_count, cyrillic_ratio, contamination, anchor_hits, is_corrupt of a page's text."""
    s = F.coalesce(text, F.lit(""))
    cyr, lat = F.regexp_count(s, F.lit("[а-яёА-ЯЁ]")), F.regexp_count(s, F.lit("[a-zA-Z]"))
    ratio = F.coalesce(F.try_divide(cyr.cast("double"), cyr + lat), F.lit(0.0))
    # runs of two letters or more, and of those the ones with both alphabets; a run is matched from its start
    with_cyr = F.regexp_count(s, F.lit("(?=[А-Яа-яЁёA-Za-z]{2})[A-Za-z]*+[А-Яа-яЁё][А-Яа-яЁёA-Za-z]*+"))
    mixed = F.regexp_count(s, F.lit("(?:[A-Za-z]++[А-Яа-яЁё]|[А-Яа-яЁё]++[A-Za-z])[А-Яа-яЁёA-Za-z]*+"))
    dirt = F.when(cyr == 0, 0.0).otherwise(F.coalesce(F.try_divide(mixed.cast("double"), with_cyr), F.lit(0.0)))
    low = F.lower(s)
    hits = sum((F.contains(low, F.lit(a)).cast("int") for a in QUALITY_ANCHORS), F.lit(0))
    stripped = F.regexp_replace(s, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")
    corrupt = (F.length(stripped) < 40) | ((ratio < 0.45) & (hits < 2)) | ((dirt > 0.18) & (hits < 3))
    return F.struct(
        F.length(s).alias("char_count"), ratio.alias("cyrillic_ratio"), dirt.alias("contamination"), hits.alias("anchor_hits"), corrupt.alias("is_corrupt")
    )


def partner_from_filename(name: Column) -> Column:
    """'Клиника N' of a file's name, first letter upper and the rest lower; else the name without its extension."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    found = F.regexp_extract(base, r"(?iu)(клиника\s*\d+)", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.when(found != "", F.concat(F.upper(F.substring(found, 1, 1)), F.lower(F.substring(found, 2, 1000)))).otherwise(stem)


def ocr_postprocess(text: Column) -> Column:
    s = F.replace(F.replace(text, F.lit("иен"), F.lit("цен")), F.lit("Иен"), F.lit("Цен"))
    return F.trim(F.regexp_replace(s, "[ \t]+", " "))


def embedding_text(name: Column, synonyms: Column) -> Column:
    return F.trim(F.concat_ws(" ", name, F.array_join(synonyms, " ")))


def split_synonyms(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";"), lambda w: F.trim(w)), lambda w: w != "")


def strip_enumeration(name: Column) -> Column:
    """A name without its leading row number, unless the number counts a unit."""
    rest = F.regexp_extract(name, r"^\s*[0-9]{1,3}[.)]?\s+([^0-9].*)$", 1)
    units = "|".join(u.replace(".", r"\.") for u in QUANTITY_UNITS)
    return F.when((rest == "") | F.lower(rest).rlike(rf"^\s*({units})"), name).otherwise(F.trim(rest))


def cache_key(kind: str, model: str, query: Column, docs: Column | None = None) -> Column:
    """SHA-256 key of a provider's answer; candidates are joined by two pipes."""
    text = F.concat(F.lit(f"{kind}:{model}:"), query)
    return F.sha2(text if docs is None else F.concat(text, F.lit("::"), F.array_join(docs, "||")), 256)


def verdict(answer: Column) -> Column:
    """choice, confidence, reason of an arbiter's answer: its first { to its last }; choice 0 if that isn't JSON."""
    found = F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit("")))
    return F.struct(
        F.coalesce(F.try_variant_get(found, "$.choice", "int"), F.lit(0)).alias("choice"),
        F.coalesce(F.try_variant_get(found, "$.confidence", "double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.try_variant_get(found, "$.reason", "string"), F.lit("")).alias("reason"),
    )
