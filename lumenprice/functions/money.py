"""Amounts, tariffs, currency and validation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the contract: words of tariff labels, tested in the order nonresident, insurance, resident.
NONRESIDENT = ("нерезидент", "не резидент", "иностран", "без гражданства", "дальнее зарубежье", "дальн", "повторный", "повторная")
INSURANCE = ("страхов", "по страховке")
RESIDENT = ("резидент", "граждан рк", "граждане рк", "для граждан рк", "рк", "первичный", "первичная", "базов", "основн")
# Currency words, the rate and the threshold of a price jump.
CURRENCY = r"(тг|тенге|kzt|₸|руб|rub|\$|usd)"
USD_RATE = "475.0"
JUMP = 0.5

AMOUNT = "decimal(18,5)"
PRICE = "decimal(14,2)"


def parse_amount(raw: Column) -> Column:
    """The first number of a text as a positive decimal, else null.

    Currency words go first. With both marks the dot groups and the comma is decimal; a lone comma is
    decimal before one or two last digits; several dots group. Blanks and no-break blanks are dropped,
    other white space within the number makes it null.
    """
    s = F.regexp_replace(raw, rf"(?iu){CURRENCY}\.?", " ")
    found = F.translate(F.regexp_extract(s, r"[0-9][0-9\s\x{00A0}\x{202F}.,]*[0-9]|[0-9]", 0), " \u00a0", "")

    def plain(m: Column) -> Column:
        comma, dot = F.contains(m, F.lit(",")), F.contains(m, F.lit("."))
        grouped = F.replace(F.replace(m, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return F.when(~comma, m).when(dot, grouped).when(m.rlike(",[0-9]{1,2}$"), F.replace(m, F.lit(","), F.lit("."))).otherwise(F.replace(m, F.lit(","), F.lit("")))

    def number(m: Column) -> Column:
        one = F.when(F.regexp_count(m, F.lit(r"\.")) > 1, F.replace(m, F.lit("."), F.lit(""))).otherwise(m)
        value = F.when(one.rlike(r"^[0-9]+(\.[0-9]*)?$"), one).try_cast(AMOUNT)
        return F.when(value > 0, value)

    return let(found, lambda m: let(plain(m), number))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def classify_label(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))

    def has(words: tuple[str, ...]) -> Column:
        return low.rlike("|".join(words))

    return F.when(has(NONRESIDENT), "nonresident").when(has(INSURANCE), "insurance").when(has(RESIDENT), "resident").otherwise("other")


def apply_tariffs(prices: Column) -> Column:
    """resident, nonresident, original and raw_label of prices, an array of (label, amount) in column order."""
    known = F.filter(prices, lambda p: p["amount"].isNotNull())
    of = lambda kind: F.filter(known, lambda p: classify_label(p["label"]) == kind)
    first = lambda a: F.get(a, F.lit(0))["amount"]
    resident = F.coalesce(first(of("resident")), first(known))
    others = F.filter(known, lambda p: p["amount"] != resident)
    nonresident = F.coalesce(first(of("nonresident")), F.when(F.size(known) > 1, F.array_max(F.transform(others, lambda p: p["amount"]))))
    label = F.when(F.size(known) > 0, F.array_join(F.transform(known, lambda p: F.concat(p["label"], F.lit(": "), p["amount"].cast("string"))), " | "))
    return F.struct(resident.alias("resident"), nonresident.alias("nonresident"), resident.alias("original"), label.alias("raw_label"))


def expand_primary_repeat(name: Column, prices: Column) -> Column:
    """One (name, prices), or two where the labels have a first and a repeated visit; other prices are then dropped."""
    of = lambda word: F.filter(prices, lambda p: F.contains(F.lower(p["label"]), F.lit(word)))
    first, again = of("первичн"), of("повторн")
    row = lambda n, p: F.struct(n.alias("name"), p.alias("prices"))
    two = F.array(row(F.concat(name, F.lit(" (первичный приём)")), first), row(F.concat(name, F.lit(" (повторный приём)")), again))
    return F.when((F.size(first) > 0) & (F.size(again) > 0), two).otherwise(F.array(row(name, prices)))


def convert_to_kzt(amount: Column, currency: Column) -> Column:
    """US dollars at the fixed rate, half to even; all else as it is."""
    return F.when(currency == "USD", F.bround(amount * F.lit(USD_RATE).cast("decimal(6,1)"), 2).cast(PRICE)).otherwise(amount.cast(PRICE))


def pct_change(old: Column, new: Column) -> Column:
    """|new - old| / old; null where that isn't known."""
    return F.try_divide(F.abs(new - old).cast("double"), old.cast("double"))


def price_of(resident: Column, nonresident: Column, original: Column) -> Column:
    return F.coalesce(resident, nonresident, original)


def history_price(resident: Column, nonresident: Column) -> Column:
    """The resident price unless it is zero or null, then the other."""
    return F.coalesce(F.when(resident != 0, resident), nonresident)


def validation(name: Column, resident: Column, nonresident: Column, original: Column, effective: Column, currency: Column, today: Column) -> Column:
    """ok, needs_review and messages of a row; a blank name ends the checks."""
    bad = lambda p: F.when(p <= 0, F.concat(F.lit("Цена не положительное число: "), p.cast("string")))
    checks = F.array_compact(
        F.array(
            F.when(resident.isNull() & nonresident.isNull() & original.isNull(), F.lit("Не распознана цена")),
            bad(resident), bad(nonresident), bad(original),
            F.when((resident > 0) & (nonresident > 0) & (nonresident < resident), F.lit("Цена нерезидента меньше цены резидента")),
            F.when(effective > today, F.concat(F.lit("Дата прайса в будущем: "), effective.cast("string"))),
            F.when((currency != "") & (currency != "KZT"), F.concat(F.lit("Валюта "), currency, F.lit(": конвертация по курсу"))),
        )
    )
    named = F.trim(F.coalesce(name, F.lit(""))) != ""
    messages = F.when(named, checks).otherwise(F.array(F.lit("Пустое название услуги, строка пропущена")))
    return F.struct(named.alias("ok"), (named & (F.size(checks) > 0)).alias("needs_review"), messages.alias("messages"))


def document_status(items: Column, review: Column) -> Column:
    return F.when(F.coalesce(items, F.lit(0)) <= 0, "error").when(review > 0, "needs_review").otherwise("done")
