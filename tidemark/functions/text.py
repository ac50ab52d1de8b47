"""Cleaning of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of valid fields and the names of currencies.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?[\d\s\-\(\)]{10,}$"
CURRENCIES = {
    "usd": "USD", "dollar": "USD", "$": "USD",
    "eur": "EUR", "euro": "EUR", "€": "EUR",
    "brl": "BRL", "real": "BRL", "r$": "BRL",
    "gbp": "GBP", "pound": "GBP", "£": "GBP",
}


def standardize(c: Column) -> Column:
    """Trimmed, without marks other than @ . -, each white-space run one blank. Null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s@.-]", ""), r"(?U)\s+", " "))


def category(c: Column) -> Column:
    return F.replace(F.lower(standardize(c)), F.lit(" "), F.lit("_"))


def email(c: Column) -> Column:
    return F.lower(standardize(c))


def phone(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d+]", "")


def currency(c: Column) -> Column:
    """Code of a currency's name or sign; other values in upper case."""
    names = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    trimmed = F.trim(c)
    return F.coalesce(names[F.lower(trimmed)], F.upper(trimmed))


def valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL), F.lit(False))


def valid_phone(c: Column) -> Column:
    return F.coalesce(c.rlike(PHONE), F.lit(False))
