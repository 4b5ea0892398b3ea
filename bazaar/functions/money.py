"""Prices in texts, and price buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaar.functions.text import ascii_digits

# Words of currencies in the order in which they are tried as prefixes; what follows a price.
CURRENCIES = {"sar": "SAR", "ريال": "SAR", "риал": "SAR", "риалов": "SAR", "риала": "SAR", "sr": "SAR", "﷼": "SAR", "usd": "USD", "$": "USD", "долл": "USD", "rub": "RUB", "руб": "RUB", "₽": "RUB", "eur": "EUR", "€": "EUR"}
PRICE = r"(?iuU)(\d[\d\s\x1c-\x1f.,]{0,12}\d|\d)[\s\x1c-\x1f]*(sar|sr|ريال|﷼|риал[\p{L}\p{N}_]*|руб[\p{L}\p{N}_]*|₽|\$|usd|долл[\p{L}\p{N}_]*|eur|€)"
STEP = 1.15


def parse_price(text: Column) -> Column:
    """struct<amount, currency> of the first price with a currency; null without one, or if it isn't a number over 0."""
    plain = ascii_digits(text)
    number = F.rtrim(F.translate(F.regexp_extract(plain, PRICE, 1), " ,", ""), F.lit("."))
    number = F.when(F.length(number) - F.length(F.translate(number, ".", "")) > 1, F.translate(number, ".", "")).otherwise(number)
    amount = F.when(number.rlike(r"^[0-9]*\.?[0-9]*$"), number.try_cast("double"))
    token = F.lower(F.regexp_extract(plain, PRICE, 2))
    code = F.lit("SAR")
    for word, name in reversed(CURRENCIES.items()):
        code = F.when(token.startswith(word), F.lit(name)).otherwise(code)
    return F.when(amount > 0, F.struct(amount.alias("amount"), code.alias("currency")))


def price_bucket(amount: Column) -> Column:
    """b and a third of the number of divisions by 1.15 until less is left; na for none. Divisions are done one by
    one, as doubles: a logarithm may differ at the edges."""
    most = F.ceil(F.log(F.greatest(amount, F.lit(1.0))) / F.log(F.lit(STEP))) + 2

    def step(s: Column, _: Column) -> Column:
        more = s["v"] >= STEP
        return F.struct(F.when(more, s["v"] / STEP).otherwise(s["v"]).alias("v"), F.when(more, s["n"] + 1).otherwise(s["n"]).alias("n"))

    n = F.aggregate(F.sequence(F.lit(1), most.cast("int")), F.struct(amount.alias("v"), F.lit(0).alias("n")), step, lambda s: s["n"])
    return F.when(amount > 0, F.concat(F.lit("b"), F.floor(n / 3).cast("string"))).otherwise("na")


def format_price(amount: Column, currency: Column, period: Column) -> Column:
    """A label such as 2 500 SAR / month; null without an amount."""
    number = F.translate(F.format_number(amount, 0), ",", " ")
    return F.when(amount != 0, F.concat_ws(" ", number, currency, F.when(period != "", F.concat(F.lit("/ "), period))))
