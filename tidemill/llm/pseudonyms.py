"""Format-preserving pseudonyms for numbers and dates, by a keyed Feistel network in SQL expressions only.

Found in a text, validated, permuted within their format and put back in the same layout (separators stay):

- payment cards: 13 to 19 digits with a right Luhn digit; the digits before it are permuted, it is computed anew
- phone numbers: 7 to 15 digits after + or with an area code in brackets or dashes; the country code stays
- dates of the years 1800 to 2199 (y-m-d, y/m/d, d.m.y, d/m/y; slashes with the day first): permuted in those 400 years;
  m/d/y where the day is over 12, so that only that reading is valid: permuted among such dates (the days up to the 28th,
  the later ones, and 29 February each among themselves)
- US social security numbers with an allocated area, group and serial: permuted within the allocated ones
- IPv4 addresses: the four bytes are permuted
- IBANs with right check digits: the account part is permuted (digits to digits, letters to letters), the check digits
  are computed anew
- e-mail addresses: letters and digits of the local part are permuted within their kind; the domain stays

What fails its validation stays as it is. The permutation depends on the key, the kind and the number of symbols only,
so equal values have equal pseudonyms in all documents, whatever their layout, and different values different ones.

The network: symbols s[i] with radix r[i] are cut into two halves; in each of ROUNDS rounds one half is added, modulo
the radices, to numbers taken from SHA-512 of key, kind, round and the other half. That is a bijection for any radices.

Not recognised: written months, two-digit years and one-digit days, IPv6, phone numbers without a plus, brackets or
dashes. The numbers of a phone are counted, not looked up, and a card's issuer digits are permuted like the rest.

Null texts stay null, empty ones empty. Every row is handled on its own: no shuffle, no groups, so very long texts,
repeated rows, ties and empty tables need nothing of their own. Other columns stay, whatever their names; n_chars, if there, becomes
the new text's length. A date with the month first and one with the year first get pseudonyms of their own, though they
name one day.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./])[0-9]{2}\2[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])"
PHONE = r"(?<![0-9])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9][0-9]{0,2}[ -]?\(?[0-9]{1,4}\)?(?:[ -]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9]|[.-][0-9])"
CARD = r"(?<![0-9+])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2,3}(?: [0-9]{1,3})?|[0-9]{4}(?:-[0-9]{4}){2,3}(?:-[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IBAN, IPV4, DATE, SSN, PHONE, CARD))


def _let(value: str, name: str, body: str) -> str:
    """SQL for `body` with `name` standing for the value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _permuted(symbols: str, radices: str, kind: str, key: str) -> str:
    """SQL of array<int>: the keyed permutation of the symbols."""
    other = "array_join(if(k % 2 = 0, slice(acc, h + 1, size(acc) - h), slice(acc, 1, h)), ',')"
    digest = f"sha2(concat({_quoted(key)}, '|{kind}|', size(acc), '|', k, '|', {other}), 512)"
    number = "cast(conv(substr(d, pmod(if(i < h, i, i - h), 32) * 4 + 1, 4), 16, 10) as int)"
    step = f"transform(acc, (s, i) -> if((i < h) = (k % 2 = 0), pmod(s + {number}, rad[i]), s))"
    rounds = f"aggregate(sequence(0, {ROUNDS - 1}), sym, (acc, k) -> {_let(digest, 'd', step)})"
    return _let(symbols, "sym", _let(radices, "rad", _let("cast(size(sym) div 2 as int)", "h", rounds)))


def _ints(digits: str) -> str:
    return f"transform(filter(split({digits}, ''), c -> c <> ''), c -> cast(c as int))"


def _tens(digits: str) -> str:
    return f"array_repeat(10, length({digits}))"


def _laid_out(original: str, digits: str) -> str:
    """The digits put where the original has digits."""
    here = f"substr({original}, p, 1)"
    return f"array_join(transform(sequence(1, length({original})), p -> if({here} rlike '[0-9]', substr({digits}, length({_digits(f'substr({original}, 1, p)')}), 1), {here})), '')"


def _luhn(payload: str) -> str:
    """The check digit of a string of digits."""
    doubled = "if((length(pl) - q) % 2 = 0, v * 2 - if(v > 4, 9, 0), v)"
    total = f"aggregate(sequence(1, length(pl)), 0, (a, q) -> a + {_let('cast(substr(pl, q, 1) as int)', 'v', doubled)})"
    return _let(payload, "pl", f"cast((10 - {total} % 10) % 10 as string)")


def _card(m: str, key: str) -> str:
    permuted = _let(f"array_join({_permuted(_ints('pay'), _tens('pay'), 'card', key)}, '')", "np", _laid_out(m, f"concat(np, {_luhn('np')})"))
    return _let(_digits(m), "dg", _let("substr(dg, 1, length(dg) - 1)", "pay", f"if({_luhn('pay')} = right(dg, 1), {permuted}, {m})"))


def _phone(m: str, key: str) -> str:
    code = f"length(regexp_extract({m}, '^[+](1|[2-9][0-9])', 1))"
    permuted = _laid_out(m, f"concat(substr(dg, 1, cc), array_join({_permuted(_ints('own'), _tens('own'), 'phone', key)}, ''))")
    return _let(_digits(m), "dg", _let(code, "cc", _let("substr(dg, cc + 1)", "own", f"if(length(dg) between 7 and 15 and length(own) > 1, {permuted}, {m})")))


def _date(m: str, key: str) -> str:
    iso = f"if({m} rlike '^[0-9]{{4}}', concat_ws('-', substr({m}, 1, 4), substr({m}, 6, 2), substr({m}, 9, 2)), concat_ws('-', substr({m}, 7, 4), substr({m}, 4, 2), substr({m}, 1, 2)))"
    new = f"date_add(date'1800-01-01', nw[0] * 5411 + nw[1])"
    format_ = f"if({m} rlike '^[0-9]{{4}}', concat('yyyy', substr({m}, 5, 1), 'MM', substr({m}, 5, 1), 'dd'), concat('dd', substr({m}, 3, 1), 'MM', substr({m}, 3, 1), 'yyyy'))"
    permuted = _let(_permuted("array(cast(dy div 5411 as int), dy % 5411)", "array(27, 5411)", "date", key), "nw", f"date_format({new}, {format_})")
    return _let(f"datediff(cast(try_to_timestamp({iso}, 'yyyy-MM-dd') as date), date'1800-01-01')", "dy", f"if(dy between 0 and 146096, {permuted}, {_month_first(m, key)})")


def _month_first(m: str, key: str) -> str:
    """m/d/y with a day over 12: months and days of dates that are never valid the other way round."""
    year, month, day = (f"cast(substr({m}, {a}, {n}) as int)" for a, n in ((7, 4), (1, 2), (4, 2)))
    later = "filter(flatten(transform(array(29, 30, 31), d -> transform(sequence(1, 12), q -> q * 100 + d))), v -> v <> 229 and v <> 230 and (v % 100 < 31 or array_contains(array(1, 3, 5, 7, 8, 10, 12), v div 100)))"
    leap = "filter(sequence(1800, 2199), y -> y % 4 = 0 and (y % 100 <> 0 or y % 400 = 0))"
    shown = lambda v, y: f"concat(lpad(cast({v} div 100 as string), 2, '0'), '/', lpad(cast({v} % 100 as string), 2, '0'), '/', cast({y} as string))"
    early = _let(_permuted(f"array({year} - 1800, {month} - 1, {day} - 13)", "array(400, 12, 16)", "month-first", key), "nw", shown("((nw[1] + 1) * 100 + nw[2] + 13)", "nw[0] + 1800"))
    at = f"cast(array_position(lt, {month} * 100 + {day}) as int) - 1"
    late = _let(later, "lt", f"if({at} >= 0, {_let(_permuted(f'array({year} - 1800, {at})', 'array(400, 29)', 'month-first-late', key), 'nw', shown('lt[nw[1]]', 'nw[0] + 1800'))}, {m})")
    # 97 leap days as two digits: what leaves them is permuted again until it is back, after four times at most
    again = _let(_permuted("array(lv div 10, lv % 10)", "array(10, 10)", "month-first-leap", key), "nw", "cast(nw[0] * 10 + nw[1] as int)")
    walked = f"aggregate(sequence(1, 4), cast(array_position(lp, {year}) as int) - 1, (lv, lk) -> if(lk = 1 or lv > 96, {again}, lv))"
    leaps = _let(leap, "lp", f"if(array_contains(lp, {year}), {_let(walked, 'lw', shown('229', 'lp[lw]'))}, {m})")
    valid = f"{m} rlike '^(?:0[1-9]|1[0-2])/(?:1[3-9]|2[0-9]|3[01])/(?:1[89]|2[01])[0-9]{{2}}$'"
    return f"case when not ({valid}) then {m} when {day} <= 28 then {early} when {month} * 100 + {day} = 229 then {leaps} else {late} end"


def _ssn(m: str, key: str) -> str:
    parts = [f"cast(substr({m}, {a}, {n}) as int)" for a, n in ((1, 3), (5, 2), (8, 4))]
    valid = f"{parts[0]} between 1 and 899 and {parts[0]} <> 666 and {parts[1]} > 0 and {parts[2]} > 0"
    symbols = f"array({parts[0]} - if({parts[0]} > 666, 2, 1), {parts[1]} - 1, {parts[2]} - 1)"
    shown = "concat(lpad(cast(nw[0] + if(nw[0] >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast(nw[1] + 1 as string), 2, '0'), '-', lpad(cast(nw[2] + 1 as string), 4, '0'))"
    return f"if({valid}, {_let(_permuted(symbols, 'array(898, 99, 9999)', 'ssn', key), 'nw', shown)}, {m})"


def _ipv4(m: str, key: str) -> str:
    valid = f"forall(split({m}, '[.]'), o -> cast(o as int) < 256 and (o = '0' or o not like '0%'))"
    symbols = f"transform(split({m}, '[.]'), o -> cast(o as int))"
    return f"if({valid}, array_join({_permuted(symbols, 'array(256, 256, 256, 256)', 'ipv4', key)}, '.'), {m})"


def _mod97(text: str) -> str:
    """Of letters (A = 10, ...) and digits read as one number."""
    return f"aggregate(filter(split({text}, ''), c -> c <> ''), 0, (a, c) -> if(c rlike '[0-9]', (a * 10 + cast(c as int)) % 97, (a * 100 + ascii(c) - 55) % 97))"


def _symbols(text: str) -> str:
    return f"transform(filter(split({text}, ''), c -> c <> ''), c -> ascii(c) - if(c rlike '[0-9]', 48, if(c rlike '[A-Z]', 65, 97)))"


def _radices(text: str) -> str:
    return f"transform(filter(split({text}, ''), c -> c <> ''), c -> if(c rlike '[0-9]', 10, 26))"


def _spelled(like: str, symbols: str) -> str:
    """Symbols as characters of the same kinds as those of `like`."""
    return f"array_join(transform(sequence(1, length({like})), p -> chr({symbols}[p - 1] + if(substr({like}, p, 1) rlike '[0-9]', 48, if(substr({like}, p, 1) rlike '[A-Z]', 65, 97)))), '')"


def _iban(m: str, key: str) -> str:
    account = _let("substr(cl, 5)", "ac", _let(_permuted(_symbols("ac"), _radices("ac"), "iban", key), "nw", _spelled("ac", "nw")))
    with_check = _let(account, "na", f"concat(substr(cl, 1, 2), lpad(cast(98 - {_mod97('concat(na, substr(cl, 1, 2), chr(48), chr(48))')} as string), 2, '0'), na)")
    spaced = f"array_join(transform(sequence(1, length({m})), p -> if(substr({m}, p, 1) = ' ', ' ', substr(ni, length(replace(substr({m}, 1, p), ' ', '')), 1))), '')"
    return _let(f"replace({m}, ' ', '')", "cl", f"if({_mod97('concat(substr(cl, 5), substr(cl, 1, 4))')} = 1, {_let(with_check, 'ni', spaced)}, {m})")


def _email(m: str, key: str) -> str:
    local = f"substring_index({m}, '@', 1)"
    plain = "regexp_replace(lc, '[^A-Za-z0-9]', '')"
    spelled = _let(_permuted(_symbols("pn"), _radices("pn"), "email", key), "nw", _spelled("pn", "nw"))
    inserted = "array_join(transform(sequence(1, length(lc)), p -> if(substr(lc, p, 1) rlike '[A-Za-z0-9]', substr(ns, length(regexp_replace(substr(lc, 1, p), '[^A-Za-z0-9]', '')), 1), substr(lc, p, 1))), '')"
    return _let(local, "lc", _let(plain, "pn", _let(spelled, "ns", f"concat({inserted}, '@', substring_index({m}, '@', -1))")))


def _replacement(m: str, key: str) -> str:
    kinds = [(EMAIL, _email), (IBAN, _iban), (IPV4, _ipv4), (DATE, _date), (SSN, _ssn), (PHONE, _phone), (CARD, _card)]
    whens = " ".join(f"when {m} rlike {_quoted('^(?:' + p + ')$')} then {f(m, key)}" for p, f in kinds)
    return f"case {whens} else {m} end"


def pseudonymised(text: str, key: str) -> Column:
    """The text column with pseudonyms in place of what it names."""
    found = f"regexp_extract_all({text}, {_quoted(ANY)}, 0)"
    joined = f"array_join(zip_with(split({text}, {_quoted(ANY)}, -1), transform({found}, m -> {_replacement('m', key)}), (a, b) -> concat(a, coalesce(b, ''))), '')"
    return F.expr(f"case when {text} rlike '[0-9@]' then {joined} else {text} end")


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with the column replaced; if there is a column n_chars, it is the new text's length."""
    out = docs.withColumn(column, pseudonymised(f"`{column}`", key))
    return out.withColumn("n_chars", F.length(column).cast("long")) if "n_chars" in docs.columns and column == "text" else out


#: For tests and trials only: what is pseudonymised with it can be undone by anyone.
DEMO_KEY = "replace this key"


def session_key(spark) -> str:
    """The key set as spark.tidemill.pseudonymKey; DEMO_KEY, with a warning, where none is."""
    key = spark.conf.get("spark.tidemill.pseudonymKey", None)
    if not key:
        warnings.warn("spark.tidemill.pseudonymKey is not set: pseudonyms are made with the public key", stacklevel=2)
    return key or DEMO_KEY


def op2(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), session_key(spark))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymise(docs, session_key(spark))
