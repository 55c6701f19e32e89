"""Format-preserving pseudonyms: a keyed Feistel permutation of validated numbers and dates (and of addresses' names).

Found and replaced where they stand, in whole texts:
  card    13 to 19 digits, single spaces or hyphens between them allowed, that pass the Luhn check: all digits but the last
          are permuted and the check digit is computed anew, so a pseudonym passes it too. A longer row of digit groups (a card
          and its code or expiry) is tried at each of its group borders; a card in a usual grouping goes before any other cut
  phone   +c (ddd) ddd-dddd and the like; codes from 2 stay so, the country code and the punctuation stay
  ssn     ddd-dd-dddd
  ipv4    four numbers up to 255, permuted as four numbers up to 255
  date    yyyy-mm-dd or dd.mm.yyyy / mm/dd/yyyy of a real calendar day from 1900 to 2099, permuted among those days
  email   letters and digits of the local part, each within its class
  secret  hexadecimal values of 12 digits or more given to password, token, secret or api_key, in either case; where a value
          has upper-case letters, letters and digits stay within their class
The permutation depends on the key, the kind and the format only: an equal value has the same pseudonym in all documents, in
whichever punctuation; different values of a format have different pseudonyms.

A value is a vector of symbols with radices. Its even and odd places are the two halves; in each of ROUNDS rounds every
symbol of a half moves, modulo its radix, by bytes of a keyed SHA-512 of the round, the format and the other half: a Feistel
network for mixed radices, so a permutation. Dates walk the cycle until the number is a day's. Built-in functions only.

The key has no default: an operator's caller gives it, the query takes spark.isobar.pii.key. Where that is not set it draws a
random one, so that links hold within the application; set it to keep them from run to run.

Null texts stay null and empty ones empty. Numbers that fail validation stay as they are. Very long texts are read whole.
Repeated rows are treated alike. Extra columns are kept by the operator. An empty table gives an empty result.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import fresh, read_table

ROUNDS = 8
DAYS = 73_049  # 1900-01-01 to 2099-12-31
_B, _E = r"(?<![\w.-])", r"(?![\w-])"
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "secret": r"(?<=(?i:password|passwd|token|secret|api_key)\s?[=:]\s?[\"']?)[0-9a-fA-F]{12,}(?![\w])",
    "ipv4": r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\w]|\.\d)",
    "iso": _B + r"(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])" + _E,
    "dmy": _B + r"(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)\d\d" + _E,
    "mdy": _B + r"(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:19|20)\d\d" + _E,
    "phone": r"(?<![\w.-])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}" + _E,
    "ssn": _B + r"\d{3}-\d{2}-\d{4}" + _E,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Digit groups with single spaces or hyphens between them; possessive, so that rows of any length are read without recursion.
_BLOCK = r"\d++(?:-\d++)*+(?![\w-])"
DIGIT_ROW = rf"(?<![\w-]){_BLOCK}(?: {_BLOCK})*+"
USUAL_CARD = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})$"
_CLASSES = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel_sql(symbols: str, radices: str, kind: str, key: str, rounds: int = ROUNDS) -> str:
    """SQL of the permuted symbols (array<int>), both arguments SQL of array<int>."""
    other = f"concat_ws(':', {_sql(key)}, {_sql(kind)}, cast(r as string), array_join(w.q, ','), array_join(filter(v, (s, j) -> j % 2 = r % 2), ','))"
    move = f"cast(conv(substr(sha2(concat(o, cast(i div 32 as string)), 512), 1 + 4 * (i % 32), 4), 16, 10) as int)"
    other = f"transform(array({other}), o -> case when size(v) > 128 then sha2(o, 512) else o end)[0]"  # each symbol hashes it
    once = f"transform(array({other}), o -> transform(v, (s, i) -> case when i % 2 = r % 2 then s else (s + {move}) % w.q[i] end))[0]"
    return f"transform(array(struct({symbols} as v0, {radices} as q)), w -> aggregate(sequence(1, {rounds}), w.v0, (v, r) -> {once}))[0]"


def _digits(value: str) -> str:
    return f"transform(split(regexp_replace({value}, '[^0-9]', ''), ''), d -> cast(d as int))"


def _refill(template: str, digits: str) -> str:
    """The template with its digits replaced in order by the digits of a string."""
    place = f"length(regexp_replace(substr({template}, 1, i + 1), '[^0-9]', ''))"
    return f"array_join(transform(split({template}, ''), (c, i) -> case when c rlike '[0-9]' then substr({digits}, {place}, 1) else c end), '')"


def _luhn_total(digits: str, odd_from_right: int) -> str:
    """Luhn sum of a string of digits; places with (n - i) % 2 = odd_from_right are doubled (i from 0)."""
    return f"aggregate(transform(split({digits}, ''), (d, i) -> case when (length({digits}) - i) % 2 = {odd_from_right} then case when cast(d as int) > 4 then 2 * cast(d as int) - 9 else 2 * cast(d as int) end else cast(d as int) end), 0, (s, d) -> s + d)"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def cards_sql(text: str) -> str:
    """SQL of the distinct cards (array<string>, longest first) among the group borders of a text's digit rows.

    A usual grouping or an unbroken number that passes the Luhn check takes its groups; other cuts that pass it must not touch it.
    """
    bare = lambda value: f"regexp_replace({value}, '[^0-9]', '')"
    passes = lambda value: _let("z", bare(value), f"length(z) between 13 and 19 and {_luhn_total('z', 0)} % 10 = 0")  # noqa: E731  bound outside the sum's own names
    cut = lambda i, k: f"regexp_replace(array_join(slice(p, {i}, {k}), ''), '[ -]$', '')"
    usual = f"coalesce(array_max(filter(array(1, 3, 4), k -> i + k - 1 <= size(p) and {cut('i', 'k')} rlike {_sql(USUAL_CARD)} and {passes(cut('i', 'k'))})), 0)"
    touches = "exists(sequence(greatest(1, i - 3), i + k - 1), a -> u[a - 1] > 0 and a + u[a - 1] > i)"
    others = f"transform(filter(sequence(1, least(19, size(p) - i + 1)), k -> not {touches} and {passes(cut('i', 'k'))}), k -> {cut('i', 'k')})"
    of_row = f"flatten(transform(sequence(1, size(p)), i -> case when u[i - 1] > 0 then array({cut('i', 'u[i - 1]')}) else {others} end))"
    of_row = _let("p", f"split(x, {_sql('(?<=[ -])')}, -1)", _let("u", f"transform(sequence(1, size(p)), i -> {usual})", of_row))
    rows = f"filter(regexp_extract_all({text}, {_sql(DIGIT_ROW)}, 0), x -> length({bare('x')}) >= 13)"
    found = f"array_sort(array_distinct(flatten(transform({rows}, x -> {of_row}))), (a, b) -> length(b) - length(a))"
    return f"case when {text} rlike {_sql('[0-9](?:[ -]?[0-9]){12}')} then {found} else cast(array() as array<string>) end"


def pseudonym_sql(m: str, key: str) -> str:
    """SQL of struct(kind, replacement) for a found value; kind is null for values that fail validation."""
    whole = {k: _sql(f"^(?:{p})$") for k, p in PATTERNS.items()}
    ten = lambda value: f"transform({_digits(value)}, d -> 10)"
    plain = lambda kind, value: f"array_join({feistel_sql(_digits(value), ten(value), kind, key)}, '')"
    card = _let("d", f"regexp_replace({m}, '[^0-9]', '')", _let("p", plain("card", "substr(d, 1, length(d) - 1)"), _refill(m, f"concat(p, cast((10 - {_luhn_total('p', 1)} % 10) % 10 as string))")))
    # area and exchange codes start from 2, their first digits have eight values; a code from 0 or 1 keeps its class of two
    national = f"right(regexp_replace({m}, '[^0-9]', ''), 10)"
    low = "case when i in (0, 3) and x >= 2 then 2 else 0 end"
    room = "case when i not in (0, 3) then 10 when x < 2 then 2 else 8 end"
    moved = feistel_sql(f"transform(d, (x, i) -> x - {low})", f"transform(d, (x, i) -> {room})", "phone", key)
    before = f"substr(regexp_replace({m}, '[^0-9]', ''), 1, length(regexp_replace({m}, '[^0-9]', '')) - 10)"
    phone = _let("d", _digits(national), _let("f", moved, _let("p", f"array_join(transform(d, (x, i) -> f[i] + {low}), '')", _refill(m, f"concat({before}, p)"))))
    ssn = _refill(m, plain("ssn", m))
    octets = f"transform(split({m}, '[.]'), x -> cast(x as int))"
    ip = f"array_join({feistel_sql(octets, 'array(256, 256, 256, 256)', 'ipv4', key)}, '.')"
    once = lambda n: f"{_let('f', feistel_sql(f'array(cast({n} div 271 as int), cast({n} % 271 as int))', 'array(270, 271)', 'date', key), 'f[0] * 271 + f[1]')}"
    walk = lambda day: f"aggregate(sequence(1, 16), {once(day)}, (a, r) -> case when a < {DAYS} then a else {once('a')} end)"
    date = lambda fmt: f"date_format(date_add(date'1900-01-01', cast({walk(f"datediff(to_date({m}, '{fmt}'), date'1900-01-01')")} as int)), '{fmt}')"
    valid = lambda fmt: f"try_to_date({m}, '{fmt}') is not null"
    local = f"substring_index({m}, '@', 1)"
    index = f"transform(filter(split({local}, ''), c -> c rlike '[A-Za-z0-9]'), c -> locate(c, '{_CLASSES}') - 1)"
    shift = "case when x < 10 then 0 when x < 36 then 10 else 36 end"
    radix = "case when x < 10 then 10 else 26 end"
    email = _let("s", index, _let("f", feistel_sql(f"transform(s, x -> x - {shift})", f"transform(s, x -> {radix})", "email", key), _let("t", f"array_join(transform(f, (y, i) -> substr('{_CLASSES}', 1 + y + transform(s, x -> {shift})[i], 1)), '')",
        f"concat(array_join(transform(split({local}, ''), (c, i) -> case when c rlike '[A-Za-z0-9]' then substr(t, length(regexp_replace(substr({local}, 1, i + 1), '[^A-Za-z0-9]', '')), 1) else c end), ''), '@', substring_index({m}, '@', -1))")))
    secret = f"array_join(transform({feistel_sql(f"transform(split({m}, ''), c -> locate(c, '{_CLASSES}') - 1)", f"transform(split({m}, ''), c -> 16)", 'secret', key)}, x -> substr('{_CLASSES}', x + 1, 1)), '')"
    start = "case when c rlike '[0-9]' then 0 when c rlike '[a-f]' then 10 else 36 end"
    cased = _let("s", f"split({m}, '')", _let("f", feistel_sql(f"transform(s, c -> locate(c, '{_CLASSES}') - 1 - {start})", "transform(s, c -> case when c rlike '[0-9]' then 10 else 6 end)", "secret", key), f"array_join(transform(s, (c, i) -> substr('{_CLASSES}', 1 + f[i] + {start}, 1)), '')"))
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    as_pair = lambda kind, value: f"struct('{kind}' as kind, {value} as value)"
    return f"""case
        when {m} like '%@%' then {as_pair("email", email)}
        when {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {as_pair("ipv4", ip)}
        when {m} rlike {whole["iso"]} and {valid("yyyy-MM-dd")} then {as_pair("date", date("yyyy-MM-dd"))}
        when {m} rlike {whole["dmy"]} and {valid("dd.MM.yyyy")} then {as_pair("date", date("dd.MM.yyyy"))}
        when {m} rlike {whole["mdy"]} and {valid("MM/dd/yyyy")} then {as_pair("date", date("MM/dd/yyyy"))}
        when {m} rlike {whole["phone"]} then {as_pair("phone", phone)}
        when {m} rlike {whole["ssn"]} then {as_pair("ssn", ssn)}
        when {m} rlike '^[0-9]([ -]?[0-9]){{12,18}}$' and {_luhn_total(digits, 0)} % 10 = 0 then {as_pair("card", card)}
        when {m} rlike '^[0-9a-f]{{12,}}$' then {as_pair("secret", secret)}
        when {m} rlike '^[0-9a-fA-F]{{12,}}$' then {as_pair("secret", cased)}
        else struct(cast(null as string) as kind, {m} as value) end"""


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "_pii") -> DataFrame:
    """All columns of docs with the text pseudonymised, and `found`: array of struct(kind, value), the pseudonyms in order."""
    if found in docs.columns:
        raise ValueError(f"docs has a column {found}")
    body, cards, pattern, values, made = fresh(docs, "_text", "_cards", "_pattern", "_found", "_made")
    every = f"case when size({cards}) = 0 then {_sql(ANY)} else concat({_sql(ANY + r'|(?<!\w)(?:')}, array_join({cards}, '|'), {_sql(r')(?!\w)')}) end"
    hits = f"case when {body} rlike '[0-9@]|[Pp][Aa][Ss][Ss][Ww]|[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Aa][Pp][Ii]_' then regexp_extract_all({body}, {pattern}, 0) else array() end"
    rows = docs.withColumn(body, F.col(text)).withColumn(cards, F.expr(cards_sql(body))).withColumn(pattern, F.expr(every))
    rows = rows.withColumn(values, F.coalesce(F.expr(hits), F.expr("cast(array() as array<string>)")))
    rows = rows.withColumn(made, F.expr(f"transform({values}, m -> {pseudonym_sql('m', key)})"))
    parts = f"split({body}, {pattern}, -1)"
    rebuilt = F.expr(f"case when size({values}) = 0 then {body} else concat_ws('', transform({parts}, (p, i) -> concat(p, coalesce(get({made}, i).value, '')))) end")
    return rows.withColumn(text, rebuilt).withColumn(found, F.expr(f"filter({made}, x -> x.kind is not null)")).drop(body, cards, pattern, values, made)


_KEYS: dict[str, str] = {}


def session_key(spark) -> str:
    """spark.isobar.pii.key, or a random key of this application: values are then linked within it, and nobody can undo them."""
    return spark.conf.get("spark.isobar.pii.key", None) or _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def op9_pseudonyms(spark, sf_dir: str) -> DataFrame:
    out = pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return out.select("doc_id", F.size("_pii").cast("long").alias("n_pii"), F.col("_pii.kind").alias("kinds"), F.col("_pii.value").alias("pseudonyms"), "text")
